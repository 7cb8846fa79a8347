import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .helpers import clash, docs, words
from .test_decontamination import exhaustive
from .test_near_duplicates import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, sf):
    """The small tables, with rows that each stage must act on."""
    path = tmp_path_factory.mktemp("tables")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(0)
    item = words(rng, 40, 5_000)
    first = table.orderBy("doc_id").first()["text"]
    extra = [None, "", "### 12 34", first, first + " tail", "The " + item + " end", "Write to a.b@c.org now, please, dear reader of these plain words"]
    table.union(docs(spark, extra, 90_000).select(*table.columns)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").union(spark.createDataFrame([(900, item)], "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs_ = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs_.columns
    seen = {}
    for name, function in P.STAGES:
        before = docs_.collect()
        docs_ = P.stage(function(spark, docs_, folder), name)
        after = docs_.collect()
        seen[name] = (before, after)
        if name != "mixing":
            assert docs_.columns == columns
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {90_000, 90_001, 90_002}
    before, after = seen["near_duplicates"]
    before = sorted(before, key=lambda r: r["doc_id"])
    want = [r["doc_id"] for i, (r, (_, c)) in enumerate(zip(before, brute([r["text"] for r in before], 5, 4, 5), strict=True)) if c == i]
    assert sorted(r["doc_id"] for r in after) == want
    before, after = seen["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    short = [r for r in before if len(r["text"]) < 1_500]
    dirty = {r["doc_id"] for r in short if any(exhaustive(r["text"], b) for b in items)}
    kept = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in short} - kept == dirty and 90_005 in dirty
    before, after = seen["personal_data"]
    text = {r["doc_id"]: r["text"] for r in after}
    assert text[90_006].startswith("Write to <EMAIL> now") and len(before) == len(after)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["mixing"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)


def test_run(spark, folder):
    out = P.run(spark, folder)
    assert out.groupBy("mix_slot", "mix_rank").count().where("count > 1").count() == 0
    assert out.where(F.col("doc_id") == 90_006).count() == 1


def test_clashing_columns_null_ids_and_repeated_rows(spark, folder, tmp_path):
    """Each stage carries columns of any name through unchanged and takes nulls and repeats."""
    table = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 or doc_id >= 90000")
    nulls = spark.createDataFrame([(None, "plain words of no one in particular are here", "en", None, None), (None, None, None, "src1", 0)], table.schema)
    rows = clash(table.union(table.where("doc_id < 20")).union(nulls)).withColumn("language", F.lit(8)).withColumn("mark", F.col("doc_id"))
    rows = rows.drop("mix_slot")
    docs_, names = rows, rows.columns
    for name, function in P.STAGES:
        docs_ = P.stage(function(spark, docs_, folder), name)
        assert docs_.columns[: len(names)] == names
        for r in docs_.collect():
            assert (r["_key"], r["p"], r["row"], r["key"], r["language"], r["mark"]) == (7, 7, 7, 7, 8, r["doc_id"])
    ids = [r["doc_id"] for r in docs_.collect()]
    assert len(set(ids)) == len(ids) and None in ids


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
