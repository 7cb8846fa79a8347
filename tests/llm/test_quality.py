from pyspark.sql import functions as F

from subjectloom.llm import host_quality as Q
from subjectloom.llm.queries import ORACLES, QUERIES

from ..compare import connect, same_rows
from .helpers import clash, docs

GOOD = "these are ten plain words that nobody would ever reject today"


def test_hosts_are_judged_with_shrinkage(spark):
    rows = docs(spark, [GOOD] * 40, source="good").union(docs(spark, ["bad"] * 40, 100, source="bad")).union(docs(spark, [GOOD], 200, source="bad")).union(docs(spark, ["bad"], 300, source="lone"))
    got = {r["doc_id"]: r["kept"] for r in Q.host_quality(rows).collect()}
    assert got[0] and not got[100]
    assert not got[200], "a fine document of a bad host goes"
    verdicts = {r["host"]: r["host_failed"] for r in Q.host_verdicts(Q.text_counts(rows.withColumn("host", F.col("source")), ["host"])).collect()}
    assert verdicts["bad"] and not verdicts["good"]


def test_edges(spark):
    texts = [None, "", " \t ", "a\na\n\n\nb", "x y z u v x y z u v", "é #$ |", "w " * 20_000]
    rows = {r["doc_id"]: r for r in Q.host_quality(clash(docs(spark, texts, source=None))).collect()}
    assert [rows[i]["n_words"] for i in range(7)] == [0, 0, 0, 3, 10, 3, 20_000]
    assert rows[3]["n_dup_lines"] == 1 and rows[4]["n_repeat_words"] == 10 and rows[5]["n_symbols"] == 3 and rows[5]["word_chars"] == 4
    assert rows[6]["n_repeat_words"] == 20_000 and rows[0]["base_failed"]
    assert Q.host_quality(docs(spark, ["a"]).where("false")).count() == 0


def test_ten_megabytes(spark):
    """A text of equal lines, and one without repeats."""
    import time

    many, other = "these are seven words in one line ok\n" * 250_000, " ".join(f"w{i}" for i in range(1_200_000))
    start = time.time()
    rows = {r["doc_id"]: r for r in Q.host_quality(docs(spark, [many, other, GOOD])).collect()}
    assert time.time() - start < 60
    assert (rows[0]["n_words"], rows[0]["n_dup_lines"], rows[0]["n_repeat_words"], rows[0]["base_failed"]) == (2_000_000, 249_999, 2_000_000, True)
    assert (rows[1]["n_words"], rows[1]["n_dup_lines"], rows[1]["n_repeat_words"]) == (1_200_000, 0, 0)


def test_hosts_of_addresses(spark):
    df = spark.sql("select 'https://A.Example.org:80/x?y' u union all select 'src1' union all select null")
    assert sorted(r[0] for r in df.select(Q.host_of(F.col("u"))).collect()) == ["", "a.example.org", "src1"]


def test_small_hosts_do_not_weaken_the_prior(spark):
    """Hosts of one document vary by chance alone: with one true rate the prior is strong."""
    rows = spark.range(4_000).select(F.col("id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit(50).cast("long").alias("n_words"), F.lit(200).cast("long").alias("word_chars"), F.lit(0).cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"), F.when(F.xxhash64("id") % 10 > 2, 40).otherwise(0).cast("long").alias("n_repeat_words"))
    assert Q.host_verdicts(rows).where("host_failed").count() == 0


def test_a_host_with_half_of_all_rows_is_split(spark):
    df = docs(spark, [f"{GOOD} {i}" for i in range(3_000)], source="hot").union(docs(spark, [f"{GOOD} {i}" for i in range(3_000)], 3_000).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 300).cast("string"))))
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "32")):
        spark.conf.set(name, value)
    try:
        parts = [r["count"] for r in Q.host_quality(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(parts) == 6_000 and max(parts) < 1_000


def test_query(spark, sf):
    same_rows(QUERIES["op6_host_rules"](spark, sf), connect(sf), ORACLES["op6_host_rules"])
