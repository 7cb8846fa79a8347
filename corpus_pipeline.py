"""The corpus pipeline: five stages over ``documents``, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet into the shared folder and reads it again for the next one.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectloom.llm import chosen_path, language_id, pfair_mix, semicrf_pii, spaced_seeds
from subjectloom.llm.common import stage


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns, so that none of their names can clash) and ``key``: a hash of id
    and text, which names a row and spreads evenly over partitions."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("key"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the language found.

    Texts without letters (null and empty ones too), and texts that no language explains,
    go.  Rows repeated with one id and text are judged alike and all stay; null ids, null
    declarations and null sources are allowed; an empty table stays empty."""
    keyed = _keyed(docs)
    found = language_id.identify(keyed, id_col="key", text_col="row.text", declared=F.col("row.lang"), host=F.col("row.source")).where("kept")
    found = found.select(F.col("id").alias("key"), "language").dropDuplicates(["key"])
    kept = keyed.join(found.hint("shuffle_hash"), "key")
    return kept.select(*[F.col("language").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with
    the least id.

    Of equal rows one stays; different texts under that one id all stay.  Null and empty
    texts resemble nothing and stay, one for each id; a null id is never the least, and a
    group of null ids alone keeps its different texts; an empty table stays empty."""
    kept = chosen_path.near_duplicates(docs, k=5, threshold=(4, 5)).where("kept").select("key").distinct()
    return _keyed(docs).join(kept.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def remove_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item.

    Null and empty texts and null ids stay; repeated rows are judged alike; an empty
    benchmark keeps every row."""
    return spaced_seeds.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kind; ``n_chars``
    is that of the new text.  Null texts stay null (with a null ``n_chars``), empty ones empty;
    repeated rows are treated alike."""
    redacted = semicrf_pii.redact(docs)
    return redacted.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources.

    Null and empty sources are one source; repeated rows have places of their own; null ids
    come where the hash of '' puts them; columns with the names of the places are replaced;
    an empty table gives an empty result."""
    return pfair_mix.pfair_mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark_overlaps),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Language models, similarity joins and random fields have no SQL form; the tests
#: hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
