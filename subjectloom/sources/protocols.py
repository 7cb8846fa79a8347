"""Transcript files: strict and tolerant JSON scans, tagged multi-file scans, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROTOCOL = T.StructType([T.StructField("knesset_num", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("committee", "doc_id", "date", "source_file", "text")]])
CORRUPT = "_corrupt"


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON file, with its name; a damaged file fails the scan."""
    return spark.read.schema(PROTOCOL).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_protocols_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_protocols``, but damaged files are left out and dates cut to the day."""
    files = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return parse_tolerant(files)


def parse_tolerant(texts: DataFrame) -> DataFrame:
    """Protocol rows of a column ``value`` of JSON; unreadable values are left out.

    Parsing in an expression keeps its result whatever columns a query later reads."""
    schema = T.StructType([*PROTOCOL.fields, T.StructField(CORRUPT, T.StringType())])
    rest = [c for c in texts.columns if c != "value"]
    rows = texts.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("p"), *rest)
    rows = rows.where(F.col(f"p.{CORRUPT}").isNull() & F.col("p.doc_id").isNotNull()).select("p.*", *rest).drop(CORRUPT)
    return rows.withColumn("date", F.substring(F.coalesce("date", F.lit("")), 1, 10))


def read_tagged(spark: SparkSession, glob: str, schema: T.StructType, prefix: str, tag: str = "tag") -> DataFrame:
    """Several JSON files (or folders of them, as Spark writes) as one table; ``tag`` is the
    file's or folder's stem without ``prefix``."""
    stem = F.regexp_extract(F.input_file_name(), rf"/{prefix}([^/]*)\.json(?:/[^/]*)?$", 1)
    return spark.read.schema(schema).json(glob).withColumn(tag, stem)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any file system Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one where the path does not exist."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows, and ``old`` rows whose key has none."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key: what keyed saves leave behind."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_protocols(rows: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII kept as it is; readers take each line as a record."""
    rows.write.json(path)


def save_progress(rows: DataFrame, root: str, save: int) -> None:
    """Add one save of all annotators' ``annotator, doc_id, label`` rows below ``root``.

    A save is a folder of its own, a later one has a larger number, and nothing is read or
    rewritten; repeating a save that failed half-way replaces it."""
    rows.select("annotator", "doc_id", "label").write.mode("overwrite").parquet(f"{root}/save={save}")


def read_progress(spark: SparkSession, root: str) -> DataFrame:
    """``annotator, doc_id, label``: the last save of each document by each annotator; no
    rows where nothing was saved yet."""
    schema = T.StructType([T.StructField("annotator", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("save", T.LongType())])
    last = read_optional(spark, root, schema).groupBy("annotator", "doc_id").agg(F.max_by("label", "save").alias("label"))
    return last.select("annotator", "doc_id", "label")


def remaining(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """The ``annotator, doc_id`` tasks without a save: where annotators resume."""
    return tasks.join(progress.select("annotator", "doc_id"), ["annotator", "doc_id"], "left_anti")


def round_trip(protocols: DataFrame) -> DataFrame:
    """Write, add a damaged file, and scan tolerantly: ``doc_id, date, n_chars``."""
    from ..sources.folders import scratch

    spark = protocols.sparkSession
    path = scratch(spark, "protocols")
    rows = protocols.select(F.lit(25).cast("long").alias("knesset_num"), "committee", F.col("doc_id").cast("string").alias("doc_id"), F.concat("date", F.lit("T15:00:00+03:00")).alias("date"), F.lit("").alias("source_file"), "text")
    write_protocols(rows, f"{path}/good")
    spark.range(1).select(F.lit('{"doc_id": "broken", "text": ').alias("value")).coalesce(1).write.text(f"{path}/bad")
    back = parse_tolerant(spark.read.text([f"{path}/good", f"{path}/bad"]))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "date", F.length("text").cast("long").alias("n_chars"))
