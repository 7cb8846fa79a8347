"""Folders for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, the one all executors share; a
    single-machine session without the setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="subjectloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/subjectloom-{uuid.uuid4().hex}/{label}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet and read back, for results with several readers."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished rounds: it does so once the driver has collected what no longer
    names them, which by itself may be after all rounds."""
    gc.collect()
    spark._jvm.System.gc()


def write_variants(variants: dict[str, DataFrame], label: str) -> str:
    """One table of vectors a variant below one folder, whose name is returned."""
    path = scratch(next(iter(variants.values())).sparkSession, label)
    for name, rows in variants.items():
        rows.write.parquet(f"{path}/variant={name}")
    return path


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """All variants below a folder as one table; ``variant`` is a partition column, so a
    filter on it reads that variant only."""
    return spark.read.parquet(path)


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row, from 1, in the order of ``keys`` (unique).

    Rows are sorted within ranges of the keys; a range's offset is the number of rows
    before it, from a table of one row a range.  No task sees all rows.
    """
    low = F.col("_id").bitwiseAND((1 << 33) - 1)
    rows = keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), name)
    rows = rows.select(*df.columns, F.shiftright("_id", 33).alias("_range"), low.alias("_at"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("long")).drop("_range", "_at", "_before")
