"""The subject linker as a real stream: each channel's journal is keyed state.

A journal grows from its own decisions, so it is state: the representatives of a
channel's entries.  Rows of a micro-batch are replayed in order; the state survives
restarts through the checkpoint.  ``run_available`` drains what has arrived into
Parquet and returns the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.folders import scratch

OUTPUT = "channel long, ord long, entry long, opened boolean"
STATE = "reps array<double>, n long"


def _step(theta: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, n = state.get if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values("ord")
        reps = np.array(flat, float).reshape(n, -1) if n else np.zeros((0, len(rows["v"].iloc[0])))
        out = []
        for ord_, v in zip(rows["ord"], rows["v"], strict=True):
            x = np.asarray(v, float)
            s = reps @ x
            best = int(np.argmax(s)) if len(s) else -1
            opened = best < 0 or s[best] < theta
            if opened:
                best = len(reps)
                reps = np.vstack([reps, x])
            out.append((key[0], ord_, best, opened))
        state.update((reps.ravel().tolist(), len(reps)))
        yield pd.DataFrame(out, columns=["channel", "ord", "entry", "opened"])

    return step


def link_stream(rows: DataFrame, theta: float) -> DataFrame:
    """Decisions over a stream of ``channel, ord, v`` (unit vectors)."""
    return rows.groupBy("channel").applyInPandasWithState(_step(theta), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet (append) or its last complete table, and return it."""
    spark = stream.sparkSession
    path = scratch(spark, label)
    if mode == "append":
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/log").format("parquet").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (one file, or a folder of files) as a stream of its files."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events with a time zone aware event time (a watermark needs one)."""
    return read_table_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))
