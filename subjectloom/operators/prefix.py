"""Prefix sums of vectors over blocks of rows, scanned in two levels.

A block's sums are one row a topic; SCANNED blocks are scanned by one task, and the sums of such
groups before that, so no task holds the vectors of a topic or of all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import keep

#: Blocks whose sums are scanned by one task; more are scanned in two levels.
SCANNED = 256


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as a matrix."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def summed(table: pa.Table, key: str) -> pa.Table:
    """One row for each value of ``key``, in the order of their first rows, with the sums of ``n`` and ``s``."""
    code = table.column(key).combine_chunks().dictionary_encode()
    at, x = code.indices.to_numpy(), vectors(table.column("s"))
    sums = np.zeros((len(code.dictionary), x.shape[1]))
    np.add.at(sums, at, x)
    first = np.unique(at, return_index=True)[1]
    return table.take(pa.array(first)).set_column(table.schema.get_field_index("n"), "n", pa.array(np.bincount(at, table.column("n").to_numpy()).astype(np.int64))).set_column(table.schema.get_field_index("s"), "s", lists(sums))


def _scanned(rows: DataFrame, by: list[str], order: str, kept: str, earlier: bool) -> DataFrame:
    """Running sums of ``n`` and ``s`` of each group in the order of ``order`` (without the row itself if
    ``earlier``), of the rows whose ``kept`` is not negative."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        n, x = table.column("n").to_numpy(), vectors(table.column("s"))
        less = (n, x) if earlier else (0, 0)
        out = table.set_column(table.schema.get_field_index("n"), "n", pa.array(np.cumsum(n) - less[0])).set_column(table.schema.get_field_index("s"), "s", lists(np.cumsum(x, axis=0) - less[1]))
        return out.filter(pa.array(table.column(kept).to_numpy() >= 0))

    return rows.groupBy(*by).applyInArrow(run, rows.schema)


def running_states(sums: DataFrame, last: int) -> DataFrame:
    """``topic, rb, n, s``: what the blocks before each block sum up to, of ``sums(topic, rb, n, s)`` with one
    row a topic and block (those that have any) and blocks up to ``last``; blocks without earlier ones have no row."""
    topic = sums.schema["topic"].dataType.simpleString()
    part = sums.withColumn("sb", F.floor(F.col("rb") / SCANNED).cast("int")).select("topic", "sb", "rb", "n", "s")
    if last >= SCANNED:
        whole = part.groupBy("topic", "sb").applyInArrow(lambda t: summed(t, "sb"), f"topic {topic}, sb int, rb int, n long, s array<double>")
        before = _scanned(whole, ["topic"], "sb", "sb", True)
        part = part.union(before.withColumn("rb", F.lit(-1)))
    running = _scanned(part, ["topic", "sb"], "rb", "rb", False).drop("sb")
    # A state holds until the topic's next block of its own, that one included.
    upto = sums.select("topic", "rb", F.coalesce(F.lead("rb").over(Window.partitionBy("topic").orderBy("rb")), F.lit(last)).alias("upto"))
    return running.join(upto, ["topic", "rb"]).where("rb < upto").select("topic", F.explode(F.sequence(F.col("rb") + 1, "upto")).alias("rb"), "n", "s")


def prefix_states(rows: DataFrame, last: int) -> DataFrame:
    """``topic, rb, n, s``: for each block of rows and each topic with rows in earlier blocks, the
    number of those rows and the sum of their vectors; of ``rows(topic, rb, v)`` with blocks up to ``last``.

    The sums of a topic and block are made block by block, so a topic with most rows is in many tasks."""
    topic = rows.schema["topic"].dataType.simpleString()
    block = rows.select("topic", "rb", F.lit(1).cast("long").alias("n"), F.col("v").alias("s"))
    sums = block.groupBy("rb").applyInArrow(lambda t: summed(t, "topic"), f"topic {topic}, rb int, n long, s array<double>")
    return running_states(keep(sums, "sums"), last)
