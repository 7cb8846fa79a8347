"""Connected components by alternating large-star and small-star joins.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Only
minima are aggregated (combined before the shuffle), each round's edges are
staged in the shared folder, and no vertex list reaches the driver.  The centre of
a large star is a hot key: its edges are dealt into parts (``spread_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, spread_join, stage


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_rows")).select("a", F.least("a", "m").alias("m"), "n_rows")
    return both, least


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(vertex, label)`` for every vertex of ``edges(a, b)``; the label is the
    least vertex of its component.  Self-loops and null ends are dropped.
    """
    edges = stage(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = edges.count()
    for _ in range(rounds):
        both, least = _star(edges)
        large = spread_join(both, least, "a", ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down = stage(down, "large", 2 * n)
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_rows"))
        small = spread_join(down, least, "a", ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = stage(small.where("a != b").distinct(), "small", 2 * n)
        # A fixpoint is a set of stars: no vertex points to a vertex that points on.
        moved = new.alias("x").join(new.alias("y"), F.col("x.b") == F.col("y.a"), "left_semi")
        split = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        edges = new
        if is_empty(moved) and is_empty(split):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("vertex"), F.col("b").alias("label"))).distinct()
