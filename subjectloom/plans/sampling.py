"""Stratified pair sampling over ``embeddings``; order by md5 stands for a seeded shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import similarity as M
from .registry import query
from .tables import S, spans

_H = "md5(i || ':' || j)"
P = f"{S}, p AS (SELECT a.ord AS i, b.ord AS j, a.topic AS ta, b.topic AS tb, round(list_dot_product(a.v, b.v), 9) AS sim FROM s a JOIN s b ON a.ord < b.ord)"
POS = f"pos AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY ta ORDER BY {_H}) AS r FROM p WHERE ta = tb) WHERE r <= 3)"
HARD = "hard AS (SELECT i, j, sim FROM p WHERE ta <> tb ORDER BY sim DESC, i, j LIMIT 30)"
EASY = f"easy AS (SELECT i, j FROM p WHERE ta <> tb AND sim <= (SELECT quantile_cont(sim, 0.2) FROM p WHERE ta <> tb) ORDER BY {_H} LIMIT 20)"


def _easy(rows: DataFrame, n: int = 20) -> DataFrame:
    """Random pairs of different topics at or below the 20th percentile of such pairs."""
    limit = M.pair_quantile(rows, 0.2)
    return M.random_easy(rows, n, -np.inf if limit is None else limit)


@query("positive_cap", f"WITH {P}, {POS} SELECT i, j FROM pos")
def positive_cap(spark, d):
    return M.random_positives(spans(spark, d), 3).select("i", "j")


@query("hard_negatives", f"WITH {P}, {HARD} SELECT i, j, sim FROM hard")
def hard_negatives(spark, d):
    return M.hardest_pairs(spans(spark, d), 30)


@query("easy_negatives", f"WITH {P}, {EASY} SELECT i, j FROM easy")
def easy_negatives(spark, d):
    return _easy(spans(spark, d)).select("i", "j")


@query("stratified_pairs", f"WITH {P}, {POS}, {HARD}, {EASY}, al AS (SELECT i, j, 'positive' AS stratum FROM pos UNION ALL SELECT i, j, 'hard_neg' FROM hard UNION ALL SELECT i, j, 'easy_neg' FROM easy), de AS (SELECT i, j, min(stratum) AS stratum FROM al GROUP BY i, j) SELECT format('pair_{{:04d}}', row_number() OVER (ORDER BY {_H}) - 1) AS id, i, j, stratum FROM de".replace("{{", "{").replace("}}", "}"))
def stratified_pairs(spark, d):
    """The batch to annotate: three strata, unordered pairs once, shuffled and numbered."""
    rows = spans(spark, d)
    parts = M.random_positives(rows, 3).select("i", "j", F.lit("positive").alias("stratum")).union(M.hardest_pairs(rows, 30).select("i", "j", F.lit("hard_neg"))).union(_easy(rows).select("i", "j", F.lit("easy_neg")))
    parts = parts.withColumn("h", F.md5(F.concat_ws(":", F.col("i").cast("string"), F.col("j").cast("string")).cast("binary")))
    once = parts.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "h").agg(F.min("stratum").alias("stratum"))
    return once.select(F.format_string("pair_%04d", F.row_number().over(Window.orderBy("h")) - 1).alias("id"), "i", "j", "stratum")
