"""Clustering, agreement and separability metrics as grouped aggregations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs2(n: Column) -> Column:
    """n choose 2, as a double."""
    return n * (n - 1) / 2.0


def _one(df: DataFrame, *aggs: Column) -> DataFrame:
    return df.groupBy(F.lit(1).alias("one")).agg(*aggs)


def contingency(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))


def _marginals(df: DataFrame, gold: str, pred: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = contingency(df, gold, pred)
    return cells, cells.groupBy("g").agg(F.sum("n").alias("a")), cells.groupBy("p").agg(F.sum("n").alias("b"))


def adjusted_rand(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``ari``: 1 for equal partitions (also where both are trivial)."""
    cells, rows, cols = _marginals(df, gold, pred)
    parts = _one(cells, F.sum(pairs2(F.col("n"))).alias("ij"), F.sum("n").alias("total")).join(_one(rows, F.sum(pairs2(F.col("a"))).alias("i")), "one").join(_one(cols, F.sum(pairs2(F.col("b"))).alias("j")), "one")
    expected = F.col("i") * F.col("j") / pairs2(F.col("total"))
    top, bottom = F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected
    return parts.select(F.when(bottom == 0, 1.0).otherwise(top / bottom).alias("ari"))


def v_measure(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``homogeneity, completeness, v, nmi`` (arithmetic mean, so nmi = v)."""
    cells, rows, cols = _marginals(df, gold, pred)
    total = _one(cells, F.sum("n").alias("t"))
    entropy = lambda d, c, name: _one(d.withColumn("one", F.lit(1)).join(total, "one"), (-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(name))
    joined = cells.join(rows, "g").join(cols, "p").withColumn("one", F.lit(1)).join(total, "one")
    mutual = _one(joined, F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    all_ = entropy(rows, "a", "hg").join(entropy(cols, "b", "hp"), "one").join(mutual, "one")
    h = F.when(F.col("hg") == 0, 1.0).otherwise(F.col("mi") / F.col("hg"))
    c = F.when(F.col("hp") == 0, 1.0).otherwise(F.col("mi") / F.col("hp"))
    v = F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c))
    return all_.select(h.alias("homogeneity"), c.alias("completeness"), v.alias("v"), v.alias("nmi"))


def partition_scores(df: DataFrame, gold: str, pred: str, by: str) -> DataFrame:
    """``by, ari, nmi`` for each variant, as ``adjusted_rand`` and ``v_measure`` give them, in one plan."""
    log = lambda c: F.sum(F.col(c) * F.log(c))
    cells = df.groupBy(F.col(by).alias("by"), F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("by", "g").agg(F.sum("n").alias("a")), cells.groupBy("by", "p").agg(F.sum("n").alias("b"))
    parts = cells.groupBy("by").agg(F.sum(pairs2(F.col("n"))).alias("ij"), F.sum("n").alias("total"), log("n").alias("ln"))
    parts = parts.join(rows.groupBy("by").agg(F.sum(pairs2(F.col("a"))).alias("i"), log("a").alias("la")), "by").join(cols.groupBy("by").agg(F.sum(pairs2(F.col("b"))).alias("j"), log("b").alias("lb")), "by")
    expected = F.when(F.col("total") > 1, F.col("i") * F.col("j") / pairs2(F.col("total"))).otherwise(0.0)
    top, bottom = F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected
    whole = F.log("total")
    hg, hp = whole - F.col("la") / F.col("total"), whole - F.col("lb") / F.col("total")
    mutual = whole + (F.col("ln") - F.col("la") - F.col("lb")) / F.col("total")
    share = lambda h: F.when(F.abs(h) < 1e-12, 1.0).otherwise(mutual / h)
    both = share(hg) + share(hp)
    return parts.select(F.col("by").alias(by), F.when(bottom == 0, 1.0).otherwise(top / bottom).alias("ari"), F.when(both == 0, 0.0).otherwise(2 * share(hg) * share(hp) / both).alias("nmi"))


def pairwise_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``precision, recall, f1`` over unordered pairs in one group, in closed form."""
    cells, rows, cols = _marginals(df, gold, pred)
    s = _one(cells, F.sum(pairs2(F.col("n"))).alias("both")).join(_one(rows, F.sum(pairs2(F.col("a"))).alias("gold")), "one").join(_one(cols, F.sum(pairs2(F.col("b"))).alias("pred")), "one")
    p = F.when(F.col("pred") > 0, F.col("both") / F.col("pred")).otherwise(0.0)
    r = F.when(F.col("gold") > 0, F.col("both") / F.col("gold")).otherwise(0.0)
    return s.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def pairwise_scores(df: DataFrame, gold: str, pred: str, by: str) -> DataFrame:
    """``by, precision, recall, f1, clusters`` over unordered pairs in one group, for each variant in one plan;
    precision is 1 where no two rows share a predicted group."""
    cells = df.groupBy(F.col(by).alias("by"), F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("by", "g").agg(F.sum("n").alias("a")), cells.groupBy("by", "p").agg(F.sum("n").alias("b"))
    parts = cells.groupBy("by").agg(F.sum(pairs2(F.col("n"))).alias("both")).join(rows.groupBy("by").agg(F.sum(pairs2(F.col("a"))).alias("gold")), "by").join(cols.groupBy("by").agg(F.sum(pairs2(F.col("b"))).alias("pred"), F.count("*").alias("clusters")), "by")
    p = F.when(F.col("pred") > 0, F.col("both") / F.col("pred")).otherwise(1.0)
    r = F.when(F.col("gold") > 0, F.col("both") / F.col("gold")).otherwise(0.0)
    return parts.select(F.col("by").alias(by), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "clusters")


def auc(pairs: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """``auc`` by the Mann-Whitney statistic with average ranks; null with one class.

    Scores are counted first; ranks are running sums over distinct scores, taken within
    ranges of a 1024th and across ranges (a small table), so no task sees all scores."""
    keys = by or ["one"]
    if not by:
        pairs = pairs.withColumn("one", F.lit(1))
    ties = pairs.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(positive)).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("n"))
    ties = ties.withColumn("range", F.floor(F.col("s") * 1024))
    lower = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ties.groupBy(*keys, "range").agg(F.sum("n").alias("m")).select(*keys, "range", F.coalesce(F.sum("m").over(lower), F.lit(0.0)).alias("base"))
    inside = Window.partitionBy(*keys, "range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("base") + F.coalesce(F.col("inside"), F.lit(0.0))
    won = ties.withColumn("inside", F.sum("n").over(inside)).join(ranges, [*keys, "range"]).withColumn("won", F.col("p") * (below + F.col("n") / 2))
    total = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(*(by or []), F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def fused_auc(pairs: DataFrame, alphas: list[float], digits: int = 7, ranges: int = 256) -> DataFrame:
    """``alpha, auc`` of alpha * lex + (1 - alpha) * sim (rounded to ``digits``) for each
    alpha, over ``pairs(same, sim, lex)``; null with one class.

    A batch of pairs makes the scores of all alphas at once and ships them packed by range
    of the score; a range's scores are sorted together, with average ranks for ties, and
    ranges are put together by their counts.  No score is left out or merged."""

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sim, lex = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("same", "sim", "lex"))
            out: list[tuple] = []
            for alpha in alphas:
                s = np.round(alpha * lex + (1 - alpha) * sim, digits)
                cell = np.floor(s * ranges).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                names, starts = np.unique(cell[order], return_index=True)
                for name, at in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
                    out.append((alpha, name, s[at][same[at]].tobytes(), s[at][~same[at]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.float64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["alpha", "cell", "p", "n"])

    def inside(table: pa.Table) -> pa.Table:
        p, n = (np.frombuffer(b"".join(table.column(c).to_pylist())) for c in ("p", "n"))
        n = np.sort(n)
        won = (np.searchsorted(n, p, "left") + np.searchsorted(n, p, "right")).sum() / 2
        return pa.table({"alpha": table.column("alpha")[:1], "cell": table.column("cell")[:1], "won": [float(won)], "p": [float(len(p))], "n": [float(len(n))]})

    packed = pairs.select("same", "sim", "lex").mapInArrow(scores, "alpha double, cell long, p binary, n binary")
    parts = packed.groupBy("alpha", "cell").applyInArrow(inside, "alpha double, cell long, won double, p double, n double")
    lower = Window.partitionBy("alpha").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(lower), F.lit(0.0)))
    total = parts.groupBy("alpha").agg(F.sum(F.col("won") + F.col("base") * F.col("p")).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select("alpha", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """``value, n``: the q-quantile with linear interpolation, and the number of rows (null
    and 0 for none).  Values are counted by ranges of a 1024th; only the ranges that hold
    the two ranks in question are ordered."""
    rows = df.select(F.col(value).alias("s"), F.floor(F.col(value) * 1024).alias("range")).where("s is not null")
    up_to = Window.orderBy("range")
    ranges = rows.groupBy("range").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(up_to)).withColumn("n", F.sum("m").over(up_to.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    h = (F.col("n") - 1) * q
    held = ranges.withColumns({"low": F.floor(h), "part": h - F.floor(h), "base": F.col("upto") - F.col("m")}).where((F.col("base") <= F.least(F.col("low") + 1, F.col("n") - 1)) & (F.col("upto") > F.col("low")))
    ties = rows.join(F.broadcast(held), "range").groupBy("range", "s", "base", "low", "part", "n").agg(F.count("*").alias("c"))
    last = F.col("base") + F.sum("c").over(Window.partitionBy("range").orderBy("s"))
    at = lambda k: F.max(F.when((F.col("last") - F.col("c") <= k) & (k < F.col("last")), F.col("s")))
    one = ties.withColumn("last", last).groupBy().agg(at(F.col("low")).alias("a"), at(F.least(F.col("low") + 1, F.col("n") - 1)).alias("b"), F.max("part").alias("part"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return one.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"), F.col("n").cast("long").alias("n"))


def cohen_kappa(votes: DataFrame, a: str, b: str) -> DataFrame:
    """``n, observed, expected, kappa``: kappa is null without pairs, 1 where chance is certain."""
    votes = votes.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    total = _one(votes, F.count("*").cast("double").alias("n"), F.count_if(F.col(a) == F.col(b)).cast("double").alias("same"))
    left = votes.groupBy(F.col(a).alias("k")).agg(F.count("*").cast("double").alias("x"))
    right = votes.groupBy(F.col(b).alias("k")).agg(F.count("*").cast("double").alias("y"))
    chance = _one(left.join(right, "k"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("xy", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return total.join(chance, "one", "left").select("n", po.alias("observed"), pe.alias("expected"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def majority(votes: DataFrame, item: str, label: str, order: str) -> DataFrame:
    """``item, label, top, n, status``: the commonest label, the earliest on ties;
    agreed with two equal votes or a single vote, else conflict (label null)."""
    counts = votes.groupBy(item, label).agg(F.count("*").alias("c"), F.min(order).alias("o"))
    w = Window.partitionBy(item).orderBy(F.desc("c"), "o")
    ranked = counts.withColumns({"r": F.row_number().over(w), "n": F.sum("c").over(Window.partitionBy(item))}).where("r = 1")
    agreed = (F.col("c") >= 2) | (F.col("n") == 1)
    return ranked.select(item, F.when(agreed, F.col(label)).alias("label"), F.col("c").alias("top"), "n", F.when(agreed, "agreed").otherwise("conflict").alias("status"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, by: list[str]) -> DataFrame:
    """Density by bin (the last bin is closed): ``by, bin, n, density``."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("long")
    counts = df.where((F.col(value) >= lo) & (F.col(value) <= hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "bin", "n", (F.col("n") / (total * width)).alias("density"))
