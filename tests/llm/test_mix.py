from collections import Counter

import pytest
from pyspark.sql import functions as F

from subjectloom.llm import pfair_mix as M
from subjectloom.llm.common import spread_join
from subjectloom.llm.queries import ORACLES, QUERIES

from ..compare import connect, same_rows
from .helpers import clash, docs


def test_schedule_keeps_every_window(spark):
    w = spark.createDataFrame([("a", 10, 7), ("b", 10, 2), ("c", 10, 1), ("d", 10, 5)], "source string, n long, p long")
    rows = M.schedule(w).collect()
    period = rows[0]["period"]
    assert sorted(s for r in rows for s in r["slots"]) == list(range(period))
    for r in rows:
        for i, slot in enumerate(r["slots"]):
            assert i * period // r["p"] <= slot < -(-(i + 1) * period // r["p"])


def edf(weights):
    """Earliest deadline first, source by source and slot by slot."""
    period = sum(weights.values())
    given, out = dict.fromkeys(weights, 0), {s: [] for s in weights}
    for t in range(period):
        free = [(-(-(given[s] + 1) * period // p), p, given[s], s) for s, p in weights.items() if given[s] < p and given[s] * period // p <= t]
        *_, s = min(free)
        given[s] += 1
        out[s].append(t)
    return out


@pytest.mark.parametrize("weights", [{"a": 7, "b": 2, "c": 1, "d": 5}, {f"s{i:03d}": 1 + (i % 7) ** 2 for i in range(120)}, {"only": 3}])
def test_schedule_equals_a_simulation(spark, weights):
    """Sources of one weight share a counter of the fold, and chunks are closed midway."""
    rows = M.schedule(spark.createDataFrame([(s, 10, p) for s, p in weights.items()], "source string, n long, p long")).collect()
    assert {r["source"]: r["slots"] for r in rows} == edf(weights)


def test_thousands_of_sources(spark):
    """No limit on sources: every row has a slot of its own, small sources one slot a period."""
    df = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.least(F.col("id"), F.lit(2_999)) % 3_000).cast("string")).alias("source"))
    rows = M.pfair_mix(df, period=3_000).collect()
    assert len(rows) == 9_000 == len({(r["mix_slot"], r["mix_rank"]) for r in rows})


def test_hot_source_is_dealt(spark):
    """A source with half of all rows lands in many parts, and its rows are all there."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 301).cast("string"))).alias("source"))
    small = df.groupBy("source").agg(F.count("*").alias("n_rows"), F.first("source").alias("again"))
    got = spread_join(df, small, "source", ["doc_id"])
    assert got.where("source = again").count() == 20_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        sizes = [r["n"] for r in spread_join(df, small, "source", ["doc_id"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 0.4 * 20_000


def test_deviation_is_less_than_a_block(spark):
    """After any slot of the mixture each source has its share within one block."""
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    rows = M.pfair_mix(df, block=4, period=100).where("in_mix").collect()
    p = {r["source"]: r["p"] for r in M.weights_of(df, "source", 0.5, 100).collect()}
    total = sum(p.values())
    by = {}
    for r in rows:
        by.setdefault(r["mix_slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in by.values())
    given = Counter()
    for t in range(max(by) + 1):
        given[next(iter(by[t]))] += 1
        assert all(abs(given[s] - (t + 1) * w / total) < 1 for s, w in p.items())


def test_edges(spark):
    df = docs(spark, ["a", "b"]).union(docs(spark, ["c"], 2, source=None)).union(docs(spark, ["a"]))
    rows = M.pfair_mix(clash(df)).collect()
    assert sorted(tuple(r)[:-4] for r in rows) == sorted(tuple(r) for r in clash(df).drop("mix_slot").collect())
    assert len(rows) == 4 and len({(r["mix_slot"], r["mix_rank"]) for r in rows}) == 4
    assert M.pfair_mix(df.where("false")).count() == 0
    null = spark.createDataFrame([(None, "s"), (None, "s")], "doc_id long, source string")
    assert M.pfair_mix(null).count() == 2


def test_query(spark, sf):
    same_rows(QUERIES["op3_pfair_mix"](spark, sf), connect(sf), ORACLES["op3_pfair_mix"])
