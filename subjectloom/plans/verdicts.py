"""Verifier, judge and upsert queries; ``events`` plays predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsonparse as J
from ..operators import journal as G
from ..sources import protocols as S
from .registry import query
from .tables import curve_sql, table

#: Predictions of three models for each query: rank 1..3 or null, and a confidence.
PRED = "pd AS (SELECT event_id AS q, m, CASE WHEN (event_id * (m + 1)) % 5 = 0 THEN NULL ELSE (event_id * (m + 2)) % 3 + 1 END AS rank, CAST(json_extract_string(props, '$.k') AS BIGINT) + m AS conf FROM events, range(3) r(m))"
RANK_OK = "CASE WHEN q % 4 = 0 THEN 1 WHEN q % 4 = 1 THEN 2 END"


def predictions(spark, d):
    m = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("m")
    e = table(spark, d, "events").select(F.col("event_id").alias("q"), F.get_json_object("props", "$.k").cast("long").alias("k"), m)
    rank = F.when((F.col("q") * (F.col("m") + 1)) % 5 == 0, F.lit(None)).otherwise((F.col("q") * (F.col("m") + 2)) % 3 + 1)
    return e.select("q", "m", rank.cast("long").alias("rank"), (F.col("k") + F.col("m")).alias("conf"))


@query("ensemble_vote", f"WITH {PRED}, g AS (SELECT q, rank, count(*) AS n, avg(conf) AS c FROM pd WHERE rank IS NOT NULL GROUP BY ALL), w AS (SELECT * FROM g WHERE n >= 2) SELECT e.event_id AS q, w.rank AS rank, coalesce(round_even(w.c, 0), 0)::BIGINT AS conf, coalesce(w.n, 0) AS n_agree FROM events e LEFT JOIN w ON w.q = e.event_id")
def ensemble_vote(spark, d):
    """A rank that two of three models give, with their mean confidence; else none and 0."""
    p = predictions(spark, d)
    won = p.where(F.col("rank").isNotNull()).groupBy("q", "rank").agg(F.count("*").alias("n"), F.avg("conf").alias("c")).where("n >= 2")
    return p.select("q").distinct().join(won, "q", "left").select("q", "rank", F.coalesce(F.bround("c", 0), F.lit(0.0)).cast("long").alias("conf"), F.coalesce("n", F.lit(0)).alias("n_agree"))


@query("confidence_sweep", f"WITH {PRED}, o AS (SELECT q, conf, rank IS NOT NULL AS has, rank, {RANK_OK} AS gold FROM pd WHERE m = 0), rows_ AS (SELECT gold IS NOT NULL AS is_repeat, CASE WHEN has THEN conf END::DOUBLE AS sc, rank, gold FROM o), {curve_sql('rows_', 'sc', '(SELECT (5 * i)::DOUBLE AS theta FROM range(21) g(i))', 'rank = gold')} SELECT * FROM curve")
def confidence_sweep(spark, d):
    """Link where a rank is given with confidence theta or more, theta from 0 to 100."""
    q = F.col("q") % 4
    gold = F.when(q == 0, 1).when(q == 1, 2)
    rows = predictions(spark, d).where("m = 0").withColumn("gold", gold).withColumn("is_repeat", gold.isNotNull()).withColumn("sc", F.when(F.col("rank").isNotNull(), F.col("conf").cast("double")).otherwise(-1.0))
    return G.sweep(rows, "sc", [5.0 * i for i in range(21)], F.col("rank") == F.col("gold"))


@query("prediction_join", f"WITH {PRED} SELECT a.q, a.rank AS rank_0, b.rank AS rank_1, c.rank AS rank_2, (a.rank = b.rank AND b.rank = c.rank) IS TRUE AS unanimous FROM pd a JOIN pd b ON a.q = b.q AND b.m = 1 JOIN pd c ON a.q = c.q AND c.m = 2 WHERE a.m = 0")
def prediction_join(spark, d):
    """Three models side by side: one grouped pivot, not a positional zip."""
    p = predictions(spark, d)
    wide = p.groupBy("q").agg(*[F.max(F.when(F.col("m") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(3)])
    same = (F.col("rank_0") == F.col("rank_1")) & (F.col("rank_1") == F.col("rank_2"))
    return wide.withColumn("unanimous", F.coalesce(same, F.lit(False)))


_JUDGED = "j AS (SELECT event_type AS model, event_id % 4 = 0 AS is_opening, event_id % 10 = 3 AS bad, CASE WHEN event_id % 10 = 3 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS faith, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 10 = 3 THEN 0 ELSE (CAST(json_extract_string(props, '$.k') AS BIGINT) * 7) % 30 END AS novelty FROM events)"


def _judged(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    bad, opening = F.col("event_id") % 10 == 3, F.col("event_id") % 4 == 0
    reply = F.when(bad, F.lit("cannot say")).otherwise(F.concat(F.lit('{"faithfulness": '), k.cast("string"), F.lit(', "novelty": '), (k * 7 % 30).cast("string"), F.lit("}")))
    s = J.scores(reply, ("faithfulness", "novelty"))
    return table(spark, d, "events").select(F.col("event_type").alias("model"), opening.alias("is_opening"), s.alias("s")).select("model", "is_opening", F.col("s.parse_error").alias("bad"), F.col("s.faithfulness").alias("faith"), F.when(~F.col("is_opening"), F.col("s.novelty")).alias("novelty"))


@query("faithfulness_summary", f"WITH {_JUDGED} SELECT model, count(*) AS n, round(avg(faith), 1) AS mean_faithfulness, round(avg(novelty) FILTER (NOT is_opening), 1) AS mean_novelty, count(*) FILTER (bad) AS parse_errors FROM j GROUP BY model")
def faithfulness_summary(spark, d):
    return summary(_judged(spark, d))


def summary(judged):
    return judged.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("faith"), 1).alias("mean_faithfulness"), F.round(F.avg(F.when(~F.col("is_opening"), F.col("novelty"))), 1).alias("mean_novelty"), F.count_if("bad").alias("parse_errors"))


@query("summary_upsert", f"WITH {_JUDGED}, s AS (SELECT model, count(*) AS n, round(avg(faith), 1) AS mean FROM j WHERE model <> 'view' GROUP BY model), o AS (SELECT DISTINCT event_type AS model, 0::BIGINT AS n, 0.0::DOUBLE AS mean FROM events) SELECT * FROM o WHERE model NOT IN (SELECT model FROM s) UNION ALL SELECT * FROM s")
def summary_upsert(spark, d):
    """New results replace old ones of the same model; others stay."""
    old = table(spark, d, "events").select(F.col("event_type").alias("model")).distinct().select("model", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"))
    new = _judged(spark, d).where("model != 'view'").groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("faith"), 1).alias("mean"))
    return S.upsert(old, new, ["model"])


@query("latest_save", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_save(spark, d):
    """The last saved row of each annotator."""
    return S.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("prompt_assembly", "WITH c AS (SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:8], ' ') AS s FROM conversations) SELECT a.conv_id, 'NEW SEGMENT (date ' || (a.conv_id % 28 + 1) || '):' || chr(10) || a.s || chr(10) || string_agg('[' || b.turn || '] ' || b.s, chr(10) ORDER BY b.turn) AS prompt FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn BETWEEN 1 AND 3 WHERE a.turn = 0 GROUP BY a.conv_id, a.s")
def prompt_assembly(spark, d):
    """A query's text and its ranked candidates as one prompt."""
    from ..functions import text as T

    c = table(spark, d, "conversations").select("conv_id", "turn", T.snippet(F.col("text"), 8).alias("s"))
    cands = c.where("turn between 1 and 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("c"))
    line = F.transform("c", lambda x: F.concat(F.lit("["), x["turn"].cast("string"), F.lit("] "), x["s"]))
    head = F.concat(F.lit("NEW SEGMENT (date "), (F.col("conv_id") % 28 + 1).cast("string"), F.lit("):\n"), F.col("s"), F.lit("\n"))
    return c.where("turn = 0").join(cands, "conv_id").select("conv_id", F.concat(head, F.array_join(line, "\n")).alias("prompt"))


@query("rank_of_verdicts", f"WITH {PRED} SELECT rank, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, rank) AS place FROM pd WHERE rank IS NOT NULL GROUP BY rank")
def rank_of_verdicts(spark, d):
    c = predictions(spark, d).where("rank is not null").groupBy("rank").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "rank")).cast("long"))
