"""The driver's tables in the roles of spans, transcripts and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str, normal: bool = True) -> DataFrame:
    """``ord, topic, v``: embeddings as spans in chronological order."""
    v = V.to_double(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") + 1).alias("ord"), F.col("label").cast("long").alias("topic"), (V.normalize(v) if normal else v).alias("v"))


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, committee, date, text``: conversations as marked-up transcripts.

    Every turn is an utterance between speaker tags; user turns open a topic whose
    title is their first three words, numbered."""
    c = table(spark, sf_dir, "conversations")
    title = F.array_join(F.slice(F.array_remove(F.split("text", r"\s+"), ""), 1, 3), " ")
    head = F.when(F.col("role") == "user", F.concat(F.lit("<< נושא >> "), (F.col("turn") + 1).cast("string"), F.lit(". "), title, F.lit(" << נושא >>\n"))).otherwise("")
    turn = F.concat(head, F.lit("<< דובר >> "), F.col("role"), F.lit(": << דובר >>\n"), F.col("text"), F.lit("\n"))
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "").alias("body"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string")).alias("committee"), F.concat(F.lit("2023-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")).alias("date"), F.concat(F.lit("סדר היום:\n"), F.col("body")).alias("text"))


#: DuckDB: spans as s(ord, topic, v), v a list of doubles of unit length.
S = """s AS (SELECT ord, topic, list_transform(u, lambda x: x / n) AS v FROM (
  SELECT vec_id + 1 AS ord, label::BIGINT AS topic, list_transform(embedding, lambda x: x::DOUBLE) AS u,
         sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings))"""

#: DuckDB: dec(t, gold, entry, size, cos, is_repeat) of centroid entries.
DEC = (
    S
    + """,
l AS (SELECT ord, topic, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM s),
ru AS (SELECT ord, topic, i, sum(x) OVER (PARTITION BY topic, i ORDER BY ord) AS c FROM l),
sv AS (SELECT topic, ord, list(c ORDER BY i) AS c FROM ru GROUP BY topic, ord),
st AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ord) AS size, lead(ord) OVER (PARTITION BY topic ORDER BY ord) AS nxt FROM sv),
f AS (SELECT topic, min(ord) AS first FROM s GROUP BY topic),
dec AS (SELECT q.ord AS t, q.topic AS gold, e.topic AS entry, e.size, list_dot_product(q.v, e.c) / sqrt(list_dot_product(e.c, e.c)) AS cos, q.ord > f.first AS is_repeat
        FROM s q JOIN st e ON q.ord > e.ord AND (e.nxt IS NULL OR q.ord <= e.nxt) JOIN f ON f.topic = q.topic)"""
)

#: DuckDB: top(t, gold, is_repeat, best, top, second) of dec.
TOP = """
rk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY cos DESC, entry) AS r FROM dec),
top AS (SELECT t, gold, is_repeat, max(entry) FILTER (r = 1) AS best, max(cos) FILTER (r = 1) AS top, max(cos) FILTER (r = 2) AS second FROM rk WHERE r <= 2 GROUP BY ALL)"""


def grid_sql(lo: float, hi: float, n: int) -> str:
    """DuckDB: a table of n evenly spaced thetas."""
    return f"(SELECT round({lo} + ({hi} - {lo}) * i / {n - 1}, 10)::DOUBLE AS theta FROM range({n}) g(i))"


def curve_sql(rows: str, score: str, grid: str, right: str, convention: str = "wrong_is_fp", by: str = "") -> str:
    """DuckDB: the confusion curve of ``rows`` (with is_repeat) over a grid."""
    key = f"{by}, " if by else ""
    wrong = f"count(*) FILTER (is_repeat AND (NOT l OR NOT ok))" if convention == "wrong_is_both" else "count(*) FILTER (is_repeat AND NOT l)"
    neg = "count(*) FILTER (NOT is_repeat)" if convention == "wrong_is_both" else "count(*) FILTER (NOT is_repeat AND NOT l) + count(*) FILTER (l AND NOT (is_repeat AND ok))"
    return f"""
cf AS (SELECT {key}theta, count(*) FILTER (l AND is_repeat AND ok) AS tp, count(*) FILTER (l AND NOT (is_repeat AND ok)) AS fp,
       {wrong} AS fn, count(*) FILTER (NOT l AND NOT is_repeat) AS tn, {neg} AS neg
       FROM (SELECT {key}theta, is_repeat, coalesce({score} >= theta, FALSE) AS l, coalesce({right}, FALSE) AS ok FROM {rows}, {grid}) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS rc, CASE WHEN neg > 0 THEN fp / neg ELSE 0.0::DOUBLE END AS m FROM cf),
curve AS (SELECT {key}theta, tp, fp, fn, tn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0::DOUBLE END, 6) AS f1, round(m, 6) AS fmr FROM pr)"""


def points_sql(default: str = "null", by: str = "") -> str:
    """DuckDB: the two operating points of ``curve``."""
    part = f"PARTITION BY {by} " if by else ""
    held = "WHERE r = 1 AND fmr <= 0.05" if default == "null" else "WHERE r = 1"
    return f"""
SELECT * EXCLUDE (r), 'best_f1' AS point FROM (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, theta) AS r FROM curve) WHERE r = 1
UNION ALL SELECT * EXCLUDE (r), 'best_recall' AS point FROM (SELECT *, row_number() OVER ({part}ORDER BY CASE WHEN fmr <= 0.05 THEN 0 ELSE 1 END, CASE WHEN fmr <= 0.05 THEN recall END DESC, theta) AS r FROM curve) {held}"""
