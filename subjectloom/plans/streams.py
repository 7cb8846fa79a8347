"""Streaming queries: the stateful linker, and windows over ``events`` (an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..streaming import linker as L
from .registry import query
from .tables import S, spans, table


_LINKED = f"""WITH RECURSIVE {S}, c AS (SELECT (ord - 1) % 4 AS channel, ord, v, row_number() OVER (PARTITION BY (ord - 1) % 4 ORDER BY ord) AS k FROM s),
j(channel, k, ord, entry, opened, reps) AS (
  SELECT channel, k, ord, 0::BIGINT, true, [v] FROM c WHERE k = 1
  UNION ALL
  SELECT c.channel, c.k, c.ord, CASE WHEN b.m >= 0.3 THEN b.e ELSE len(j.reps) END, b.m < 0.3, CASE WHEN b.m >= 0.3 THEN j.reps ELSE list_append(j.reps, c.v) END
  FROM j JOIN c ON c.channel = j.channel AND c.k = j.k + 1, LATERAL (SELECT list_max(d) AS m, list_position(d, list_max(d)) - 1 AS e FROM (SELECT list_transform(j.reps, lambda r: list_dot_product(r, c.v)) AS d)) b)
SELECT channel, ord, entry::BIGINT AS entry, opened FROM j"""


@query("stream_linker", _LINKED)
def stream_linker(spark, d):
    """Four channels' feedback journals over a stream of embeddings."""
    rows = L.read_table_stream(spark, f"{d}/embeddings.parquet")
    unit = rows.select((F.col("vec_id") % 4).alias("channel"), (F.col("vec_id") + 1).alias("ord"), V.normalize(V.to_double(F.col("embedding"))).alias("v"))
    return L.run_available(L.link_stream(unit, 0.3), "linker")


@query("stream_entry_counts", "SELECT label::BIGINT AS topic, count(*) AS n, min(vec_id) + 1 AS opened FROM embeddings GROUP BY label")
def stream_entry_counts(spark, d):
    """The oracle journal's entries, kept by a streaming aggregation."""
    rows = L.read_table_stream(spark, f"{d}/embeddings.parquet").groupBy(F.col("label").cast("long").alias("topic")).agg(F.count("*").alias("n"), (F.min("vec_id") + 1).alias("opened"))
    return L.run_available(rows, "entries", "complete")


@query("tumbling_counts", "SELECT date_trunc('day', ts)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    """Daily windows with a watermark, run as a stream to its end."""
    rows = L.event_stream(spark, f"{d}/events.parquet").withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    out = L.run_available(rows, "tumbling", "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", "total")


@query("sliding_counts", "SELECT w::VARCHAR AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY w")
def sliding_counts(spark, d):
    """Windows of two days, one each day."""
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("session_counts", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id")
def session_counts(spark, d):
    """Sessions with gaps of six hours."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("journal_growth", "SELECT vec_id + 1 AS ord, count(*) FILTER (r = 1) OVER (ORDER BY vec_id) AS entries FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)")
def journal_growth(spark, d):
    """The number of journal entries after each row: the openings are ranked, and each row
    takes the rank of the last opening at or before it, by ranges of the order."""
    from pyspark.sql import Window

    from ..operators.journal import first_seen

    s = first_seen(spans(spark, d).select("ord", "topic")).withColumn("part", F.floor(F.col("ord") / 65_536))
    new = F.when(F.col("is_repeat"), 0).otherwise(1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = s.groupBy("part").agg(F.sum(new).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.sum(new).over(Window.partitionBy("part").orderBy("ord"))
    return s.withColumn("n", inside).join(parts, "part").select("ord", (F.col("base") + F.col("n")).cast("long").alias("entries"))
