"""Mixing sources to target weights by a Pfair schedule.

Baruah, Cohen, Plaxton and Varvel, "Proportionate progress" (1996).  Every
source is a task of integer weight p out of the period P, so that its block i
(from 0) has release floor(i P / p) and deadline ceil((i + 1) P / p).  In each
slot, earliest deadline first picks among the released blocks; with one slot at a
time this meets every deadline, so after t slots each source has had between
t p / P - 1 and t p / P + 1 blocks, exclusive: less than one block of deviation.

The schedule repeats after P slots, so only one period is simulated.  Sources of one
weight have the same releases and deadlines; they take turns by name, and the fold
over the slots holds one counter for each *different* weight.  As weights sum to P
there are fewer than sqrt(2 P) of those, whatever the number of sources.  Block i of a
source then has the slot floor(i / p) * P + slot[i mod p].

Rows get their place in their source from a hash of the id: sources are dealt into
``shards`` ranges of the hash, so that a source with a third of all rows is ranked
in many tasks; offsets come from the shards' counts.

A source that runs out leaves its later slots empty; the others keep their slots
and so their order.  ``in_mix`` marks the slots before the first source runs out:
there the weights hold exactly; later rows are kept as surplus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stage

#: Slots of a period where none is given: SLOTS_A_SOURCE for each source, within these
#: bounds.  Each source gets one slot at least, so with more sources a period is longer.
SLOTS_A_SOURCE, LEAST_PERIOD, MOST_SCALED = 100, 1_000, 20_000
#: Slots that the fold appends one by one before it closes a chunk.
CHUNK = 512


def weights_of(docs: DataFrame, source_col: str, exponent: float, period: int | None = None) -> DataFrame:
    """``source, n, p``: rows and integer weight; p is ``period`` times n^exponent's
    share, rounded, 1 at least."""
    counts = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("power", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    total = shares.select(F.sum("power")).scalar()
    slots = F.lit(period) if period else shares.select(F.greatest(F.lit(LEAST_PERIOD), F.least(F.count("*") * SLOTS_A_SOURCE, F.lit(MOST_SCALED)))).scalar()
    return shares.select("source", "n", F.greatest(F.lit(1), F.floor(F.col("power") / total * slots + 0.5)).cast("long").alias("p"))


def schedule(weights: DataFrame) -> DataFrame:
    """``source, n, p, period, slots``: the slots of each source's p blocks in one period,
    ascending.  Ties of deadlines go to the lesser weight, those of one weight to the
    lesser source name."""
    classes = weights.groupBy("p").agg(F.count("*").alias("m"))
    one = classes.groupBy(F.lit(1).alias("one")).agg(F.sum(F.col("p") * F.col("m")).alias("period"), F.array_sort(F.collect_list(F.struct("p", "m"))).alias("classes"))
    period = F.col("period")

    def place(state, t):
        """One slot: the class whose next block is released and due first."""
        open_ = F.filter(
            F.transform("classes", lambda x, c: F.struct(c.alias("c"), x["p"].alias("p"), F.floor(F.get(state["given"], c) / x["m"]).alias("i"))),
            lambda y: (y["i"] < y["p"]) & (F.floor(y["i"] * period / y["p"]) <= t),
        )
        best = F.array_min(F.transform(open_, lambda y: F.struct(F.ceil((y["i"] + 1) * period / y["p"]).alias("d"), y["c"].alias("c"))))["c"]
        return F.struct(F.transform(state["given"], lambda g, c: g + F.when(c == best, 1).otherwise(0)).alias("given"), F.concat(state["picked"], F.array(best)).alias("picked"))

    def chunk(state, start):
        inner = F.struct(state["given"].alias("given"), F.array().cast("array<int>").alias("picked"))
        done = F.aggregate(F.sequence(start, F.least(start + CHUNK, period) - 1), inner, place)
        return F.struct(done["given"].alias("given"), F.concat(state["chunks"], F.array(done["picked"])).alias("chunks"))

    first = F.struct(F.transform("classes", lambda x: F.lit(0).cast("long")).alias("given"), F.array().cast("array<array<int>>").alias("chunks"))
    picked = F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1, F.lit(CHUNK).cast("long")), first, chunk, lambda s: s["chunks"]))
    slots = one.select("period", "classes", picked.alias("picked")).select("period", F.posexplode(F.transform("picked", lambda c: F.get("classes", c)["p"])).alias("t", "p"))
    # Block b of a class of m sources is block b div m of its source b mod m.
    numbered = slots.join(classes, "p").withColumn("b", F.row_number().over(Window.partitionBy("p").orderBy("t")) - 1)
    numbered = numbered.select("p", "period", F.col("t").cast("long").alias("t"), F.pmod("b", "m").cast("long").alias("k"))
    members = weights.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("source")).cast("long") - 1)
    return members.join(numbered, ["p", "k"]).groupBy("source", "n", "p", "period").agg(F.array_sort(F.collect_list("t")).alias("slots"))


def _slot(i, p="p"):
    return F.floor(i / F.col(p)).cast("long") * F.col("period") + F.get("slots", F.pmod(i, F.col(p)).cast("int"))


def pfair_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", block: int = 8, exponent: float = 0.5, period: int | None = None, shards: int = 4096, weights: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` and ``mix_block, mix_slot, mix_rank, in_mix``; order by
    ``mix_slot, mix_rank`` to read the mixture.

    ``weights`` (``source, n, p``) replaces the default of weights in proportion to
    n^exponent.  Defined results: null and empty sources are one source '';
    rows repeated with one id keep places of their own (ranked by the hash of the
    id, then the id; equal rows are interchangeable); a null id hashes as ''; a
    source of ``weights`` without rows is skipped; an empty table gives an
    empty result.  Columns that already have one of the new names are replaced; all
    others are carried in one struct, so no name of theirs can clash.
    """
    names = ("mix_block", "mix_slot", "mix_rank", "in_mix")
    docs = docs.drop(*names)
    plan = stage(schedule(weights if weights is not None else weights_of(docs, source_col, exponent, period)), "schedule")
    key = F.coalesce(F.col(source_col), F.lit(""))
    mark = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    shard = F.floor(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") * shards / (1 << 32)).cast("int")
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("source"), mark.alias("mark"), shard.alias("shard"), F.col(id_col).alias("id"))
    sizes = placed.groupBy("source", "shard").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("source", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    horizon = plan.select(_slot(F.floor(F.col("n") / block)).alias("end")).select(F.min("end")).scalar()
    rank = F.row_number().over(Window.partitionBy("source", "shard").orderBy("mark", "id"))
    ranked = placed.withColumn("place", rank).join(sizes, ["source", "shard"]).withColumn("place", F.col("before") + F.col("place") - 1)
    timed = plan.select("source", F.col("n").alias("n_rows"), "p", "period", "slots")
    out = spread_join(ranked.select("row", "source", "place"), timed, "source", ["place"])
    out = out.withColumn("mix_block", F.floor(F.col("place") / block).cast("long")).withColumn("mix_slot", _slot(F.col("mix_block")))
    return out.select("row.*", "mix_block", "mix_slot", F.pmod("place", F.lit(block)).cast("long").alias("mix_rank"), (F.col("mix_slot") < horizon).alias("in_mix"))


def op3_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """The schedule of the whole of ``documents`` (no text is read)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return pfair_mix(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_rank", "in_mix")


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT s, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM d GROUP BY s),
q AS (SELECT greatest({LEAST_PERIOD}, least({SLOTS_A_SOURCE} * count(*), {MOST_SCALED})) AS slots, sum(w) AS total FROM c),
p AS (SELECT s, n, greatest(1, floor(w / total * slots + 0.5))::BIGINT AS p FROM c, q),
cl AS (SELECT p, count(*) AS m FROM p GROUP BY p),
k AS (SELECT list(struct_pack(p := p, m := m) ORDER BY p) AS classes, sum(p * m)::BIGINT AS period FROM cl),
e(t, given, pick) AS (
  SELECT -1::BIGINT, list_transform(classes, lambda x: 0::BIGINT), NULL::BIGINT FROM k
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, i: g + (i = b)::BIGINT), b FROM (
    SELECT t, given, list_min(list_filter(list_transform(classes, lambda x, i: CASE WHEN given[i] // x.m < x.p AND (given[i] // x.m * period) // x.p <= t + 1
      THEN struct_pack(d := -((-(given[i] // x.m + 1) * period) // x.p), i := i::BIGINT) END), lambda y: y IS NOT NULL)).i AS b
    FROM e, k WHERE t + 1 < period)),
bl AS (SELECT t, z.p, m, row_number() OVER (PARTITION BY z.p ORDER BY t) - 1 AS b FROM (SELECT t, classes[pick].p AS p FROM e, k WHERE t >= 0) z JOIN cl USING (p)),
mb AS (SELECT s, n, p, row_number() OVER (PARTITION BY p ORDER BY s) - 1 AS j FROM p),
pl AS (SELECT s, n, mb.p, period, list(t ORDER BY t) AS slots FROM mb JOIN bl ON bl.p = mb.p AND b % m = j, k GROUP BY ALL),
hz AS (SELECT min((n // 8) // p * period + slots[(n // 8) % p + 1]) AS horizon FROM pl),
r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS i FROM d)
SELECT doc_id, source, i // 8 AS mix_block, (i // 8) // p * period + slots[(i // 8) % p + 1] AS mix_slot, i % 8 AS mix_rank,
       (i // 8) // p * period + slots[(i // 8) % p + 1] < horizon AS in_mix
FROM r JOIN pl USING (s), hz
"""
