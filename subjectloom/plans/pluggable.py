"""End-to-end queries with stand-in models: encode, retrieve, verify, write and judge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import jsonparse as J
from ..functions import text as T
from ..functions import vectors as V
from ..operators import journal as G
from ..operators import models as M
from ..operators import similarity as Y
from ..sources.folders import keep
from .registry import query
from .tables import table


@query("encode_pool")
def encode_pool(spark, d):
    """Texts chunked, encoded, and pooled by chunk length."""
    c = table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), 350)).alias("i", "chunk"))
    e = M.apply_model(c.select("doc_id", "i", "chunk"), "chunk", "e", M.hashing_encoder(), "array<double>")
    long = e.select("doc_id", F.greatest(F.lit(1), T.word_count(F.col("chunk"))).cast("double").alias("w"), F.posexplode("e").alias("k", "x"))
    means = long.groupBy("doc_id", "k").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    v = V.normalize(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]))
    return means.groupBy("doc_id").agg(v.alias("v")).select("doc_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


def _retrieved(spark, d):
    """``q, t, rank, c``: each user turn against the ten best of all earlier user turns, of
    whatever conversation; turns are ordered by conversation and turn."""
    c = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    at = (F.col("conv_id").cast("long") * (1 << 20) + F.col("turn")).alias("at")
    e = keep(M.apply_model(c.select(at, "text"), "text", "v", M.hashing_encoder(), "array<double>"), "turns")
    # The query just before its own turn: entries up to it are the strictly earlier ones.
    best = Y.nearest_earlier(e.select((F.col("at") - 1).alias("q"), "v"), e.select("at", F.col("v").alias("c")), "at", 10)
    said = e.select(F.col("at").alias("t"), F.col("text").alias("q"))
    return best.select((F.col("q") + 1).alias("t"), "at", "rank").join(e.select("at", F.col("text").alias("c")), "at").join(said, "t")


@query("retrieve_verify")
def retrieve_verify(spark, d):
    """Retrieve, prompt, score, parse."""
    r = _retrieved(spark, d).groupBy("t").agg(F.first("q").alias("q"), F.array_sort(F.collect_list(F.struct("rank", "c"))).alias("cands"))
    line = F.transform("cands", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), T.snippet(x["c"], 40)))
    prompts = r.select("t", F.concat(T.snippet(F.col("q"), 40), F.lit("\n"), F.array_join(line, "\n")).alias("prompt"))
    said = M.apply_model(prompts, "prompt", "reply", M.overlap_scorer())
    said = said.select(F.shiftright("t", 20).alias("conv_id"), F.col("t").bitwiseAND((1 << 20) - 1).alias("t"), J.verdict(F.col("reply")).alias("v"))
    return said.select("conv_id", "t", "v.best_matched_rank", "v.same_confidence", "v.parse_error")


@query("verify_sweep")
def verify_sweep(spark, d):
    """The confidence curve of the stand-in verifier; even turns play repeats."""
    v = retrieve_verify(spark, d).withColumn("is_repeat", F.col("t") % 4 == 2).withColumn("sc", F.when(F.col("best_matched_rank").isNotNull(), F.col("same_confidence").cast("double")).otherwise(-1.0))
    return G.sweep(v, "sc", [5.0 * i for i in range(21)], F.col("best_matched_rank") == 1)


def _write(journal: str, text: str) -> str:
    """A stand-in writer: the first words of the new text that the journal does not have yet."""
    known = set(journal.split())
    return " ".join([w for w in text.split() if w not in known][:8])


#: DuckDB: the stand-in writer's logs, lg(conv_id, idx, words, entry words, words known before).
_LOGS = r"""c AS (SELECT conv_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations WHERE role = 'assistant'),
lg AS (SELECT conv_id, idx, w, w[1:8] AS e, []::VARCHAR[] AS known FROM c WHERE idx = 0
  UNION ALL SELECT conv_id, idx, w, list_filter(w, lambda x: NOT list_contains(had, x))[1:8], had FROM (SELECT c.conv_id, c.idx, c.w, list_concat(lg.known, lg.e) AS had FROM lg JOIN c ON c.conv_id = lg.conv_id AND c.idx = lg.idx + 1))"""


@query("log_writing", f"WITH RECURSIVE {_LOGS} SELECT conv_id, idx, idx = 0 AS is_opening, array_to_string(e, ' ') AS entry FROM lg")
def log_writing(spark, d):
    """Logs written incrementally, one conversation a chain."""
    return M.write_logs(table(spark, d, "conversations").where("role = 'assistant'"), "conv_id", "turn", "text", _write)


_SHARE = "CASE WHEN len(list_distinct(e)) > 0 THEN round(100.0::DOUBLE * {} / len(list_distinct(e)), 0) ELSE 0 END::BIGINT"


@query("log_judging", f"WITH RECURSIVE {_LOGS} SELECT conv_id, idx, idx = 0 AS is_opening, {_SHARE.format('len(list_filter(list_distinct(e), lambda x: list_contains(w, x)))')} AS faithfulness, CASE WHEN idx > 0 THEN {_SHARE.format('len(list_filter(list_distinct(e), lambda x: NOT list_contains(known, x)))')} END AS novelty FROM lg")
def log_judging(spark, d):
    """Written entries joined to their source by position and judged: the share of an
    entry's words that its source has, and how many the journal before it lacks."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    src = c.select("conv_id", "text", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("idx"))
    before = F.flatten(F.collect_list(T.words(F.col("entry"))).over(Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)))
    logs = log_writing(spark, d).withColumn("before", before).join(src, ["conv_id", "idx"])
    own = F.array_distinct(T.words(F.col("entry")))
    share = lambda part: F.when(F.size(own) > 0, F.round(100 * F.size(part) / F.size(own), 0)).otherwise(0.0).cast("long")
    return logs.select("conv_id", "idx", "is_opening", share(F.array_intersect(own, T.words(F.col("text")))).alias("faithfulness"), F.when(~F.col("is_opening"), share(F.array_except(own, F.coalesce("before", F.array().cast("array<string>"))))).alias("novelty"))


@query("fingerprint_extraction")
def fingerprint_extraction(spark, d):
    """Fingerprints by a stand-in extractor, then their stable id sets."""

    def load():
        import json

        return lambda prompts: [json.dumps({"ministry": "", "entities": p.split()[:3], "laws_programs": [], "request_numbers": ["7"], "matter": p[:10]}) for p in prompts]

    c = M.apply_model(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "reply", load)
    fp = J.fingerprint(F.col("reply"))
    return c.select("conv_id", "turn", fp.alias("f")).select("conv_id", "turn", F.array_join(F.array_sort(T.stable_ids(F.concat("f.laws_programs", "f.entities"))), "|").alias("ids"), "f.parse_error")
