"""Text and JSON queries over ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonparse as J
from ..functions import text as T
from ..operators.dictionary import names_in
from .registry import query
from .tables import table

W = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("strip_numbering", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped FROM documents")
def strip_numbering(spark, d):
    """A number put before each text is stripped again."""
    return _docs(spark, d).select("doc_id", T.strip_numbering(F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit(".  "), T.trim_ws(F.col("text")))).alias("stripped"))


@query("normalize_ws", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def normalize_ws(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_ws(F.col("text")).alias("clean"))


@query("clean_span", "SELECT doc_id, trim(regexp_replace('a ' || text || ' b', '\\s+', ' ', 'g')) AS span FROM documents")
def clean_span(spark, d):
    """Speaker names and stray tags put around each text are cleaned away."""
    marked = F.concat(F.lit("a << דובר >> name: << דובר >>\n"), F.col("text"), F.lit("<< סיום >> b"))
    return _docs(spark, d).select("doc_id", T.clean_span(marked).alias("span"))


@query("first_speaker", "SELECT doc_id, (length(text) + 1)::BIGINT AS at FROM documents UNION ALL SELECT doc_id + 1000000, 1 FROM documents")
def first_speaker(spark, d):
    """Where the first speaker tag stands; 1 for texts without one."""
    r = _docs(spark, d)
    tagged = r.select("doc_id", T.first_speaker(F.concat("text", F.lit("<< יור >> x << יור >>"))).cast("long").alias("at"))
    return tagged.union(r.select(F.col("doc_id") + 1000000, T.first_speaker(F.col("text")).cast("long")))


@query("snippet_words", f"SELECT doc_id, array_to_string(({W})[1:40], ' ') AS snippet FROM documents")
def snippet_words(spark, d):
    return _docs(spark, d).select("doc_id", T.snippet(F.col("text"), 40).alias("snippet"))


@query("chunk_words", f"SELECT doc_id, i::BIGINT AS chunk, array_to_string(w[350 * i + 1:350 * i + 350], ' ') AS text, len(w[350 * i + 1:350 * i + 350])::BIGINT AS n_words FROM (SELECT doc_id, w, unnest(range(greatest(1, (len(w) + 349) // 350))) AS i FROM (SELECT doc_id, {W} AS w FROM documents))")
def chunk_words(spark, d):
    """Chunks of 350 words with their weights."""
    c = _docs(spark, d).select("doc_id", F.posexplode(T.chunks(F.col("text"), 350)).alias("i", "text"))
    return c.select("doc_id", F.col("i").cast("long").alias("chunk"), "text", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query("boilerplate_strip", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS stripped, 7::BIGINT AS n_removed FROM documents")
def boilerplate_strip(spark, d):
    """Procedural phrases woven into each text are stripped."""
    noisy = F.concat(F.lit("תודה רבה "), F.col("text"), F.lit(" מי בעד? מי נגד? מי נמנע?"))
    stripped = T.strip_procedural(noisy)
    before, after = T.word_count(noisy), T.word_count(stripped)
    return _docs(spark, d).where("text rlike '\\\\S'").select("doc_id", stripped.alias("stripped"), (before - after - 1).cast("long").alias("n_removed"))


@query("removal_ratio", f"SELECT lang, sum(n + 8)::BIGINT AS before, sum(n)::BIGINT AS after, round(1 - sum(n) / sum(n + 8), 6) AS removed FROM (SELECT lang, len({W}) AS n FROM documents) GROUP BY lang")
def removal_ratio(spark, d):
    """The share of words that stripping removes, by language."""
    noisy = F.concat(F.lit("תודה רבה "), F.col("text"), F.lit(" מי בעד? מי נגד? מי נמנע?"))
    r = _docs(spark, d).select("lang", T.word_count(noisy).alias("b"), T.word_count(T.strip_procedural(noisy)).alias("a"))
    return r.groupBy("lang").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.round(1 - F.sum("a") / F.sum("b"), 6).alias("removed"))


@query("dict_gate", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'רשות המיסים' WHEN 1 THEN 'משרד האוצר|רשות מקרקעי ישראל' ELSE '' END AS found FROM documents")
def dict_gate(spark, d):
    """Ministries that a text names, spelling variants merged."""
    k = F.col("doc_id") % 3
    named = F.concat("text", F.when(k == 0, " רשות המסים ").when(k == 1, ' משרד האוצר ו רמ"י ').otherwise(""))
    rows = names_in(_docs(spark, d).select("doc_id", named.alias("named")), "named", "names", T.MINISTRIES, T.MINISTRY_VARIANTS)
    return rows.select("doc_id", F.array_join("names", "|").alias("found"))


@query("gate_overlap", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, len(list_intersect(a.w, b.w))::BIGINT AS common FROM (SELECT n_nationkey, list_distinct(string_split(lower(n_name), '')) AS w FROM nation) a JOIN (SELECT n_nationkey, list_distinct(string_split(lower(n_name), '')) AS w FROM nation) b ON a.n_nationkey < b.n_nationkey WHERE len(list_intersect(a.w, b.w)) >= 4")
def gate_overlap(spark, d):
    """A set-overlap join: pairs that share four letters or more, met by shared letter."""
    n = table(spark, d, "nation").select("n_nationkey", F.explode(F.array_distinct(F.array_remove(F.split(F.lower("n_name"), ""), ""))).alias("c"))
    pairs = n.withColumnRenamed("n_nationkey", "a").join(n.withColumnRenamed("n_nationkey", "b"), "c").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common")).where("common >= 4")


@query("norm_tokens", "SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g')) AS tokens FROM documents")
def norm_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.normal_token(F.col("text")).alias("tokens"))


@query("stable_id_set", "WITH a AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g')) AS t FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_filter([t], lambda x: length(x) >= 3), CASE WHEN length(t) >= 3 THEN list_filter(string_split(t, ' '), lambda w: length(w) >= 4) ELSE [] END))), '|') AS ids FROM a")
def stable_id_set(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.stable_ids(F.array("p_name"))), "|").alias("ids"))


@query("word_stats", f"SELECT lang, count(*) AS n, sum(len({W}))::BIGINT AS words, sum(length(text))::BIGINT AS chars, min(substr(text, 1, 20)) AS preview FROM documents GROUP BY lang")
def word_stats(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum(T.word_count(F.col("text"))).alias("words"), F.sum(F.length("text").cast("long")).alias("chars"), F.min(F.substring("text", 1, 20)).alias("preview"))


@query("upper_median_words", f"SELECT lang, n::BIGINT AS upper_median FROM (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) AS r, count(*) OVER (PARTITION BY lang) AS c FROM (SELECT lang, len({W}) AS n FROM documents)) WHERE r = c // 2 + 1")
def upper_median_words(spark, d):
    """The element n // 2 of the sorted counts, from counts of counts (no group is sorted whole)."""
    from pyspark.sql import Window

    c = _docs(spark, d).groupBy("lang", T.word_count(F.col("text")).alias("w")).agg(F.count("*").alias("c"))
    run = Window.partitionBy("lang").orderBy("w")
    seen = c.withColumns({"upto": F.sum("c").over(run), "all": F.sum("c").over(Window.partitionBy("lang"))})
    at = F.floor(F.col("all") / 2) + 1
    return seen.where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)).select("lang", F.col("w").cast("long").alias("upper_median"))


@query("reply_cut", "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS reply FROM documents")
def reply_cut(spark, d):
    said = F.concat("text", F.lit("\nNEW SESSION x\n<segment>y"))
    return _docs(spark, d).select("doc_id", T.cut_reply(said).alias("reply"))


@query("plausible_title", "SELECT doc_id, NOT contains(substr(text, 1, 30), chr(10)) AND length(text) < 300 AS plausible FROM documents")
def plausible_title(spark, d):
    return _docs(spark, d).select("doc_id", T.plausible_title(F.col("text")).alias("plausible"))


@query("script_json", "SELECT doc_id, '{\"t\":\"' || replace(replace(lang || '<b>&' || source, '<', '\\u003c'), '>', '\\u003e') || '\"}' AS json FROM (SELECT doc_id, lang, source FROM documents)".replace("'<b>&'", "'<b>\\u0026'"))
def script_json(spark, d):
    """JSON that is safe inside a script element."""
    return _docs(spark, d).select("doc_id", T.script_safe(F.to_json(F.struct(F.concat("lang", F.lit("<b>&"), "source").alias("t")))).alias("json"))


# ---------------------------------------------------------------- JSON replies

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _reply():
    """Replies around the events' numbers: a fifth without JSON, a fifth with a null rank,
    a fifth with an unreadable number, a fifth far out of range."""
    k, e = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    text = lambda rank, conf: F.concat(F.lit('Sure. {"best_matched_rank": '), rank, F.lit(', "same_confidence": '), conf, F.lit("} done"))
    return F.when(e == 0, F.concat(F.lit("no verdict "), k)).when(e == 1, text(F.lit("null"), k)).when(e == 2, text(F.lit("1"), F.concat(F.lit('"'), k, F.lit('%"')))).when(e == 3, text(F.lit("2"), F.concat(F.lit("1"), k, F.lit("00")))).otherwise(text(F.lit("3"), F.concat(k, F.lit(".7"))))


@query("verdict_parse", f"SELECT event_id, CASE event_id % 5 WHEN 3 THEN 2 WHEN 4 THEN 3 END::BIGINT AS best_matched_rank, CASE event_id % 5 WHEN 3 THEN 100 WHEN 4 THEN least(100, {_K}) ELSE 0 END::BIGINT AS same_confidence, event_id % 5 IN (0, 2) AS parse_error FROM events")
def verdict_parse(spark, d):
    return table(spark, d, "events").select("event_id", J.verdict(_reply()).alias("v")).select("event_id", "v.best_matched_rank", "v.same_confidence", "v.parse_error")


@query("verdict_two_scores", f"SELECT event_id, least(100, {_K} + 50)::BIGINT AS topical_similarity, {_K}::BIGINT AS specific_match_confidence FROM events")
def verdict_two_scores(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    reply = F.concat(F.lit('{"best_matched_rank": 1, "topical_similarity": '), (k + 50).cast("string"), F.lit(', "specific_match_confidence": '), k.cast("string"), F.lit("}"))
    v = J.verdict(reply, ("topical_similarity", "specific_match_confidence"))
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", "v.topical_similarity", "v.specific_match_confidence")


@query("verdict_clamp", f"SELECT event_id, greatest(0, least(100, {_K} * 3 - 50))::BIGINT AS confidence FROM events")
def verdict_clamp(spark, d):
    return table(spark, d, "events").select("event_id", J.clamp(F.get_json_object("props", "$.k").cast("long") * 3 - 50).cast("long").alias("confidence"))


@query("score_fallback", f"SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN {_K} END, CASE WHEN event_id % 3 = 1 THEN {_K} + 1 END, 0)::BIGINT AS confidence FROM events")
def score_fallback(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", J.confidence(F.when(F.col("event_id") % 3 == 0, k), F.when(F.col("event_id") % 3 == 1, k + 1)).cast("long").alias("confidence"))


@query("score_parse", f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE {_K} END::BIGINT AS faithfulness, CASE WHEN event_id % 4 IN (0, 1) THEN 0 ELSE 7 END::BIGINT AS novelty, event_id % 4 IN (0, 1) AS parse_error FROM events")
def score_parse(spark, d):
    """Scores of a judge; a record with an unreadable second score keeps its first."""
    k, e = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    reply = F.when(e == 0, F.lit("nothing")).otherwise(F.concat(F.lit('x {"faithfulness": '), k, F.lit(', "novelty": '), F.when(e == 1, '"high"').otherwise("7"), F.lit("}")))
    return table(spark, d, "events").select("event_id", J.scores(reply, ("faithfulness", "novelty")).alias("s")).select("event_id", "s.faithfulness", "s.novelty", "s.parse_error")


@query("fingerprint_parse", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'm' || {_K} END AS ministry, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ',' || {_K} END AS entities, event_id % 3 = 0 AS parse_error FROM events")
def fingerprint_parse(spark, d):
    """Fingerprints with numbers among the strings; nested objects need the widest match."""
    k, bad = F.get_json_object("props", "$.k"), F.col("event_id") % 3 == 0
    good = F.concat(F.lit('>> {"ministry": "m'), k, F.lit('", "entities": ["'), F.col("event_type"), F.lit('", '), k, F.lit('], "extra": {"a": 1}, "laws_programs": null} <<'))
    fp = J.fingerprint(F.when(bad, '{"ministry": "m').otherwise(good))
    return table(spark, d, "events").select("event_id", fp.alias("f")).select("event_id", "f.ministry", F.array_join("f.entities", ",").alias("entities"), "f.parse_error")


@query("json_error_rate", "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 5 IN (0, 2)) AS errors FROM events GROUP BY event_type")
def json_error_rate(spark, d):
    v = table(spark, d, "events").select("event_type", J.verdict(_reply())["parse_error"].alias("e"))
    return v.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("e").alias("errors"))
