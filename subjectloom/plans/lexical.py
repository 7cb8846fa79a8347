"""Vector and lexical queries: transforms, centroids, TF-IDF, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import indexed as I
from ..operators import kernels as K
from ..operators import mixtures as X
from ..operators import similarity as M
from ..sources.folders import ranked, read_variants, write_variants
from .registry import query
from .tables import S, spans, table

NORM = "sqrt(list_dot_product(v, v))"
#: Raw embeddings as doubles: r(ord, topic, v).
RAW = "r AS (SELECT vec_id + 1 AS ord, label::BIGINT AS topic, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def digest(v="v"):
    """Two numbers that pin a vector down: its first coordinate and an index-weighted sum."""
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return [F.round(F.get(F.col(v), F.lit(0)), 6).alias("first"), F.round(weighted, 5).alias("weighted")]


DIGEST = "round(z[1], 6) AS first, round(list_sum(list_transform(z, lambda x, i: x * i)), 5) AS weighted"


@query("l2_normalize", f"WITH {RAW} SELECT ord, {DIGEST} FROM (SELECT ord, list_transform(v, lambda x: x * 3 / (3 * {NORM})) AS z FROM r)")
def l2_normalize(spark, d):
    s = spans(spark, d, normal=False).withColumn("v", V.scale(F.col("v"), F.lit(3.0)))
    return s.select("ord", V.normalize(F.col("v")).alias("v")).select("ord", *digest())


@query("center", f"WITH {S}, l AS (SELECT unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM s), m AS (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(x) AS a FROM l GROUP BY i)), c AS (SELECT ord, list_transform(list_zip(v, mu), lambda p: p[1] - p[2]) AS v FROM s, m) SELECT ord, {DIGEST} FROM (SELECT ord, list_transform(v, lambda x: x / {NORM}) AS z FROM c)")
def center(spark, d):
    return K.transform(spans(spark, d), "center").select("ord", *digest())


@query("variant_matrices", f"WITH {S}, l AS (SELECT unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM s), m AS (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(x) AS a FROM l GROUP BY i)), c AS (SELECT ord, list_transform(list_zip(v, mu), lambda p: p[1] - p[2]) AS v FROM s, m), z AS (SELECT 'raw' AS variant, ord, v AS z FROM s UNION ALL SELECT 'center', ord, list_transform(v, lambda x: x / {NORM}) FROM c UNION ALL SELECT 'reversed', ord, list_reverse(v) FROM s) SELECT variant, ord, {DIGEST} FROM z")
def variant_matrices(spark, d):
    """Saved matrices found by their folders, beside a variant that is computed anew."""
    rows = spans(spark, d).select("ord", "topic", "v")
    path = write_variants({"raw": rows, "center": K.transform(rows, "center").select("ord", "topic", "v")}, "variants")
    anew = rows.select("ord", F.reverse("v").alias("v"), F.lit("reversed").alias("variant"))
    return read_variants(spark, path).select("ord", "v", "variant").union(anew).select("variant", "ord", *digest())


@query("cosine_pairs", f"WITH {S} SELECT a.ord AS i, b.ord AS j, round(list_dot_product(a.v, b.v), 6) AS sim FROM s a JOIN s b ON a.ord < b.ord")
def cosine_pairs(spark, d):
    """All pairs, through the blocked self-join."""
    return M.cosine_pairs(spans(spark, d)).select("i", "j", F.round("sim", 6).alias("sim"))


@query("topic_centroid", f"WITH {S}, l AS (SELECT topic, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM s), c AS (SELECT topic, list(a ORDER BY i) AS v FROM (SELECT topic, i, avg(x) AS a FROM l GROUP BY topic, i) GROUP BY topic) SELECT topic, {DIGEST} FROM (SELECT topic, list_transform(v, lambda x: x / {NORM}) AS z FROM c)")
def topic_centroid(spark, d):
    return topic_centroids(spans(spark, d)).select("topic", *digest())


def topic_centroids(rows):
    """``topic, n, v``: normalised mean vectors; sums by dimension are combined before the shuffle."""
    means = rows.select("topic", F.posexplode("v").alias("i", "x")).groupBy("topic", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return means.groupBy("topic").agg(F.max("n").alias("n"), V.normalize(v).alias("v"))


@query("weighted_pool", f"WITH {S}, w AS (SELECT ord // 4 AS span, (ord % 4 + 1)::DOUBLE AS w, v FROM s), l AS (SELECT span, w, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM w), c AS (SELECT span, list(a ORDER BY i) AS v FROM (SELECT span, i, sum(x * w) / sum(w) AS a FROM l GROUP BY span, i) GROUP BY span) SELECT span, {DIGEST} FROM (SELECT span, list_transform(v, lambda x: x / {NORM}) AS z FROM c)")
def weighted_pool(spark, d):
    """Chunk vectors pooled by length: four rows play a span's chunks, with weights 1 to 4."""
    c = spans(spark, d).select(F.floor(F.col("ord") / 4).alias("span"), (F.col("ord") % 4 + 1).cast("double").alias("w"), F.posexplode("v").alias("i", "x"))
    means = c.groupBy("span", "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return means.groupBy("span").agg(V.normalize(v).alias("v")).select("span", *digest())


@query("sigma_estimates", f"WITH {S}, l AS (SELECT ord, topic, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM s), c AS (SELECT topic, i, avg(x) AS a FROM l GROUP BY topic, i), n AS (SELECT topic, sqrt(sum(a * a)) AS n FROM c GROUP BY topic), g AS (SELECT i, avg(x) AS a FROM l GROUP BY i), k AS (SELECT sqrt(sum(a * a)) AS n FROM g), w AS (SELECT ord, 2 - 2 * sum(x * c.a) / any_value(n.n) AS d FROM l JOIN c USING (topic, i) JOIN n USING (topic) GROUP BY ord), o AS (SELECT ord, 2 - 2 * sum(x * g.a) / any_value(k.n) AS d FROM l JOIN g USING (i), k GROUP BY ord) SELECT round(greatest((SELECT avg(d) FROM w), 0.001), 6) AS sigma2, round(greatest((SELECT avg(d) FROM o), 0.001), 6) AS sigma0")
def sigma_estimates(spark, d):
    return sigmas(spans(spark, d)).select(F.round("sigma2", 6).alias("sigma2"), F.round("sigma0", 6).alias("sigma0"))


def sigmas(s):
    """``sigma2, sigma0``: mean squared distance of unit vectors to the own topic's centroid,
    and to the global one, 0.001 at least.  The mean cosine to a normalised mean is the
    length of that mean, so sums by topic and dimension are all that is needed."""
    sums = s.select("topic", F.posexplode("v").alias("i", "x")).groupBy("topic", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    topics = sums.groupBy("topic").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("w"), F.max("n").alias("n")).agg((2 - 2 * F.sum("w") / F.sum("n")).alias("w"))
    every = sums.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).agg((2 - 2 * F.sqrt(F.sum(F.col("x") * F.col("x"))) / F.max("n")).alias("g"))
    both = topics.select("w", none.alias("g")).union(every.select(none.alias("w"), "g"))
    return both.agg(F.greatest(F.max("w"), F.lit(0.001)).alias("sigma2"), F.greatest(F.max("g"), F.lit(0.001)).alias("sigma0"))


@query("same_diff_gap", f"WITH {S}, p AS (SELECT a.topic = b.topic AS same, list_dot_product(a.v, b.v) AS sim FROM s a JOIN s b ON a.ord < b.ord) SELECT round(avg(sim) FILTER (same), 6) AS mean_same, round(avg(sim) FILTER (NOT same), 6) AS mean_diff, round(avg(sim) FILTER (same) - avg(sim) FILTER (NOT same), 6) AS gap FROM p")
def same_diff_gap(spark, d):
    """Mean similarities within and across topics without forming pairs: sums of all dot
    products are squared norms of vector sums."""
    s = spans(spark, d)
    own = s.select("topic", F.posexplode("v").alias("i", "x")).groupBy("topic", "i").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    topic = own.groupBy("topic").agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.sum("q").alias("q"), F.max("n").cast("double").alias("n"))
    same = topic.agg((F.sum(F.col("s") - F.col("q")) / 2).alias("dots"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    every = own.groupBy("i").agg(F.sum("x").alias("x"), F.sum("q").alias("q"), F.sum("n").cast("double").alias("n")).agg(((F.sum(F.col("x") * F.col("x")) - F.sum("q")) / 2).alias("all_dots"), F.max(F.col("n") * (F.col("n") - 1) / 2).alias("all_pairs"))
    both = same.withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one")
    ms, md = F.col("dots") / F.col("pairs"), (F.col("all_dots") - F.col("dots")) / (F.col("all_pairs") - F.col("pairs"))
    return both.select(F.round(ms, 6).alias("mean_same"), F.round(md, 6).alias("mean_diff"), F.round(ms - md, 6).alias("gap"))


@query("clip_distance", f"WITH {S} SELECT a.ord AS i, b.ord AS j, round(greatest(0, 1 - list_dot_product(a.v, b.v)), 6) AS distance, round(greatest(list_dot_product(a.v, b.v), 0), 6) AS affinity FROM s a JOIN s b ON a.ord < b.ord")
def clip_distance(spark, d):
    p = M.cosine_pairs(spans(spark, d))
    return p.select("i", "j", F.round(F.greatest(F.lit(0.0), 1 - F.col("sim")), 6).alias("distance"), F.round(F.greatest(F.col("sim"), F.lit(0.0)), 6).alias("affinity"))


# ------------------------------------------------------------------ TF-IDF

TF = r"""cv AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
tk AS (SELECT conv_id, list_transform(regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{M}\p{N}_])([\p{L}\p{M}\p{N}_]{2,})', 1), lambda x: x) AS w FROM cv),
tm AS (SELECT conv_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tk),
tf AS (SELECT conv_id, term, count(*) AS tf FROM tm GROUP BY ALL),
nd AS (SELECT count(*)::DOUBLE AS n FROM tk),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
kp AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, nd WHERE df >= 2 AND df <= 0.85 * n ORDER BY cf DESC, term LIMIT 50000),
rw AS (SELECT conv_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN kp USING (term)),
ln_ AS (SELECT conv_id, sqrt(sum(raw * raw)) AS len FROM rw GROUP BY conv_id),
wt AS (SELECT conv_id, term, raw / len AS weight FROM rw JOIN ln_ USING (conv_id))"""


def whole_conversations(spark, d):
    """``conv_id, text``: all turns of a conversation, in order."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns, " ").alias("text"))


def _weights(spark, d):
    return M.tfidf(whole_conversations(spark, d), "conv_id", "text")


@query("tfidf_weights", f"WITH {TF} SELECT conv_id, term, round(weight, 6) AS weight FROM wt")
def tfidf_weights(spark, d):
    return _weights(spark, d).select("conv_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_topk_terms", f"WITH {TF} SELECT conv_id, term, round(weight, 6) AS weight, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(weight, 9) DESC, term) AS r FROM wt) WHERE r <= 5")
def tfidf_topk_terms(spark, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.round("weight", 9)), "term"))
    return _weights(spark, d).withColumn("rank", r.cast("long")).where("rank <= 5").select("conv_id", "term", F.round("weight", 6).alias("weight"), "rank")


@query("tfidf_pairs", f"WITH {TF} SELECT a.conv_id AS i, b.conv_id AS j, round(sum(a.weight * b.weight), 6) AS sim FROM wt a JOIN wt b ON a.term = b.term AND a.conv_id < b.conv_id GROUP BY 1, 2")
def tfidf_pairs(spark, d):
    return M.sparse_pairs(_weights(spark, d), "conv_id").select("i", "j", F.round("sim", 6).alias("sim"))


@query("tfidf_near", f"WITH {TF}, p AS (SELECT a.conv_id AS i, b.conv_id AS j, round(sum(a.weight * b.weight), 9) AS sim FROM wt a JOIN wt b ON a.term = b.term AND a.conv_id < b.conv_id GROUP BY 1, 2) SELECT i, j, round(sim, 6) AS sim FROM p WHERE sim >= 0.25")
def tfidf_near(spark, d):
    """Conversations with a TF-IDF similarity of a quarter or more, found inside the products of blocks."""
    return X.lexical_above(_weights(spark, d), "conv_id", 0.25).select("i", "j", F.round("sim", 6).alias("sim"))


@query("document_frequency", f"WITH {TF} SELECT term, df, cf::BIGINT AS cf FROM df WHERE df >= 2")
def document_frequency(spark, d):
    tf = M.terms(whole_conversations(spark, d), "conv_id", "text")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 2")


@query("hybrid_fusion", f"WITH {S}, {TF}, d AS (SELECT a.ord - 1 AS i, b.ord - 1 AS j, a.topic = b.topic AS same, list_dot_product(a.v, b.v) AS sim FROM s a JOIN s b ON a.ord < b.ord), x AS (SELECT a.conv_id AS i, b.conv_id AS j, sum(a.weight * b.weight) AS lex FROM wt a JOIN wt b ON a.term = b.term AND a.conv_id < b.conv_id GROUP BY 1, 2) SELECT alpha, i, j, same, round(alpha * coalesce(lex, 0) + (1 - alpha) * sim, 6) AS sim FROM d LEFT JOIN x USING (i, j), (SELECT unnest([0.0, 0.4, 0.6, 1.0])::DOUBLE AS alpha)")
def hybrid_fusion(spark, d):
    """Dense and lexical similarities of all spans (conversation n, where there is one, lends
    span n its text)."""
    return X.fused_pairs(mixed_spans(spark, d), [0.0, 0.4, 0.6, 1.0]).select("alpha", "i", "j", "same", F.round("sim", 6).alias("sim"))


def mixed_spans(spark, d):
    """Spans by number from 0, with the entries of the conversation of the same number."""
    return X.mixed(spans(spark, d).withColumn("i", F.col("ord") - 1), _weights(spark, d), "conv_id")


# ------------------------------------------------------------------ kernels


@query("abtt_k")
def abtt_k(spark, d):
    """Rows with the top two directions removed; cosines are free of sign choices."""
    return _pair_cosines(K.transform(spans(spark, d), "abtt2"))


@query("whiten_d")
def whiten_d(spark, d):
    return _pair_cosines(K.transform(spans(spark, d), "whiten20"))


def _pair_cosines(rows):
    """The cosine of each row with the next one."""
    nxt = rows.select((F.col("ord") - 1).alias("ord"), F.col("v").alias("w"))
    return rows.join(nxt, "ord").select("ord", F.round(V.dot(F.col("v"), F.col("w")), 5).alias("cos"))


@query("geometric_median")
def geometric_median(spark, d):
    return K.topic_medians(spans(spark, d)).select("topic", "n", *digest())


@query("fuzzy_ratio_pairs")
def fuzzy_ratio_pairs(spark, d):
    """Topic titles that resemble each other by the indel ratio, 60 or more."""
    return I.fuzzy_above(topic_titles(spark, d), 60.0)


@query("leader_clusters")
def leader_clusters(spark, d):
    t = topic_titles(spark, d)
    return M.leader_clusters(t, I.fuzzy_above(t, 60.0))


def topic_titles(spark, d):
    """``pos, s``: the distinct topic titles of all transcripts, in first-seen order."""
    from ..functions import text as T
    from .tables import protocols

    raw = protocols(spark, d).select("doc_id", F.posexplode(T.between_tags(F.col("text"), T.TOPIC_TAG)).alias("at", "s"))
    first = raw.groupBy("s").agg(F.min(F.struct("doc_id", "at")).alias("o"))
    return ranked(first, ["o"], "pos").select("s", "pos")
