"""Metric queries: separability, partitions, agreement, pairwise sweeps, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import journal as J
from ..operators import kernels as K
from ..operators import metrics as E
from ..operators import mixtures as X
from ..operators import similarity as M
from ..sources.folders import keep
from .journals import _RANKS, shortlist_events
from .lexical import TF
from .registry import query
from .tables import S, curve_sql, grid_sql, points_sql, spans, table

PAIRS = f"{S}, pr_ AS (SELECT a.topic = b.topic AS is_repeat, round(list_dot_product(a.v, b.v), 9) AS sim FROM s a JOIN s b ON a.ord < b.ord)"
PARTS = "q AS (SELECT lang AS g, source AS p FROM documents)"
CELLS = f"{PARTS}, c AS (SELECT g, p, count(*)::DOUBLE AS n FROM q GROUP BY ALL), a AS (SELECT g, sum(n) AS a FROM c GROUP BY g), b AS (SELECT p, sum(n) AS b FROM c GROUP BY p)"


@query("auc_same_topic", f"WITH {PAIRS}, r AS (SELECT is_repeat, rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0::DOUBLE AS r FROM pr_) SELECT round((sum(r) FILTER (is_repeat) - count(*) FILTER (is_repeat)::DOUBLE * (count(*) FILTER (is_repeat) + 1) / 2) / (count(*) FILTER (is_repeat)::DOUBLE * count(*) FILTER (NOT is_repeat)), 6) AS auc FROM r")
def auc_same_topic(spark, d):
    """Separability of all pairs, counted inside the block products."""
    return spark.range(1).select(F.lit(M.pair_auc(spans(spark, d), 6)).cast("double").alias("auc"))


_RECURRING = PAIRS.replace("ON a.ord < b.ord)", "ON a.ord < b.ord WHERE a.topic IN (SELECT topic FROM s GROUP BY topic HAVING count(*) > 1) AND b.topic IN (SELECT topic FROM s GROUP BY topic HAVING count(*) > 1))")
_SWEEP = f"WITH {_RECURRING}, {curve_sql('pr_', 'sim', grid_sql(0.0, 1.0, 201), 'is_repeat', 'wrong_is_both')}"


@query("pairwise_sweep", _SWEEP + " SELECT * FROM curve")
def pairwise_sweep(spark, d):
    """The oracle pairwise curve over 201 thetas, in one pass over the pairs of rows whose
    topic recurs."""
    rows, grid = M.recurring(spans(spark, d)), V.linear_grid(0.0, 1.0, 201)
    return J.curve_of(_passed(rows, grid), grid, convention="wrong_is_both")


def _passed(rows, grid):
    """``k, a, b, c``: pairs counted inside the products by the number of grid values that they pass; a pair of
    one topic is right."""
    n = M.pair_counts(rows, lambda s: np.searchsorted(grid, s, "right")).withColumnRenamed("bin", "k")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return n.groupBy("k").agg(of(F.col("same")).alias("a"), F.lit(0).cast("long").alias("b"), of(~F.col("same")).alias("c"))


@query("pairwise_best_f1", _SWEEP + points_sql("first"))
def pairwise_best_f1(spark, d):
    return J.operating_points(pairwise_sweep(spark, d), default="first")


@query("ari", f"WITH {CELLS}, x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(a * (a - 1) / 2) FROM a) AS i, (SELECT sum(b * (b - 1) / 2) FROM b) AS j, (SELECT sum(n) FROM c) AS t) SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 8) AS ari FROM x")
def ari(spark, d):
    return E.adjusted_rand(table(spark, d, "documents"), "lang", "source").select(F.round("ari", 8).alias("ari"))


@query("nmi_v", f"WITH {CELLS}, t AS (SELECT sum(n) AS t FROM c), x AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS hg, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hp, (SELECT sum(n / t * ln(n * t / (a * b))) FROM c JOIN a USING (g) JOIN b USING (p), t) AS mi) SELECT round(mi / hg, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * (mi / hg) * (mi / hp) / (mi / hg + mi / hp), 6) AS v, round(2 * (mi / hg) * (mi / hp) / (mi / hg + mi / hp), 6) AS nmi FROM x")
def nmi_v(spark, d):
    r = E.v_measure(table(spark, d, "documents"), "lang", "source")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("pairwise_f1", f"WITH {CELLS}, x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(a * (a - 1) / 2) FROM a) AS i, (SELECT sum(b * (b - 1) / 2) FROM b) AS j) SELECT round(ij / j, 6) AS precision, round(ij / i, 6) AS recall, round(2 * (ij / j) * (ij / i) / (ij / j + ij / i), 6) AS f1 FROM x")
def pairwise_f1(spark, d):
    r = E.pairwise_f1(table(spark, d, "documents"), "lang", "source")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query("cohen_kappa", "WITH v AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS same FROM v), e AS (SELECT sum(x * y) AS xy FROM (SELECT a AS k, count(*)::DOUBLE AS x FROM v GROUP BY a) JOIN (SELECT b AS k, count(*)::DOUBLE AS y FROM v GROUP BY b) USING (k)) SELECT n, round(same / n, 6) AS observed, round(xy / (n * n), 6) AS expected, round((same / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM t, e")
def cohen_kappa(spark, d):
    """Agreement of two annotators: quality, and the absence of toxicity."""
    r = E.cohen_kappa(table(spark, d, "labels").select("quality", (1 - F.col("toxic")).alias("clean")), "quality", "clean")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


_VOTES = "v AS (SELECT doc_id, 0 AS o, quality AS label FROM labels UNION ALL SELECT doc_id, 1, 1 - toxic FROM labels UNION ALL SELECT doc_id, 2, (doc_id % 3)::INT FROM labels WHERE doc_id % 2 = 0)"


def _votes(spark, d):
    v = table(spark, d, "labels")
    three = v.where("doc_id % 2 = 0").select("doc_id", F.lit(2).alias("o"), (F.col("doc_id") % 3).cast("int").alias("label"))
    return v.select("doc_id", F.lit(0).alias("o"), F.col("quality").cast("int").alias("label")).union(v.select("doc_id", F.lit(1), (1 - F.col("toxic")).cast("int"))).union(three)


@query("majority_vote", f"WITH {_VOTES}, c AS (SELECT doc_id, label, count(*) AS c, min(o) AS o FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, o) AS r, sum(c) OVER (PARTITION BY doc_id) AS n FROM c) SELECT doc_id, CASE WHEN c >= 2 OR n = 1 THEN label END::INT AS label, c AS top, n::BIGINT AS n, CASE WHEN c >= 2 OR n = 1 THEN 'agreed' ELSE 'conflict' END AS status FROM r WHERE r = 1")
def majority_vote(spark, d):
    return E.majority(_votes(spark, d), "doc_id", "label", "o")


@query("agreement_stats", f"WITH {_VOTES}, c AS (SELECT doc_id, label, count(*) AS c FROM v GROUP BY ALL), m AS (SELECT doc_id, max(c) AS c, sum(c) AS n FROM c GROUP BY doc_id) SELECT count(*) AS adjudicated, count(*) FILTER (c >= 2 OR n = 1) AS agreed, count(*) FILTER (NOT (c >= 2 OR n = 1)) AS conflicts FROM m")
def agreement_stats(spark, d):
    m = majority_vote(spark, d)
    return m.agg(F.count("*").alias("adjudicated"), F.count_if(F.col("status") == "agreed").alias("agreed"), F.count_if(F.col("status") == "conflict").alias("conflicts"))


@query("percentile_neg", f"WITH {PAIRS} SELECT round(quantile_cont(sim, 0.2), 6) AS p20, count(*) AS n FROM pr_ WHERE NOT is_repeat")
def percentile_neg(spark, d):
    """The 20th percentile of cross-topic similarities, linearly interpolated."""
    value, n = M.pair_quantile_of(spans(spark, d), 0.2)
    return spark.range(1).select(F.round(F.lit(value).cast("double"), 6).alias("p20"), F.lit(n).cast("long").alias("n"))


@query("margin_histogram", f"WITH {PAIRS}, h AS (SELECT is_repeat, least(floor((sim + 1) / (2.0::DOUBLE / 30)), 29)::BIGINT AS bin, count(*) AS n FROM pr_ GROUP BY ALL) SELECT is_repeat, bin, n, round(n / (sum(n) OVER (PARTITION BY is_repeat) * (2.0::DOUBLE / 30)), 6) AS density FROM h")
def margin_histogram(spark, d):
    from pyspark.sql import Window

    width = 2.0 / 30
    h = M.pair_counts(spans(spark, d), lambda s: np.clip(np.floor((s + 1) / width), 0, 29)).withColumnRenamed("same", "is_repeat")
    total = F.sum("n").over(Window.partitionBy("is_repeat"))
    return h.select("is_repeat", "bin", "n", F.round(F.col("n") / (total * width), 6).alias("density"))


def _confusion_sql(convention: str) -> str:
    fn = "is_repeat AND (NOT l OR NOT ok)" if convention == "wrong_is_both" else "is_repeat AND NOT l"
    return f"SELECT count(*) FILTER (l AND is_repeat AND ok) AS tp, count(*) FILTER (l AND NOT (is_repeat AND ok)) AS fp, count(*) FILTER ({fn}) AS fn, count(*) FILTER (NOT l AND NOT is_repeat) AS tn FROM (SELECT quality = 1 AS is_repeat, doc_id % 3 > 0 AS l, doc_id % 2 = 0 AS ok FROM labels)"


def _confusion(spark, d, convention):
    return table(spark, d, "labels").agg(*J.outcome_counts(F.col("doc_id") % 3 > 0, F.col("quality") == 1, F.col("doc_id") % 2 == 0, convention))


query("confusion_wrong_is_fp", _confusion_sql("wrong_is_fp"))(lambda spark, d: _confusion(spark, d, "wrong_is_fp"))
query("confusion_wrong_is_both", _confusion_sql("wrong_is_both"))(lambda spark, d: _confusion(spark, d, "wrong_is_both"))


@query("strata_counts", "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other FROM documents GROUP BY source")
def strata_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"))


def _scored(led, by):
    """``by, ari, nmi`` of clusters against topics, a row for each variant."""
    return E.partition_scores(led, "topic", "cluster", by).select(by, F.round("ari", 4).alias("ari"), F.round("nmi", 4).alias("nmi"))


def _clusters(spark, d, method):
    led = keep(C.cluster(spans(spark, d), method, 10).withColumn("method", F.lit(method)), "led")
    return _scored(led, "method")


query("agglomerative")(lambda spark, d: _clusters(spark, d, "agglomerative"))
query("kmeans")(lambda spark, d: _clusters(spark, d, "kmeans"))
query("spectral")(lambda spark, d: _clusters(spark, d, "spectral"))


@query("kmeans_ml")
def kmeans_ml(spark, d):
    """k-means at scale: MLlib's distributed k-means|| on all rows, scored by ARI."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = spans(spark, d).select("topic", array_to_vector("v").alias("features"))
    out = KMeans(k=10, seed=0, maxIter=20, predictionCol="cluster").fit(rows).transform(rows)
    return E.adjusted_rand(out, "topic", "cluster")


@query("abtt_k_sweep")
def abtt_k_sweep(spark, d):
    """ARI and AUC by the number of removed directions, and the best row marked."""
    from pyspark.sql import Window

    rows = aucs = None
    for k in (0, 1, 2, 3, 5):
        moved = keep(K.transform(spans(spark, d), "raw" if k == 0 else f"abtt{k}"), "moved").withColumn("k", F.lit(k))
        auc = spark.range(1).select(F.lit(k).alias("k"), F.lit(M.pair_auc(moved, 4)).cast("double").alias("auc"))
        rows, aucs = (moved, auc) if rows is None else (rows.union(moved), aucs.union(auc))
    led = keep(C.cluster(rows, "agglomerative", 10, by="k"), "led")
    out = aucs.join(_scored(led, "k").drop("nmi"), "k")
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc("ari"), "k")) == 1)


_ALPHAS = [round(0.1 * i, 1) for i in range(11)]


@query("alpha_sweep", f"WITH {S}, {TF}, d AS (SELECT a.ord - 1 AS i, b.ord - 1 AS j, a.topic = b.topic AS same, list_dot_product(a.v, b.v) AS sim FROM s a JOIN s b ON a.ord < b.ord), x AS (SELECT a.conv_id AS i, b.conv_id AS j, sum(a.weight * b.weight) AS lex FROM wt a JOIN wt b ON a.term = b.term AND a.conv_id < b.conv_id GROUP BY 1, 2), f AS (SELECT alpha, same, round(alpha * coalesce(lex, 0) + (1 - alpha) * sim, 7) AS sim FROM d LEFT JOIN x USING (i, j), (SELECT unnest({_ALPHAS})::DOUBLE AS alpha)), r AS (SELECT alpha, same, rank() OVER (PARTITION BY alpha ORDER BY sim) + (count(*) OVER (PARTITION BY alpha, sim) - 1) / 2.0::DOUBLE AS r FROM f), u AS (SELECT alpha, round((sum(r) FILTER (same) - count(*) FILTER (same)::DOUBLE * (count(*) FILTER (same) + 1) / 2) / (count(*) FILTER (same)::DOUBLE * count(*) FILTER (NOT same)), 6) AS auc FROM r GROUP BY alpha) SELECT alpha, auc, row_number() OVER (ORDER BY round(auc, 4) DESC, alpha) = 1 AS best FROM u")
def alpha_sweep(spark, d):
    """Separability of the fused similarity by alpha, the best alpha marked.  Scores stand to
    seven digits, as in ``auc_same_topic`` to nine: sums of products differ in the last ones."""
    from pyspark.sql import Window

    from .lexical import mixed_spans

    auc = X.fused_auc(mixed_spans(spark, d), _ALPHAS).select("alpha", F.round("auc", 6).alias("auc"))
    return auc.withColumn("best", F.row_number().over(Window.orderBy(F.desc(F.round("auc", 4)), "alpha")) == 1)


def _recurring(rows):
    """Rows of one or more variants whose topic has two rows or more in each."""
    counts = rows.groupBy("variant", "topic").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(counts.drop("n"), ["variant", "topic"], "left_semi")


@query("hybrid_study")
def hybrid_study(spark, d):
    """Rows whose topic recurs, clustered on alpha * lexical + (1 - alpha) * dense: ARI by average linkage
    and by spectral clusters for each dense variant and alpha, the best of each variant and of all."""
    from pyspark.sql import Window

    from .lexical import _weights

    lex = _weights(spark, d).groupBy((F.col("conv_id") + 1).alias("ord")).agg(F.map_from_entries(F.collect_list(F.struct(F.xxhash64("term"), "weight"))).alias("m"))
    rows = None
    for kind in ("raw", "abtt1"):
        own = K.transform(spans(spark, d), kind).withColumn("variant", F.lit(kind))
        rows = own if rows is None else rows.union(own)
    none = F.create_map().cast("map<bigint,double>")
    rows = keep(_recurring(rows).join(lex, "ord", "left").withColumn("m", F.coalesce("m", none)), "rows")
    each = rows.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in _ALPHAS])))
    dense, lexical = F.sqrt(1 - F.col("alpha")), F.sqrt("alpha")
    scaled = each.select("ord", "topic", F.transform("v", lambda x: x * dense).alias("v"), F.transform_values("m", lambda k, x: x * lexical).alias("m"), F.concat_ws("|", "variant", F.col("alpha").cast("string")).alias("setting"))
    scaled = keep(scaled, "scaled")
    k = rows.select("topic").distinct().count()
    merged = C.cluster(scaled, "agglomerative", k, by="setting")
    # All settings share the products of the dense variants and of the lexical part.
    settings = [(f"{x}|{a}", x, a) for x in ("raw", "abtt1") for a in _ALPHAS]
    shared = rows.where("variant = 'raw'").select("ord", F.col("v").alias("raw"), "m").join(rows.where("variant = 'abtt1'").select("ord", F.col("v").alias("abtt1")), "ord")
    labels = C.kmeans_labels(keep(C.mixed_embedding(shared, ["raw", "abtt1"], settings, k), "embedding"), "e", k)
    split = rows.where("variant = 'raw'").select("ord", "topic").join(labels.withColumnRenamed("by", "setting"), "ord")
    out = None
    for method, led in (("agglomerative", merged), ("spectral", split)):
        part = _scored(keep(led.select("setting", "topic", "cluster"), "led"), "setting").select("setting", F.col("ari").alias(f"ari_{method}"))
        out = part if out is None else out.join(part, "setting")
    out = out.select(F.split("setting", r"\|")[0].alias("variant"), F.split("setting", r"\|")[1].cast("double").alias("alpha"), "ari_agglomerative", "ari_spectral")
    first = lambda score, *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "variant", "alpha")) == 1
    one = F.lit(1)
    return out.select("*", first("ari_agglomerative", "variant").alias("best_of_variant"), first("ari_agglomerative", one).alias("best_agglomerative"), first("ari_spectral", one).alias("best_spectral"))


@query("recall_summary", _RANKS + " SELECT count(*) AS events, round(avg(1.0::DOUBLE / rank), 6) AS mean_reciprocal_rank FROM ev")
def recall_summary(spark, d):
    return shortlist_events(spark, d).agg(F.count("*").alias("events"), F.round(F.avg(1 / F.col("rank")), 6).alias("mean_reciprocal_rank"))
