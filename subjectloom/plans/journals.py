"""Journal queries over ``embeddings``: decision streams, rules, sweeps, shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import journal as J
from ..operators import kernels as K
from ..operators import metrics as E
from ..sources.folders import keep, swept
from .lexical import TF, sigmas
from .lexical import _weights as lexical_weights
from .registry import query
from .tables import DEC, S, TOP, curve_sql, grid_sql, points_sql, spans, table

MARGIN = "CASE WHEN second IS NULL THEN top ELSE top - second END"
PADDED = "CASE WHEN second IS NULL THEN top + 1 ELSE top - second END"


def _centroid(spark, d, single="self") -> DataFrame:
    return J.top_two(J.decisions(spans(spark, d)), single=single)


@query("link_centroid_margin", f"WITH {DEC}, {TOP} SELECT t, gold, is_repeat, best, round(top, 6) AS cos, round({MARGIN}, 6) AS margin FROM top")
def link_centroid_margin(spark, d):
    return _centroid(spark, d).select("t", "gold", "is_repeat", "best", F.round("top", 6).alias("cos"), F.round("margin", 6).alias("margin"))


def _margin_curve(spark, d, single="self", lo=0.0, hi=0.6):
    rows = _centroid(spark, d, single).withColumn("margin", F.round("margin", 9))
    return J.sweep(rows, "margin", V.linear_grid(lo, hi, 101), F.col("best") == F.col("gold"))


_MARGIN_SQL = f"WITH {DEC}, {TOP}, {curve_sql('top', f'round({MARGIN}, 9)', grid_sql(0.0, 0.6, 101), 'best = gold')}"
_THRESHOLD_SQL = f"WITH {DEC}, {TOP}, {curve_sql('top', 'round(top, 9)', grid_sql(-0.2, 1.0, 101), 'best = gold')}"


@query("link_margin_sweep", _MARGIN_SQL + " SELECT * FROM curve")
def link_margin_sweep(spark, d):
    return _margin_curve(spark, d)


@query("link_margin_summary", _MARGIN_SQL + points_sql())
def link_margin_summary(spark, d):
    return J.operating_points(_margin_curve(spark, d))


@query("link_threshold_sweep", _THRESHOLD_SQL + " SELECT * FROM curve")
def link_threshold_sweep(spark, d):
    rows = _centroid(spark, d).withColumn("top", F.round("top", 9))
    return J.sweep(rows, "top", V.linear_grid(-0.2, 1.0, 101), F.col("best") == F.col("gold"))


@query("link_threshold_summary_first", _THRESHOLD_SQL + points_sql("first"))
def link_threshold_summary_first(spark, d):
    return J.operating_points(link_threshold_sweep(spark, d), default="first")


_FIRST = f"""{S}, fs AS (SELECT topic, ord, v, lead(ord) OVER (PARTITION BY topic ORDER BY ord) AS nxt, row_number() OVER (PARTITION BY topic ORDER BY ord) AS size,
  first_value(v) OVER (PARTITION BY topic ORDER BY ord) AS fv FROM s), f AS (SELECT topic, min(ord) AS first FROM s GROUP BY topic),
dec AS (SELECT q.ord AS t, q.topic AS gold, e.topic AS entry, e.size, list_dot_product(q.v, e.fv) AS cos, q.ord > f.first AS is_repeat
        FROM s q JOIN fs e ON q.ord > e.ord AND (e.nxt IS NULL OR q.ord <= e.nxt) JOIN f ON f.topic = q.topic)"""


@query("entry_first_threshold", f"WITH {_FIRST}, {TOP}, {curve_sql('top', 'round(top, 9)', grid_sql(0.0, 1.0, 101), 'best = gold')} SELECT * FROM curve")
def entry_first_threshold(spark, d):
    rows = J.top_two(J.decisions(spans(spark, d), "first")).withColumn("top", F.round("top", 9))
    return J.sweep(rows, "top", V.linear_grid(0.0, 1.0, 101), F.col("best") == F.col("gold"))


def _members_sql(how: str) -> str:
    return f"""WITH {S}, f AS (SELECT topic, min(ord) AS first FROM s GROUP BY topic),
dec AS (SELECT q.ord AS t, q.topic AS gold, m.topic AS entry, count(*) AS size, {how}(list_dot_product(q.v, m.v)) AS cos, any_value(q.ord > f.first) AS is_repeat
        FROM s q JOIN s m ON m.ord < q.ord JOIN f ON f.topic = q.topic GROUP BY 1, 2, 3)
SELECT t, gold, entry, size::BIGINT AS size, round(cos, 6) AS cos, is_repeat FROM dec"""


def _members(spark, d, kind):
    return J.decisions(spans(spark, d), kind).select("t", "gold", "entry", "size", F.round("cos", 6).alias("cos"), "is_repeat")


query("entry_members_max", _members_sql("max"))(lambda spark, d: _members(spark, d, "members_max"))
query("entry_members_min", _members_sql("min"))(lambda spark, d: _members(spark, d, "members_min"))
query("entry_members_mean", _members_sql("avg"))(lambda spark, d: _members(spark, d, "members_mean"))


_D0 = """d0 AS (SELECT ord AS t, 2 - 2 * sum(x * m) / sqrt(sum(m * m)) AS d0_sq FROM (SELECT ord, i, x, sum(x) OVER (PARTITION BY i ORDER BY ord) AS m FROM l) GROUP BY ord)"""
SIGMA2, SIGMA0 = 0.6, 0.9


def _dp(spark, d, sized):
    """The bias at which each decision links: link score - new0 > bias, strictly."""
    s = spans(spark, d)
    scored = J.dp_scores(J.decisions(s), J.running_mean_distance(s).withColumnRenamed("ord", "t"), SIGMA2, SIGMA0, sized)
    best = J.top_two(scored.drop("d0_sq"), "link").join(scored.select("t", "new0").distinct(), "t")
    rows = best.withColumn("gain", F.round(F.col("top") - F.col("new0"), 9))
    return J.sweep(rows, "gain", V.linear_grid(-6, 6, 101), F.col("best") == F.col("gold"), strict=True)


def _dp_sql(sized: bool) -> str:
    prior = "ln(size::DOUBLE)" if sized else "0.0::DOUBLE"
    curve = curve_sql("gn", "gain", grid_sql(-6, 6, 101), "best = gold").replace(">= theta", "> theta")
    return f"""WITH {DEC}, {_D0},
ln_ AS (SELECT dec.*, {prior} - (2 - 2 * cos) / (2 * {SIGMA2}) AS link, -d0_sq / (2 * {SIGMA0}) AS new0 FROM dec JOIN d0 USING (t)),
gn AS (SELECT t, gold, is_repeat, entry AS best, round(link - new0, 9) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY link DESC, entry) AS r FROM ln_) WHERE r = 1), {curve}
SELECT * FROM curve"""


query("sweep_dp", _dp_sql(True))(lambda spark, d: _dp(spark, d, True))
query("sweep_dp_nosize", _dp_sql(False))(lambda spark, d: _dp(spark, d, False))


@query("running_mean_distance", f"WITH {DEC}, {_D0} SELECT t, round(d0_sq, 6) AS d0_sq FROM d0")
def running_mean_distance(spark, d):
    return J.running_mean_distance(spans(spark, d)).select(F.col("ord").alias("t"), F.round("d0_sq", 6).alias("d0_sq"))


FLOORS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]


@query("gate_2d", f"WITH {DEC}, {TOP}, fl AS (SELECT unnest({FLOORS})::DOUBLE AS floor), ga AS (SELECT floor, is_repeat, best, gold, CASE WHEN round(top, 9) >= floor THEN round({PADDED}, 9) END AS sc FROM top, fl), {curve_sql('ga', 'sc', grid_sql(0.0, 0.6, 31), 'best = gold', by='floor')} SELECT * FROM curve")
def gate_2d(spark, d):
    rows = _centroid(spark, d, "padded")
    floors = rows.select("*", F.explode(F.array(*[F.lit(f) for f in FLOORS])).alias("floor"))
    gated = floors.withColumn("sc", F.when(F.round("top", 9) >= F.col("floor"), F.round("margin", 9)).otherwise(-10.0))
    return J.sweep(gated, "sc", V.linear_grid(0.0, 0.6, 31), F.col("best") == F.col("gold"), by=["floor"])


_RANKS = f"""WITH {DEC}, ra AS (SELECT t, gold, entry, is_repeat, row_number() OVER (PARTITION BY t ORDER BY cos DESC, entry) AS rank, count(*) OVER (PARTITION BY t) AS pool FROM dec),
ev AS (SELECT t, gold, pool, rank FROM ra WHERE is_repeat AND entry = gold)"""


def shortlist_events(spark, d) -> DataFrame:
    """The rank of the true entry among all entries, for each repeat."""
    w = Window.partitionBy("t")
    ranked = J.decisions(spans(spark, d)).withColumns({"rank": F.row_number().over(w.orderBy(F.desc("cos"), "entry")), "pool": F.count("*").over(w)})
    return ranked.where(F.col("is_repeat") & (F.col("entry") == F.col("gold"))).select("t", "gold", "pool", F.col("rank").cast("long").alias("rank"))


@query("shortlist_events", _RANKS + " SELECT * FROM ev")
def shortlist_events_query(spark, d):
    return shortlist_events(spark, d)


@query("shortlist_recall", _RANKS + " SELECT k::BIGINT AS k, round(avg((rank <= k)::INT), 6) AS recall FROM ev, (SELECT unnest([1, 2, 3, 5, 10]) AS k) GROUP BY k")
def shortlist_recall(spark, d):
    ks = F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 5, 10)])).alias("k")
    return shortlist_events(spark, d).select("rank", ks).groupBy("k").agg(F.round(F.avg((F.col("rank") <= F.col("k")).cast("int")), 6).alias("recall"))


@query("pool_sizes", _RANKS + " SELECT min(pool)::BIGINT AS least, floor(median(pool))::BIGINT AS middle, max(pool)::BIGINT AS most FROM ev")
def pool_sizes(spark, d):
    return shortlist_events(spark, d).agg(F.min("pool").alias("least"), F.floor(F.percentile("pool", F.lit(0.5))).cast("long").alias("middle"), F.max("pool").alias("most"))


@query("rank_distribution", _RANKS + " SELECT rank, count(*) AS n FROM ev GROUP BY rank")
def rank_distribution(spark, d):
    return shortlist_events(spark, d).groupBy("rank").agg(F.count("*").alias("n"))


@query("miss_inspection", _RANKS + " SELECT ra.t, ra.gold, ra.entry, ra.rank, ev.rank AS true_rank, (ra.entry % 3) = (ra.gold % 3) AS same_committee FROM ra JOIN ev USING (t) WHERE ev.rank > 1 AND ra.rank < ev.rank")
def miss_inspection(spark, d):
    """Entries ranked above the true one; topics modulo 3 play committees."""
    w = Window.partitionBy("t").orderBy(F.desc("cos"), "entry")
    ranked = J.decisions(spans(spark, d)).select("t", "gold", "entry", F.row_number().over(w).cast("long").alias("rank"))
    true = shortlist_events(spark, d).where("rank > 1").select("t", F.col("rank").alias("true_rank"))
    return ranked.join(true, "t").where("rank < true_rank").withColumn("same_committee", F.col("entry") % 3 == F.col("gold") % 3)


@query("verifier_queries", f"WITH {DEC}, ra AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY cos DESC, entry) AS rank FROM dec) SELECT t, gold, is_repeat, max(rank) FILTER (entry = gold) AS gold_rank, count(*) AS n_candidates, string_agg(entry::VARCHAR, ',' ORDER BY rank) AS candidates FROM ra WHERE rank <= 10 GROUP BY t, gold, is_repeat")
def verifier_queries(spark, d):
    """The ten best entries of each decision, nested in rank order."""
    w = Window.partitionBy("t").orderBy(F.desc("cos"), "entry")
    ranked = J.decisions(spans(spark, d)).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")
    return ranked.groupBy("t", "gold", "is_repeat").agg(F.max(F.when(F.col("entry") == F.col("gold"), F.col("rank"))).alias("gold_rank"), F.count("*").alias("n_candidates"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"].cast("string")), ",").alias("candidates"))


BETAS = [0.0, 0.1, 0.3, 0.5, 1.0]
RERANK_BETAS, RERANK_GATES = [0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0], [0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5]
_SHORT = f"""{_FIRST}, sl AS (SELECT dec.*, f.first, row_number() OVER (PARTITION BY t ORDER BY cos DESC, entry) AS r1 FROM dec JOIN f ON f.topic = dec.entry),
sh AS (SELECT * FROM (SELECT *, max((entry = gold)::INT) OVER (PARTITION BY t) AS has FROM sl WHERE r1 <= 10 AND is_repeat) WHERE has = 1)"""


def _rerank_sql(weight: str, name: str, values: list[float]) -> str:
    return f"""re AS (SELECT {name}, t, gold, entry, row_number() OVER (PARTITION BY {name}, t ORDER BY round(cos + {name} * {weight}, 9) DESC, entry) AS r FROM wg, (SELECT unnest({values})::DOUBLE AS {name}))
SELECT {name}, count(*) AS events, round(avg((r = 1)::INT), 6) AS recall_1, round(avg((r <= 3)::INT), 6) AS recall_3 FROM re WHERE entry = gold GROUP BY {name}"""


def shortlists(spark, d) -> DataFrame:
    """``t, gold, entry, cos, first``: the ten entries nearest by their first members, of
    repeats whose true entry is among them; ``first`` is the entry's first row."""
    s = spans(spark, d)
    w = Window.partitionBy("t")
    short = J.decisions(s, "first").where("is_repeat").withColumn("r1", F.row_number().over(w.orderBy(F.desc("cos"), "entry"))).where("r1 <= 10")
    short = short.withColumn("has", F.max(F.col("entry") == F.col("gold")).over(w)).where("has")
    firsts = s.groupBy(F.col("topic").alias("entry")).agg(F.min("ord").alias("first"))
    return short.join(firsts, "entry").select("t", "gold", "entry", "cos", "first")


def _reranked(short: DataFrame, weight: str, name: str, values: list[float]) -> DataFrame:
    """Recall of the true entry at one and three, by the weight of the added score."""
    grid = short.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))
    order = Window.partitionBy(name, "t").orderBy(F.desc(F.round(F.col("cos") + F.col(name) * F.col(weight), 9)), "entry")
    ranked = grid.withColumn("r", F.row_number().over(order)).where("entry = gold")
    hit = lambda k: F.round(F.avg((F.col("r") <= k).cast("int")), 6).alias(f"recall_{k}")
    return ranked.groupBy(name).agg(F.count("*").alias("events"), hit(1), hit(3))


@query("rerank_fusion", f"WITH {_SHORT}, {TF}, lx AS (SELECT t, entry, sum(a.weight * b.weight) AS lex FROM sh JOIN wt a ON a.conv_id = t - 1 JOIN wt b ON b.conv_id = first - 1 AND a.term = b.term GROUP BY 1, 2), wg AS (SELECT sh.*, coalesce(lex, 0) AS lex FROM sh LEFT JOIN lx USING (t, entry)), {_rerank_sql('lex', 'beta', RERANK_BETAS)}")
def rerank_fusion(spark, d):
    """The shortlist reranked by dense + beta * TF-IDF similarity of the row and the entry's
    first row (conversation n lends row n its text, as in ``hybrid_fusion``).  Only shortlisted
    pairs look up their terms."""
    short, weights = keep(shortlists(spark, d), "short"), keep(lexical_weights(spark, d), "weights")
    a = weights.select((F.col("conv_id") + 1).alias("t"), "term", F.col("weight").alias("x"))
    b = weights.select((F.col("conv_id") + 1).alias("first"), "term", F.col("weight").alias("y"))
    lex = short.select("t", "entry", "first").join(a, "t").join(b, ["first", "term"]).groupBy("t", "entry").agg(F.sum(F.col("x") * F.col("y")).alias("lex"))
    both = short.join(lex, ["t", "entry"], "left").withColumn("lex", F.coalesce("lex", F.lit(0.0)))
    return _reranked(both, "lex", "beta", RERANK_BETAS)


@query("gate_rerank", f"WITH {_SHORT}, {TF}, tp AS (SELECT conv_id, list(term) AS own FROM (SELECT conv_id, term, row_number() OVER (PARTITION BY conv_id ORDER BY round(weight, 9) DESC, term) AS r FROM wt) WHERE r <= 20 GROUP BY conv_id), wg AS (SELECT sh.*, coalesce(list_has_any(a.own, b.own), false)::INT AS ov FROM sh LEFT JOIN tp a ON a.conv_id = t - 1 LEFT JOIN tp b ON b.conv_id = first - 1), {_rerank_sql('ov', 'gate', RERANK_GATES)}")
def gate_rerank(spark, d):
    """The shortlist reranked by dense + gate * overlap: whether row and entry share one of
    their twenty foremost terms (the gate's names come from the texts, not from labels)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.round("weight", 9)), "term")
    own = keep(lexical_weights(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 20").groupBy("conv_id").agg(F.collect_list("term").alias("own")), "names")
    a, b = own.select((F.col("conv_id") + 1).alias("t"), F.col("own").alias("x")), own.select((F.col("conv_id") + 1).alias("first"), F.col("own").alias("y"))
    short = shortlists(spark, d).join(a, "t", "left").join(b, "first", "left").withColumn("ov", F.coalesce(F.arrays_overlap("x", "y"), F.lit(False)).cast("int"))
    return _reranked(short, "ov", "gate", RERANK_GATES)


_HONEST = f"""WITH {S}, l AS (SELECT ord, topic, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM s),
mu AS (SELECT ord AS t, i, avg(x) OVER (PARTITION BY i ORDER BY ord) AS m FROM l),
mv AS (SELECT t, list(m ORDER BY i) AS m FROM mu GROUP BY t),
ce AS (SELECT mv.t, s.ord, s.topic, list_transform(list_zip(s.v, mv.m), lambda p: p[1] - p[2]) AS c FROM mv JOIN s ON s.ord <= mv.t),
cn AS (SELECT t, ord, topic, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-300)) AS z FROM ce),
pt AS (SELECT t, topic, i, avg(z[i]) AS c FROM cn, range(1, 65) r(i) WHERE ord < t GROUP BY t, topic, i),
pv AS (SELECT t, topic, list(c ORDER BY i) AS c FROM pt GROUP BY t, topic)
SELECT pv.t, pv.topic AS entry, round(list_dot_product(pv.c, cn.z) / sqrt(list_dot_product(pv.c, pv.c)), 5) AS cos FROM pv JOIN cn ON cn.t = pv.t AND cn.ord = pv.t"""


@query("honest_center_margin", _HONEST)
def honest_center_margin(spark, d):
    """All decisions with the centring refitted on each prefix."""
    return K.honest_decisions(spans(spark, d), "center").select("t", "entry", F.round("cos", 5).alias("cos"))


@query("honest_abtt_margin")
def honest_abtt_margin(spark, d):
    return K.honest_decisions(spans(spark, d), "abtt1").select("t", "entry", F.round("cos", 5).alias("cos"))


def honest_curves(rows: DataFrame, kinds: tuple[str, ...], entry: str) -> DataFrame:
    """``kind, theta, f1, fmr, seen_theta, seen_f1``: the margin rule's best point with the
    transform refitted on each prefix, and beside it with one fit on all rows, which has
    seen the future."""
    out = None
    for kind in kinds:
        for name, made in (("", K.honest_decisions(rows, kind, entry)), ("seen_", J.decisions(K.transform(rows, kind), entry))):
            top = J.top_two(made, single="padded").withColumns({"kind": F.lit(kind), "name": F.lit(name)})
            out = top if out is None else out.union(top)
    tops = keep(out.withColumn("margin", F.round("margin", 9)), "honest")
    curve = J.sweep(tops, "margin", V.linear_grid(0.0, 0.6, 101), F.col("best") == F.col("gold"), by=["kind", "name"])
    best = J.operating_points(curve, by=["kind", "name"]).where("point = 'best_f1'")
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c))).alias(f"{name}{c}")
    return best.groupBy("kind").agg(pick("", "theta"), pick("", "f1"), pick("", "fmr"), pick("seen_", "theta"), pick("seen_", "f1"))


@query("honest_comparison")
def honest_comparison(spark, d):
    """What refitting costs: centring, ABTT and whitening with median entries."""
    return honest_curves(spans(spark, d), ("center", "abtt1", "whiten16"), "median")


@query("whiten_sweep")
def whiten_sweep(spark, d):
    """The best F1 of the margin rule by whitening dimension and entry representation."""
    out = None
    for dims in (4, 8, 16, 32, 50):
        moved = K.transform(spans(spark, d), f"whiten{dims}")
        top = J.top_two(J.decisions(moved, ("centroid", "median")).withColumn("dims", F.lit(dims)), by=["dims", "kind", "t"], single="padded")
        # What is shuffled for one transform is dropped before the next one.
        top = keep(top, "top")
        swept(spark)
        out = top if out is None else out.union(top)
    curve = J.sweep(out.withColumn("margin", F.round("margin", 9)), "margin", V.linear_grid(0.0, 0.6, 101), F.col("best") == F.col("gold"), by=["dims", "kind"])
    best = J.operating_points(curve, by=["dims", "kind"]).where("point = 'best_f1'")
    return best.select("dims", "kind", "theta", "precision", "recall", "f1", "fmr")


# Identifier sets: a span's set is {topic % 4, ord % 5, ord % 7}, tagged.
_IDS = "list_distinct(['a' || (topic % 4), 'b' || (ord % 5), 'c' || (ord % 7)])"
_FUSED = f"""{DEC}, ids AS (SELECT ord, topic, {_IDS} AS own FROM s),
acc AS (SELECT q.ord AS t, e.topic AS entry, list_distinct(flatten(list(e.own))) AS have, any_value(q.own) AS own FROM ids q JOIN ids e ON e.ord < q.ord GROUP BY 1, 2),
ov AS (SELECT t, entry, len(list_intersect(own, have)) / (len(list_distinct(list_concat(own, have))) + 1e-9) AS ov FROM acc),
fu AS (SELECT dec.*, ov.ov FROM dec JOIN ov USING (t, entry))"""


def _with_overlap(spark, d) -> DataFrame:
    """Decisions with the overlap of the row's ids and all ids of the entry so far."""
    s = spans(spark, d)
    tag = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    ids = s.select("ord", "topic", F.array_distinct(F.array(tag("a", F.col("topic") % 4), tag("b", F.col("ord") % 5), tag("c", F.col("ord") % 7))).alias("own"))
    # An id enters an entry's set with its first occurrence; the set at t is all ids that entered before.
    entered = ids.select("topic", F.explode("own").alias("id"), "ord").groupBy("topic", "id").agg(F.min("ord").alias("since"))
    sets = entered.groupBy("topic").agg(F.collect_list(F.struct("since", "id")).alias("all"))
    rows = J.decisions(s).join(sets.withColumnRenamed("topic", "entry"), "entry").join(ids.select(F.col("ord").alias("t"), "own"), "t")
    have = F.transform(F.filter("all", lambda x: x["since"] < F.col("t")), lambda x: x["id"])
    return rows.withColumn("ov", V.jaccard(F.col("own"), have)).drop("all", "own")


@query("id_overlap_additive", f"WITH {_FUSED}, be AS (SELECT beta, t, gold, is_repeat, entry, round(cos + beta * ov, 9) AS sc FROM fu, (SELECT unnest({BETAS})::DOUBLE AS beta)), rk AS (SELECT *, row_number() OVER (PARTITION BY beta, t ORDER BY sc DESC, entry) AS r FROM be), tp AS (SELECT beta, t, gold, is_repeat, max(entry) FILTER (r = 1) AS best, max(sc) FILTER (r = 1) AS top, max(sc) FILTER (r = 2) AS second FROM rk WHERE r <= 2 GROUP BY ALL), {curve_sql('tp', f'round({PADDED}, 8)', grid_sql(0.0, 0.6, 31), 'best = gold', by='beta')} SELECT * FROM curve")
def id_overlap_additive(spark, d):
    rows = _with_overlap(spark, d).select("*", F.explode(F.array(*[F.lit(b) for b in BETAS])).alias("beta"))
    top = J.top_two(rows.withColumn("sc", F.round(F.col("cos") + F.col("beta") * F.col("ov"), 9)), "sc", ["beta", "t"], "padded")
    return J.sweep(top.withColumn("margin", F.round("margin", 8)), "margin", V.linear_grid(0.0, 0.6, 31), F.col("best") == F.col("gold"), by=["beta"])


@query("id_gate", f"WITH {_FUSED}, {TOP}, gt AS (SELECT gate, top.is_repeat, best, top.gold, CASE WHEN round(ov, 9) >= gate THEN round({PADDED}, 9) END AS sc FROM top JOIN fu ON fu.t = top.t AND fu.entry = top.best, (SELECT unnest([0.0, 0.2, 0.4])::DOUBLE AS gate)), {curve_sql('gt', 'sc', grid_sql(0.0, 0.6, 31), 'best = gold', by='gate')} SELECT * FROM curve")
def id_gate(spark, d):
    rows = _with_overlap(spark, d)
    top = J.top_two(rows.drop("ov"), single="padded").join(rows.select("t", F.col("entry").alias("best"), "ov"), ["t", "best"])
    gates = top.select("*", F.explode(F.array(F.lit(0.0), F.lit(0.2), F.lit(0.4))).alias("gate"))
    gated = gates.withColumn("sc", F.when(F.round("ov", 9) >= F.col("gate"), F.round("margin", 9)).otherwise(-10.0))
    return J.sweep(gated, "sc", V.linear_grid(0.0, 0.6, 31), F.col("best") == F.col("gold"), by=["gate"])


@query("timeline_cap", """WITH w AS (SELECT conv_id, turn, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT conv_id, count(*) AS kept, sum(n)::BIGINT AS n_words, string_agg('[' || turn || '] ' || text, chr(10) ORDER BY turn) AS timeline FROM c WHERE before < 500 GROUP BY conv_id""")
def timeline_cap(spark, d):
    """Turns as a timeline that stops once 500 words have been told."""
    c = table(spark, d, "conversations").withColumn("n", F.size(F.array_remove(F.split("text", r"\s+"), "")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    kept = c.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("before < 500")
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("text"))
    return kept.groupBy("conv_id").agg(F.count("*").alias("kept"), F.sum("n").cast("long").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))), lambda x: x["s"]), "\n").alias("timeline"))


@query("running_journal", """SELECT conv_id, turn, coalesce(string_agg('[' || turn || '] ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS journal FROM conversations""")
def running_journal(spark, d):
    """Everything told before a turn, as dated lines."""
    c = table(spark, d, "conversations")
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("text"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("conv_id", "turn", F.array_join(F.collect_list(line).over(w), "\n").alias("journal"))


#: The factorial study: sweep, transforms, entries, rules.
STUDY = (
    ("S1", ("abtt1",), J.ENTRIES, ("threshold",)),
    ("S2", ("raw", "center", "abtt1", "abtt2", "abtt3", "whiten50"), ("centroid",), ("threshold",)),
    ("S3", ("abtt1",), ("centroid",), ("threshold", "margin", "dp")),
    ("S4", ("center", "abtt1", "abtt2", "whiten50"), ("centroid", "median", "members_min", "members_mean"), ("threshold", "margin", "dp")),
    ("BASELINE", ("abtt1",), ("first",), ("threshold",)),
)
RULES = {"threshold": ("top", -0.2, 1.0), "margin": ("margin", 0.0, 0.6), "dp": ("gain", -6.0, 6.0)}


def factorial(rows: DataFrame) -> DataFrame:
    """``config, theta, precision, recall, f1, fmr, held_recall`` of the 64 settings of STUDY:
    the best F1 on the rule's curve, and the best recall at a false-merge rate of 5 % or less.

    A transform's decisions are made once for all entries that any sweep asks of it, and
    all streams are swept together."""
    wanted: dict[str, list[str]] = {}
    for _, kinds, entries, _ in STUDY:
        for k in kinds:
            wanted.setdefault(k, []).extend(e for e in entries if e not in wanted.get(k, []))
    tops = None
    for kind, entries in wanted.items():
        moved = keep(K.transform(rows, kind), kind)
        made = J.decisions(moved, tuple(entries))
        sigma = sigmas(moved)
        timed = made.join(J.running_mean_distance(moved).withColumnRenamed("ord", "t"), "t")
        link = F.log(F.col("size").cast("double")) - V.chord2(F.col("cos")) / (2 * sigma.select("sigma2").scalar())
        timed = timed.withColumns({"link": link, "new0": -F.col("d0_sq") / (2 * sigma.select("sigma0").scalar())})
        by = Window.partitionBy("kind", "t")
        timed = timed.withColumns({"r": F.row_number().over(by.orderBy(F.desc("cos"), "entry")), "l": F.row_number().over(by.orderBy(F.desc("link"), "entry"))})
        at = lambda test, c: F.max(F.when(test, F.col(c)))
        first, second, linked = F.col("r") == 1, F.col("r") == 2, F.col("l") == 1
        top = timed.groupBy("kind", "t", "gold", "is_repeat").agg(at(first, "entry").alias("best"), at(first, "cos").alias("top"), at(second, "cos").alias("second"), at(linked, "entry").alias("dp_best"), (at(linked, "link") - F.max("new0")).alias("gain"))
        top = top.withColumn("margin", F.col("top") - F.coalesce("second", F.lit(0.0))).withColumn("stream", F.concat(F.lit(f"{kind}|"), "kind"))
        # What is shuffled for one transform is dropped before the next one.
        top = keep(top, "top")
        swept(rows.sparkSession)
        tops = top if tops is None else tops.union(top)
    points = None
    for rule, (score, lo, hi) in RULES.items():
        scored = tops.withColumn(score, F.round(score, 9))
        right = F.col("dp_best" if rule == "dp" else "best") == F.col("gold")
        curve = keep(J.sweep(scored, score, V.linear_grid(lo, hi, 101), right, by=["stream"], strict=rule == "dp"), f"curve_{rule}")
        part = J.operating_points(curve, by=["stream"]).withColumn("rule", F.lit(rule))
        points = part if points is None else points.union(part)
    best = points.where("point = 'best_f1'").select("stream", "rule", "theta", "precision", "recall", "f1", "fmr")
    held = points.where("point = 'best_recall'").select("stream", "rule", F.col("recall").alias("held_recall"))
    names = [(f"{s}|{k}|{e}|{r}", f"{k}|{e}", r) for s, kinds, entries, rules in STUDY for k in kinds for e in entries for r in rules]
    study = rows.sparkSession.createDataFrame(names, "config string, stream string, rule string")
    return study.join(best.join(held, ["stream", "rule"], "left"), ["stream", "rule"]).select("config", "theta", "precision", "recall", "f1", "fmr", "held_recall")


@query("factorial_study")
def factorial_study(spark, d):
    return factorial(spans(spark, d))


@query("transform_leaderboard")
def transform_leaderboard(spark, d):
    """The twenty best settings of the factorial study, each setting once."""
    once = factorial(spans(spark, d)).withColumn("config", F.regexp_replace("config", r"^[A-Z0-9]+\|", "")).groupBy("config").agg(*[F.first(c).alias(c) for c in ("theta", "f1", "fmr")])
    return once.orderBy(F.desc("f1"), "config").limit(20)


_FEEDBACK_THETA = 0.3


@query("feedback_linker", f"""WITH RECURSIVE {S},
j(t, entry, reps) AS (
  SELECT 1::BIGINT, 0::BIGINT, [v] FROM s WHERE ord = 1
  UNION ALL
  SELECT s.ord, CASE WHEN b.m >= {_FEEDBACK_THETA} THEN b.k ELSE len(j.reps) END, CASE WHEN b.m >= {_FEEDBACK_THETA} THEN j.reps ELSE list_append(j.reps, s.v) END
  FROM j JOIN s ON s.ord = j.t + 1, LATERAL (SELECT list_max(d) AS m, list_position(d, list_max(d)) - 1 AS k FROM (SELECT list_transform(j.reps, lambda r: list_dot_product(r, s.v)) AS d)) b)
SELECT t AS ord, topic, entry::BIGINT AS entry FROM j JOIN s ON s.ord = j.t""")
def feedback_linker(spark, d):
    """The journal that grows from its own decisions; representatives never change."""
    return K.feedback(spans(spark, d), [_FEEDBACK_THETA]).select("ord", "topic", "entry")


_FEEDBACK = f"""{S}, m AS (SELECT b.ord AS t, b.topic, list(list_dot_product(a.v, b.v) ORDER BY a.ord) AS sims FROM s a JOIN s b ON a.ord < b.ord GROUP BY ALL),
j(theta, t, topic, entry, reps, opened) AS (
  SELECT theta, 1::BIGINT, topic, 0::BIGINT, [1::BIGINT], true FROM s, {grid_sql(0.0, 1.0, 21)} WHERE ord = 1
  UNION ALL
  SELECT theta, t, topic, CASE WHEN b >= theta THEN list_position(d, b) - 1 ELSE len(reps) END, CASE WHEN b >= theta THEN reps ELSE list_append(reps, t) END, b < theta
  FROM (SELECT theta, t, topic, reps, d, list_max(d) AS b FROM (SELECT j.theta, m.t, m.topic, j.reps, list_transform(j.reps, lambda r: m.sims[r]) AS d FROM j JOIN m ON m.t = j.t + 1))),
g AS (SELECT theta, t, NOT opened AS l, row_number() OVER (PARTITION BY theta, topic ORDER BY t) > 1 AS is_repeat, topic = first_value(topic) OVER (PARTITION BY theta, entry ORDER BY t) AS ok FROM j),
cf AS (SELECT theta, count(*) FILTER (l AND is_repeat AND ok) AS tp, count(*) FILTER (l AND NOT (is_repeat AND ok)) AS fp, count(*) FILTER (is_repeat AND (NOT l OR NOT ok)) AS fn, count(*) FILTER (NOT l AND NOT is_repeat) AS tn, count(*) FILTER (NOT is_repeat) AS neg FROM g GROUP BY theta),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS rc FROM cf)
SELECT theta, tp, fp, fn, tn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0::DOUBLE END, 6) AS f1, round(CASE WHEN neg > 0 THEN fp / neg ELSE 0.0::DOUBLE END, 6) AS fmr FROM pr"""


@query("feedback_sweep", f"WITH RECURSIVE {_FEEDBACK}")
def feedback_sweep(spark, d):
    """Confusion of feedback journals over theta (one group each), wrong links both FP and FN."""
    rows = K.feedback(spans(spark, d), V.linear_grid(0.0, 1.0, 21))
    opened = rows.groupBy("theta", "entry").agg(F.min_by("topic", "ord").alias("named"), F.min("ord").alias("since"))
    seen = Window.partitionBy("theta", "topic").orderBy("ord")
    judged = rows.withColumn("is_repeat", F.row_number().over(seen) > 1).join(opened, ["theta", "entry"])
    link = F.col("ord") > F.col("since")
    counts = judged.groupBy("theta").agg(*J.outcome_counts(link, F.col("is_repeat"), F.col("named") == F.col("topic"), "wrong_is_both"), F.count_if(~F.col("is_repeat")).alias("neg"))
    return counts.select("theta", "tp", "fp", "fn", "tn", *J.confusion(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), negatives=F.col("neg")))


@query("feedback_clusters")
def feedback_clusters(spark, d):
    """Pairwise F1 of the partition that a margin-rule feedback journal induces, by theta."""
    rows = keep(K.feedback(spans(spark, d), [0.1, 0.3, 0.5], rule="margin", entry="centroid"), "feedback")
    return E.pairwise_scores(rows, "topic", "entry", "theta").select("theta", "precision", "recall", "f1")


def best_feedback(rows: DataFrame, thetas: list[float], rule: str, entry: str) -> DataFrame:
    """``theta, precision, recall, f1, clusters`` of the feedback journal whose partition has the best
    pairwise F1 (on four digits, the first theta of equal ones)."""
    led = keep(K.feedback(rows, thetas, rule=rule, entry=entry), "feedback")
    curve = E.pairwise_scores(led, "topic", "entry", "theta")
    digits = curve.select("theta", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "clusters")
    return digits.orderBy(F.desc("f1"), "theta").limit(1)


@query("feedback_study")
def feedback_study(spark, d):
    """Journals that grow from their own decisions, each at the best of 40 thetas: first representatives under
    the threshold rule, and whitened medians under the margin rule."""
    out = None
    for name, kind, rule, entry, lo, hi in (("baseline", "abtt1", "threshold", "first", 0.2, 0.95), ("winner", "whiten50", "margin", "median", 0.02, 0.5)):
        best = best_feedback(K.transform(spans(spark, d), kind), V.linear_grid(lo, hi, 40), rule, entry).select(F.lit(name).alias("setting"), "*")
        out = best if out is None else out.union(best)
    return out
