"""Oracle-growth journals: decision streams, rules and sweeps, all declarative.

A journal entry holds the members of one topic seen so far.  As it grows from the
gold topics, its state at a decision is a function of the members that came before,
whatever was decided.  Arriving rows are cut into blocks by their order.  First members,
centroids and means are prefix sums in two levels: the sums of each topic and block are
scanned over the blocks, and a block's own members are added inside it, so a member's vector is
sent once.  Extremes over members need each member beside each later row; there blocks of
members meet the blocks of rows that come later.  Tasks ship scores only.

Spans have columns ``ord`` (dense chronological order from 1), ``topic`` and ``v``
(unit vector of doubles).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.folders import keep, ranked
from .kernels import geometric_median
from .prefix import prefix_states, vectors


def chronological(df: DataFrame, keys: list[str]) -> DataFrame:
    """``ord`` from 1, in the order of ``keys`` (unique)."""
    return ranked(df, keys, "ord")


def first_seen(spans: DataFrame) -> DataFrame:
    """``is_repeat``: whether an earlier row has the row's topic."""
    first = spans.groupBy(F.col("topic").alias("_topic")).agg(F.min("ord").alias("_first"))
    joined = spans.join(first, F.col("topic").eqNullSafe(F.col("_topic")))
    return joined.withColumn("is_repeat", F.col("ord") > F.col("_first")).drop("_topic", "_first")


def _block_rows(last: int | None) -> int:
    """Blocks of 2,048 rows, fewer where that would leave most cores idle."""
    return max(64, min(2048, (last or 0) // 16))


def running_mean_distance(spans: DataFrame) -> DataFrame:
    """``ord, d0_sq``: squared chord distance to the mean of all rows up to this one.

    Prefix sums in two levels: the state before a block, and the block's own rows."""
    last = spans.agg(F.max("ord")).first()[0] or 0
    size = _block_rows(last)
    cut = spans.select(F.lit(0).alias("topic"), F.floor(F.col("ord") / size).cast("int").alias("rb"), "ord", "v")
    states = prefix_states(cut, last // size).select("rb", F.lit(0).cast("long").alias("ord"), F.col("s").alias("v"))

    def distances(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        order, x = table.column("ord").to_numpy(), vectors(table.column("v"))
        m = np.cumsum(x, axis=0)
        own = order > 0  # a state, if any, comes first
        size = np.sqrt((m * m).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 2 - 2 * (x * m).sum(1) / size
        return pa.table({"ord": order[own], "d0_sq": pa.array(d[own], from_pandas=True)})

    return cut.select("rb", "ord", "v").union(states).groupBy("rb").applyInArrow(distances, "ord long, d0_sq double")


ENTRIES = ("first", "centroid", "median", "members_max", "members_min", "members_mean")


#: Representations whose state is a sum, and those that need all members.
SUMMED = ("first", "centroid", "members_mean")


def _affinity(kind: str, x: np.ndarray, members: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The affinity of each row of ``x`` to an entry that has the first ``before`` of
    ``members`` (1 or more of them)."""
    if kind == "median":
        sizes, at = np.unique(before, return_inverse=True)
        return np.einsum("ij,ij->i", x, np.array([geometric_median(members[:k]) for k in sizes])[at])
    running = np.maximum if kind == "members_max" else np.minimum
    out, at = np.zeros(len(x)), 0
    while at < len(x):
        # Rows come in order: all of a tile have the members that its first row has, and some have later ones.
        to = min(len(x), at + max(1, TILED // int(before[min(len(x), at + TILE) - 1])), at + TILE)
        least, most = int(before[at]), int(before[to - 1])
        s = x[at:to] @ members[:most].T
        s[:, least - 1] = running.reduce(s[:, :least], axis=1)
        later = running.accumulate(s[:, least - 1 :], axis=1)
        out[at:to] = later[np.arange(to - at), before[at:to] - least]
        at = to
    return out


#: Entries, and members of one entry, that a block of entries holds at most (about).
ENTRIES_A_BLOCK, MEMBERS_A_BLOCK = 512, 65_536
#: Rows, and rows times members, of a tile of extremes.
TILE, TILED = 512, 1 << 23
#: Blocks of rows, and of entries, that members meet: a member is sent once for each later block of rows, a row once for
#: each block of entries.  A block has at most so many of the blocks of rows that others meet (65,536 rows).
MEMBER_ROWS, MEMBER_ENTRIES, WIDEST = 16, 4, 32

_TYPES = {"size": pa.int64(), "cos": pa.float64(), "is_repeat": pa.bool_(), "kind": pa.string()}


def _scores(topics: pa.Array, t, gold, entry, size, cos, again, kind) -> pa.Table:
    """Decisions as a table; ``gold`` and ``entry`` are places in ``topics``."""
    named = {"t": pa.array(t, pa.int64()), "gold": topics.take(pa.array(gold, pa.int64())), "entry": topics.take(pa.array(entry, pa.int64()))}
    return pa.table(named | {k: pa.array(c, _TYPES[k]) for k, c in (("size", size), ("cos", cos), ("is_repeat", again), ("kind", kind))})


def _summed_decisions(cut: DataFrame, kinds: tuple[str, ...], rows: int, entries: int, ddl: str, most: int | None = None) -> DataFrame:
    """Decisions on entries whose state is a sum: a block of rows meets, for each block of entries,
    their states before it and their members inside it.  With ``most`` a block keeps that many best
    entries of a row (of equal ones, to nine digits, the least) and drops the others."""
    eb = F.pmod(F.xxhash64("topic"), F.lit(entries)).cast("int").alias("eb")
    none = F.lit(None).cast("array<double>")
    each = F.explode(F.sequence(F.lit(0), F.lit(entries - 1))).alias("eb")
    asks = cut.select("rb", each, F.lit(0).alias("role"), "ord", "topic", "is_repeat", "v", none.alias("f"))
    own = cut.select("rb", eb, F.lit(1).alias("role"), "ord", "topic", "is_repeat", "v", none.alias("f"))
    states = prefix_states(cut.select("topic", "rb", "v"), rows - 1)
    if "first" in kinds:
        states = states.join(cut.groupBy("topic").agg(F.min_by("v", "ord").alias("f")), "topic")
    else:
        states = states.withColumn("f", none)
    states = states.select("rb", eb, F.lit(2).alias("role"), F.col("n").alias("ord"), "topic", F.lit(True).alias("is_repeat"), F.col("s").alias("v"), "f")

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by([("role", "ascending"), ("ord", "ascending")])
        role, order, v = table.column("role").to_numpy(), table.column("ord").to_numpy(), vectors(table.column("v"))
        again = np.array(table.column("is_repeat").to_pylist(), bool)
        coded = table.column("topic").combine_chunks().dictionary_encode()
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        asked, held = role == 0, role == 2
        x, t, gold, repeat = v[asked], order[asked], code[asked], again[asked]
        sums, count = np.zeros((n, v.shape[1])), np.zeros(n, np.int64)
        sums[code[held]], count[code[held]] = v[held], order[held]
        before = np.repeat(count[None], len(t), axis=0)
        members = {int(e): np.flatnonzero((role == 1) & (code == e)) for e in np.unique(code[role == 1])}
        for e, at in members.items():
            before[:, e] += np.searchsorted(order[at], t, "left")
        some, e_some = np.nonzero(before > 0)
        parts = []
        for kind in kinds:
            if kind == "first":
                state = np.zeros_like(sums)
                if held.any():
                    state[code[held]] = vectors(table.column("f").filter(pa.array(held)))
                cos = x @ state.T
                for e, at in members.items():
                    if not count[e]:
                        cos[:, e] = x @ v[at[0]]
            else:
                size = lambda s, c: np.maximum(np.linalg.norm(s, axis=-1) if kind == "centroid" else c, 1e-12)  # noqa: B023, E731
                cos = x @ sums.T / size(sums, count)
                for e, at in members.items():
                    grown = np.vstack([sums[e], sums[e] + np.cumsum(v[at], axis=0)])
                    place = before[:, e] - count[e]
                    cos[:, e] = np.einsum("ij,ij->i", x, grown[place]) / size(grown, count[e] + np.arange(len(grown)))[place]
            if most is not None:
                order = np.argsort(np.array(coded.dictionary.to_pylist()), kind="stable")
                sim = np.where(before > 0, np.round(cos, 9), -np.inf)[:, order]
                top = np.argsort(-sim, axis=1, kind="stable")[:, :most]
                some, place = np.nonzero(np.take_along_axis(sim, top, axis=1) > -np.inf)
                e_some = order[top[some, place]]
            parts.append(cos[some, e_some])
        times = len(kinds)
        return _scores(coded.dictionary, np.tile(t[some], times), np.tile(gold[some], times), np.tile(e_some, times), np.tile(before[some, e_some], times), np.concatenate(parts), np.tile(repeat[some], times), np.repeat(np.array(kinds, object), len(some)))

    return asks.union(own).union(states).groupBy("rb", "eb").applyInArrow(product, ddl)


def _member_blocks(rows: int) -> tuple[int, int]:
    """Blocks of rows that make one wide block, and the number of those."""
    wide = min(WIDEST, -(-rows // MEMBER_ROWS))
    return wide, -(-rows // wide)


def _member_decisions(cut: DataFrame, kinds: tuple[str, ...], rows: int, entries: int, most: int, ddl: str) -> DataFrame:
    """Decisions on entries that need all their members: a block of members meets each block of
    rows that does not come earlier.  Row blocks are few, so that what is shuffled is the table times their
    number.  An entry of many members is dealt by order into parts, whose
    extremes are put together; a median needs its members in one place."""
    parts = 1 if "median" in kinds else -(-most // MEMBERS_A_BLOCK)
    wide, rows = _member_blocks(rows)
    cut = cut.withColumn("rb", F.floor(F.col("rb") / wide).cast("int"))
    each = lambda lo, hi, name: F.explode(F.sequence(lo, F.lit(hi - 1))).alias(name)
    deal = F.pmod(F.xxhash64("topic", *([F.pmod(F.xxhash64("ord"), F.lit(parts))] if parts > 1 else [])), F.lit(entries * parts)).cast("int")
    asks = cut.select("rb", each(F.lit(0), entries * parts, "eb"), F.lit(True).alias("asks"), "ord", "topic", "is_repeat", "v")
    held = cut.select(each(F.col("rb"), rows, "rb"), deal.alias("eb"), F.lit(False).alias("asks"), "ord", "topic", "is_repeat", "v")

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        ask, order, v = np.array(table.column("asks").to_pylist(), bool), table.column("ord").to_numpy(), vectors(table.column("v"))
        repeat = np.array(table.column("is_repeat").to_pylist(), bool)
        coded = table.column("topic").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        x, t, gold, again = v[ask], order[ask], code[ask], repeat[ask]
        found: list[list] = [[np.zeros(0, d)] for d in (np.int64, np.int64, np.int64, np.int64, float, bool, object)]
        for e in np.unique(code[~ask]):
            own = np.flatnonzero(~ask & (code == e))
            before = np.searchsorted(order[own], t, "left")
            some = np.flatnonzero(before > 0)
            for kind in kinds if len(some) else ():
                values = (t[some], gold[some], np.full(len(some), e), before[some], _affinity(kind, x[some], v[own], before[some]), again[some], np.full(len(some), kind, object))
                for part, value in zip(found, values, strict=True):
                    part.append(value)
        return _scores(coded.dictionary, *(np.concatenate(p) for p in found))

    out = asks.union(held.select(*asks.columns)).groupBy("rb", "eb").applyInArrow(product, ddl)
    if parts == 1:
        return out
    extreme = F.when(F.col("kind") == "members_max", F.max("cos")).otherwise(F.min("cos"))
    return out.groupBy("t", "gold", "entry", "is_repeat", "kind").agg(F.sum("size").alias("size"), extreme.alias("cos")).select(*out.columns)


def _ddl(spans: DataFrame) -> str:
    topic = spans.schema["topic"].dataType.simpleString()
    return f"t long, gold {topic}, entry {topic}, size long, cos double, is_repeat boolean, kind string"


def _cut(spans: DataFrame, rows_a_block: int | None) -> tuple[DataFrame, int, int, int]:
    """Rows in blocks (``rb``) and whether they repeat a topic; the number of blocks, of topics, and of rows
    of the largest topic."""
    sizes = spans.groupBy("topic").agg(F.max("ord").alias("last"), F.count("*").alias("n"))
    last, topics, most = sizes.agg(F.coalesce(F.max("last"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    size = rows_a_block or _block_rows(last)
    cut = first_seen(spans.select("ord", "topic", "v")).withColumn("rb", F.floor(F.col("ord") / size).cast("int"))
    return keep(cut, "cut"), last // size + 1, topics, most


def decisions(spans: DataFrame, entry: str | tuple[str, ...] = "centroid", rows_a_block: int | None = None) -> DataFrame:
    """One row for each decision and entry: ``t, gold, entry, size, cos, is_repeat``, and
    ``kind`` where several representations are asked for (they share their passes).

    ``entry``: first | centroid | median | members_max | members_min | members_mean.
    The first row of the stream makes no decision.
    """
    kinds = (entry,) if isinstance(entry, str) else tuple(entry)
    for k in kinds:
        if k not in ENTRIES:
            raise ValueError(f"unknown entry representation {k}")
    cut, rows, topics, most = _cut(spans, rows_a_block)
    entries, ddl = topics // ENTRIES_A_BLOCK + 1, _ddl(spans)
    summed, whole = tuple(k for k in kinds if k in SUMMED), tuple(k for k in kinds if k not in SUMMED)
    found = [_summed_decisions(cut, summed, rows, entries, ddl)] if summed else []
    # A median's members stay together; extremes of large entries are made in parts.
    found += [_member_decisions(cut, part, rows, max(entries, min(topics, MEMBER_ENTRIES)), most, ddl) for part in (("median",) if "median" in whole else (), tuple(k for k in whole if k != "median")) if part]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.drop("kind") if isinstance(entry, str) else out


def shortlist(spans: DataFrame, most: int, entry: str = "centroid") -> DataFrame:
    """``t, gold, entry, size, cos, is_repeat, rank``: the ``most`` best entries of each decision, by similarity
    to nine digits, the least of equal ones first; ``entry``: first | centroid | members_mean.  Each
    block product keeps its own best, so what is shipped does not grow with the entries."""
    if entry not in SUMMED:
        raise ValueError(f"no shortlists by {entry}")
    cut, rows, topics, _ = _cut(spans, None)
    best = _summed_decisions(cut, (entry,), rows, topics // ENTRIES_A_BLOCK + 1, _ddl(spans), most).drop("kind")
    order = Window.partitionBy("t").orderBy(F.desc(F.round("cos", 9)), "entry")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def top_two(scored: DataFrame, score: str = "cos", by: list[str] = ["t"], single: str = "self") -> DataFrame:
    """Per decision the best entry, its score, and the margin over the runner-up.

    Ties go to the lesser entry.  A lone entry's margin is its score (``self``) or
    its score + 1 (``padded``: the runner-up counts as -1).
    """
    order = Window.partitionBy(*by).orderBy(F.desc(score), "entry")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    keep = [c for c in ("gold", "is_repeat") if c in scored.columns]
    best = ranked.groupBy(*by, *keep).agg(
        F.max(F.when(F.col("rank") == 1, F.col("entry"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top"),
        F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second"),
    )
    lone = F.col("top") if single == "self" else F.col("top") + 1
    return best.withColumn("margin", F.when(F.col("second").isNull(), lone).otherwise(F.col("top") - F.col("second")))


def dp_scores(rows: DataFrame, d0: DataFrame, sigma2: float, sigma0: float, sized: bool = True) -> DataFrame:
    """Dirichlet-process scores: ``link`` of each entry and ``new0`` (without the bias)."""
    prior = F.log(F.col("size").cast("double")) if sized else F.lit(0.0)
    return rows.join(d0, "t").withColumn("link", prior - V.chord2(F.col("cos")) / (2 * sigma2)).withColumn("new0", -F.col("d0_sq") / (2 * sigma0))


# ------------------------------------------------------------------ sweeps


def confusion(tp: Column, fp: Column, fn: Column, tn: Column, digits: int = 6, negatives: Column | None = None) -> list[Column]:
    """precision (1 without predictions), recall, f1 and false-merge rate, rounded."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    r = div(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    fmr = div(fp, fp + tn if negatives is None else negatives)
    return [F.round(c, digits).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"), (fmr, "fmr"))]


def outcome_counts(link: Column, is_repeat: Column, right: Column, convention: str = "wrong_is_fp") -> list[Column]:
    """tp, fp, fn, tn.  A repeat linked to the wrong entry is a false positive, and in
    the convention ``wrong_is_both`` a false negative as well."""
    miss = is_repeat & (~link | (link & ~right)) if convention == "wrong_is_both" else is_repeat & ~link
    tests = (("tp", link & is_repeat & right), ("fp", link & ~(is_repeat & right)), ("fn", miss), ("tn", ~link & ~is_repeat))
    return [F.count_if(t).alias(n) for n, t in tests]


def sweep(rows: DataFrame, score: str, grid: list[float], right: Column, by: list[str] | None = None, convention: str = "wrong_is_fp", digits: int = 6, strict: bool = False) -> DataFrame:
    """The confusion curve over ``grid`` (link where score >= theta; > if ``strict``).

    One pass: a row's score gives the number of grid values that it passes; outcomes
    are counted by that number, and the counts, at most one row for each grid value,
    are accumulated over the grid.  The rows are never multiplied by the grid.
    """
    by = by or []
    grid = sorted(float(g) for g in grid)
    values = F.array(*[F.lit(g) for g in grid])
    meets = (lambda g: F.col(score) > g) if strict else (lambda g: F.col(score) >= g)
    step = (grid[-1] - grid[0]) / (len(grid) - 1) if len(grid) > 1 else 0.0
    if step > 0 and all(abs(g - grid[0] - i * step) < step / 8 for i, g in enumerate(grid)):
        # Even grids: guess the count by arithmetic, then settle it against the grid itself.
        guess = F.greatest(F.lit(0), F.least(F.lit(len(grid)), F.floor((F.col(score) - grid[0]) / step).cast("int") + 1))
        above, below = F.coalesce(meets(F.get(values, guess)), F.lit(False)), F.coalesce(meets(F.get(values, guess - 1)), F.lit(True))
        passed = F.coalesce(F.when(above, guess + 1).when(~below, guess - 1).otherwise(guess), F.lit(0))
    else:
        passed = F.size(F.filter(values, meets))
    rep, ok = F.col("is_repeat"), F.coalesce(right, F.lit(False))
    binned = rows.groupBy(*by, passed.alias("k")).agg(F.count_if(rep & ok).alias("a"), F.count_if(rep & ~ok).alias("b"), F.count_if(~rep).alias("c"))
    return curve_of(binned, grid, by, convention, digits)


def curve_of(binned: DataFrame, grid: list[float], by: list[str] | None = None, convention: str = "wrong_is_fp", digits: int = 6) -> DataFrame:
    """The confusion curve of counts by ``k``, the number of grid values passed: ``a`` right repeats, ``b`` wrong
    ones, ``c`` rows that are no repeats."""
    by, values = by or [], F.array(*[F.lit(g) for g in grid])
    # Every grid index once; bins with k > i link at grid value i.
    spread = binned.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    link = F.col("k") > F.col("i")
    pick = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0))
    wrong = F.sum("b") if convention == "wrong_is_both" else pick(~link, "b")
    out = spread.groupBy(*by, "i").agg(pick(link, "a").alias("tp"), (pick(link, "b") + pick(link, "c")).alias("fp"), (pick(~link, "a") + wrong).alias("fn"), pick(~link, "c").alias("tn"), F.sum("c").alias("neg"))
    negatives = F.col("neg") if convention == "wrong_is_both" else None
    theta = F.element_at(values, F.col("i") + 1).alias("theta")
    return out.select(*by, theta, "tp", "fp", "fn", "tn", *confusion(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"), digits, negatives))


def operating_points(curve: DataFrame, by: list[str] | None = None, limit: float = 0.05, default: str = "null") -> DataFrame:
    """Two rows for each curve: ``best_f1`` (first maximum) and ``best_recall`` under
    the false-merge limit (first maximum of recall); without such a row the first row
    of the curve (``default='first'``) or none.  Chosen on the rounded values."""
    by = by or []
    w = lambda *o: Window.partitionBy(*(by or [F.lit(1)])).orderBy(*o)
    best = curve.withColumn("r", F.row_number().over(w(F.desc("f1"), "theta"))).where("r = 1").withColumn("point", F.lit("best_f1"))
    fine = F.col("fmr") <= limit
    order = w(F.when(fine, 0).otherwise(1), F.desc(F.when(fine, F.col("recall"))), "theta")
    held = curve.withColumn("r", F.row_number().over(order)).where("r = 1").withColumn("point", F.lit("best_recall"))
    if default == "null":
        held = held.where(fine)
    return best.union(held).drop("r")
