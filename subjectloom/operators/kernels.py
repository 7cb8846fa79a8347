"""Numeric kernels without a built-in form: de-biasing transforms, linkage, medians,
spectral clusters and feedback journals.

Grams and means are aggregated in Spark; only d x d matrices (d: the embedding width)
come to the driver.  Kernels over whole small samples run as one pandas group for each
value of a parameter, so a sweep runs in parallel over its values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.folders import keep as kept
from .feedback import first_feedback
from .prefix import lists, running_states, summed, vectors

GEOMETRIC_ROUNDS, GEOMETRIC_STOP = 16, 1e-7


def moments(rows: DataFrame, v: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """n, the mean and the centred Gram matrix of a vector column: partial sums of d x d
    entries a batch, added up over partitions."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = vectors(pa.chunked_array([batch.column(0)]))
                part = [float(len(x)), x.sum(0), x.T @ x]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            n, s, g = total
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], ["n", "s", "g"])

    parts = rows.select(v).mapInArrow(partial, "n double, s array<double>, g array<double>")
    add = parts.select("n", F.posexplode(F.concat("s", "g")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    n = int(add[0]["n"])
    d = int((-1 + np.sqrt(1 + 4 * len(add))) / 2)
    flat = np.array([r["x"] for r in add])
    mean = flat[:d] / n
    return n, mean, flat[d:].reshape(d, d) - n * np.outer(mean, mean)


#: Directions whose singular value is below this share of the largest have no variance: a Gram
#: matrix in doubles tells no smaller ones apart.
RANK = 1e-7


def principal(gram: np.ndarray, n: int, kind: str) -> np.ndarray | None:
    """The directions (columns) that a transform removes (``abtt``) or projects on, scaled (``whiten``), from the Gram
    matrix of the centred rows; none where centring is all (``center``, or no direction has variance)."""
    if kind == "center":
        return None
    values, directions = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, directions = np.maximum(values[order], 0), directions[:, order]
    if kind.startswith("abtt"):
        return directions[:, : int(kind[4:])]
    keep = min(int(kind[6:] or 50), n - 1, int((np.sqrt(values) > RANK * np.sqrt(values[0])).sum()))
    if keep < 1:
        return None
    variance = values[:keep] / n
    return directions[:, :keep] / np.sqrt(np.maximum(0.9 * variance + 0.1 * variance.mean(), 1e-12))


def fitted(gram: np.ndarray, n: int, kind: str) -> np.ndarray | None:
    """The matrix by which a transform multiplies centred rows; none where centring is all."""
    found = principal(gram, n, kind)
    return np.eye(len(gram)) - found @ found.T if found is not None and kind.startswith("abtt") else found


def moved(centred: np.ndarray, matrix: np.ndarray | None, kind: str) -> np.ndarray:
    """Centred rows transformed, of unit length; zero rows stay zero, whitened ones become the all-ones
    direction."""
    z = centred if matrix is None else centred @ matrix
    size = np.linalg.norm(z, axis=1, keepdims=True)
    if matrix is not None and kind.startswith("whiten"):
        z = np.where(size > 1e-12, z, 1.0)
        size = np.linalg.norm(z, axis=1, keepdims=True)
    return np.divide(z, size, out=np.zeros_like(z), where=size > 0)


def transform(rows: DataFrame, kind: str, v: str = "v") -> DataFrame:
    """``rows`` with ``v`` transformed: raw | center | abttK | whitenD.

    ``raw`` only normalises.  ``abttK`` removes the top K principal directions of the
    centred vectors.  ``whitenD`` projects to D components (fewer where the rank is
    lower), scaled by variances shrunk by a tenth toward their mean; a row without any
    component becomes the all-ones direction.
    """
    if kind == "raw":
        return rows.withColumn(v, V.normalize(F.col(v)))
    if not (kind == "center" or kind.startswith("abtt") or kind.startswith("whiten")):
        raise ValueError(f"unknown transform {kind}")
    n, mean, gram = moments(rows, v)
    mu = F.array(*[F.lit(float(x)) for x in mean])
    centred = V.subtract(F.col(v), mu)
    if kind == "center":
        return rows.withColumn(v, V.normalize(centred))
    matrix = fitted(gram, n, kind)
    if matrix is None:
        return rows.withColumn(v, V.normalize(centred))
    at = rows.columns.index(v)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(pa.chunked_array([batch.column(at)])) if batch.num_rows else np.zeros((0, len(mean)))
            yield batch.set_column(at, v, lists(moved(x - mean, matrix, kind)))

    return rows.mapInArrow(project, rows.schema)


#: Squared lengths below this share of their parts are not taken from dot products.
CANCELLED = 1e-6


def geometric_median(x: np.ndarray, rounds: int = GEOMETRIC_ROUNDS, stop: float | None = GEOMETRIC_STOP) -> np.ndarray:
    """Weiszfeld iterations from the mean, normalised.  Without ``stop`` all rounds that move anything."""
    m = x.mean(0)
    lengths = np.einsum("ij,ij->i", x, x)
    for _ in range(rounds):
        scale = lengths + m @ m
        squared = scale - 2 * (x @ m)
        near = np.flatnonzero(squared < CANCELLED * scale)
        if len(near):
            off = x[near] - m
            squared[near] = np.einsum("ij,ij->i", off, off)
        w = 1 / np.maximum(np.sqrt(squared), 1e-9)
        new = w @ x / w.sum()
        still = np.linalg.norm(new - m) < (1e-15 if stop is None else stop)
        m = new
        if still:
            break
    size = np.linalg.norm(m)
    return m / size if size > 0 else m


#: Rows of a topic that one task iterates over; larger topics are dealt into parts.
MEDIAN_ROWS = 4096


def topic_medians(rows: DataFrame, whole: int = MEDIAN_ROWS, rounds: int = GEOMETRIC_ROUNDS, stop: float = GEOMETRIC_STOP) -> DataFrame:
    """``topic, n, v``: the geometric median of each topic's vectors.

    A topic of up to ``whole`` rows is one group.  Larger ones are dealt into parts: a round of Weiszfeld's
    iteration is a weighted sum over the parts, and only topics whose median still moves take part in the next."""
    kind = rows.schema["topic"].dataType.simpleString()
    sizes = kept(rows.groupBy("topic").agg(F.count("*").alias("n")), "sizes")

    def one(table: pa.Table) -> pa.Table:
        x = vectors(table.column("v"))
        return pa.table({"topic": table.column("topic")[:1], "n": [len(x)], "v": lists(geometric_median(x, rounds, stop)[None])})

    small = rows.join(sizes.where(F.col("n") <= whole), "topic").select("topic", "v").groupBy("topic").applyInArrow(one, f"topic {kind}, n long, v array<double>")
    large = sizes.where(F.col("n") > whole).withColumn("parts", F.ceil(F.col("n") / whole).cast("int"))
    if not large.limit(1).count():
        return small
    points = kept(rows.join(large, "topic").select("topic", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "v"), "points")

    def weighted(key, points: pa.Table, state: pa.Table) -> pa.Table:
        if not points.num_rows or not state.num_rows:
            return pa.table({"topic": pa.array([], points.schema.field("topic").type), "n": pa.array([], pa.int64()), "s": pa.array([], pa.list_(pa.float64()))})
        x, m = vectors(points.column("v")), vectors(state.column("m"))[0]
        w = 1 / np.maximum(np.linalg.norm(x - m, axis=1), 1e-9) if len(m) else np.ones(len(x))
        return pa.table({"topic": points.column("topic")[:1], "n": [len(x)], "s": lists(np.append((x * w[:, None]).sum(0), w.sum())[None])})

    def copies(state: DataFrame) -> DataFrame:
        return state.select("topic", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    active, done = large.select("topic", "parts", F.array().cast("array<double>").alias("m")), None
    for r in range(rounds + 1):
        met = points.groupBy("topic", "part").cogroup(copies(active).groupBy("topic", "part"))
        sums = met.applyInArrow(lambda key, p, q: weighted(key, p.select(["topic", "v"]), q.select(["m"])), f"topic {kind}, n long, s array<double>")
        added = sums.groupBy("topic").applyInArrow(lambda t: summed(t, "topic"), f"topic {kind}, n long, s array<double>")
        new = F.transform(F.slice("s", 1, F.size("s") - 1), lambda x: x / F.element_at("s", -1))
        step = added.join(active, "topic").select("topic", "parts", "n", new.alias("m"), F.col("m").alias("old"))
        # The first pass gives the mean; a median that moves less than ``stop`` stays.
        far = F.lit(True) if r == 0 else V.norm(V.subtract(F.col("m"), F.col("old"))) >= stop
        step = kept(step.withColumn("moves", far & F.lit(r < rounds)), "medians")
        rest = step.where("not moves").select("topic", "n", V.normalize(F.col("m")).alias("v"))
        done = rest if done is None else done.union(rest)
        active = step.where("moves").select("topic", "parts", "m")
        if not active.limit(1).count():
            break
    return small.union(done)


class _Entries:
    """The entries of one journal: their representatives, and what those are made of (sums, or members in order)."""

    def __init__(self, width: int, entry: str):
        self.entry, self.n = entry, 0
        self.reps, self.size = np.zeros((16, width)), np.zeros(16, np.int64)
        self.held: list[np.ndarray] = []

    def add(self, k: int, x: np.ndarray) -> None:
        """``x`` opens entry k = n or joins an earlier one, whose representative is then ``settle``d."""
        if k == self.n:
            if k == len(self.reps):
                self.reps, self.size = (np.concatenate([c, np.zeros_like(c)]) for c in (self.reps, self.size))
            self.n += 1
            self.reps[k], self.size[k] = x, 1
            if self.entry != "first":
                self.held.append(x.copy() if self.entry == "centroid" else x[None])
            return
        if self.entry == "centroid":
            self.held[k] += x
        elif self.entry == "median":
            if self.size[k] == len(self.held[k]):
                self.held[k] = np.concatenate([self.held[k], np.zeros_like(self.held[k])])
            self.held[k][self.size[k]] = x
        self.size[k] += 1

    def settle(self, k: int) -> None:
        if self.entry != "first" and self.size[k] > 1:
            rep = self.held[k] / self.size[k] if self.entry == "centroid" else geometric_median(self.held[k][: self.size[k]], 12, None)
            self.reps[k] = rep / max(np.linalg.norm(rep), 1e-12)


#: Rows that meet all entries in one product at most, and numbers of such a product at most.
STRETCH, PRODUCT = 256, 4_000_000


def _replayed(x: np.ndarray, entry: np.ndarray, score: np.ndarray, start: int, thetas: list[float], own: list[int], rule: str, kind: str) -> tuple[list[int], list[tuple[list[int], int]]]:
    """Goes on with a journal from row ``start`` on; ``entry`` and ``score`` are filled in.  As long as the thetas ``own``
    decide alike they share the journal.  Where they do not, the larger part goes on; the
    others are returned with the row that they left at."""
    held, late = _Entries(x.shape[1], kind), []
    for k, row in zip(entry[:start].tolist(), x[:start], strict=True):
        held.add(k, row)
    for k in range(held.n):
        held.settle(k)
    t = start
    while t < len(x):
        end, known = min(len(x), t + max(16, min(STRETCH, PRODUCT // (held.n + 1)))), held.n
        first = x[t:end] @ held.reps[:known].T
        # Entries that were opened or have changed since the product was made.
        fresh: dict[int, None] = {}
        for row, made in zip(x[t:end], first, strict=True):
            best = held.n
            if held.n:
                s = np.empty(held.n)
                s[:known] = made
                if fresh:
                    at = np.fromiter(fresh, np.int64, len(fresh))
                    s[at] = held.reps[at] @ row
                best = int(s.argmax())
                value = float(s[best])
                if rule == "margin":
                    s[best] = -np.inf
                    value -= float(s.max()) if held.n > 1 else -1.0
                joins = [k for k in own if value >= thetas[k]]
                opens = [k for k in own if value < thetas[k]]
                own, rest = (joins, opens) if len(joins) >= len(opens) else (opens, joins)
                if rest:
                    late.append((rest, t))
                if own is opens:
                    best = held.n
                score[t] = value
            held.add(best, row)
            held.settle(best)
            if kind != "first" or best >= known:
                fresh[best] = None
            entry[t] = best
            t += 1
    return own, late


def _sequential_feedback(rows: DataFrame, thetas: list[float], rule: str, kind: str) -> DataFrame:
    """A journal that only a pass in order can tell, in rounds over the thetas.

    Thetas that have decided alike so far share one journal.  In a round each journal is a group: it goes on to the end with
    the larger part of its thetas wherever they part, and the smaller parts take up the next round where they left.  A part has
    at most half of the thetas, so there are few rounds, and no row is decided twice for one history."""
    topic = rows.schema["topic"].dataType.simpleString()
    base = kept(rows.select(F.col("ord").cast("long").alias("ord"), "topic", "v"), "rows")

    def go_on(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        known, n = table.column("entry"), table.num_rows
        start = n - known.null_count
        entry, score = np.zeros(n, np.int64), np.full(n, np.nan)
        entry[:start] = known.slice(0, start).to_numpy()
        score[:start] = table.column("score").slice(0, start).to_numpy()
        own, late = _replayed(vectors(table.column("v")), entry, score, start, thetas, table.column("ks")[0].as_py(), rule, kind)
        parts = []
        for ks, end, waits in [(own, n, False), *[(ks, at, True) for ks, at in late]]:
            same = lambda value, type_: pa.array([value], type_).take(pa.array(np.zeros(end, np.int64)))  # noqa: B023, E731
            named = {"cohort": same(ks[0], pa.int32()), "ks": same(ks, pa.list_(pa.int32())), "waits": same(waits, pa.bool_())}
            parts.append(pa.table(named | {c: table.column(c).slice(0, end) for c in ("ord", "topic")} | {"entry": entry[:end], "score": pa.array(score[:end], from_pandas=True)}))
        return pa.concat_tables(parts)

    cohorts, state, done = [list(range(len(thetas)))], None, None
    while cohorts:
        asked = base.crossJoin(F.broadcast(base.sparkSession.createDataFrame([(c[0], c) for c in cohorts], "cohort int, ks array<int>")))
        if state is None:
            asked = asked.withColumns({"entry": F.lit(None).cast("long"), "score": F.lit(None).cast("double")})
        else:
            asked = asked.join(state, ["cohort", "ord"], "left")
        made = asked.repartitionByRange(len(cohorts), "cohort").groupBy("cohort").applyInArrow(go_on, f"cohort int, ks array<int>, waits boolean, ord long, topic {topic}, entry long, score double")
        made = kept(made, "feedback")
        ended = made.where("not waits").select(F.explode("ks").alias("k"), "ord", "topic", "entry", "score")
        done = ended if done is None else done.union(ended)
        state = made.where("waits").select("cohort", "ord", "entry", "score")
        cohorts = [r["ks"] for r in made.where("waits").select("ks").distinct().collect()]  # no more than thetas
    theta = F.element_at(F.array(*[F.lit(t) for t in thetas]), F.col("k") + 1)
    return done.select(theta.alias("theta"), "ord", "topic", "entry", "score")


def feedback(rows: DataFrame, thetas: list[float], rule: str = "threshold", entry: str = "first") -> DataFrame:
    """``theta, ord, topic, entry, score``: a journal that grows from its own decisions.

    ``entry`` is the journal entry that the row joins (numbered in order of opening)
    and ``score`` the best similarity (or margin) it had, null for the first row.
    ``entry`` kinds: first (representatives never change) | centroid | median.  First
    representatives under the threshold rule are found in rounds (``first_feedback``).  Where an
    entry changes with each decision, or a margin depends on all entries, the stream is
    sequential by nature: each history of decisions is a group of its own, for samples.
    """
    if rule == "threshold" and entry == "first":
        return first_feedback(rows, thetas)
    return _sequential_feedback(rows, [float(t) for t in thetas], rule, entry)


def _honest_fits(rows: DataFrame, kind: str, size: int, last: int) -> DataFrame:
    """``t, topic, rb, v, mean, found``: each row with the mean and the directions (``principal``, a row each) of the rows up to it.

    The moments before a block of rows are prefix sums in two levels; inside a block they grow by
    one row at a time, so a fit costs the same wherever it stands."""
    topic = rows.schema["topic"].dataType.simpleString()
    cut = rows.select("topic", F.floor(F.col("ord") / size).cast("int").alias("rb"), "ord", "v")

    def block_moments(table: pa.Table) -> pa.Table:
        x = vectors(table.column("v"))
        s = np.concatenate([x.sum(0), (x.T @ x).ravel()])
        return pa.table({"topic": pa.array([0], pa.int32()), "rb": table.column("rb")[:1], "n": [len(x)], "s": lists(s[None])})

    sums = cut.groupBy("rb").applyInArrow(block_moments, "topic int, rb int, n long, s array<double>")
    states = running_states(kept(sums, "moments"), last // size).select(F.lit(None).cast(topic).alias("topic"), "rb", (-F.col("n")).alias("ord"), F.col("s").alias("v"))

    def fits(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        order, v = table.column("ord").to_numpy(), table.column("v")
        state = order[0] < 0  # minus the number of earlier rows
        x = vectors(v.slice(1) if state else v) if len(order) > state else np.zeros((0, 1))
        d = x.shape[1]
        flat = vectors(v.slice(0, 1))[0] if state else np.zeros(d + d * d)
        n, total, gram = -int(order[0]) if state else 0, flat[:d].copy(), flat[d:].reshape(d, d).copy()
        means, directions = [], []
        for row in x:
            n, total, gram = n + 1, total + row, gram + np.outer(row, row)
            mean = total / n
            found = principal(gram - n * np.outer(mean, mean), n, kind)
            means.append(mean)
            directions.append(np.zeros(0) if found is None else found.T.ravel())
        own = table.slice(1) if state else table
        return pa.table({"t": own.column("ord"), "topic": own.column("topic"), "rb": own.column("rb"), "v": own.column("v"), "mean": pa.array(means, pa.list_(pa.float64())), "found": pa.array(directions, pa.list_(pa.float64()))})

    return cut.union(states.select(*cut.columns)).groupBy("rb").applyInArrow(fits, f"t long, topic {topic}, rb int, v array<double>, mean array<double>, found array<double>")


#: Decisions of a task at most, those and members that a product takes at once.
DECISIONS, ASKED, MEMBERS = 16_384, 1024, 512


def _moved(centred: np.ndarray, found: np.ndarray, kind: str) -> np.ndarray:
    """Centred rows transformed by ``found`` (a direction a row, or a block of such for each row), of unit length."""
    if kind.startswith("whiten"):
        return moved(centred, found.T, kind) if found.size else moved(centred, None, kind)
    along = lambda k: found[..., k, :]
    # Sums along a row are the same whatever rows stand beside it: opposite rows stay opposite.
    parts = [((centred * along(k)).sum(-1, keepdims=True), along(k)) for k in range(found.shape[-2])]
    return moved(centred - sum(p * u for p, u in parts) if parts else centred, None, "center")


class _Decisions:
    """A block of decisions, to which the rows before them come topic by topic."""

    def __init__(self, table: pa.Table, kind: str, entry: str):
        table = table.sort_by("ord")
        self.kind, self.entry, self.gold = kind, entry, table.column("topic").combine_chunks()
        self.t, x, self.mean = table.column("ord").to_numpy(), vectors(table.column("v")), vectors(table.column("mean"))
        n, d = self.mean.shape
        self.found = [f.values.to_numpy().reshape(-1, d) for f in table.column("found")]
        # One number of directions for all decisions: those that center only have none.
        self.even = not kind.startswith("whiten") and len({len(f) for f in self.found}) == 1
        if self.even:
            self.u = np.array(self.found).transpose(1, 0, 2)  # direction, decision, dimension
            self.along = (self.u * self.mean).sum(-1)
        self.own = [_moved(x[i : i + 1] - self.mean[i], self.found[i], kind)[0] for i in range(n)]
        self.start()

    def start(self) -> None:
        n, d = self.mean.shape
        self.size, self.sums, self.weight = np.zeros(n, np.int64), np.zeros((n, d)), np.zeros(n)
        self.rest = [np.zeros(len(z)) for z in self.own] if self.entry == "centroid" else []
        self.kept: list[tuple] = []

    def meet(self, order: np.ndarray, x: np.ndarray) -> None:
        """Members of the present topic, in order."""
        if self.entry == "median":
            self.kept.append((order, x))
            return
        for at in range(0, len(x), MEMBERS):
            o, y = order[at : at + MEMBERS], x[at : at + MEMBERS]
            for lo in range(int(np.searchsorted(self.t, o[0], "right")), len(self.t), ASKED):
                part = slice(lo, min(lo + ASKED, len(self.t)))
                if self.even:
                    self._weighed(part, o, y)
                else:
                    for i in range(part.start, part.stop):
                        m = int(np.searchsorted(o, self.t[i], "left"))
                        self.rest[i] += _moved(y[:m] - self.mean[i], self.found[i], self.kind).sum(0)
                        self.size[i] += m

    def _weighed(self, part: slice, o: np.ndarray, y: np.ndarray) -> None:
        """A transformed row is its centred one less its share along the directions, by its length.  All lengths
        come from dot products, and the sum is made of the rows weighted by them before it is transformed."""
        mean = self.mean[part]
        scale = (mean * mean).sum(1)[:, None] + (y * y).sum(1)
        squared = scale - 2 * (mean @ y.T)
        for u, along in zip(self.u, self.along, strict=True):
            squared -= (u[part] @ y.T - along[part][:, None]) ** 2
        far = squared > CANCELLED * scale
        weight = np.divide(1, np.sqrt(squared, where=far, out=np.ones_like(squared)), where=far, out=np.zeros_like(squared))
        if o[-1] >= self.t[part.start]:
            held = o < self.t[part][:, None]
            weight *= held
            near, n = held & ~far, held.sum(1)
        else:
            near, n = ~far, len(o)
        self.size[part] += n
        self.sums[part] += weight @ y
        self.weight[part] += weight.sum(1)
        r, c = np.nonzero(near)
        for at in range(0, len(r), 65_536):
            i, j = part.start + r[at : at + 65_536], c[at : at + 65_536]
            z = _moved(y[j] - self.mean[i], self.u[:, i].transpose(1, 0, 2), self.kind)
            for k in np.unique(i):
                self.rest[k] += z[i == k].sum(0)

    def decided(self, topic: pa.Scalar) -> pa.Table:
        """The decisions on the entry of the topic whose members have come."""
        if self.entry == "median":
            order, x = (np.concatenate(c) for c in zip(*self.kept, strict=True))
            self.size = np.searchsorted(order, self.t, "left")
        some = np.flatnonzero(self.size)
        cos = np.zeros(len(some))
        for at, i in enumerate(some.tolist()):
            if self.entry == "median":
                z, u = x[: self.size[i]] - self.mean[i], self.found[i]
                c = geometric_median(moved(z, u.T if len(u) else None, self.kind) if self.kind.startswith("whiten") else moved(z - (z @ u.T) @ u, None, "center"))
            else:
                c = self.rest[i]
                if self.even:
                    whole, u = self.sums[i] - self.weight[i] * self.mean[i], self.found[i]
                    c = c + whole - (u @ whole) @ u
            cos[at] = c @ self.own[i] / max(np.linalg.norm(c), 1e-12)
        out = pa.table({"t": self.t[some], "gold": self.gold.take(pa.array(some)), "entry": pa.array([topic] * len(some), self.gold.type), "size": self.size[some], "cos": cos})
        self.start()
        return out


def honest_decisions(rows: DataFrame, kind: str, entry: str = "centroid", decisions_a_task: int | None = None) -> DataFrame:
    """``t, gold, entry, size, cos, is_repeat`` with the transform (center | abttK | whitenD)
    refitted on the rows up to each decision; entries are centroids or medians.

    Fits come from running moments.  Each decision transforms the earlier rows anew, as it must: their
    lengths after it are not sums of anything.  A block of decisions stands first in its task, and the earlier
    rows pass by it topic by topic, so a task holds decisions and a batch of rows, and only its scores leave it.  With
    centring and removed directions the lengths come from products of blocks.  A median needs an entry's
    rows in one place: there a task holds those of one topic."""
    if not (kind == "center" or kind.startswith(("abtt", "whiten"))) or entry not in ("centroid", "median"):
        raise ValueError(f"unknown transform or entry: {kind}, {entry}")
    topic = rows.schema["topic"].dataType.simpleString()
    last = rows.agg(F.max("ord")).first()[0] or 0
    # Each row is sent once for each block of later decisions.
    size = decisions_a_task or max(64, min(DECISIONS, last // 24))
    asked = kept(_honest_fits(rows.select("ord", "topic", "v"), kind, size, last), "fits")
    none = F.lit(None).cast("array<double>")
    later = F.explode(F.sequence(F.floor(F.col("ord") / size).cast("int"), F.lit(last // size).cast("int"))).alias("rb")
    held = rows.select(later, F.lit(1).alias("role"), "topic", F.col("ord").cast("long").alias("ord"), "v", none.alias("mean"), none.alias("found"))
    asks = asked.select("rb", F.lit(0).alias("role"), "topic", F.col("t").alias("ord"), "v", "mean", "found")

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, block, topic = None, [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rb, role, order = (table.column(c).to_numpy() for c in ("rb", "role", "ord"))
            code = table.column("topic").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            starts = np.flatnonzero(np.append(True, (np.diff(rb) != 0) | (np.diff(role) != 0) | (np.diff(code) != 0))) if len(rb) else []
            for lo, hi in zip(starts, [*starts[1:], len(rb)], strict=True):
                own, name = table.slice(lo, hi - lo), table.column("topic")[int(lo)]
                if block is not None and (rb[lo] != now or name != topic):
                    yield from block.decided(topic).to_batches()
                if rb[lo] != now:
                    now, asks, block = rb[lo], [], None
                if not role[lo]:
                    asks.append(own)
                elif asks:
                    block = block or _Decisions(pa.concat_tables(asks), kind, entry)
                    topic = name
                    block.meet(order[lo:hi], vectors(own.column("v")))
        if block is not None:
            yield from block.decided(topic).to_batches()

    met = held.unionByName(asks).repartitionByRange(last // size + 1, "rb").sortWithinPartitions("rb", "role", "topic", "ord")
    scored = met.mapInArrow(decide, f"t long, gold {topic}, entry {topic}, size long, cos double")
    first = rows.groupBy(F.col("topic").alias("gold")).agg(F.min("ord").alias("first"))
    return scored.join(first, "gold").select("t", "gold", "entry", "size", "cos", (F.col("t") > F.col("first")).alias("is_repeat"))
