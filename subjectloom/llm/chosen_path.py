"""MinHash near-duplicates by a chosen-path set similarity join.

Christiani and Pagh, "Set similarity search beyond MinHash" (2017);
Christiani, Pagh and Sivertsen, "Scalable and robust set similarity join"
(2018).  Every document's shingle set is embedded in ``COORDINATES`` minwise
tokens.  A tree starts with one coordinate; a node holds the documents that
agree on all tokens chosen on its path.  Nodes with more than ``leaf``
documents branch again, each on one or two further coordinates so that the
expected number of children that a pair shares is one for a pair that agrees on
three standard deviations fewer coordinates than one at the threshold.  Small
nodes are compared exhaustively, and trees are repeated until a pair at the
threshold is missed with probability below ``1 - recall`` even where all of its
nodes branch to the full depth.

How this stays linear under large groups of copies:

* Equal sets are one class; only classes enter the trees.
* Nodes with the same members (one pair meets in most trees) are compared once.
* Inside a node, sketches drop documents that resemble nobody there (4.5
  standard deviations below the threshold); what is left forms *groups*.
* Each class is first compared with the least class that shares a group with
  it, its hub, in chunks of bounded size.  Groups whose members are then all in
  one component need no further work: any link inside them changes nothing.
* The rest is compared exhaustively, skipping pairs already connected; groups
  larger than a chunk are compared chunk against chunk, so no cap drops a pair.
  Chunks of a group's largest component do not meet each other.
* Keys of large groups, hubs and components are dealt into parts (``spread_join``).

Links are always confirmed on full shingle sets, in integer arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded, clean_text, groups_of, is_empty, mix, small_batches, spread_join, stage, text_bytes, word_hashes
from .components import components

COORDINATES = 64
_RNG = np.random.Generator(np.random.PCG64(20170))
_MULTIPLIERS = _RNG.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 1 << 62, COORDINATES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)

SKETCH = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("sig", pa.binary())])


def shingle_set(text: bytes, k: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    words = word_hashes(text.lower().split(), cache)
    n = len(words)
    if not n:
        return words
    take = min(k, n)
    h = np.full(n - take + 1, np.uint64(take))
    for i in range(take):
        h = mix(h * _STEP + words[i : n - take + 1 + i])
    return np.unique(h)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """A (documents x COORDINATES) array of 32-bit minwise tokens of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            out[:, c] = np.minimum.reduceat(((flat * _MULTIPLIERS[c] + _ADDENDS[c]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _sketches(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()

        def rows(keys: list, sets: list[np.ndarray]) -> Iterator[tuple]:
            full = [s for s in sets if len(s)]
            sigs = iter(minwise(full) if full else ())
            for key, s in zip(keys, sets, strict=True):
                yield *key, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, next(sigs).tobytes() if len(s) else None

        def all_rows() -> Iterator[tuple]:
            for batch in batches:
                ids = zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
                keys, sets, held = [], [], 0
                for key, text in zip(ids, text_bytes(batch, "text"), strict=True):
                    s = shingle_set(text, k, cache)
                    keys.append(key)
                    sets.append(s)
                    held += len(s)
                    if held > 200_000:
                        yield from rows(keys, sets)
                        keys, sets, held = [], [], 0
                yield from rows(keys, sets)

        yield from bounded(all_rows(), SKETCH, 2_000)

    return run


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether intersection / union >= num / den, on sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * den < len(large) * num:
        return False
    at = np.searchsorted(large, small)
    inter = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return inter * den >= (len(a) + len(b) - inter) * num


class _Union:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _groups(tau: float):
    """Nodes (sorted by path) to groups of members that some other resembles by sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, node in groups_of(batches, "path"):
                members = sorted(zip(node["cls"], node["sig"], strict=True))
                n = len(members)
                sig = np.frombuffer(b"".join(s for _, s in members), np.uint32).reshape(n, COORDINATES)
                own = _Union(n)
                for i in range(n - 1):
                    for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= tau * COORDINATES):
                        own.join(i, i + 1 + int(j))
                parts: dict[int, list[bytes]] = {}
                for i in range(n):
                    parts.setdefault(own.find(i), []).append(members[i][0])
                for part in parts.values():
                    if len(part) > 1:
                        mark = xxhash.xxh3_64_intdigest(b"".join(part)) - (1 << 63)
                        for c in part:
                            yield mark, c

        yield from bounded(rows(), pa.schema([("grp", pa.int64()), ("cls", pa.binary())]))

    return run


def _links(num: int, den: int, tau: float):
    """Tasks (sorted by ``task``) to confirmed links between members that are not
    connected yet; members carry their component so far (``label``).  Where
    ``side`` is given (chunk against chunk), pairs on one side are left out.
    Full sets are compared only where sketches leave the pair possible."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, task in groups_of(batches, "task"):
                order = sorted(range(len(task["cls"])), key=lambda i: (task["cls"][i], task["side"][i]))
                sets = [np.frombuffer(task["shingles"][i], np.uint64) for i in order]
                names, labels, sides = ([task[c][i] for i in order] for c in ("cls", "label", "side"))
                own, first = _Union(len(order)), {}
                for i, label in enumerate(labels):
                    if first.setdefault(label, i) != i:
                        own.join(i, first[label])
                sig = np.frombuffer(b"".join(task["sig"][i] for i in order), np.uint32).reshape(len(order), COORDINATES)
                for i in range(len(order) - 1):
                    for j in (np.flatnonzero((sig[i + 1 :] == sig[i]).sum(axis=1) >= tau * COORDINATES) + i + 1).tolist():
                        if (sides[i] < 0 or sides[i] != sides[j]) and own.find(i) != own.find(j) and _similar(sets[i], sets[j], num, den):
                            own.join(i, j)
                            yield names[i], names[j]

        yield from bounded(rows(), pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return run


def _shingles(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows = zip(batch.column("cls").to_pylist(), batch.column("sig").to_pylist(), text_bytes(batch, "text"), strict=True)
            yield from bounded(((c, s, shingle_set(t, k, cache).tobytes()) for c, s, t in rows), pa.schema([("cls", pa.binary()), ("sig", pa.binary()), ("shingles", pa.binary())]), 500)

    return run


def branching(j: float, recall: float, depth: int) -> tuple[int, float]:
    """Trees, and the share of nodes that branch on two coordinates, for a pair of
    similarity ``j`` to be missed with probability below ``1 - recall``.

    The pair agrees on a binomial number of coordinates.  Given that number, the
    survival of a shared node over ``depth - 1`` branchings is a recursion, and the
    agreeing roots among the trees (which start with different coordinates) are
    hypergeometric."""
    extra = min(1.0, 1 / max(0.5, j - 3 * math.sqrt(j * (1 - j) / COORDINATES)) - 1)
    cases = []
    for agree in range(COORDINATES + 1):
        alive = 1.0
        for _ in range(depth - 1):
            x = agree / COORDINATES * alive
            # Two picks are one where they fall on the same coordinate.
            two = extra * (1 - 1 / COORDINATES)
            alive = (1 - two) * x + two * (1 - (1 - x) ** 2)
        cases.append((math.comb(COORDINATES, agree) * j**agree * (1 - j) ** (COORDINATES - agree), agree, alive))

    def missed(trees: int) -> float:
        ways = lambda n, h: math.comb(n, h) * math.comb(COORDINATES - n, trees - h)
        return sum(w * sum(ways(n, h) * (1 - alive) ** h for h in range(min(n, trees) + 1)) for w, n, alive in cases) / math.comb(COORDINATES, trees)

    for trees in range(4, COORDINATES + 1):
        if missed(trees) < 1 - recall:
            return trees, extra
    raise ValueError(f"{COORDINATES} coordinates do not give recall {recall} at similarity {j}")


def _tree_nodes(classes: DataFrame, trees: int, extra: float, leaf: int, depth: int) -> DataFrame:
    """``(path, cls, n)`` of all nodes with two or more members that branch no more.

    A large node that kept over 60 % of its parent is dense (its members resemble each
    other on average) and further branching would only copy it; as in the published
    join, it is compared as it stands."""
    token = lambda c: F.expr(f"substring(sig, 4 * ({c}) + 1, 4)")
    level = classes.select(F.explode(F.array(*[F.xxhash64(F.lit(t), token(t)) for t in range(trees)])).alias("path"), "cls", F.lit(0).cast("long").alias("parent"))
    # Rows of a level, for the number of files: members fall into about one child each.
    rows = trees * classes.count()
    level = stage(level, "level0", rows)
    done = []
    for at in range(depth):
        sizes = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").withColumn("n_rows", F.col("n"))
        if at == 0:
            sizes = stage(sizes, "sizes", rows)  # the widest level, and three readers
        shared = stage(spread_join(level, sizes, "path", ["cls"]), f"shared{at}", rows)
        branches = F.col("n") > leaf
        if at >= 1:
            branches = branches & (10 * F.col("n") <= 6 * F.col("parent"))
        if at == depth - 1:
            branches = F.lit(False)
        done.append(shared.where(~branches).select("path", "cls", "n"))
        large = shared.where(branches)
        if at == depth - 1 or is_empty(large):
            break
        pick = lambda salt: F.pmod(F.xxhash64("path", F.lit(salt)), F.lit(COORDINATES)).cast("int")
        second = F.pmod(F.xxhash64("path", F.lit(-1)), F.lit(1000)) < int(1000 * extra)
        picked = large.select("path", "cls", "n", F.explode(F.when(second, F.array_distinct(F.array(pick(1), pick(2)))).otherwise(F.array(pick(1)))).alias("c"))
        level = stage(picked.join(classes.select("cls", "sig"), "cls").select(F.xxhash64("path", "c", token("c")).alias("path"), "cls", F.col("n").alias("parent")), f"level{at + 1}", rows)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: tuple[int, int] = (85, 100), recall: float = 0.9999, leaf: int = 48, depth: int = 7, chunk: int = 512) -> DataFrame:
    """Components of documents whose k-word shingle sets have Jaccard similarity
    of ``threshold`` (numerator, denominator) or more.

    Returns one row per row of ``docs``: ``key`` (hash of id and text),
    ``doc_id``, ``n_shingles``, ``component_id`` (the least id in the component)
    and ``kept``.

    Defined results: a null or wordless text has 0 shingles and links with
    nothing, a text with fewer than k words is one shingle; a document with a
    null id takes part in links, but its id is never the least (a component of
    null ids alone has a null id and keeps its documents).  Rows repeated with
    one id share a component and are all kept or all not.
    """
    num, den = threshold
    small_batches(docs.sparkSession)
    j = num / den
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))
    source = source.withColumn("key", F.xxhash64("doc_id", "text"))
    sketch = stage(source.select("key", "doc_id", "text").mapInArrow(_sketches(k), "key long, doc_id long, n_shingles long, cls binary, sig binary"), "sketch")
    members = sketch.select("key", "doc_id", "n_shingles", "cls")
    classes = stage(sketch.where("n_shingles > 0").groupBy("cls").agg(F.min("key").alias("key"), F.first("sig").alias("sig"), F.min("doc_id").alias("least"), F.count("*").alias("size")), "classes")
    trees, extra = branching(j, recall, depth)
    nodes = _tree_nodes(classes, trees, extra, leaf, depth)
    n_classes = classes.count()
    n_nodes = trees * n_classes
    # Nodes with the same members are one node: two independent member sums name them.
    marks = nodes.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("y"))
    once = stage(marks.groupBy("n", "x", "y").agg(F.min("path").alias("path")).select("path", "n", F.col("n").alias("n_rows")), "once", n_nodes)
    tau = max(0.0, j - 4.5 * math.sqrt(j * (1 - j) / COORDINATES))
    nodes = stage(spread_join(nodes.select("path", "cls"), once, "path", ["cls"]), "nodes", n_nodes)
    small = nodes.where(F.col("n") <= leaf).join(classes.select("cls", "sig"), "cls")
    groups = small.select("path", "cls", "sig").repartition("path").sortWithinPartitions("path").mapInArrow(_groups(tau), "grp long, cls binary").distinct()
    groups = stage(groups.union(nodes.where(F.col("n") > leaf).select("path", "cls")), "groups", n_nodes)

    wanted = groups.select("cls").distinct().join(classes.select("cls", "key", "sig"), "cls").hint("shuffle_hash")
    sets = stage(source.select("key", "text").join(wanted, "key").dropDuplicates(["cls"]).select("cls", "sig", "text").mapInArrow(_shingles(k), "cls binary, sig binary, shingles binary"), "sets")

    def confirmed(tasks: DataFrame) -> DataFrame:
        rows = tasks.join(sets, "cls").select("task", "cls", "label", "side", "sig", "shingles")
        return rows.repartition("task").sortWithinPartitions("task").mapInArrow(_links(num, den, tau), "a binary, b binary")

    least = stage(groups.groupBy("grp").agg(F.min("cls").alias("hub"), F.count("*").alias("n_rows")), "least", n_nodes)
    hubs = stage(spread_join(groups, least, "grp", ["cls"]).groupBy("cls").agg(F.min("hub").alias("hub")).where("cls != hub"), "hubs", n_classes)
    parts = stage(hubs.groupBy("hub").agg(F.count("*").alias("n_rows")).withColumn("parts", F.ceil(F.col("n_rows") / chunk)), "parts", n_classes)
    dealt = spread_join(hubs, parts, "hub", ["cls"]).select("hub", "cls", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"))
    dealt = dealt.union(dealt.select("hub", F.col("hub").alias("cls"), "part").distinct())
    first = stage(confirmed(dealt.select(F.xxhash64("hub", "part").alias("task"), "cls", F.col("cls").alias("label"), F.lit(-1).cast("long").alias("side"))), "links1", n_classes)

    named = components(first)
    labelled = stage(groups.join(named.withColumnRenamed("vertex", "cls"), "cls", "left").select("grp", "cls", F.coalesce("label", "cls").alias("label")), "labelled", n_nodes)
    shares = labelled.groupBy("grp", "label").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", "n").alias("main"))
    open_ = stage(shares.where("n > most").withColumn("n_rows", F.col("n")), "shares", n_nodes)
    labelled = stage(spread_join(labelled, open_, "grp", ["cls"]), "open", n_nodes)
    task = lambda *cols: F.xxhash64(*cols).alias("task")
    small = labelled.where(F.col("n") <= chunk).select(F.col("grp").alias("task"), "cls", "label", F.lit(-1).cast("long").alias("side"))
    # The largest component's members fill the first chunks and the others the rest: two
    # chunks of that component need no meeting, so the work is others times all, not all times all.
    pieces = lambda c: F.ceil(c / chunk).cast("long")
    own, parts = pieces(F.col("most")), pieces(F.col("most")) + pieces(F.col("n") - F.col("most"))
    big = labelled.where(F.col("n") > chunk).select("grp", "cls", "label", own.alias("own"), parts.alias("parts"), (F.col("label") == F.col("main")).alias("in_main"))
    h = F.xxhash64("cls")
    big = big.withColumn("part", F.when(F.col("in_main"), F.pmod(h, F.col("own"))).otherwise(F.col("own") + F.pmod(h, F.col("parts") - F.col("own"))))
    # Chunk p meets chunk q: in task (min, max) its rows carry side p; task (p, p) compares all.
    faced = big.withColumn("q", F.explode(F.sequence(F.when(F.col("in_main"), F.col("own")).otherwise(F.lit(0).cast("long")), F.col("parts") - 1)))
    faced = faced.select(task("grp", F.least("part", "q"), F.greatest("part", "q")), "cls", "label", F.when(F.col("part") == F.col("q"), F.lit(-1)).otherwise(F.col("part")).cast("long").alias("side"))
    second = stage(confirmed(small.union(faced)), "links2")
    if not is_empty(second):
        # The stars found so far stand for the links behind them.
        named = components(named.select(F.col("vertex").alias("a"), F.col("label").alias("b")).union(second))

    # Least ids by class and component first; documents meet only their class's row.
    found = stage(classes.select("cls", "least", "size").join(named.withColumnRenamed("vertex", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "found", n_classes)
    heads = found.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n_rows"))
    heads = stage(spread_join(found.select("cls", "label", "size"), heads, "label", ["cls"]).select("cls", "component_id", F.col("size").alias("n_rows")), "heads", n_classes)
    out = spread_join(members, heads, "cls", ["key"], "left")
    return out.select("key", "doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op10_chosen_path(spark, sf_dir: str) -> DataFrame:
    """The digest of ``near_duplicates`` over the whole of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")
