"""Similarity joins: dense all-pairs in blocks, sparse by shared term, TF-IDF, strings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.folders import keep
from .metrics import auc
from .packing import packed, unpacked


#: Rows of a block of documents or strings: a task holds two blocks and makes their product.
BLOCK_ROWS = 512
#: Vectors of a block at most, blocks that keep all machines busy, and vectors of a side of the tile
#: of a block product that is made at once.
WIDE_ROWS, LEAST_BLOCKS, TILE = 16_384, 12, 512
#: Documents of a block at most.
WIDE_DOCUMENTS = 4096


def _blocks(rows: DataFrame) -> int:
    return -(-rows.count() // BLOCK_ROWS) or 1


def _wide_blocks(rows: DataFrame, most: int = WIDE_ROWS) -> int:
    """Each row is sent once for each block, so there are few: what is shuffled is the table times this number."""
    n = rows.count()
    return max(-(-n // most), min(-(-n // BLOCK_ROWS), LEAST_BLOCKS)) or 1


def all_pairs(rows: DataFrame, key: str = "ord", blocks: int | None = None, carry: tuple[str, ...] = ("topic", "v")) -> DataFrame:
    """Every unordered pair once (left key < right key), columns suffixed _a and _b.

    Rows are dealt into blocks and block pairs are equi-joined, so that the work is
    blocks^2 / 2 even tasks rather than one nested loop over a broadcast side.  There are as
    many blocks as keep each at about BLOCK_ROWS rows.
    """
    blocks = blocks or _blocks(rows)
    block = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    left = block.select(F.col(key).alias("i"), *[F.col(c).alias(f"{c}_a") for c in carry], F.col("block").alias("ba"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bb"))
    right = block.select(F.col(key).alias("j"), *[F.col(c).alias(f"{c}_b") for c in carry], F.col("block").alias("bb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("ba"))
    return left.join(right, ["ba", "bb"]).where("i < j").drop("ba", "bb")


class Tile(NamedTuple):
    """A part of a block product: ids and coded topics of its rows and columns, the dictionary of topics,
    similarities, and which of them are pairs (none: all are)."""

    i: np.ndarray
    j: np.ndarray
    ti: np.ndarray
    tj: np.ndarray
    topics: pa.Array
    sim: np.ndarray
    held: np.ndarray | None

    def same(self) -> np.ndarray:
        return self.ti[:, None] == self.tj

    def of(self, wanted: np.ndarray) -> np.ndarray:
        return wanted if self.held is None else wanted & self.held


def pair_tiles(rows: DataFrame, reduce: Callable[[Iterator[Tile]], Iterator[pa.Table]], ddl: str, key: str = "ord", blocks: int | None = None) -> DataFrame:
    """What ``reduce`` makes of all pairs of unit vectors, each pair once, a block pair at a time.

    Every row goes to the ``blocks`` block pairs that its block is in.  A block pair is a task's group; its product
    is made in tiles, and only what ``reduce`` returns of them leaves the task.  What a task holds is bounded by
    WIDE_ROWS and TILE and does not grow with the table."""
    blocks = blocks or _wide_blocks(rows)
    block = rows.select(F.col(key).cast("long").alias("i"), "topic", "v", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    dealt = block.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = dealt.select("i", "topic", "v", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        b, ids = table.column("b").to_numpy(), table.column("i").to_numpy()
        coded = table.column("topic").combine_chunks().dictionary_encode()
        topics = coded.indices.to_numpy(zero_copy_only=False)
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        del table
        order = np.argsort(ids, kind="stable")
        left, right = order[b[order] == lo], order[b[order] == hi]

        def tiles() -> Iterator[Tile]:
            for at in range(0, len(left), TILE):
                p = left[at : at + TILE]
                own = x[p]
                for to in range(at if lo == hi else 0, len(right), TILE):
                    q = right[to : to + TILE]
                    yield Tile(ids[p], ids[q], topics[p], topics[q], coded.dictionary, own @ x[q].T, ids[p][:, None] < ids[q] if lo == hi else None)

        for part in reduce(tiles()):
            yield from part.to_batches()

    return dealt.groupBy("lo", "hi").applyInArrow(product, ddl)


def pair_blocks(rows: DataFrame, make: Callable[..., pa.Table], ddl: str, key: str = "ord", blocks: int | None = None) -> DataFrame:
    """What ``make(i, j, topic, same, sim)`` keeps of all pairs of unit vectors, each pair once (i < j);
    ``topic`` is that of i.  The pairs of one tile are made at once."""

    def flat(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
        for t in tiles:
            r, c = np.indices(t.sim.shape).reshape(2, -1) if t.held is None else np.nonzero(t.held)
            i, j, p, q = t.i[r], t.j[c], t.ti[r], t.tj[c]
            turned = i > j
            first = np.where(turned, q, p)
            yield make(np.where(turned, j, i), np.where(turned, i, j), t.topics.take(pa.array(first)), p == q, t.sim[r, c])

    return pair_tiles(rows, flat, ddl, key, blocks)


def pair_counts(rows: DataFrame, bins: Callable[[np.ndarray], np.ndarray], key: str = "ord", blocks: int | None = None) -> DataFrame:
    """``same, bin, n``: all pairs, counted by ``bins`` (whole numbers from 0) of their similarities to nine digits.
    A row for each bin is all that leaves a block product."""

    def count(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
        total = np.zeros(0, np.int64)
        for t in tiles:
            code = 2 * bins(np.round(t.sim, 9)).astype(np.int64) + t.same()
            n = np.bincount(code.ravel() if t.held is None else code[t.held])
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.table({"same": at % 2 == 1, "bin": at // 2, "n": total[at]})

    found = pair_tiles(rows, count, "same boolean, bin long, n long", key, blocks)
    return found.groupBy("same", "bin").agg(F.sum("n").alias("n"))


def cosine_pairs(rows: DataFrame, key: str = "ord", blocks: int | None = None) -> DataFrame:
    """``i, j, same, sim`` over all pairs of unit vectors, each pair once (i < j)."""
    return pair_blocks(rows, lambda i, j, topic, same, sim: pa.table({"i": i, "j": j, "same": same, "sim": sim}), "i long, j long, same boolean, sim double", key, blocks)


def hardest_pairs(rows: DataFrame, most: int, blocks: int | None = None) -> DataFrame:
    """``i, j, sim``: the ``most`` most similar pairs of different topics (to nine digits, then by i and j).
    A block product keeps its own best; those are merged."""

    def best(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
        i, j, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for t in tiles:
            # Similarities are compared to nine digits: what is less by more is worse than all kept.
            least = sim[-1] - 1e-9 if len(sim) == most else -np.inf
            r, c = np.nonzero(t.of((t.sim >= least) & ~t.same()))
            if len(r):
                i, j = np.append(i, np.minimum(t.i[r], t.j[c])), np.append(j, np.maximum(t.i[r], t.j[c]))
                sim = np.append(sim, np.round(t.sim[r, c], 9))
                if len(sim) > most:
                    near = np.flatnonzero(sim >= np.partition(sim, -most)[-most])
                    i, j, sim = i[near], j[near], sim[near]
                order = np.lexsort((j, i, -sim))[:most]
                i, j, sim = i[order], j[order], sim[order]
        yield pa.table({"i": i, "j": j, "sim": sim})

    return pair_tiles(rows, best, "i long, j long, sim double", blocks=blocks).orderBy(F.desc("sim"), "i", "j").limit(most)


def shuffle_key(i: np.ndarray, j: np.ndarray) -> list[str]:
    """A key of a pair whose order stands for a seeded shuffle."""
    return [hashlib.md5(f"{a}:{b}".encode()).hexdigest() for a, b in zip(i.tolist(), j.tolist(), strict=True)]


#: MD5: rotations and constants of its 64 steps.
_TURNS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_SINES = [int(abs(np.sin(k + 1)) * 2**32) for k in range(64)]


def _lead(block: np.ndarray, bits: int) -> np.ndarray:
    """The first eight hex digits, as numbers, of the MD5 of messages of ``bits`` bits (a row of words each, the
    rest of the one block being zero)."""
    words = dict(enumerate(np.ascontiguousarray(block.T))) | {14: np.uint32(bits)}
    a, b, c, d = (np.full(len(block), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for k in range(64):
        if k < 16:
            f, g = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, g = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * k % 16
        f += a
        if g in words:
            f += words[g]
        f += np.uint32(_SINES[k])
        low = f >> np.uint32(32 - _TURNS[k])
        f <<= np.uint32(_TURNS[k])
        f |= low
        f += b
        a, d, c, b = d, c, b, f
    return (a + np.uint32(0x67452301)).byteswap()


def shuffle_lead(i: np.ndarray, j: np.ndarray, at_once: int = 32_768) -> np.ndarray:
    """The first eight hex digits of ``shuffle_key`` as numbers, for many pairs at once."""
    out = np.zeros(len(i), np.uint32)
    for at in range(0, len(i), at_once):
        a, b = i[at : at + at_once].astype(np.int64), j[at : at + at_once].astype(np.int64)
        if min(a.min(), b.min()) < 0:
            out[at : at + at_once] = [int(h[:8], 16) for h in shuffle_key(a, b)]
            continue
        digits = lambda x: 1 + (x[:, None] >= 10 ** np.arange(1, 19)).sum(1) if len(x) else x
        (ua, pa_), (ub, pb) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        la, lb = digits(ua)[pa_], digits(ub)[pb]
        for m in np.unique(la).tolist():
            for n in np.unique(lb[la == m]).tolist():
                own = np.flatnonzero((la == m) & (lb == n))
                text = np.zeros((len(own), -(-(m + n + 2) // 4) * 4), np.uint8)
                for u, p, size, start in ((ua, pa_, m, 0), (ub, pb, n, m + 1)):
                    spelt = (u[:, None] // 10 ** np.arange(size)[::-1] % 10 + 48).astype(np.uint8)
                    text[:, start : start + size] = spelt[p[own]]
                text[:, m] = 58
                text[:, m + 1 + n] = 0x80
                out[at + own] = _lead(text.view("<u4"), 8 * (m + 1 + n))
    return out


def random_positives(rows: DataFrame, most: int, blocks: int | None = None) -> DataFrame:
    """``i, j, h``: at most ``most`` pairs of each topic, by the shuffle key ``h``."""
    kind = rows.schema["topic"].dataType.simpleString()

    def first(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
        best: dict[int, list[tuple]] = {}
        names = None
        for t in tiles:
            names = t.topics
            r, c = np.nonzero(t.of(t.same()))
            i, j, code = np.minimum(t.i[r], t.j[c]), np.maximum(t.i[r], t.j[c]), t.ti[r]
            lead = shuffle_lead(i, j)
            order = np.lexsort((lead, code)) if not best else np.arange(len(code))
            for k in np.unique(code).tolist():
                own, kept = order[code[order] == k], best.get(k, [])
                # Pairs that share the eight digits of the last one kept are compared whole.
                last = int(kept[-1][0][:8], 16) if len(kept) == most else int(np.partition(lead[own], most - 1)[most - 1]) if len(own) > most else 2**32
                near = own[lead[own] <= last]
                new = zip(shuffle_key(i[near], j[near]), i[near].tolist(), j[near].tolist(), strict=True)
                best[k] = sorted([*kept, *new])[:most]
        found = [(k, *x) for k, kept in best.items() for x in kept]
        k, h, i, j = zip(*found, strict=True) if found else ((), (), (), ())
        if names is not None:
            yield pa.table({"topic": names.take(pa.array(k, pa.int64())), "i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "h": pa.array(h, pa.string())})

    found = pair_tiles(rows, first, f"topic {kind}, i long, j long, h string", blocks=blocks)
    return found.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("h"))).where(F.col("r") <= most).select("i", "j", "h")


def random_easy(rows: DataFrame, most: int, limit: float, blocks: int | None = None) -> DataFrame:
    """``i, j, h``: ``most`` pairs of different topics with a similarity (to nine digits) of ``limit`` or less, by
    the shuffle key."""

    def first(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
        best: list[tuple] = []
        for t in tiles:
            r, c = np.nonzero(t.of((np.round(t.sim, 9) <= limit) & ~t.same()))
            i, j = np.minimum(t.i[r], t.j[c]), np.maximum(t.i[r], t.j[c])
            lead = shuffle_lead(i, j)
            # Pairs that share the eight digits of the last one kept are compared whole.
            last = int(best[-1][0][:8], 16) if len(best) == most else int(np.partition(lead, most - 1)[most - 1]) if len(lead) > most else 2**32
            near = np.flatnonzero(lead <= last)
            best = sorted([*best, *zip(shuffle_key(i[near], j[near]), i[near].tolist(), j[near].tolist(), strict=True)])[:most]
        h, i, j = zip(*best, strict=True) if best else ((), (), ())
        yield pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "h": pa.array(h, pa.string())})

    return pair_tiles(rows, first, "i long, j long, h string", blocks=blocks).orderBy("h", "i", "j").limit(most)


#: Bins of a pass over all pairs, and values that are gathered at once.
BINS, GATHERED = 1 << 16, 50_000


def pair_quantile(rows: DataFrame, q: float, blocks: int | None = None, gathered: int = GATHERED) -> float | None:
    """The q-quantile, linearly interpolated, of the similarities (to nine digits) of pairs of different topics."""
    return pair_quantile_of(rows, q, blocks, gathered)[0]


def pair_quantile_of(rows: DataFrame, q: float, blocks: int | None = None, gathered: int = GATHERED) -> tuple[float | None, int]:
    """``pair_quantile`` and the number of pairs of different topics.

    Similarities are counted as whole billionths.  Each pass counts pairs in at most BINS bins of the
    intervals that hold the two ranks in question (a row for each bin is all that leaves a task); the
    intervals shrink until one holds few enough values to be sorted, or a single one."""
    blocks = blocks or _wide_blocks(rows)

    def counted(spans: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
        """Pairs by interval (low, width of a bin, number of bins) and bin."""

        def count(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
            total = [np.zeros(n, np.int64) for _, _, n in spans]
            for t in tiles:
                unit = np.rint(t.sim * 1e9).astype(np.int64)[t.of(~t.same())]
                for (lo, width, n), own in zip(spans, total, strict=True):
                    own += np.bincount((unit[(unit >= lo) & (unit < lo + width * n)] - lo) // width, minlength=n)
            for k, own in enumerate(total):
                at = np.flatnonzero(own)
                yield pa.table({"k": np.full(len(at), k), "bin": at, "n": own[at]})

        found = pair_tiles(rows, count, "k long, bin long, n long", blocks=blocks).groupBy("k", "bin").agg(F.sum("n").alias("n"))
        return {(r["k"], r["bin"]): r["n"] for r in found.collect()}

    # Unit vectors: from -1 to 1, and a little for rounding.
    whole = (-1_100_000_000, -(-2_200_000_000 // BINS), BINS)
    first = counted([whole])
    total = sum(first.values())
    if not total:
        return None, 0
    place = (total - 1) * q
    ranks = sorted({int(np.floor(place)), min(int(np.floor(place)) + 1, total - 1)})
    state = {r: (whole, 0, {b: n for (_, b), n in first.items()}) for r in ranks}  # interval, values below it, its bins
    out: dict[int, float] = {}
    while len(out) < len(ranks):
        for r in set(ranks) - set(out):
            (lo, width, _), below, bins = state[r]
            for b in sorted(bins):
                if below + bins[b] > r:
                    break
                below += bins[b]
            if width == 1:
                out[r] = (lo + b) / 1e9
            else:
                # As many bins as values that could be told apart, if there are few values.
                finer = 1 if bins[b] <= gathered else -(-width // BINS)
                state[r] = ((lo + b * width, finer, -(-width // finer)), below, {})
        spans = sorted({state[r][0] for r in ranks if r not in out})
        found = counted(spans) if spans else {}
        for r in set(ranks) - set(out):
            k = spans.index(state[r][0])
            state[r] = (*state[r][:2], {b: n for (s_, b), n in found.items() if s_ == k})
    low, high = out[ranks[0]], out[ranks[-1]]
    return low + (high - low) * (place - np.floor(place)), total


#: Billionths of a cell, billionths of a bin at first, and bins that a task counts at once.
CELL, FIRST_WIDTH, COUNTED = 1 << 22, 64, 1 << 25
#: Pairs that are few enough to be formed and sorted.
FORMED = 1 << 20


def _few_blocks(rows: DataFrame, most: int = 2 * WIDE_ROWS) -> int:
    """As few blocks as have two block pairs for each core, for tasks whose results are as large for few pairs as for many."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(-(-n // most), min(-(-n // BLOCK_ROWS), int(np.ceil(np.sqrt(4 * cores + 0.25) - 0.5)))) or 1


def pair_auc(rows: DataFrame, digits: int, blocks: int | None = None, width: int = FIRST_WIDTH, counted: int = COUNTED, formed: int = FORMED) -> float | None:
    """The AUC of similarities (to nine digits) of pairs of one topic against those of two, with average ranks for ties,
    rounded to ``digits``; none with one class.

    Similarities are counted as whole billionths, by class, in bins; counts leave a block product packed by cells of
    bins.  What pairs of one bin add lies between nothing and all of them: the cells with most of that are counted
    anew in narrower bins until both bounds round alike.  A bin of one billionth has ties only and leaves no doubt."""
    n = rows.count()
    if n * (n - 1) // 2 <= formed:
        pairs = cosine_pairs(rows, blocks=blocks).select("same", F.round("sim", 9).alias("sim"))
        return next((None if r["auc"] is None else round(r["auc"], digits) for r in auc(pairs, "sim", "same").collect()), None)
    blocks = blocks or _few_blocks(rows)
    # Unit vectors: from -1 to 1, and a little for rounding.
    low, cells = -1_000_010_000, -(-2_000_020_000 // CELL)

    def cells_of(chosen: list[int], width: int) -> dict[int, tuple]:
        """``p, n, won, doubt`` of the chosen cells, in bins of ``width`` billionths."""
        size, slot = CELL // width, np.full(cells, -1)
        slot[chosen] = np.arange(len(chosen))
        every = len(chosen) == cells

        def count(tiles: Iterator[Tile]) -> Iterator[pa.Table]:
            total = np.zeros(2 * len(chosen) * size, np.int32)
            for t in tiles:
                # Whole numbers below 2^53 times a power of two: bins are exact.
                unit = t.sim * 1e9
                np.rint(unit, out=unit)
                unit -= low
                unit *= 1 / width
                at = unit.astype(np.int64)
                own, held = t.same(), t.held
                if not every:
                    place = slot[at // size]
                    at = place * size + at % size
                    held = t.of(place >= 0)
                at *= 2
                at += own
                np.add.at(total, at.ravel() if held is None else at[held], np.int32(1))
            each = total.reshape(len(chosen), size, 2)
            for k, c in enumerate(chosen):
                if each[k].any():
                    yield pa.table({"cell": [c], "p": [packed(each[k, :, 1])], "n": [packed(each[k, :, 0])]})

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, n = np.zeros(size), np.zeros(size)
            for batch in batches:
                cell = batch.column("cell")[0].as_py()
                for a, b in zip(batch.column("p").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    p += unpacked(a)
                    n += unpacked(b)
            tied = float(p @ n)
            won = float(p @ (np.cumsum(n) - n)) + (tied / 2 if width == 1 else 0)
            yield pa.RecordBatch.from_pydict({"cell": [cell], "p": [float(p.sum())], "n": [float(n.sum())], "won": [won], "doubt": [0.0 if width == 1 else tied]})

        parts = pair_tiles(rows, count, "cell long, p binary, n binary", blocks=blocks)
        found = parts.groupBy("cell").applyInArrow(judged, "cell long, p double, n double, won double, doubt double")
        return {r["cell"]: tuple(r)[1:] for r in found.collect()}

    def rounds() -> Iterator[tuple[list[int], int]]:
        """The cells of each pass and the width of their bins, as long as it is asked for more."""
        size = CELL // width
        for at in range(0, cells, max(1, counted // size)):
            yield list(range(at, min(cells, at + max(1, counted // size)))), width
        while True:
            worst = max(state, key=lambda c: state[c][3])
            finer = max(1, state[worst][4] // 8)
            most = [c for c in sorted(state, key=lambda c: -state[c][3]) if state[c][4] > finer and state[c][3]]
            yield sorted(most[: max(1, counted * finer // CELL)]), finer

    state: dict[int, tuple] = {}
    left = cells
    for chosen, wide in rounds():
        state |= {c: (*x, wide) for c, x in cells_of(chosen, wide).items()}
        left -= len(chosen)
        if left > 0:
            continue
        p, n, won, doubt, _ = np.array([state[c] for c in sorted(state)], float).reshape(-1, 5).T
        pairs = p.sum() * n.sum()
        if not pairs:
            return None
        least = float((won + p * (np.cumsum(n) - n)).sum() / pairs)
        most = least + float(doubt.sum() / pairs)
        # Sums of doubles are off by less than 1e-12.
        if not doubt.any() or round(least - 1e-12, digits) == round(most + 1e-12, digits):
            return round((least + most) / 2, digits)


#: Entries that meet a tile of queries at once, and at first.
ENTRIES, FIRST_ENTRIES = 4096, 512


def _nearest(x: np.ndarray, q: np.ndarray, e: np.ndarray, keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and similarity of the ``most`` best entries (``keys`` in order, those up to q) of each query.

    What is below the least of the best so far is passed over; only what may be kept is rounded and sorted."""
    row, place, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least, at = np.full(len(q), -np.inf), 0
    end = int(np.searchsorted(keys, q.max(initial=keys[0] - 1), "right"))
    while at < end:
        to = min(end, at + (ENTRIES if at else FIRST_ENTRIES))
        s = x @ e[at:to].T
        if keys[to - 1] > q.min():
            s[keys[at:to] > q[:, None]] = -np.inf
        if to - at > most and np.isneginf(least).any():
            least = np.maximum(least, np.partition(s, to - at - most, axis=1)[:, to - at - most] - 1e-9)
        r, c = np.nonzero((s > least[:, None] - 1e-9) & (s > -np.inf))
        row, place, sim = np.append(row, r), np.append(place, c + at), np.append(sim, np.round(s[r, c], 9))
        order = np.lexsort((place, -sim, row))
        row, place, sim = row[order], place[order], sim[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        least[row[rank == most - 1]] = sim[rank == most - 1]
        row, place, sim = row[rank < most], place[rank < most], sim[rank < most]
        at = to
    return row, place, sim


def nearest_earlier(queries: DataFrame, entries: DataFrame, key: str, most: int, rows_a_block: int = WIDE_ROWS) -> DataFrame:
    """``q, key, sim, rank``: for each query (``q, v``) the ``most`` entries (``key, c``) with
    ``key <= q`` and the highest dot products, rounded to 9 digits, ties by key.

    Blocks are ranges of the key, so a block of queries meets the blocks of entries up to its own, in tiles that keep
    their own best; those are merged.  No entry is left out.
    """
    n, cores = entries.count(), entries.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n // rows_a_block), min(-(-n // BLOCK_ROWS), int(np.ceil(np.sqrt(4 * cores + 0.25) - 0.5)))) or 1
    cuts = sorted({int(c) for c in entries.approxQuantile(key, [k / blocks for k in range(1, blocks)], 0.1 / blocks)}) if blocks > 1 else []
    of = lambda c: F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda x: x <= F.col(c))) if cuts else F.lit(0)
    a = queries.select(F.lit(True).alias("asks"), F.col("q").cast("long").alias("id"), F.col("v").alias("x"), of("q").alias("bq")).withColumn("be", F.explode(F.sequence(F.lit(0), F.col("bq"))))
    b = entries.select(F.lit(False).alias("asks"), F.col(key).cast("long").alias("id"), F.col("c").alias("x"), of(key).alias("be")).withColumn("bq", F.explode(F.sequence(F.col("be"), F.lit(len(cuts)))))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False).astype(bool), table.column("id").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        own, other = order[asks[order]], order[~asks[order]]
        keys, e = ids[other], x[other]
        for at in range(0, len(own) if len(other) else 0, TILE):
            p = own[at : at + TILE]
            row, place, sim = _nearest(x[p], ids[p], e, keys, most)
            yield from pa.table({"q": ids[p][row], key: keys[place], "sim": sim}).to_batches()

    best = a.union(b.select(*a.columns)).groupBy("bq", "be").applyInArrow(product, f"q long, {key} long, sim double")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def recurring(rows: DataFrame, topic: str = "topic", least: int = 2) -> DataFrame:
    """Rows whose topic occurs ``least`` times or more."""
    counts = rows.groupBy(topic).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return rows.join(counts.drop("_n"), topic, "left_semi")


# ------------------------------------------------------------------ TF-IDF


def terms(docs: DataFrame, key: str, text: str, grams: int = 2) -> DataFrame:
    """``key, term, tf``: word tokens of two characters or more, and n-grams of them
    (short tokens are dropped before the n-grams are formed)."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)
    layer = docs.select(key, tokens.alias("w"))

    def joined(n: int):
        starts = F.slice("w", 1, F.greatest(F.size("w") - (n - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.array_join(F.slice(F.col("w"), i + 1, F.lit(n)), " "))

    parts = [F.col("w"), *[joined(n) for n in range(2, grams + 1)]]
    return layer.select(key, F.explode(F.concat(*parts)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, key: str, text: str, *, min_df: int = 2, max_df: float = 0.85, most: int = 50_000, grams: int = 2) -> DataFrame:
    """``key, term, weight``: (1 + ln tf)(ln((1 + N) / (1 + df)) + 1), unit length a
    document, over the ``most`` terms with most occurrences among those with
    ``min_df <= df <= max_df * N`` (ties of occurrences by term)."""
    tf = terms(docs, key, text, grams)
    n = docs.groupBy(F.lit(1).alias("one")).agg(F.count("*").cast("double").alias("docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("one", F.lit(1)).join(n, "one")
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("docs"))).orderBy(F.desc("cf"), "term").limit(most)
    idf = kept.select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").withColumn("raw", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    # A document's terms are gathered beside its length, so that they are made once.
    whole = raw.groupBy(key).agg(F.collect_list(F.struct("term", "raw")).alias("x"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("len"))
    return whole.select(key, "len", F.explode("x").alias("x")).select(key, "x.term", (F.col("x.raw") / F.col("len")).alias("weight"))


#: Terms whose weights are laid out densely at once in a block product.
TERMS_AT_ONCE = 4096


def sparse_pairs(weights: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """``i, j, sim`` of documents that share a term (weights are positive).

    Documents are dealt into few wide blocks, one row a document; a block pair is made in tiles.  The columns of a
    tile are laid out densely over a bounded number of terms at a time, and a row adds up those of its own terms.  A
    term that nearly every document has is a term among others, not a key with a square of rows.  Terms are told
    apart by 64-bit hashes."""
    docs = keep(weights.groupBy(F.col(key).cast("long").alias("i")).agg(F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list("weight").alias("w")), "documents")
    blocks = blocks or _wide_blocks(docs, WIDE_DOCUMENTS)
    block = docs.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    dealt = block.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = dealt.select("i", "terms", "w", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        b, ids = table.column("b").to_numpy(), table.column("i").to_numpy()
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        sizes = table.column("terms").combine_chunks().value_lengths().to_numpy()
        row, w = np.repeat(np.arange(len(ids)), sizes), flat("w")
        names, term = np.unique(flat("terms"), return_inverse=True)
        # By document and then by term, so that a document's terms of a chunk are a slice.
        order = np.lexsort((term, row))
        w, term = w[order], term[order]
        start = np.append(0, np.cumsum(sizes))
        edges = np.arange(0, len(names) + TERMS_AT_ONCE, TERMS_AT_ONCE)
        cuts = np.array([start[k] + np.searchsorted(term[start[k] : start[k + 1]], edges) for k in range(len(ids))], np.int64)
        by_id = np.argsort(ids, kind="stable")
        left, right = by_id[b[by_id] == lo], by_id[b[by_id] == hi]
        x = np.zeros((TERMS_AT_ONCE, TILE))
        for to in range(0, len(right), TILE):
            q = right[to : to + TILE]
            p = left[: to + TILE] if lo == hi else left
            s = np.zeros((len(p), len(q)))
            for chunk in range(len(edges) - 1):
                own = [slice(cuts[k, chunk], cuts[k, chunk + 1]) for k in q.tolist()]
                at = np.concatenate([term[o] for o in own]) - edges[chunk]
                column = np.repeat(np.arange(len(q)), [o.stop - o.start for o in own])
                x[at, column] = np.concatenate([w[o] for o in own])
                for r, k in enumerate(p.tolist()):
                    o = slice(cuts[k, chunk], cuts[k, chunk + 1])
                    if o.start < o.stop:
                        s[r] += w[o] @ x[term[o] - edges[chunk], : len(q)]
                x[at, column] = 0
            for first in range(0, len(p), TILE):
                part, own_p = s[first : first + TILE], p[first : first + TILE]
                r, c = np.nonzero(part > 0 if lo != hi else (part > 0) & (ids[own_p][:, None] < ids[q]))
                i, j = ids[own_p[r]], ids[q[c]]
                yield from pa.table({"i": np.minimum(i, j), "j": np.maximum(i, j), "sim": part[r, c]}).to_batches()

    return dealt.groupBy("lo", "hi").applyInArrow(product, "i long, j long, sim double")


def fuse(dense: DataFrame, sparse: DataFrame, alphas: list[float]) -> DataFrame:
    """``alpha, i, j, same, sim``: alpha * lexical + (1 - alpha) * dense; pairs without a
    common term have lexical similarity 0."""
    joined = dense.join(sparse.select("i", "j", F.col("sim").alias("lex")), ["i", "j"], "left").withColumn("lex", F.coalesce("lex", F.lit(0.0)))
    alpha = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    return joined.select("*", alpha).select("alpha", "i", "j", "same", (F.col("alpha") * F.col("lex") + (1 - F.col("alpha")) * F.col("sim")).alias("sim"))


# ------------------------------------------------------------- fuzzy strings


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, a machine word of columns at a time (Hyyro 2004)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


#: Strings of either side whose pairs are compared at once.
STRINGS_ACROSS, STRINGS_DOWN = 512, 128


def lcs_matrix(left: list[str], right: list[str]) -> np.ndarray:
    """``lcs_length`` of every string of ``left`` with every one of ``right``, those of ``left`` of 64 characters or
    fewer a character of many pairs at a time, in the shortest words that hold them; longer ones one by one."""
    out = np.zeros((len(right), len(left)), np.int32)
    sizes, widths = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    letters = {c: i for i, c in enumerate(sorted(set("".join(right))))}
    codes = np.full((len(right), int(widths.max(initial=0))), len(letters))
    for q, x in enumerate(right):
        codes[q, : len(x)] = [letters[c] for c in x]
    # Strings of one length stand together, so that none waits for a longer one.
    order = np.argsort(widths, kind="stable")
    for least, bits in ((0, 16), (17, 32), (33, 64)):
        word, rows = np.dtype(f"uint{bits}"), np.flatnonzero((sizes >= least) & (sizes <= bits))
        for lo in range(0, len(rows), STRINGS_ACROSS):
            own = rows[lo : lo + STRINGS_ACROSS]
            masks = np.zeros((len(letters) + 1, len(own)), np.uint64)
            for r, k in enumerate(own.tolist()):
                for i, c in enumerate(left[k]):
                    if c in letters:
                        masks[letters[c], r] |= np.uint64(1 << i)
            masks, full = masks.astype(word), np.array([(1 << n) - 1 for n in sizes[own].tolist()], np.uint64).astype(word)
            for at in range(0, len(order), STRINGS_DOWN):
                columns = order[at : at + STRINGS_DOWN]
                s = np.full((len(columns), len(own)), np.iinfo(word).max, word)
                u, v = np.empty_like(s), np.empty_like(s)
                for k in range(int(widths[columns[-1]])):
                    # Past a string's end there are no letters, and nothing changes.
                    np.take(masks, codes[columns, k], axis=0, out=u, mode="clip")
                    u &= s
                    np.add(s, u, out=v)
                    s ^= u
                    s |= v
                s &= full
                out[at : at + len(columns), own] = sizes[own].astype(np.int32) - np.bitwise_count(s)
    for k in np.flatnonzero(sizes > 64).tolist():
        out[:, k] = [lcs_length(left[k], right[q]) for q in order.tolist()]
    return out.T if (order[:-1] < order[1:]).all() else out[np.argsort(order)].T


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (len a + len b); 100 for two empty strings."""
    return pd.Series([100.0 if not x and not y else 200.0 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


#: Strings of a block at most, and of a side of a tile.
WIDE_STRINGS, STRINGS = 16_384, 1024


def fuzzy_pairs(strings: DataFrame, column: str = "s", key: str = "pos", threshold: float = 88.0, blocks: int | None = None) -> DataFrame:
    """``i, j, ratio`` of pairs whose indel ratio is the threshold or more; null strings
    resemble nothing.  Few wide blocks of strings meet as those of ``cosine_pairs`` do, in tiles of strings of like
    lengths: a tile whose lengths alone forbid the threshold is passed over."""
    strings = strings.where(F.col(column).isNotNull())
    blocks = blocks or _wide_blocks(strings, WIDE_STRINGS)
    block = strings.select(F.col(key).cast("long").alias("i"), F.col(column).alias("s"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    dealt = block.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = dealt.select("i", "s", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        b, ids, texts = table.column("b").to_numpy(), table.column("i").to_numpy(), table.column("s").to_pylist()
        size = np.array([len(x) for x in texts])
        order = np.argsort(size, kind="stable")
        left, right = order[b[order] == lo], order[b[order] == hi]
        for at in range(0, len(left), STRINGS):
            p = left[at : at + STRINGS]
            for to in range(at if lo == hi else 0, len(right), STRINGS):
                q = right[to : to + STRINGS]
                # What is common is no longer than the shorter string; lengths come in order.
                short, long_ = sorted([(size[p[0]], size[p[-1]]), (size[q[0]], size[q[-1]])])
                if 200 * short[1] < (threshold - 1e-4) * (short[1] + long_[0]) and short[1] < long_[0]:
                    continue
                same = lcs_matrix([texts[k] for k in p], [texts[k] for k in q])
                least = np.ceil((threshold - 1e-3) * np.arange(size[p[-1]] + size[q[-1]] + 1) / 200).astype(np.int32)
                r, c = np.nonzero(same >= least[size[p][:, None] + size[q]])
                if lo == hi:
                    once = r < c if at == to else np.ones(len(r), bool)
                    r, c = r[once], c[once]
                total = size[p[r]] + size[q[c]]
                ratio = np.where(total > 0, np.round(200.0 * same[r, c] / np.maximum(total, 1), 4), 100.0)
                near = ratio >= threshold
                i, j = ids[p[r[near]]], ids[q[c[near]]]
                yield from pa.table({"i": np.minimum(i, j), "j": np.maximum(i, j), "ratio": ratio[near]}).to_batches()

    return dealt.groupBy("lo", "hi").applyInArrow(compare, "i long, j long, ratio double")


#: Undecided pairs of strings that are settled one by one in a single task.
SETTLED_AT_ONCE = 100_000


def leader_clusters(strings: DataFrame, pairs: DataFrame, key: str = "pos", column: str = "s", settle: int = SETTLED_AT_ONCE) -> DataFrame:
    """``pos, s, leader, canonical``: greedy star clusters in first-seen order.

    A string joins the first leader before it that it resembles; leaders are strings
    that no earlier leader took: the lexicographically first independent set.  Rounds of
    joins find it: an undecided string without an earlier undecided neighbour leads, and
    its neighbours are taken.  When few pairs are undecided they are settled in order in
    one task.  The canonical form is the longest member, the first on ties.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        later: dict[int, list[int]] = {}
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            later.setdefault(a, []).append(b)
        taken: set[int] = set()
        for s in sorted(later):
            if s not in taken:
                taken.update(later[s])
        return pd.DataFrame({key: sorted(taken)}, dtype="int64")

    every = keep(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct(), "pairs")
    open_, taken = every, strings.select(F.col(key).cast("long").alias(key)).where("false")
    while (n := open_.count()) > settle:
        first = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = open_.join(first, "a", "left_semi").select(F.col("b").alias(key)).distinct()
        taken = keep(taken.union(gone), "taken")
        done = taken.union(first.select(F.col("a").alias(key)))
        for end in ("a", "b"):
            open_ = open_.join(done.select(F.col(key).alias(end)), end, "left_anti")
        open_ = keep(open_.select("a", "b"), "open")
    if n:
        # At most ``settle`` rows.
        taken = keep(taken.union(open_.groupBy(F.lit(1).alias("one")).applyInPandas(greedy, f"{key} long")), "taken")
    led = every.join(taken.select(F.col(key).alias("a")), "a", "left_anti").groupBy(F.col("b").alias(key)).agg(F.min("a").alias("leader")).join(taken, key, "left_semi")
    named = strings.join(led, key, "left").withColumn("leader", F.coalesce("leader", key))
    w = Window.partitionBy("leader").orderBy(F.desc(F.length(column)), key)
    return named.withColumn("canonical", F.first(column).over(w))
