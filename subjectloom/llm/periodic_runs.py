"""All maximal runs of words of each text, by Lempel-Ziv blocks.

A run is a stretch of consecutive words with smallest period q and at least
``max(shortest, 3 q)`` words that no neighbouring word extends.

The method.  Suffix array and LCP give the array of longest previous factors
(Crochemore and Ilie, "Computing longest previous factor in linear time", 2008) and
with it the Lempel-Ziv blocks.  A run that touches the border b of two blocks is found
by extending the two positions b and b + q (or b - q and b) to both sides (Main,
"Detecting leftmost maximal periodicities", 1989).  A period's distance from its border is
bounded by the blocks beside it:

* Whatever starts at s + q or later and lies in the run occurred q words before, so a
  block that starts there reaches the run's end, and only one border lies in [s + q, t).
* Where there is one, b, the border before it lies left of s + q.  If it lies left of s, q is at
  most the block that ends at b; else the run's part right of that border is longer than 2 q and
  lies in the two blocks that follow it.
* Where there is none, the last border in [s, s + q) is followed by a block that reaches
  t; without that one as well, the run ends where its block does, or lies inside the block.

So the periods tried at a border sum up to a few times the length of the text.  A run
inside a block without touching its borders is a copy of one that starts earlier: runs
are kept in buckets by start, and each block copies the buckets of its source from left to
right (Kolpakov and Kucherov, 1999).

Spark deals the rows; a row needs nothing from another, so nothing is shuffled.  Inside a
task the texts of one Arrow batch are handled together: words are numbered exactly (no
hashes), classes of equal stretches of 2^k words are refined by sorting (only those still
shared), the last classes are the suffix array, and extensions to either side compare classes
from the longest stretch down.  A run contains two equal stretches of 16 words a period apart, so
texts that have no two equal stretches of that many words have no run and go no further.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, clean_text, mix, small_batches, text_bytes

SHORTEST, EXPONENT = 24, 3

RUNS = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_collapsed", pa.int64()), ("collapsed_text", pa.string())])


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document whose id's checksum ends in 0, with its tail made periodic; others as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


def _repeats(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Documents (numbers) that may have two equal stretches of ``width`` words."""
    m = len(ids) - width + 1
    if m < 1:
        return np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + m].astype(np.uint64) + np.uint64(1)
    inside = doc[:m] == doc[width - 1 :]
    h = mix(h[inside] ^ mix(doc[:m][inside].astype(np.uint64)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    return np.unique(doc[:m][inside][order][1:][same])


def _shared(ranked: np.ndarray) -> np.ndarray:
    """Whether each of these ascending values stands more than once."""
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    return same[1:] | same[:-1]


class Classes:
    """Classes of equal stretches of 2^k words, for several documents laid end to end.

    A stretch that a document's end cuts off equals no other, and none reaches into the next
    document: ``start[k][i] == start[k][j]`` says that the 2^k words at i and at j are equal."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        n = len(ids)
        self.n = n
        end = np.searchsorted(doc, doc, "right")
        _, rank = np.unique(doc.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)
        self.levels = [rank.astype(np.int32)]
        width = 1
        # Ranks keep the order of stretches; only ranks that several stretches share are refined.
        rank = self._first_place(rank)
        at = np.argsort(rank, kind="stable")
        while len(at := at[_shared(rank[at])]):
            after = np.full(len(at), -1, np.int64)
            inside = at + width < end[at]
            after[inside] = rank[at[inside] + width]
            by = np.lexsort((after, rank[at]))
            at, after = at[by], after[by]
            old = rank[at]
            opens = np.ones(len(at), bool)
            opens[1:] = old[1:] != old[:-1]
            new = opens.copy()
            # Two stretches cut off by the end of one document differ in length.
            new[1:] |= (after[1:] != after[:-1]) | (after[1:] < 0)
            begin = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            rank = rank.copy()
            rank[at] = old + first - begin
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")

    @staticmethod
    def _first_place(rank: np.ndarray) -> np.ndarray:
        """Each rank as the number of stretches before it, so that refined ranks never collide."""
        counts = np.bincount(rank)
        return (np.cumsum(counts) - counts)[rank]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretch that starts at i and at j (i != j)."""
        i, j, n = i.copy(), j.copy(), self.n
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            ok = (i < n) & (j < n)
            same = ok & (level[np.where(ok, i, 0)] == level[np.where(ok, j, 0)])
            step = same.astype(np.int64) << k
            i += step
            j += step
            total += step
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretch that ends before i and before j (i != j)."""
        i, j = i.copy(), j.copy()
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            ok = (i >= width) & (j >= width)
            same = ok & (level[np.where(ok, i - width, 0)] == level[np.where(ok, j - width, 0)])
            step = same.astype(np.int64) << k
            i -= step
            j -= step
            total += step
        return total


def previous_factors(suffixes: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """For each position the length of the longest factor that also starts earlier, and where.

    ``lcp[r]``: of the suffixes of ranks r - 1 and r.  Positions leave a list linked by rank
    from the last one on, so that a suffix's neighbours are those that start before it."""
    n = len(suffixes)
    at = suffixes.tolist()
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.arange(n)
    rank = rank.tolist()
    up, down = list(range(-1, n - 1)), list(range(1, n + 1))
    common = [*lcp.tolist(), 0]
    length, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        u, d = up[r], down[r]
        a, b = common[r], common[d] if d < n else 0
        if a >= b:
            if a:
                length[i], source[i] = a, at[u]
        else:
            length[i], source[i] = b, at[d]
        if d < n:
            common[d] = a if a < b else b
            up[d] = u
        if u >= 0:
            down[u] = d
    return length, source


def maximal_runs(ids: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs of at least ``max(shortest, 3 period)`` words, for
    documents laid end to end (positions count from the first of them), by start and period."""
    n = len(ids)
    if not n:
        return np.zeros((0, 3), np.int64)
    classes = Classes(ids, doc)
    order = classes.suffixes
    lcp = np.zeros(n, np.int64)
    lcp[1:] = classes.forward(order[:-1], order[1:])
    length, source = previous_factors(order, lcp)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])).tolist()
    borders, blocks = [], []  # (border, block before, two blocks after); (start, end, source)
    for lo, hi in zip(first, [*first[1:], n], strict=True):
        cuts = [lo]
        while cuts[-1] < hi:
            cuts.append(cuts[-1] + max(1, length[cuts[-1]]))
        for j, b in enumerate(cuts):
            borders.append((b, b - cuts[max(j - 1, 0)], cuts[min(j + 2, len(cuts) - 1)] - b, lo, hi))
        blocks += [(b, e, source[b]) for b, e in zip(cuts[:-1], cuts[1:], strict=True) if e - b >= shortest + 2]
    b, before, after, lo, hi = np.array(borders, np.int64).T
    found = []
    for sign, most in ((-1, np.minimum(before, b - lo)), (1, np.minimum(after // 2, hi - b - 1))):
        most = np.maximum(most, 0)
        for part in _slices(most, 1 << 20):
            count = most[part]
            at = np.repeat(b[part], count)
            q = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + 1
            i = at - q if sign < 0 else at
            f, g = classes.forward(i, i + q), classes.backward(i, i + q)
            ok = f + g + q >= np.maximum(shortest, EXPONENT * q)
            found.append(np.stack([(i - g)[ok], (i + q + f)[ok], q[ok]], 1))
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    least = np.ones(len(found), bool)  # the least period of each stretch
    least[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    buckets: dict[int, dict[int, int]] = defaultdict(dict)
    for s, t, q in found[least].tolist():
        buckets[s][t] = q
    starts = sorted(buckets)
    for lo, hi, old in blocks:
        shift, i = lo - old, bisect.bisect_right(starts, old)
        while i < len(starts) and starts[i] < old + hi - lo:
            s = starts[i]
            inner = [(t, q) for t, q in buckets[s].items() if t < old + hi - lo]
            if inner:
                if s + shift not in buckets:
                    bisect.insort(starts, s + shift)
                for t, q in inner:
                    buckets[s + shift].setdefault(t + shift, q)
            i += 1
    out = sorted((s, q, t) for s in starts for t, q in buckets[s].items())
    return np.array([(s, t, q) for s, q, t in out], np.int64).reshape(-1, 3)


def _slices(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of about ``most`` in sum (one element at least)."""
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def _digest(doc_id, words: list[bytes], runs: list[tuple[int, int, int]], texts: bool) -> tuple:
    """One row of the result; ``runs``: (start, end, period) by start and period."""
    n = len(words)
    if runs:
        best = runs[0]
        for s, t, q in runs[1:]:
            long, was = (t - s) * best[2], (best[1] - best[0]) * q
            if long > was:
                best = (s, t, q)
        gone = np.zeros(n + 1, np.int64)
        for s, t, q in runs:
            gone[s + q] += 1
            gone[t] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0)]
        top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    else:
        top = (None, None, None, None)
    listed = "".join(f"{s},{t - s},{q}\n" for s, t, q in runs)
    kept = b" ".join(words)
    return doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), n, len(words), kept.decode("utf-8", "replace") if texts else None


def _find(shortest: int, loops: bool, texts: bool):
    width = shortest - shortest // EXPONENT  # equal stretches of a run, one period apart

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids_of: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        names, held, parts = batch.column("doc_id").to_pylist(), [], [np.zeros(0, np.int64)]
        for doc_id, text in zip(names, text_bytes(batch, "text"), strict=True):
            words = text.split()
            if loops:
                words = looped(doc_id, words)
            held.append(words)
            parts.append(np.fromiter(map(ids_of.__getitem__, words), np.int64, len(words)))
        parts = parts[1:] or parts
        sizes = np.array([len(p) for p in parts], np.int64)
        ids, doc = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        some = _repeats(ids, doc, width)
        del ids, doc
        for group in _slices(sizes[some], 200_000):
            these = some[group]
            first = np.cumsum(sizes[these]) - sizes[these]
            own = np.concatenate([parts[d] for d in these])
            runs = maximal_runs(own, np.repeat(np.arange(len(these)), sizes[these]), shortest)
            for k, (s, t, q) in zip(np.searchsorted(first, runs[:, 0], "right") - 1, runs.tolist(), strict=True):
                found[int(these[k])].append((s - int(first[k]), t - int(first[k]), q))
        for d, (doc_id, words) in enumerate(zip(names, held, strict=True)):
            yield _digest(doc_id, words, found.get(d, []), texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from bounded(rows(batch), RUNS, 2_000)

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, loops: bool = False, texts: bool = False) -> DataFrame:
    """The runs of every text: ``doc_id, n_runs``, the run with the greatest exponent (``start,
    length, period, exponent_milli``; of equal ones the first, then the least period),
    digests of all runs and of the text with each run cut to its first period
    (``runs_sha256, collapsed_sha256``), ``n_words, n_collapsed`` and, if ``texts``, ``collapsed_text``.

    ``loops`` first makes the tail of one document in ten periodic (the stated rule of the
    query).  Defined results: null and empty texts have no words and no runs (four nulls, digests
    of the empty string); a null id is carried through and never looped; repeated rows are
    judged each by itself; an empty table gives an empty result; other columns are ignored,
    whatever their names; a very long text is one row of one task (about 150 bytes of memory
    for each word that stands in a text with repeats).
    """
    if shortest < 3:
        raise ValueError("a run has three words at least")
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))
    ddl = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_collapsed long, collapsed_text string"
    out = base.mapInArrow(_find(shortest, loops, texts), ddl)
    return out if texts else out.drop("collapsed_text")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """``periodic_runs`` over the whole of ``documents``, one in ten looped as the contract says."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), loops=True)
