"""Exact substring deduplication by compaction of a sparse de Bruijn graph.

Words that stand in a window of ``window`` consecutive words whose sequence
also starts anywhere else are removed, in all their copies.

The graph.  In every run of ``SPAN`` consecutive ``ANCHOR``-word k-mers the one
with the least hash (the leftmost of equals) is an anchor, as in minimizer-based
assemblers (Ye et al., "Exploiting sparseness in de novo genome assembly", 2012;
Chikhi et al., "Compacting de Bruijn graphs", 2016).  The tokens from one anchor
to the end of the next are an edge, keyed by a hash of all its words.  Because
``ANCHOR + 2 * SPAN - 1 <= window``, equal windows always contain an equal edge at
an equal offset, so only edges that occur twice can lie in a repeated window;
the graph has one edge in seven words instead of one at each word.

Compaction.  A join with the edge counts keeps repeated edges.  Consecutive
repeated edges of a document with equal counts are merged into a path, and a
join with the counts of whole paths (keyed by their edge sequence) tells which
paths never branch: those that occur as often as each of their edges.  Every
window inside such a path is repeated, and all its copies lie in copies of it.

Verification.  From the source coordinates the windows whose edges are all repeated
but that reach over an end of their path are hashed in full (two independent 64-bit
polynomials); those that occur twice are repeated.  Coverage goes back to the
documents by key, and whole texts are cut once.

All counts are aggregated before the shuffle, so a passage shared by a third of
the documents is a count, not a group.  The counts are staged before the joins back to
coordinates: adaptive execution splits a hot key only where both sides of a join
come straight from a shuffle.  The key of a path that a third of the documents share
is dealt into parts (``spread_join``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, bounded, clean_text, mix, small_batches, spread_join, stage, text_bytes, word_hashes

ANCHOR, SPAN = 6, 15
#: An edge has at most this many words: the anchors are at most SPAN apart.
LONGEST = ANCHOR + SPAN
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4D))

EDGE = pa.schema([("eh", pa.int64()), ("key", pa.int64()), ("pos", pa.int64())])
WINDOW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("at", pa.int64())])
CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> _Powers:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self


def _spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Hashes of the word sequences [start, end), equal wherever the words are."""
    p = powers.to(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p.up[: len(words)], out=sums[1:])
    return mix(((sums[ends] - sums[starts]) * p.down[starts]) ^ (ends - starts).astype(np.uint64))


def least_kmers(words: np.ndarray) -> np.ndarray:
    """For each run of SPAN k-mers of one document, the position of the least (leftmost)."""
    n = len(words) - ANCHOR + 1
    if n < SPAN:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(ANCHOR):
        h = h * _BASES[0] + words[i : i + n]
    h = mix(h)
    least = np.arange(n)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(h[a] <= h[b], a, b)
        width += step
    return least


def anchors(words: np.ndarray) -> np.ndarray:
    """Positions of the anchors of one document, ascending."""
    marked = np.zeros(len(words), bool)
    marked[least_kmers(words)] = True
    return np.flatnonzero(marked)


def candidates(words: np.ndarray, runs: list, window: int) -> np.ndarray:
    """Starts of windows that may be repeated and that no unbranched path covers.

    Equal windows share all edges from the first anchor chosen inside them to the
    last one, so these anchors must lie on one chain of repeated edges."""
    least = least_kmers(words)
    chain = np.full(len(words), -1)
    end = number = -1
    for r in sorted(runs, key=lambda r: r["s"]):
        number += r["s"] != end - ANCHOR
        end = r["e"]
        chain[r["s"] : end - ANCHOR + 1] = number
    last = window - ANCHOR + 1 - SPAN
    m = len(words) - window + 1
    first = chain[least[:m]]
    open_ = (first >= 0) & (first == chain[least[last : last + m]])
    for r in runs:
        if r["whole"]:
            open_[r["s"] : max(r["s"], r["e"] - window + 1)] = False
    return np.flatnonzero(open_)


def _edges(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, powers = WordHashes(), _Powers(_BASES[1])
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], schema=EDGE)

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), text_bytes(batch, "text"), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                w = word_hashes(words, cache)
                at = anchors(w)
                s, e = at[:-1], at[1:] + ANCHOR
                held.append((_spans(w, s, e, powers).view(np.int64), np.full(len(s), key, np.int64), s * 64 + (e - s)))
                size += len(s)
                if size >= 100_000:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return run


def _windows(window: int):
    """Hashes of the candidate windows of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, one, two = WordHashes(), _Powers(_BASES[0]), _Powers(_BASES[1])
        for batch in batches:
            held: list[tuple] = []
            for key, text, runs in zip(batch.column("key").to_pylist(), text_bytes(batch, "text"), batch.column("runs").to_pylist(), strict=True):
                w = word_hashes(text.split(), cache)
                at = candidates(w, runs, window)
                if len(at):
                    held.append((_spans(w, at, at + window, one).view(np.int64), _spans(w, at, at + window, two).view(np.int64), np.full(len(at), key, np.int64), at))
            if held:
                parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                for i in range(0, len(parts[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in parts], schema=WINDOW)

    return run


def _cut(texts: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if spans:
                    gone = np.zeros(n + 1, np.int64)
                    for x in spans:
                        gone[x["s"]] += 1
                        gone[x["e"]] -= 1
                    keep = np.cumsum(gone)[:n] == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                kept = b" ".join(words)
                yield doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None

        for batch in batches:
            yield from bounded(rows(batch), CUT, 2_000)

    return run


def substring_dedup(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text`` if ``texts``) of every row.

    Defined results: a null text has no words; a text shorter than the window
    loses nothing; a row repeated with the same id and text is a copy like any
    other, so both lose what they share; a null id is carried through.
    Documents are keyed by a 64-bit hash of id and text.
    """
    if window < ANCHOR + 2 * SPAN - 1:
        raise ValueError(f"window must be at least {ANCHOR + 2 * SPAN - 1} words")
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))
    base = base.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    edges = stage(base.select("key", "text").mapInArrow(_edges(window), "eh long, key long, pos long"), "edges")

    repeated = stage(edges.groupBy("eh").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    w = Window.partitionBy("key").orderBy("pos")
    sites = edges.join(repeated, "eh").withColumns({"before": F.lag("pos").over(w), "n_before": F.lag("n").over(w)})
    sites = sites.where("before is null or before != pos")  # repeated rows have one key and so the same sites
    s, length = F.shiftright("pos", 6), F.col("pos").bitwiseAND(63)
    sites = sites.select("key", "pos", "eh", "n", s.alias("s"), (s + length).alias("e"), F.when((F.shiftright("before", 6) + F.col("before").bitwiseAND(63) - ANCHOR == s) & (F.col("n_before") == F.col("n")), 0).otherwise(1).alias("new"))
    # A path is named by the start of its first edge, its edge sequence by an order-sensitive hash.
    first = F.max(F.when(F.col("new") == 1, F.col("s"))).over(w)
    paths = sites.withColumn("path", first).groupBy("key", "path").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("n").alias("n"), F.bit_xor(F.xxhash64("eh", F.col("pos") - F.col("path") * 64)).alias("x"), F.count("*").alias("m"))
    paths = paths.withColumn("seq", F.xxhash64("x", "m")).drop("x", "m")
    paths = stage(paths, "paths")
    many = stage(paths.groupBy("seq").agg(F.count("*").alias("n_rows")).where("n_rows > 1").withColumn("copies", F.col("n_rows")), "sequences")
    paths = stage(spread_join(paths, many, "seq", ["key", "s"], "left").select("key", "s", "e", F.coalesce(F.col("copies") == F.col("n"), F.lit(False)).alias("whole")), "compacted")

    runs = paths.groupBy("key").agg(F.collect_list(F.struct("s", "e", "whole")).alias("runs")).hint("shuffle_hash")
    windows = stage(base.join(runs, "key").select("key", "text", "runs").mapInArrow(_windows(window), "h1 long, h2 long, key long, at long"), "windows")
    twice = stage(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "twice")
    covered = windows.join(twice, ["h1", "h2"]).select("key", F.col("at").alias("s"), (F.col("at") + window).alias("e"))
    covered = covered.union(paths.where(F.col("whole") & (F.col("e") - F.col("s") >= window)).select("key", "s", "e"))
    spans = covered.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans")).hint("shuffle_hash")
    out = base.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut(texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")


def op5_debruijn(spark, sf_dir: str) -> DataFrame:
    """The digest of ``substring_dedup`` over the whole of ``documents``."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
