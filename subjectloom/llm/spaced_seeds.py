"""Benchmark decontamination by spaced-seed hashing.

Ma, Tromp and Li, "PatternHunter" (2002): a seed reads only some positions of a
stretch of tokens, so a substitution at an ignored position does not break it.
Four fixed masks hash every position of the benchmark items and of the documents;
equal hashes are joined, and on each hit's diagonal the longest gapless stretch is
taken of which four fifths agree.  It counts if it has ``least`` tokens (13, or all
of a shorter item).  What no mask hits is not found; the README gives the recall.

Items of 8 to 12 tokens have to match whole, so they have masks of their own, read from
the item's first token: a length that allows m substitutions is cut into m + 2 blocks, and
each mask leaves out m of them, so every allowed copy is hit.  Items of fewer tokens
have one mask, all of their tokens: they occur only exactly.

Tokens are words without punctuation, lower-cased, so a passage is found under
changed punctuation or case; a word that is all punctuation is no token.

The work on a document is bounded by its length times that of the items it hits: a seed
that stands in many places on both sides (repetition) is not listed pair by pair, all
diagonals of its items are looked at instead, a block of them at once.

The benchmark is the build side of the join.  It is read in blocks of about
``block_words`` words (an item is never cut), so that what a worker holds is bounded whatever the size of
the benchmark; each block is one pass over all documents.  Documents are never
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, SPACE, bounded, clean_text, mix, small_batches, text_bytes

# Offsets that each mask reads; all span SPAN tokens or fewer.
MASKS = ((0, 1, 2, 3, 4, 5, 6, 7), (0, 1, 2, 4, 7, 8, 10), (0, 2, 3, 6, 7, 9, 10), (0, 1, 4, 5, 6, 9, 10))
SPAN = 11
#: Shorter items match whole: below WHOLE with substitutions, below EXACT without.
WHOLE, EXACT = 13, 8
#: A seed with more places than this in a document and in the benchmark is not listed.
LISTED = 16
#: Diagonals that are looked at together hold about this many tokens.
CELLS = 1 << 19
_STEPS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(16)], np.uint64)
HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_tokens", pa.int64()), ("n_match", pa.int64())])


class TokenHashes(dict):
    """Hashes of words without case and punctuation; 0 for words that are no token."""

    def __init__(self):
        super().__init__()
        self.drop = re.compile(r"[\W_]+").sub

    def __missing__(self, word: bytes) -> int:
        token = self.drop("", word.decode("utf-8", "replace").lower())
        value = xxhash.xxh3_64_intdigest(token.encode()) or 1 if token else 0
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


#: Longer texts are split piece by piece, so that their words are never all held at once.
PIECE = 1 << 20
_space = re.compile(rb"[\x20\x09-\x0d]").search


def tokens(text: bytes, cache: TokenHashes) -> np.ndarray:
    parts, at = [], 0
    while at < len(text) or not parts:
        border = _space(text, at + PIECE) if len(text) - at > PIECE else None
        end = border.start() if border else len(text)
        words = text[at:end].split()
        out = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        parts.append(out[out != 0] if (out == 0).any() else out)
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def seeds(t: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each position at which the mask fits."""
    n = len(t) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, at in enumerate(mask):
        h += t[at : at + n] * _STEPS[k]
    return mix(h)


def whole_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of ``n`` tokens that has to match whole; see the module's head."""
    if n < EXACT:
        return [tuple(range(n))]
    m = n - -(-4 * n // 5)
    cuts = [n * i // (m + 2) for i in range(m + 3)]
    return [tuple(k for i in range(m + 2) if i not in out for k in range(cuts[i], cuts[i + 1])) for out in combinations(range(m + 2), m)]


class SeedTable:
    """Sorted seed hashes of one block of benchmark items ``(item_id, text, copies)``, one
    table a mask."""

    def __init__(self, items: list[tuple[int, bytes, int]]):
        cache = TokenHashes()
        self.items = [(i, n) for i, _, n in items]
        self.tokens = [tokens(x, cache) for _, x, _ in items]
        masks = [(mask, [k for k, t in enumerate(self.tokens) if len(t) >= WHOLE], False) for mask in MASKS]
        for n in sorted({len(t) for t in self.tokens if 0 < len(t) < WHOLE}):
            masks += [(mask, [k for k, t in enumerate(self.tokens) if len(t) == n], True) for mask in whole_masks(n)]
        self.masks = []
        for mask, own, first_only in masks:
            if not own:
                continue
            parts = [seeds(self.tokens[k], mask)[: 1 if first_only else None] for k in own]
            h = np.concatenate(parts)
            item = np.repeat(np.array(own, np.int32), [len(s) for s in parts])
            pos = np.concatenate([np.arange(len(s), dtype=np.int32) for s in parts])
            order = np.argsort(h, kind="stable")
            first = np.zeros(1 << 20, bool)
            first[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.masks.append((mask, h[order], item[order], pos[order], first))

    def diagonals(self, t: np.ndarray) -> dict[int, np.ndarray | None]:
        """For each item that a seed hits, the diagonals (document position - item
        position) of its hits; None stands for all of them."""
        listed: list[np.ndarray] = []
        every: set[int] = set()
        for mask, h, item, pos, first in self.masks:
            s = seeds(t, mask)
            at = np.flatnonzero(first[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(h, s[at], "left"), np.searchsorted(h, s[at], "right")
            at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
            if not len(at):
                continue
            _, back, places = np.unique(lo, return_inverse=True, return_counts=True)
            many = (places[back] > LISTED) & (hi - lo > LISTED)
            for a in np.unique(lo[many]).tolist():
                every.update(np.unique(item[a : np.searchsorted(h, h[a], "right")]).tolist())
            at, lo, n = at[~many], lo[~many], (hi - lo)[~many]
            row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            if len(row):
                # Item and diagonal in one number: diagonals are far below 2**31 either way.
                listed.append((item[row].astype(np.int64) << 32) + (np.repeat(at, n) - pos[row] + (1 << 31)))
        out: dict[int, np.ndarray | None] = {}
        if listed:
            pairs = np.unique(np.concatenate(listed))
            names, starts = np.unique(pairs >> 32, return_index=True)
            out = dict(zip(names.tolist(), np.split((pairs & ((1 << 32) - 1)) - (1 << 31), starts[1:]), strict=True))
        return out | dict.fromkeys(every)


def stretches(own: np.ndarray, t: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each shift (document position of the item's first token): start, length and
    matches of the longest stretch of which four fifths agree, the first on ties: the
    longest run whose sum of +1 a match and -4 a mismatch is not negative."""
    m = len(own)
    at = shifts[:, None] + np.arange(m)
    inside = (at >= 0) & (at < len(t))
    same = (t[np.clip(at, 0, len(t) - 1)] == own) & inside
    far = 8 * m
    sums = np.zeros((len(shifts), m + 1), np.int64)
    np.cumsum(np.where(same, 1, np.where(inside, -4, -far)), axis=1, out=sums[:, 1:])
    # For each end, the first start whose sum is no higher: least sums so far only fall.  Rows
    # are laid end to end, each above the one before, for a single search.
    base = np.arange(len(shifts), dtype=np.int64)[:, None] * (4 * far * (m + 1))
    falling = base - np.minimum.accumulate(sums, axis=1)
    starts = np.searchsorted(falling.ravel(), (base - sums).ravel(), "left").reshape(sums.shape) - np.arange(len(shifts))[:, None] * (m + 1)
    lengths = np.arange(m + 1) - starts
    end = lengths.argmax(axis=1)
    row = np.arange(len(shifts))
    start = starts[row, end]
    total = np.concatenate([np.zeros((len(shifts), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
    return start, end - start, total[row, end] - total[row, start]


def overlaps(t: np.ndarray, table: SeedTable, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The best verified overlap of a document with each item: item_id, document
    start, item start, tokens, matches.  Most matches win, then length, then place."""
    for item, shifts in sorted(table.diagonals(t).items()):
        own = table.tokens[item]
        if shifts is None:
            shifts = np.arange(1 - len(own), len(t))
        best = None
        step = max(1, CELLS // len(own))
        for k in range(0, len(shifts), step):
            part = shifts[k : k + step]
            start, length, match = stretches(own, t, part)
            good = np.flatnonzero(length >= min(least, len(own)))
            if len(good):
                found = max((int(match[g]), int(length[g]), -int(start[g] + part[g]), -int(start[g])) for g in good[match[good] == match[good].max()])
                best = max(best, found) if best else found
                if best[0] == len(own):
                    break  # shifts ascend: no later one has more matches or starts sooner
        if best:
            name, copies = table.items[item]
            for _ in range(copies):
                yield name, -best[2], -best[3], best[1], best[0]


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_words: int):
    """The benchmark's distinct items with their copies, in blocks of about ``block_words``
    words as the tokeniser splits them; each is broadcast when it is asked for."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), clean_text(item_text).alias("text")).groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    words = F.size(F.array_remove(F.split("text", SPACE), ""))
    blocks = -(-(items.agg(F.sum(words).alias("n")).first()["n"] or 0) // block_words) or 1
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"].encode(), r["copies"]) for r in block.collect()])


def _scan(table, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, build = TokenHashes(), SeedTable(table.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), strict=True):
                    for hit in overlaps(tokens(text, cache), build, least):
                        yield doc_id, *hit

        yield from bounded(rows(), HIT)

    return run


def overlap_rows(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 13, block_words: int = 400_000) -> DataFrame:
    """One row for each document and benchmark item that overlap: ``doc_id, item_id,
    doc_start, item_start, n_tokens, n_match`` (of the longest stretch of each
    diagonal, the one with most matches; in tokens).

    Defined results: null and empty texts and items overlap with nothing; a repeated
    document row gives its rows again; repeated items each give their rows; a null id
    is carried through; an empty benchmark gives an empty result; of overlaps with
    equal matches and length the first in the document, then in the item, is given;
    other columns of both tables are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))
    out = None
    for table in _blocks(benchmark, item_col, item_text, block_words):
        part = source.mapInArrow(_scan(table, least), "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_match long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 13, block_words: int = 400_000) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, all columns kept.

    Defined results: null and empty texts are kept; repeated rows are judged alike;
    null ids do not matter; an empty benchmark keeps all rows; columns of any name are
    carried through.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(table):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache, build = TokenHashes(), SeedTable(table.value)
            for batch in batches:
                texts = (v.as_py() or b"" for v in batch.column(at).cast(pa.binary()))
                yield batch.filter(pa.array([next(overlaps(tokens(t, cache), build, least), None) is None for t in texts], pa.bool_()))

        return run

    for table in _blocks(benchmark, item_col, item_text, block_words):
        docs = docs.mapInArrow(keep(table), docs.schema)
    return docs


def op7_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    """``overlap_rows`` of the whole of ``documents`` with the whole of ``benchmark``."""
    return overlap_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
