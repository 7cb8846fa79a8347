"""Similarity joins of strings above a threshold by an index on rare tokens instead of all pairs.

Prefix filtering (Chaudhuri et al., "A primitive operator for similarity joins", 2006; Bayardo et
al., "Scaling up all pairs similarity search", 2007): tokens have one order, the rare ones first.
What a row must share with any partner above the threshold is so much that a pair shares
a token among the first few of both rows.  Only rows that share such a token meet: those of one token
in blocks, a pair under the first token that both have among their first ones, where it is
compared exactly.  Bounds hold for every row, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import keep
from .mixtures import lexical_above as lexical_above
from .similarity import fuzzy_pairs, lcs_length

#: Rows of one token that a task holds of either block.
BLOCK = 512


def _ranks(df, token):
    """A number by which tokens stand in one order, the rarer first; it names the token."""
    return F.shiftleft(F.least(df, F.lit((1 << 19) - 1)).cast("long"), 43) + F.shiftrightunsigned(F.xxhash64(token), 21)


def met(rows: DataFrame, make: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], ddl: str, block: int = BLOCK) -> DataFrame:
    """What ``make(table, p, q)`` returns for the pairs (places p and q in the table, each pair once) of ``rows(i,
    first, ...)`` that share a number of their ``first`` ones; every pair meets once, under the least
    number that both have.  A number of many rows is dealt into pairs of blocks."""
    each = rows.withColumn("t", F.explode("first"))
    sizes = each.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    dealt = each.join(sizes.select("t", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "t")
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("b", "o"), "hi": F.greatest("b", "o")}).drop("blocks", "o")

    def pairs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("i")
        t, lo, hi, b = table.column("t")[0].as_py(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py(), table.column("b").to_numpy()
        first = table.column("first").combine_chunks()
        row, number = np.repeat(np.arange(len(first)), first.value_lengths().to_numpy()), first.flatten().to_numpy()
        # Numbers less than t that two rows share: those pairs have met before.
        row, number = row[number < t], number[number < t]
        names, code = np.unique(number, return_inverse=True)
        before = np.zeros((len(first), len(names)), np.float32)
        before[row, code] = 1
        left, right = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
        new = before[left] @ before[right].T == 0
        if lo == hi:
            new &= left[:, None] < right[None]
        p, q = np.nonzero(new)
        p, q = left[p], right[q]
        return make(table, np.minimum(p, q), np.maximum(p, q))

    return dealt.groupBy("t", "lo", "hi").applyInArrow(pairs, ddl)


# ----------------------------------------------------------------------- strings


def lcs_lengths(texts: list[str], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Longest common subsequences of the pairs (p, q) of texts: those with a first text of up to 63 characters
    a character of all pairs at a time, others one by one."""
    short = np.array([len(x) < 64 for x in texts])
    out = np.zeros(len(p), np.int64)
    fast = np.flatnonzero(short[p])
    if len(fast):
        letters = {c: k for k, c in enumerate(sorted(set("".join(texts))))}
        masks = np.zeros((len(texts), len(letters) + 1), np.uint64)
        for r in np.unique(p[fast]).tolist():
            for k, c in enumerate(texts[r]):
                masks[r, letters[c]] |= np.uint64(1 << k)
        sizes = np.array([len(x) for x in texts])
        codes = np.full((len(texts), max(1, int(sizes.max(initial=0)))), len(letters))
        for r in np.unique(q[fast]).tolist():
            codes[r, : sizes[r]] = [letters[c] for c in texts[r]]
        full = np.array([(1 << len(x)) - 1 if len(x) < 64 else 0 for x in texts], np.uint64)
        for at in range(0, len(fast), 100_000):
            own = fast[at : at + 100_000]
            a, b = p[own], q[own]
            s = full[a].copy()
            for k in range(int(sizes[b].max(initial=0))):
                # Columns past a string's end have no letters and change nothing.
                u = s & masks[a, codes[b, k]]
                s = ((s + u) | (s - u)) & full[a]
            out[own] = sizes[a] - np.bitwise_count(s)
    for k in np.flatnonzero(~short[p]).tolist():
        out[k] = lcs_length(texts[p[k]], texts[q[k]])
    return out


def string_tokens(text: str, threshold: float) -> tuple[list[str], list[tuple[int, int]]]:
    """The tokens of a string, and for each kind how many of them (a slice of the tokens) and how many at least a
    partner shares.

    For strings a and b with a longest common subsequence L, 200 L >= threshold (|a| + |b|), so that b has
    threshold |a| / (200 - threshold) characters or more.  They share L characters at least, counted with
    repeats, and 3 L - |a| - |b| - 1 pairs of neighbours: a deletion breaks two of those of a, an insertion
    one.  Where that may be none, characters are tokens as well."""

    def counted(items: list[str], kind: str) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for x in items:
            seen[x] = seen.get(x, 0) + 1
            out.append(f"{kind}{seen[x]}:{x}")
        return out

    if not text:
        return ["e"], [(1, 1)]
    n, share = len(text), threshold / (200.0 - threshold)
    total = n * (1 + share)
    pairs = int(np.ceil(total * (1.5 * threshold / 100 - 1) - 1 - 1e-9))
    tokens = counted([text[k : k + 2] for k in range(n - 1)], "p")
    kinds = [(len(tokens), max(1, pairs))]
    if pairs < 1:
        more = counted(list(text), "c")
        tokens += more
        kinds.append((len(more), max(1, int(np.ceil(n * share - 1e-9)))))
    return tokens, kinds


def fuzzy_above(strings: DataFrame, threshold: float, column: str = "s", key: str = "pos", block: int = BLOCK, counter=None) -> DataFrame:
    """``i, j, ratio`` of pairs of strings whose indel ratio (to four digits) is the threshold or more; null strings
    resemble nothing.  ``counter``: an accumulator that gets the number of pairs that are compared.

    Of each kind of tokens, a string with m of them that must share k shares one of its m - k + 1 rarest.  Where no
    pair of neighbours need be shared, single characters part next to no strings: there whole blocks are compared."""
    if 1.5 * threshold <= 100:
        return fuzzy_pairs(strings, column, key, threshold)
    rows = keep(strings.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("i"), F.col(column).alias("s")), "strings")

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, s in zip(batch.column("i").to_pylist(), batch.column("s").to_pylist(), strict=True):
                found, kinds = string_tokens(s, threshold - 1e-4)  # ratios are rounded
                at = 0
                for kind, (m, k) in enumerate(kinds):
                    for x in found[at : at + m]:
                        for values, value in zip(out, (i, kind, m - k + 1, x), strict=True):
                            values.append(value)
                    at += m
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["i", "kind", "most", "token"])

    each = keep(rows.mapInArrow(tokens, "i long, kind int, most int, token string"), "tokens")
    df = each.groupBy("token").agg(F.count("*").alias("df"))
    ranked = each.join(df, "token").select("i", "kind", "most", _ranks(F.col("df"), F.col("token")).alias("r"))
    firsts = ranked.groupBy("i", "kind", "most").agg(F.array_sort(F.collect_list("r")).alias("r")).select("i", F.slice("r", F.lit(1), F.greatest("most", F.lit(0))).alias("r"))
    firsts = firsts.groupBy("i").agg(F.array_distinct(F.flatten(F.collect_list("r"))).alias("first"))

    def compare(table: pa.Table, p: np.ndarray, q: np.ndarray) -> pa.Table:
        texts = table.column("s").to_pylist()
        size = np.array([len(x) for x in texts], np.int64)
        total = size[p] + size[q]
        # The common part is no longer than the shorter string.
        able = 200 * np.minimum(size[p], size[q]) >= (threshold - 1e-4) * total
        p, q, total = p[able], q[able], total[able]
        if counter is not None:
            counter.add(len(p))
        ratio = np.where(total > 0, np.round(200.0 * lcs_lengths(texts, p, q) / np.maximum(total, 1), 4), 100.0)
        near, i = ratio >= threshold, table.column("i").to_numpy()
        return pa.table({"i": i[p[near]], "j": i[q[near]], "ratio": ratio[near]})

    return met(rows.join(firsts, "i").select("i", "s", "first"), compare, "i long, j long, ratio double", block)
