"""Quality of documents by a linear-chain conditional random field over their lines.

Each line with a word is a node with the label good or bad.  Its evidence is its own form
and that of the lines before and after it: shares of capitals, signs, digits, bars and
marks, repeated words and lines, lengths, each cut into bins.  Neighbouring labels that
agree have a weight as well.  Forward and backward sums give each line's marginal
probability to be good; a document's score is their mean, weighted by the lines' lengths.

Fitting.  The labels name documents, so in fitting all lines of a document have its label;
the likelihood of whole chains is maximised (Adam, L2) on at most ``SAMPLE_ROWS`` documents,
as many of either label, that a hash of the id chooses among the labelled rows
admitted (never those held out), of at most ``SAMPLE_LINES`` lines each.  Their lines' bins,
a few bytes each, are all that the driver gets.  Scoring covers every row and every line.

Forms are counted for a whole Arrow batch at once: one histogram of (line, class of byte).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, clean_text, small_batches, text_bytes

#: At most so many labelled documents are fitted to, half of them of either label, of so many lines.
SAMPLE_ROWS, SAMPLE_LINES = 4_000, 100

#: Classes of bytes; the first is what none of the others is.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "shout": b"!?", "sign": b"#*$%&@^~=+\\", "bar": b"|<>{}[]_", "stop": b".,;:", "lead": bytes(range(0xC0, 0x100)), "rest": bytes(range(0x80, 0xC0))}
_LUT = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(CLASSES.values(), 1):
    _LUT[list(_bytes)] = _i
_N = len(CLASSES) + 1

#: Bins of each measure of a line: upper ends, so one more bin than ends.
BINS = {
    "upper": (0.02, 0.1, 0.3, 0.6, 0.9),
    "shout": (0.0, 0.05, 0.2, 0.6),
    "sign": (0.0, 0.05, 0.2, 0.6),
    "bar": (0.0, 0.05, 0.2, 0.6),
    "stop": (0.0, 0.03, 0.1, 0.3, 0.6),
    "digit": (0.0, 0.02, 0.1, 0.3),
    "beyond": (0.0, 0.02, 0.1, 0.3),
    "other": (0.0, 0.02, 0.1, 0.3),
    "echo": (0.0, 0.05, 0.2, 0.5),
    "distinct": (0.1, 0.3, 0.5, 0.7, 0.85, 0.95),
    "length": (2.5, 3.5, 4.5, 5.5, 7.0, 10.0),
    "words": (1.0, 3.0, 8.0, 20.0, 60.0, 200.0),
    "again": (0.5,),
}
_FIRST = np.cumsum([0, *(len(b) + 1 for b in BINS.values())])
N_BINS = int(_FIRST[-1])
#: Weights: own bins, bins of the line before and after, no line before, no line after, bias.
N_WEIGHTS = 3 * N_BINS + 3


def line_bins(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines with a word of all texts: the number of lines of each text, the lines' lengths in
    characters, and their bins (one of each measure).  A text without words counts as one empty
    line."""
    lines: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    distinct: list[int] = []
    echo: list[int] = []
    again: list[bool] = []
    for k, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            words = line.split()
            if words:
                lines.append(line)
                distinct.append(len(set(words)))
                echo.append(sum(map(eq, words, words[1:])))
                again.append(line in seen)
                seen.add(line)
        if not seen:
            lines.append(b"")
            distinct.append(0)
            echo.append(0)
            again.append(False)
        counts[k] = len(lines)
    counts = np.diff(counts, prepend=0)
    size = np.array([len(x) for x in lines], np.int64)
    data = np.frombuffer(b"".join(lines), np.uint8)
    of = np.repeat(np.arange(len(lines)), size)
    kind = _LUT[data]
    found = np.bincount(of * _N + kind, minlength=len(lines) * _N).reshape(-1, _N).astype(float)
    space = kind == 4
    opens = ~space
    opens[1:] &= space[:-1] | (of[1:] != of[:-1])
    words = np.bincount(of[opens], minlength=len(lines)).astype(float)
    by = {name: found[:, i] for i, name in enumerate(CLASSES, 1)}
    chars = size - by["rest"]
    solid = np.maximum(chars - by["space"], 1)
    some = np.maximum(words, 1)
    letters = np.maximum(by["upper"] + by["lower"], 1)
    measures = {"upper": by["upper"] / letters, "shout": by["shout"] / some, "sign": by["sign"] / some, "bar": by["bar"] / some, "stop": by["stop"] / some, "digit": by["digit"] / solid, "beyond": by["lead"] / solid, "other": found[:, 0] / solid, "echo": np.array(echo) / some, "distinct": np.array(distinct) / some, "length": solid / some, "words": words, "again": np.array(again, float)}
    bins = np.stack([np.searchsorted(BINS[m], measures[m], "left") + first for m, first in zip(BINS, _FIRST, strict=False)], 1)
    return counts, np.maximum(chars, 1).astype(np.int64), bins.astype(np.uint8)


def evidence(weights: np.ndarray, counts: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The log-odds that each line's own and neighbouring forms give to the label good."""
    own, before, after = (weights[k * N_BINS : (k + 1) * N_BINS][bins].sum(1) for k in range(3))
    start = np.cumsum(counts) - counts
    end = start + counts - 1
    out = own + weights[-1]
    out[1:] += before[:-1]
    out[:-1] += after[1:]
    # The ends of a text have no neighbours: take back what crossed from other texts.
    out[start[1:]] -= before[start[1:] - 1]
    out[end[:-1]] -= after[end[:-1] + 1]
    out[start] += weights[-3]
    out[end] += weights[-2]
    return out


def chains(odds: np.ndarray, counts: np.ndarray, stay: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all lines to be good, and of all neighbours to be both bad and both good (summed,
    each with its line's ``weight``).

    ``stay``: the weights of two bad and of two good neighbours.  All chains go forward one
    line at a time together, the longest first."""
    order = np.argsort(-counts, kind="stable")
    start, size = (np.cumsum(counts) - counts)[order], counts[order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    a = np.zeros((2, len(odds)))
    b = np.zeros((2, len(odds)))
    add = np.logaddexp
    for t, m in enumerate(live):
        at = start[:m] + t
        if t:
            a[0, at] = add(a[0, at - 1] + stay[0], a[1, at - 1])
            a[1, at] = add(a[0, at - 1], a[1, at - 1] + stay[1]) + odds[at]
        else:
            a[1, at] = odds[at]
    for t in range(len(live) - 2, -1, -1):
        at = start[: live[t + 1]] + t
        bad, good = b[0, at + 1], b[1, at + 1] + odds[at + 1]
        b[0, at], b[1, at] = add(bad + stay[0], good), add(bad, good + stay[1])
    good = 1 / (1 + np.exp(np.clip((a[0] + b[0]) - (a[1] + b[1]), -700, 700)))
    whole = add(a[0] + b[0], a[1] + b[1])
    inner = np.ones(len(odds), bool)
    inner[start + size - 1] = False
    i = np.flatnonzero(inner)
    w = np.ones(len(i)) if weight is None else weight[i]
    pairs = np.array([w @ np.exp(a[0, i] + stay[0] + b[0, i + 1] - whole[i]), w @ np.exp(a[1, i] + stay[1] + odds[i + 1] + b[1, i + 1] - whole[i])])
    return good, pairs


def scores(model: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The mean marginal of each text's lines, weighted by their lengths."""
    counts, length, bins = line_bins(texts)
    good, _ = chains(evidence(model[:-2], counts, bins), counts, model[-2:])
    of = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(of, good * length, len(counts)) / np.bincount(of, length, len(counts))
    return np.clip(total, 0.0, 1.0)


def fit_chains(counts: np.ndarray, bins: np.ndarray, labels: np.ndarray, rounds: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Weights of evidence and of agreement that maximise the mean likelihood of the labels of
    all lines (each that of its text), less a ridge; the lines of either label weigh the same in sum."""
    model = np.zeros(N_WEIGHTS + 2)
    if not len(counts) or labels.min() == labels.max():
        return model
    y = np.repeat(labels, counts)
    weight = (0.5 / np.bincount(y))[y]
    start = np.cumsum(counts) - counts
    first, last = np.zeros(len(y), bool), np.zeros(len(y), bool)
    first[start], last[start + counts - 1] = True, True
    seen = np.bincount(y[~last], weight[~last], 2)
    mean, square = np.zeros_like(model), np.zeros_like(model)
    for step in range(1, rounds + 1):
        good, pairs = chains(evidence(model[:-2], counts, bins), counts, model[-2:], weight)
        rest = (y - good) * weight
        tally = lambda at, r: np.bincount(at.ravel(), np.repeat(r, at.shape[1]), N_BINS)
        slope = np.concatenate([tally(bins, rest), tally(bins[:-1][~last[:-1]], rest[1:][~first[1:]]), tally(bins[1:][~first[1:]], rest[:-1][~last[:-1]]), [rest[first].sum(), rest[last].sum(), rest.sum()], seen - pairs])
        slope = slope - ridge * model
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        model = model + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learnt from; rows without an id have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The model of a sample of labelled rows: evidence weights, then those of agreement.

    A document's label is the least of its labels that are 0 or 1; without documents of
    both labels the model is all zeros (every score 0.5).  Of documents with one id, one is taken."""
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"))
    half = [usable.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2) for k in (0, 1)]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text")).join(F.broadcast(half[0].union(half[1])), "doc_id")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("bins", pa.binary())])

        def each(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), text_bytes(batch, "text"), strict=True):
                if text.count(b"\n") < SAMPLE_LINES:
                    yield doc_id, y, line_bins([text])[2].tobytes()

        for batch in batches:
            yield from bounded(each(batch), schema, 2_000)

    binned = chosen.mapInArrow(rows, "doc_id long, y int, bins binary")
    sample = sorted(tuple(r) for r in binned.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("bins").alias("bins")).collect())
    bins = [np.frombuffer(r[2], np.uint8).reshape(-1, len(BINS)) for r in sample]
    counts = np.array([len(b) for b in bins], np.int64)
    return fit_chains(counts, np.concatenate(bins) if bins else np.zeros((0, len(BINS)), np.uint8), np.array([r[1] for r in sample], np.int64))


def document_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; the score depends on the text alone.

    Defined results: null and empty texts, and those of white space, count as one empty line and are
    scored; repeated rows get equal scores; a null id is carried through and never held out; a table
    without labels of both kinds scores 0.5; an empty table gives an empty result; columns
    other than those named are ignored, whatever their names; a very long text is read whole, its
    lines in one chain.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_rows=sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = scores(model, list(text_bytes(batch, "text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), clean_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_crf_quality(spark, sf_dir: str) -> DataFrame:
    """``document_quality`` over the whole of ``documents``, learnt from ``labels``."""
    return document_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
