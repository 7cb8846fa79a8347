import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjectloom.llm import periodic_runs as R
from subjectloom.llm.queries import QUERIES

from .helpers import clash, docs


def all_runs(x, shortest=24):
    """By the definition: for each period the longest stretches that keep it; the least period of each."""
    found = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(shortest, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, t, q) for (s, t), q in found.items())


def row_of(doc_id, text, shortest=24, loops=True):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if loops and n and h % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = sorted(all_runs(words, shortest), key=lambda r: (r[0], r[2]))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < t for s, t, q in runs)]
    best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{t - s},{q}\n" for s, t, q in runs).encode()), sha(b" ".join(kept)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def strings(rng, count):
    """Random words over small alphabets, with loops in loops and copied stretches."""
    for _ in range(count):
        x = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 60))).tolist()
        for _ in range(int(rng.integers(0, 5))):
            kind = rng.integers(0, 4)
            piece = x[int(rng.integers(0, len(x) + 1)) :][: int(rng.integers(1, 40))]
            x = x + piece if kind == 0 else piece * int(rng.integers(2, 6)) + x if kind == 1 else x + [int(rng.integers(0, 9))] + piece * int(rng.integers(2, 5)) if kind == 2 else x + rng.integers(0, 5, 6).tolist()
        yield x[:700]


@pytest.mark.parametrize("shortest", [3, 6, 24])
def test_all_runs_of_random_words(shortest):
    rng = np.random.default_rng(shortest)
    for _ in range(60):
        group = list(strings(rng, 8))
        ids = np.array([w for x in group for w in x], np.int64)
        doc = np.repeat(np.arange(len(group)), [len(x) for x in group])
        want, first = [], 0
        for x in group:
            want += [(s + first, t + first, q) for s, t, q in sorted(all_runs(x, shortest), key=lambda r: (r[0], r[2]))]
            first += len(x)
        assert [tuple(r) for r in R.maximal_runs(ids, doc, shortest).tolist()] == want


def test_strings_with_most_runs():
    """Fibonacci and paper-folding words, powers of powers."""
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    fold = [((i & -i) << 1 & i) != 0 for i in range(1, 700)]
    power = ((([0] * 5 + [1]) * 4 + [2]) * 4 + [3]) * 4
    for x in (b, [int(v) for v in fold], power, [0] * 500, [0, 1] * 300, power + power[3:]):
        x = np.array(x, np.int64)
        for shortest in (3, 24):
            got = [tuple(r) for r in R.maximal_runs(x, np.zeros(len(x), np.int64), shortest).tolist()]
            assert got == sorted(all_runs(x.tolist(), shortest), key=lambda r: (r[0], r[2]))


def test_previous_factors():
    rng = np.random.default_rng(0)
    for x in strings(rng, 40):
        x = np.array(x, np.int64)
        if not len(x):
            continue
        c = R.Classes(x, np.zeros(len(x), np.int64))
        assert [tuple(x[i:]) for i in c.suffixes] == sorted(tuple(x[i:]) for i in range(len(x)))
        lcp = np.zeros(len(x), np.int64)
        lcp[1:] = c.forward(c.suffixes[:-1], c.suffixes[1:])
        length, source = R.previous_factors(c.suffixes, lcp)
        for i in range(len(x)):
            want = max((next((k for k in range(len(x) - i) if x[j + k] != x[i + k]), len(x) - i) for j in range(i)), default=0)
            assert length[i] == want
            assert not want or source[i] < i and (x[source[i] : source[i] + want] == x[i : i + want]).all()


def test_edges(spark):
    loop = "a b c " * 12
    texts = [None, "", " \n\t", "a", loop, loop, "x " + loop + "y " + loop, "é " * 24, "w " * 23, "u v " * 30]
    rows = R.periodic_runs(clash(docs(spark, texts)), texts=True).collect()
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == row_of(r["doc_id"], texts[r["doc_id"]], loops=False)
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["runs_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["start"] is None
    assert got[4]["collapsed_text"] == "a b c" and got[6]["n_runs"] == 2 and got[7]["n_collapsed"] == 1 and got[8]["n_runs"] == 0
    same = R.periodic_runs(docs(spark, [loop]).union(docs(spark, [loop])).withColumn("doc_id", F.lit(None).cast("long")), loops=True).collect()
    assert len(same) == 2 and all(r["doc_id"] is None and r["period"] == 3 for r in same)
    assert R.periodic_runs(docs(spark, ["a"]).where("false")).count() == 0


def test_a_text_of_megabytes(spark):
    """Half a million words: one loop, loops inside loops, and random words with a loop."""
    rng = np.random.default_rng(1)
    part = ("p q " * 20 + "r ") * 6000
    random = " ".join(f"w{i}" for i in rng.integers(0, 50_000, 250_000)) + " " + "k l m " * 100_000
    rows = {r["doc_id"]: r for r in R.periodic_runs(docs(spark, ["w " * 500_000, part, random])).collect()}
    assert (rows[0]["n_runs"], rows[0]["period"], rows[0]["length"]) == (1, 1, 500_000)
    assert rows[1]["n_runs"] == 6001 and rows[1]["exponent_milli"] == 1000 * (41 * 6000) // 41 and rows[1]["period"] == 41
    assert rows[2]["period"] == 3 and rows[2]["length"] >= 300_000


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r["n_runs"] for r in rows)
    short = [r for r in rows if len((texts[r["doc_id"]] or "").split()) <= 900]
    assert len(short) > 100
    for r in short:
        assert tuple(r[c] for c in COLUMNS) == row_of(r["doc_id"], texts[r["doc_id"]])
