from collections import defaultdict

import numpy as np
import pytest

from subjectloom.llm import chosen_path as C
from subjectloom.llm.components import components

from .helpers import clash, docs, words


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        met = defaultdict(int)
        for g in s:
            for j in where[g]:
                met[j] += 1
            where[g].append(i)
        for j, n in met.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = np.random.default_rng(seed)
    texts = [None, "", "a b", "A b", "a  b", "one"]
    for _ in range(12):
        base = words(rng, int(rng.integers(20, 200)), 3_000).split()
        for rate in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.1):
            texts.append(" ".join(x if rng.random() >= rate else f"e{rng.integers(1_000)}" for x in base))
    chain = words(rng, 120, 3_000).split()
    for step in range(25):
        texts.append(" ".join(chain))
        chain[step * 4] = f"c{step}"
    return texts


@pytest.mark.parametrize(("k", "num", "den", "leaf", "chunk"), [(3, 85, 100, 48, 512), (5, 4, 5, 48, 512), (3, 85, 100, 6, 4)])
def test_brute_force(spark, k, num, den, leaf, chunk):
    """Small leaves and chunks send the groups through branching and chunk against chunk."""
    texts = corpus(leaf)
    rows = C.near_duplicates(docs(spark, texts), k=k, threshold=(num, den), leaf=leaf, chunk=chunk).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == brute(texts, k, num, den)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = words(rng, 150, 3_000).split()
    texts = [" ".join(base[:i] + [f"x{j}"] + base[i + 1 :]) for j, i in enumerate(rng.integers(0, 150, 400))]
    rows = C.near_duplicates(docs(spark, texts), leaf=16, chunk=64).collect()
    assert {r["component_id"] for r in rows} == {0}


def missed(j, trees, extra, depth=7, draws=20_000):
    """How often a pair at the threshold shares no node where all of its nodes branch to
    the full depth (in a large family of texts): drawn, coordinate by coordinate."""
    rng = np.random.default_rng(11)
    lost = 0
    for _ in range(draws):
        agree = rng.random(C.COORDINATES) < j
        shared = int(agree[rng.permutation(C.COORDINATES)[:trees]].sum())
        for _ in range(depth - 1):
            first, second = rng.integers(0, C.COORDINATES, (2, shared))
            two = (rng.random(shared) < extra) & (first != second)
            shared = min(300, int(agree[first].sum() + (agree[second] & two).sum()))
        lost += shared == 0
    return lost


@pytest.mark.parametrize(("j", "before"), [(0.85, 11), (0.8, 12)])
def test_recall_at_full_depth(j, before):
    """At most 1e-4 of 20,000 pairs, within chance; the trees set before lost 80 or more."""
    assert missed(j, before, 1 / j - 1) >= 80
    assert missed(j, *C.branching(j, 0.9999, 7)) <= 8


def test_edges(spark):
    df = docs(spark, ["a b c d", None, ""])
    rows = C.near_duplicates(clash(df.union(df))).collect()
    assert len(rows) == 6 and {(r["doc_id"], r["component_id"]) for r in rows} == {(0, 0), (1, 1), (2, 2)}
    null = spark.createDataFrame([(None, "p q r s"), (None, "p q r s"), (5, "p q r s"), (None, "other words")], "doc_id long, text string")
    rows = C.near_duplicates(null).collect()
    assert sorted(str(r["component_id"]) for r in rows) == ["5", "5", "5", "None"]
    assert C.near_duplicates(df.where("false")).count() == 0


def test_very_long_text(spark):
    rng = np.random.default_rng(1)
    long = words(rng, 60_000, 9_000)
    rows = C.near_duplicates(docs(spark, [long, long + " tail"])).collect()
    assert {r["component_id"] for r in rows} == {0}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(60)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if x in got} and {x for x in up if find(x) != x} <= got.keys()
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf):
    from subjectloom.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in table]
    got = QUERIES["op10_chosen_path"](spark, sf).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == [(n, ids[c]) for n, c in brute([r["text"] for r in table], 3, 85, 100)]
