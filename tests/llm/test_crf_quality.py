import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjectloom.llm import crf_quality as Q
from subjectloom.llm.queries import QUERIES

from .helpers import clash, docs

GOOD = "The plain words of a fine line, with some more of them."
BAD = "BUY!! NOW!! CHEAP!! CHEAP!! DEAL!!"


def by_enumeration(odds, stay):
    """Marginals, agreements and the likelihood of each labelling, by all labellings."""
    total, good, pairs, weight = 0.0, np.zeros(len(odds)), np.zeros(2), {}
    for y in itertools.product((0, 1), repeat=len(odds)):
        w = np.exp(sum(o for o, v in zip(odds, y, strict=True) if v) + sum(stay[a] for a, b in itertools.pairwise(y) if a == b))
        weight[y] = w
        total += w
        good += w * np.array(y)
        for a, b in itertools.pairwise(y):
            if a == b:
                pairs[a] += w
    return good / total, pairs / total, {y: w / total for y, w in weight.items()}


def test_chains_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 6, 2, 6, 4])
    odds, stay = rng.normal(0, 2, counts.sum()), np.array([0.7, -0.3])
    good, pairs = Q.chains(odds, counts, stay)
    want, both, at = [], np.zeros(2), 0
    for n in counts:
        g, p, _ = by_enumeration(odds[at : at + n], stay)
        want += list(g)
        both += p
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, both)


def test_fit_climbs_the_likelihood():
    """At the fitted weights the likelihood (by enumeration, less the ridge) has a zero slope."""
    counts, _, bins = Q.line_bins([t.encode() for t in (GOOD, f"{GOOD}\n{BAD}", BAD, f"{BAD}\n{GOOD}\n{BAD}", f"{GOOD}\n{GOOD}")])
    labels = np.array([1, 0, 0, 0, 1])

    def value(model):
        odds, at, out = Q.evidence(model[:-2], counts, bins), 0, 0.0
        for n, y in zip(counts, labels, strict=True):
            out += 0.5 / counts[labels == y].sum() * np.log(by_enumeration(odds[at : at + n], model[-2:])[2][(int(y),) * n])
            at += n
        return out - 0.5e-3 * (model**2).sum()

    model = Q.fit_chains(counts, bins, labels, rounds=3000, rate=0.02, ridge=1e-3)
    assert value(model) > value(np.zeros_like(model)) + 0.3
    step = 1e-4
    used = [*np.unique(bins)[:12], *(Q.N_BINS + np.unique(bins)[:6]), Q.N_WEIGHTS - 1, Q.N_WEIGHTS, Q.N_WEIGHTS + 1]
    for i in used:
        e = np.zeros_like(model)
        e[i] = step
        assert abs(value(model + e) - value(model - e)) / (2 * step) < 2e-3


def test_neighbours_matter():
    counts, _, bins = Q.line_bins([GOOD.encode(), f"{GOOD}\n{BAD}".encode()])
    model = np.random.default_rng(3).normal(size=Q.N_WEIGHTS)
    odds = Q.evidence(model, counts, bins)
    assert odds[0] != odds[1]
    alone = [Q.evidence(model, *Q.line_bins([t])[::2]) for t in (GOOD.encode(), f"{GOOD}\n{BAD}".encode())]
    assert np.allclose(np.concatenate(alone), odds), "a text's evidence does not depend on its batch"


@pytest.fixture(scope="module")
def trained(spark):
    texts = [f"{GOOD}\n{GOOD} {i}" for i in range(60)] + [f"{BAD} A{i}!!\n{BAD}" for i in range(60)]
    rows = docs(spark, texts)
    return rows, rows.select("doc_id", F.when(F.col("doc_id") < 60, 1).otherwise(0).alias("quality"))


def test_edges(spark, trained):
    rows, labels = trained
    texts = [None, "", " \n\t\n", GOOD, BAD, GOOD, "é" * 50, "\n".join([BAD] * 3 + [GOOD] * 3)]
    more = clash(docs(spark, texts, 1000))
    noisy = labels.union(spark.createDataFrame([(None, 1), (5, None), (6, 7), (10**9, 1)], "doc_id long, quality int")).union(labels)
    plus = rows.select("doc_id", "text").union(more.select("doc_id", "text")).union(spark.createDataFrame([(None, BAD)], "doc_id long, text string")).union(more.select("doc_id", "text"))
    got = Q.document_quality(plus, noisy).collect()
    assert len(got) == 120 + 2 * 8 + 1
    by = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert by[1000]["score"] == by[1001]["score"] == by[1002]["score"]
    assert by[1003]["score"] == by[1005]["score"] > 0.9 and by[1004]["score"] < 0.1
    assert by[1004]["score"] < by[1007]["score"] < by[1003]["score"]
    assert not by[None]["held_out"] and by[None]["predicted"] == 0
    for r in got:
        assert r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    none = Q.document_quality(docs(spark, [GOOD]), labels.where("quality = 1")).collect()
    assert [(r["score"], r["predicted"]) for r in none] == [(0.5, 1)]
    assert Q.document_quality(docs(spark, ["a"]).where("false"), labels).count() == 0


def test_labels_held_out_are_never_learnt(spark, trained):
    rows, labels = trained
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert turned.exceptAll(labels).count() > 10
    assert (Q.fit(rows, labels) == Q.fit(rows, turned)).all()
    assert (Q.fit(rows, labels) == Q.fit(rows.repartition(7), labels.repartition(3))).all()


def test_texts_of_megabytes(spark, trained):
    rows, labels = trained
    texts = [GOOD * 80_000, "\n".join([BAD] * 100_000)]
    got = {r["doc_id"]: r["predicted"] for r in Q.document_quality(rows.union(docs(spark, texts, 500)), labels).collect()}
    assert got[500] == 1 and got[501] == 0


def test_held_out_accuracy(spark):
    """Over sf0.1: rows whose labels were not learnt."""
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op12_crf_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    y, p = np.array([r["quality"] for r in rows]), np.array([r["predicted"] for r in rows])
    s = np.array([r["score"] for r in rows])
    bad, good = s[y == 0], s[y == 1]
    auc = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    print("held out", len(y), "accuracy", (y == p).mean(), "bad found", (p[y == 0] == 0).mean(), "good kept", (p[y == 1] == 1).mean(), "auc", auc)
    assert len(y) > 500 and auc > 0.99 and (p[y == 0] == 0).mean() > 0.95 and (p[y == 1] == 1).mean() > 0.98
