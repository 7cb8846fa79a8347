"""Statistics of all pairs, made inside block products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjectloom.operators import similarity as M
from subjectloom.plans import measures, registry

from .compare import connect, same_rows

UNIT = "ord long, topic long, v array<double>"


def unit(n, topics=4, width=6):
    v = np.random.default_rng(n).normal(size=(n, width))
    return [(i + 1, i % topics, x) for i, x in enumerate((v / np.linalg.norm(v, axis=1, keepdims=True)).tolist())]


@pytest.mark.parametrize("name", ["percentile_neg", "margin_histogram", "pairwise_sweep", "pairwise_best_f1"])
def test_counted_without_forming_pairs(spark, sf, monkeypatch, name):
    monkeypatch.setattr(M, "cosine_pairs", None)
    same_rows(registry.queries()[name](spark, sf), connect(sf), registry.oracle_sql()[name])


def test_a_row_is_sent_to_few_blocks(spark):
    assert [M._wide_blocks(spark.range(n)) for n in (0, 1, 512, 513, 20_000, 200_000)] == [1, 1, 1, 2, 12, 13]


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("tile", [512, 7])
def test_tiles_have_every_pair_once(spark, monkeypatch, blocks, tile):
    monkeypatch.setattr(M, "TILE", tile)
    rows = unit(40)
    df = spark.createDataFrame(rows, UNIT)
    want = {(i, j): (a == b, round(float(np.dot(v, w)), 9)) for i, a, v in rows for j, b, w in rows if i < j}
    got = M.cosine_pairs(df, blocks=blocks).select("i", "j", "same", F.round("sim", 9).alias("sim")).collect()
    assert len(got) == len(want) and {(r["i"], r["j"]): (r["same"], r["sim"]) for r in got} == want
    n = M.pair_counts(df, lambda s: np.floor((s + 1) * 8), blocks=blocks).collect()
    cells = [(same, int((s + 1) * 8)) for same, s in want.values()]
    assert {(r["same"], r["bin"]): r["n"] for r in n} == {c: cells.count(c) for c in set(cells)}
    assert M.pair_quantile_of(df, 0.2, blocks)[1] == sum(not same for same, _ in want.values())


def test_leading_digits_of_shuffle_keys():
    rng = np.random.default_rng(4)
    i, j = (rng.integers(0, 10 ** rng.integers(1, 19, 500)) for _ in range(2))
    i[:4], j[:4] = [0, 9, 10, 99], [2**63 - 1, 10**18, 100, 9]
    want = [int(h[:8], 16) for h in M.shuffle_key(i, j)]
    assert M.shuffle_lead(i, j).tolist() == want == M.shuffle_lead(i, j, 64).tolist()
    assert M.shuffle_lead(-i[:9], j[:9]).tolist() == [int(h[:8], 16) for h in M.shuffle_key(-i[:9], j[:9])]
    assert M.shuffle_lead(i[:0], j[:0]).tolist() == []


def test_recurring_pairs_pass_the_grid(spark):
    rows, grid = unit(30), [0.0, 0.5]
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in measures._passed(spark.createDataFrame(rows, UNIT), grid).collect()}
    want = {k: [0, 0, 0] for k in range(3)}
    for i, a, v in rows:
        for _, b, w in rows[i:]:
            want[sum(round(float(np.dot(v, w)), 9) >= g for g in grid)][0 if a == b else 2] += 1
    assert got == {k: tuple(x) for k, x in want.items()}


@pytest.mark.parametrize("blocks", [1, 3])
def test_documents_in_tiles(spark, monkeypatch, blocks):
    """Tiles and chunks of terms that cut documents anywhere, documents without a common term, few wide blocks."""
    monkeypatch.setattr(M, "TERMS_AT_ONCE", 5)
    monkeypatch.setattr(M, "TILE", 4)
    rng = np.random.default_rng(8)
    x = np.where(rng.random((23, 30)) < 0.15, rng.random((23, 30)) + 0.01, 0.0)
    df = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "k long, term string, weight double")
    got = {(r["i"], r["j"]): r["sim"] for r in M.sparse_pairs(df, "k", blocks).collect()}
    s = x @ x.T
    assert got == {(i, j): pytest.approx(s[i, j]) for i in range(23) for j in range(i + 1, 23) if s[i, j] > 0}
    assert M._wide_blocks(spark.range(100_000), M.WIDE_DOCUMENTS) == 25


@pytest.mark.parametrize(("blocks", "width", "counted", "digits"), [(1, 1 << 18, 1 << 23, 9), (3, 1 << 12, 1 << 18, 2)])
def test_auc_of_counts_equals_ranks(spark, monkeypatch, blocks, width, counted, digits):
    """Ties, passes over some cells at a time and bins that have to be narrowed; no pair is formed."""
    rows = unit(16) + [(17 + k, k % 3, [1.0, 0, 0, 0, 0, 0] if k % 2 else [0.6, 0.8, 0, 0, 0, 0]) for k in range(6)]
    pairs = [(a == b, round(float(np.dot(v, w)), 9)) for k, (_, a, v) in enumerate(rows) for _, b, w in rows[k + 1 :]]
    p, n = (np.array([s for same, s in pairs if same is kind]) for kind in (True, False))
    want = ((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n))
    monkeypatch.setattr(M, "cosine_pairs", None)
    df = spark.createDataFrame([(i, t, [float(x) for x in v]) for i, t, v in rows], UNIT)
    assert M.pair_auc(df, digits, blocks, width, counted, formed=0) == round(float(want), digits)
    assert M.pair_auc(df.withColumn("topic", F.col("ord")), digits, blocks, width, counted, formed=0) is None


def test_auc_same_topic_forms_no_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(M, "cosine_pairs", None)
    whole = M.pair_auc
    monkeypatch.setattr(M, "pair_auc", lambda rows, digits: whole(rows, digits, formed=0))
    same_rows(registry.queries()["auc_same_topic"](spark, sf), connect(sf), registry.oracle_sql()["auc_same_topic"])
