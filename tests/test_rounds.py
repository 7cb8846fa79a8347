"""What rounds write, and the nearest of all earlier rows in blocks by key."""

import numpy as np
import pytest

from subjectloom.operators import clusters as C
from subjectloom.operators import similarity as M


def test_rounds_write_no_vectors_anew(spark, monkeypatch):
    seen, keep = [], C.keep
    monkeypatch.setattr(C, "keep", lambda df, label: seen.append((label, df.columns)) or keep(df, label))
    x = np.random.default_rng(1).normal(size=(40, 6))
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())], "by int, ord long, v array<double>")
    assert C.spectral_embedding(rows, 2, more=3).count() == 40
    states = [columns for label, columns in seen if label == "state"]
    assert len(states) > 2 and not any("v" in c for c in states)


@pytest.mark.parametrize("rows_a_block", [1000, 13])
def test_nearest_earlier_in_order_of_keys(spark, monkeypatch, rows_a_block):
    """Ties (equal vectors, zero ones), keys with gaps, tiles of any size."""
    for name, value in (("TILE", 5), ("ENTRIES", 7), ("FIRST_ENTRIES", 4)):
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    x[10:30] = x[rng.integers(0, 5, 20)]
    x[40:44] = 0
    keys = np.cumsum(rng.integers(1, 9, 60))
    entries = spark.createDataFrame([(int(k), v) for k, v in zip(keys, x.tolist(), strict=True)], "k long, c array<double>").repartition(3)
    queries = spark.createDataFrame([(int(k) - 1, v) for k, v in zip(keys, x.tolist(), strict=True)], "q long, v array<double>")
    found = M.nearest_earlier(queries, entries, "k", 3, rows_a_block).collect()
    got = {(r["q"], r["rank"]): (r["k"], r["sim"]) for r in found}
    want = {}
    for i in range(60):
        s = np.round(x[:i] @ x[i], 9)
        for rank, j in enumerate(np.argsort(-s, kind="stable")[:3], 1):
            want[int(keys[i]) - 1, rank] = (int(keys[j]), pytest.approx(s[j], abs=1e-8))
    assert len(found) == len(want) and got == want


def test_only_what_may_be_kept_is_sorted(monkeypatch):
    """Of 4,000 entries a query sorts few."""
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(M.np, "lexsort", lambda k: sizes.append(len(k[0])) or lexsort(k))
    x = np.random.default_rng(3).normal(size=(4000, 8))
    row, place, sim = M._nearest(x[:20], np.full(20, 9999), x, np.arange(4000), 10)
    s = np.round(x[:20] @ x.T, 9)
    assert place.reshape(20, 10).tolist() == np.argsort(-s, axis=1, kind="stable")[:, :10].tolist() and sum(sizes) < 20 * 400
