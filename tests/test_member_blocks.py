"""Decisions on entries that need their members: few blocks of rows, extremes in tiles."""

import numpy as np
import pytest

from subjectloom.operators import journal as G

from .test_operators import UNIT, replay, unit_rows


def test_a_member_is_sent_to_few_blocks_of_rows():
    assert [G._member_blocks(n) for n in (1, 16, 17, 301, 1000)] == [(1, 1), (1, 16), (2, 9), (19, 16), (32, 32)]


@pytest.mark.parametrize("kind", ["members_max", "members_min"])
def test_extremes_in_tiles(kind, monkeypatch):
    monkeypatch.setattr(G, "TILE", 7)
    rng = np.random.default_rng(3)
    x, members, before = rng.normal(size=(40, 5)), rng.normal(size=(30, 5)), np.sort(rng.integers(1, 31, 40))
    best = np.max if kind == "members_max" else np.min
    want = [best(members[:k] @ r) for r, k in zip(x, before, strict=True)]
    for tiled in (1, 60, 1 << 23):
        monkeypatch.setattr(G, "TILED", tiled)
        assert G._affinity(kind, x, members, before) == pytest.approx(want)


@pytest.mark.parametrize("entry", ["median", "members_max", "members_min"])
def test_decisions_in_wide_blocks(spark, entry, monkeypatch):
    monkeypatch.setattr(G, "MEMBER_ROWS", 3)
    rows = unit_rows(60, 5)
    got = {(r["t"], r["entry"]): r["cos"] for r in G.decisions(spark.createDataFrame(rows, UNIT), entry, 4).collect()}
    want = replay(rows, entry)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
