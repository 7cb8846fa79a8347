import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from subjectloom.llm import divergence as D
from subjectloom.llm.queries import ORACLES, QUERIES

from ..compare import connect, same_rows
from .helpers import DOC, clash

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, least, top=50):
    """The audit in plain Python over (lang, source, text)."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        all_ = Counter()
        for c in own.values():
            all_.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q, p = share(all_), {s: share(c) for s, c in own.items()}
        for s in own:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)]
    return sorted(out)


def audit(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, s, 0) for i, (lang, s, t) in enumerate(rows)], DOC)
    got = D.source_divergence(clash(df).withColumn("term", F.lit(1)).withColumn("grp", F.lit(1)), **options)
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect())


def random_rows(rng, n, sources=7):
    words = ["the", "The", "Été", "été", "x1y", "日本", "a-b", "", "É", "zz", "don't", *[f"w{chr(97 + i)}" for i in range(26)]]
    return [(f"l{rng.integers(0, 2)}", f"s{int(rng.integers(0, sources) ** 2 / sources)}", " ".join(rng.choice(words, int(rng.integers(0, 30))))) for _ in range(n)]


@pytest.mark.parametrize("block,span", [(256, 20_000), (2, 10)])
def test_audit_equals_plain_python(spark, block, span, monkeypatch):
    if block == 2:
        monkeypatch.setattr(D, "BLOCK_ENTRIES", 5)
    rng = np.random.default_rng(block)
    rows = random_rows(rng, 150) + [(None, None, None), ("", "s", ""), (None, "t", "the the the"), ("l0", "lone", "only once seen"), ("l0", "empty", ""), ("x\0y", "s", "the"), ("x\0y", "t", ""), ("x", "y\0", "the")] + [("l1", "s1", "the the Q" * 9)] * 5
    assert audit(spark, rows, least_docs=4, sources_a_block=block, rows_a_range=span) == expected(rows, 4)


def test_no_term_is_kept(spark):
    rows = [("l", "a", "x y"), ("l", "b", "z"), ("m", "a", "x")]
    assert audit(spark, rows) == [("l", "a", "pair", "b", 0, 1), ("l", "b", "pair", "a", 0, 1)]
    assert audit(spark, rows[:1]) == []
    assert D.source_divergence(spark.createDataFrame([], DOC)).count() == 0


def test_blocks_and_pieces(monkeypatch):
    """Long texts in pieces and small blocks give the same counts."""
    text = ("Ab cD1e-ÄÖ.é" * 40).encode()
    whole = [t.encode() for t in TERM.findall(text.decode().translate(LOWER))]
    assert list(D.pieces(text)) == [whole] and list(D.pieces(b"")) == []
    monkeypatch.setattr(D, "PIECE", 7)
    parts = list(D.pieces(text))
    assert len(parts) > 20 and sum(parts, []) == whole


def test_shares_are_exact_for_huge_counts(spark):
    df = spark.createDataFrame([(9 * 10**17 + 3, 9 * 10**17 + 17, 12345)], "n long, total long, terms long")
    assert df.select(D.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (9 * 10**17 + 8) // (9 * 10**17 + 17 + 5 * 12345)


def test_one_term_and_source_with_most_rows(spark):
    """A term that is nearly all text, and a source with nearly all rows, without adaptive execution."""
    rows = [("l", "hot", "the " * 50)] * 400 + [("l", f"s{i}", "the other") for i in range(40)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert audit(spark, rows, sources_a_block=8, rows_a_range=10) == expected(rows, 30)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_very_long_text(spark):
    rows = [("l", "a", "Lorem ipsum " * 400_000), ("l", "b", "lorem")]
    got = audit(spark, rows, least_docs=1)
    assert got == expected(rows, 1)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    same_rows(QUERIES["op11_source_divergence"](spark, sf), connect(sf), ORACLES["op11_source_divergence"])
