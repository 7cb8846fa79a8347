import hashlib
from collections import Counter

import numpy as np
import pytest

from subjectloom.llm import debruijn as D

from .helpers import clash, docs, words


def brute(texts, size=35):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p : p + size]) for w in split for p in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] > 1:
                gone[p : p + size] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return [tuple(r)[1:] for r in D.substring_dedup(df).orderBy("doc_id").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(spark, seed):
    """Copies, edited copies, passages at the threshold, periodic and low-entropy texts."""
    rng = np.random.default_rng(seed)
    base, passage = words(rng, 300), words(rng, 35)
    w = base.split()
    texts = [base, base, " ".join(x if i % 40 else "edit" for i, x in enumerate(w)), " ".join(w[50:120]), None, "", "one"]
    texts += [words(rng, 60) + " " + passage + " " + words(rng, 50) for _ in range(3)]
    texts += [" ".join(passage.split()[:34]), "a b c " * 40, "a " * 90, words(rng, 200, 3), words(rng, 200, 3), " ".join(w[:36] + ["x"] + w[:36])]
    texts += [" ".join(np.roll(w, 7)), words(rng, 5_000, 50)]
    assert got(docs(spark, texts)) == brute(texts)


def test_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"x{i}" for i in range(50))
    df = docs(spark, [text])
    rows = D.substring_dedup(clash(df.union(df))).collect()
    assert [r["n_removed"] for r in rows] == [50, 50]
    null = spark.createDataFrame([(None, text), (None, "a")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in D.substring_dedup(null).collect()) == [0, 0]
    assert D.substring_dedup(df.where("false")).count() == 0
    assert D.substring_dedup(df, texts=True).first()["kept_text"] == text
    with pytest.raises(ValueError):
        D.substring_dedup(df, window=20)


def test_query(spark, sf):
    from subjectloom.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in QUERIES["op5_debruijn"](spark, sf).orderBy("doc_id").collect()] == brute([r["text"] for r in table])
