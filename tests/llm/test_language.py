import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from subjectloom.llm import language_id as L

from .helpers import DOC, clash, docs


def slow(model, text):
    total, n = np.zeros(model.logs.shape[1]), 0
    for w in text.encode().split():
        grams = L.trigrams(w)
        n += bool(grams)
        for g in grams:
            total += model.logs[model.grams.get(g, len(model.grams))]
    return total, n


def test_array_scores_equal_word_by_word(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts = Counter((r["lang"], g) for r in rows[:80] for w in r["text"].encode().split() for g in L.trigrams(w))
    model = L.TrigramModel.of([(a, g, n) for (a, g), n in counts.items()], sorted({a for a, _ in counts}))
    for dense in (L.DENSE, 0):
        monkeypatch.setattr(L, "DENSE", dense)
        scorer = L._Scorer(model)
        for text in [r["text"] for r in rows[80:110]] + ["", " 12 ##", "a1b2 É!é\xa0x ﻿y", "漢字 日本"]:
            (a, n), (b, m) = scorer.score(text.encode()), slow(model, text)
            assert n == m and np.allclose(a, b)


def test_held_out_accuracy(spark, sf):
    """A third of the rows declare a wrong language, which the other evidence overrules."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    noisy = table.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")))
    got = L.identify(noisy).join(table.select(F.col("doc_id").alias("id"), "lang"), "id")
    right = got.where(F.col("language") == F.col("lang")).count()
    assert right >= 0.97 * table.count()
    assert got.where("not kept").count() == 0


def test_junk_and_edges(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    junk = [None, "", "123 ### 45", "zqxj kwvz xqjz vvkq jjxz qqzw wkxv zzqj xkqv jqzx wvqk zxqj"]
    df = table.union(docs(spark, junk, 10_000, lang=None, source=None).select(*table.columns))
    got = {r["id"]: r for r in L.identify(clash(df)).where("id >= 10000").collect()}
    assert [got[10_000 + i]["kept"] for i in range(4)] == [False] * 4
    assert got[10_000]["language"] == "und" and got[10_000]["posterior"] == 0.0
    assert L.identify(table.where("false")).count() == 0
    nothing = spark.createDataFrame([(1, "some words", None, None, 1), (1, "some words", None, None, 1)], DOC)
    assert [r["kept"] for r in L.identify(nothing).collect()] == [True, True]


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(60)
    got = L.identify_pages(pages).join(pages.select(F.col("page_id").alias("id"), L.declared_of(F.col("html")).alias("d")), "id")
    assert got.where("language = d").count() >= 0.95 * pages.count()


def test_addresses(spark):
    row = spark.sql("select 'a.example.fr' h, '<html class=x lang=\"DE-at\">' m").select(L.suffix_of(F.col("h")), L.declared_of(F.col("m"))).first()
    assert tuple(row) == ("fr", "de")


def slow_fusion(rows, names, weight=20.0):
    """The fusion in plain Python: counts of text-only decisions, then sums of logs."""
    k = len(names)
    best = [None if not r["n_words"] else max(range(k), key=lambda i, r=r: (r["logs"][i], -i)) for r in rows]

    def counts(key):
        out = defaultdict(lambda: [0.0] * k)
        for r, b in zip(rows, best, strict=True):
            if b is not None:
                out[key(r)][b] += 1
        return out

    every = counts(lambda r: 0)[0]
    base = [(x + 1) / (sum(every) + k) for x in every]
    by_suffix, by_host, by_declared = (counts(lambda r, c=c: r[c]) for c in ("suffix", "host", "declared"))

    def likely(c):
        share = (sum(c) + 1) / (sum(every) + 1)
        return [math.log((x + 10 * share) / (n + 10)) for x, n in zip(c, every, strict=True)]

    out = []
    for r, b in zip(rows, best, strict=True):
        logs = list(r["logs"])
        if r["host"] in by_host:
            sc, hc = by_suffix[r["suffix"]], by_host[r["host"]]
            prior = [(x + weight * p) / (sum(sc) + weight) for x, p in zip(sc, base, strict=True)]
            prior = [(x + weight * p) / (sum(hc) + weight) for x, p in zip(hc, prior, strict=True)]
            logs = [x + math.log(p) + (y if r["suffix"] else 0) for x, p, y in zip(logs, prior, likely(sc), strict=True)]
        if r["declared"] in names[:-1] and r["declared"] in by_declared:
            logs = [x + y for x, y in zip(logs, likely(by_declared[r["declared"]]), strict=True)]
        top = max(logs)
        post = 1 / sum(math.exp(x - top) for x in logs) if r["n_words"] else 0.0
        out.append((r["id"], names[logs.index(top)] if r["n_words"] else "und", post, names[b] if b is not None else "und"))
    return out


def test_fusion_equals_plain_python(spark):
    rng = np.random.default_rng(8)
    names = ["de", "en", "fr", "und"]
    hosts = [("", ""), ("a.fr", "fr"), ("b.fr", "fr"), ("c.de", "de"), ("plain", "")]
    rows = []
    for i in range(300):
        host, suffix = hosts[int(rng.integers(0, 5)) if i % 3 else 1]
        logs = [-1.0, -1.0, -2.0, -3.0] if i % 50 == 0 else [float(x) for x in np.round(rng.normal(-20, 2, 4), 3)]
        rows.append({"id": i, "declared": ["", "en", "fr", "xx"][int(rng.integers(0, 4))], "host": host, "suffix": suffix, "n_words": int(i % 10 > 0), "logs": logs})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, declared string, host string, suffix string, n_words long, logs array<double>")
    got = {r["id"]: r for r in L.fuse(df, names).collect()}
    assert len(got) == 300
    for i, language, posterior, text_language in slow_fusion(rows, names):
        assert (got[i]["language"], got[i]["text_language"]) == (language, text_language) and abs(got[i]["posterior"] - posterior) < 1e-9
    assert got[50 * 5]["text_language"] == "und" and got[51]["n_words"] == 1


def test_pages_with_all_kinds_of_evidence(spark, sf, monkeypatch):
    """The whole of pages: markup, suffix and host speak, and the fusion equals plain Python."""
    from subjectloom.llm.queries import QUERIES

    seen, fuse = [], L.fuse

    def watched(scored, names, weight):
        seen.append(([r.asDict() for r in scored.collect()], names))
        return fuse(scored, names, weight)

    monkeypatch.setattr(L, "fuse", watched)
    got = {r["page_id"]: r for r in QUERIES["pages_evidence_fusion"](spark, sf).collect()}
    ((rows, names),) = seen
    assert len(rows) == len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert {r["suffix"] for r in rows} >= {"com", "net", "org"} and len({r["host"] for r in rows}) > 5
    assert {r["declared"] for r in rows} == {"de", "en", "es", "fr"} == set(names) - {"und"}
    for i, language, posterior, text_language in slow_fusion(rows, names):
        assert (got[i]["language"], got[i]["text_language"]) == (language, text_language) and abs(got[i]["posterior"] - posterior) < 1e-6


def test_blocks_of_languages_change_nothing(spark, sf, monkeypatch):
    """Every declared language is modelled; a pass for each changes no score."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: {r["id"]: (r["language"], round(r["posterior"], 9), r["text_language"], r["n_words"]) for r in df.collect()}
    one = key(L.identify(table))
    monkeypatch.setattr(L, "LANGUAGES_A_PASS", 1)
    assert key(L.identify(table)) == one and len({x for x, *_ in one.values()}) == 4


def test_query(spark, sf):
    """The registered query: all rows, and very long and tied texts have results."""
    from subjectloom.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op9_evidence_fusion"](spark, sf)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in table.select("doc_id").collect())
    long = table.where("lang = 'fr'").first()["text"] * 3_000
    more = table.union(docs(spark, [long, long], 20_000, lang="fr", source=None).select(*table.columns))
    assert {r["language"] for r in L.identify(more).where("id >= 20000").collect()} == {"fr"}
