import random
import re
import resource
import time
from itertools import combinations

import numpy as np
import pytest

from subjectloom.llm import spaced_seeds as S

from .helpers import clash, docs, words


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def split(text):
    return [x for x in (re.sub(r"[\W_]+", "", w.lower()) for w in (text or "").split()) if x]


def best_stretch(a, b):
    """(matches, length, -start) of the longest stretch of which four fifths agree, the first
    on ties, by trying all of them."""
    same = [x == y for x, y in zip(a, b, strict=True)]
    found = max(((j - i, -j) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)), default=None)
    if found is None:
        return None
    length, end = found[0], -found[1]
    return sum(same[end - length : end]), length, length - end


def exhaustive(text, item, least=13):
    """(doc_start, item_start, tokens, matches) of the best stretch that counts, over all diagonals."""
    t, b = split(text), split(item)
    best = None
    for shift in range(-len(b) + 1, len(t)):
        lo, hi = max(0, -shift), min(len(b), len(t) - shift)
        if sum(x == y for x, y in zip(b[lo:hi], t[lo + shift : hi + shift], strict=True)) * 5 < 4 * min(least, len(b)):
            continue
        found = best_stretch(b[lo:hi], t[lo + shift : hi + shift])
        if found and found[1] >= min(least, len(b)) and (len(b) >= S.EXACT or found[0] == len(b)):
            match, length, start = found
            key = (match, length, start - lo - shift, start - lo)
            best = max(best, key) if best else key
    return best and (-best[2], -best[3], best[1], best[0])


def test_against_all_diagonals(spark):
    rng = np.random.default_rng(2)
    items = [words(rng, n, 5_000) for n in (40, 25, 13, 9)] + ["too short", None, ""]
    texts = []
    for item in items[:4]:
        w = item.split()
        edited = [x if (i + 1) % 9 else "other" for i, x in enumerate(w)]
        texts += [words(rng, 50, 5_000) + " " + item + " " + words(rng, 20, 5_000), "z " + " ".join(edited) + " q", item.upper().replace(" ", ", "), " ".join(w[: len(w) // 2])]
    texts += [words(rng, 300, 5_000), None, "", "too short"]
    texts += ["too short", "it is too   SHORT, yes", "too long short"]
    hits = {tuple(r)[:2]: tuple(r)[2:] for r in S.overlap_rows(clash(docs(spark, texts)), clash(bench(spark, items))).collect()}
    want = {(i, j): e for i, t in enumerate(texts) for j, b in enumerate(items) if (e := exhaustive(t, b))}
    assert hits == want and len(want) >= 12


def test_blocks_change_nothing(spark):
    rng = np.random.default_rng(3)
    items = [words(rng, 30, 5_000) for _ in range(12)]
    df = docs(spark, [items[3] + " a b", items[7], words(rng, 90, 5_000)])
    one, many = (sorted(map(tuple, S.overlap_rows(df, bench(spark, items), block_words=n).collect())) for n in (10**6, 50))
    assert one == many and len(one) == 2
    kept = S.decontaminate(clash(df), bench(spark, items), block_words=50)
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == clash(df).columns


def test_edges(spark):
    df = docs(spark, ["a b c d e f g h i j"] * 2)
    assert S.overlap_rows(df, bench(spark, ["x"]).where("false")).count() == 0
    assert S.overlap_rows(df.where("false"), bench(spark, ["a b c d e f g h"])).count() == 0
    assert S.overlap_rows(df, bench(spark, ["a b c d e f g h"])).count() == 2
    twice = bench(spark, ["a b c d e f g h", None, ""])
    assert S.overlap_rows(df, twice.union(twice)).count() == 4
    null = spark.createDataFrame([(None, "a b c d e f g h"), (None, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in S.overlap_rows(null, twice).collect()] == [None]
    assert S.decontaminate(null, twice).count() == 1
    lines = bench(spark, ["\n".join(f"x{i}y{j}" for j in range(1_000)) for i in range(5)])
    assert len(list(S._blocks(lines, "item_id", "text", 1_000))) == 5
    assert S.decontaminate(df, bench(spark, ["x"]).where("false")).count() == 2


@pytest.mark.parametrize("n", range(1, 13))
def test_short_items_are_always_found(n):
    """Whole items of up to 12 tokens, with every choice of places for the substitutions allowed."""
    item = [f"t{i}" for i in range(n)]
    table = S.SeedTable([(7, " ".join(item).encode(), 1)])
    allowed = n - -(-4 * n // 5) if n >= S.EXACT else 0
    for places in combinations(range(n), allowed):
        copy = ["other" if i in places else x for i, x in enumerate(item)]
        text = " ".join(["x", "y", *copy, "z"]).encode()
        assert list(S.overlaps(S.tokens(text, S.TokenHashes()), table, 13)) == [(7, 2, 0, n, n - allowed)]
    for places in combinations(range(n), allowed + 1):
        copy = ["other" if i in places else x for i, x in enumerate(item)]
        assert not list(S.overlaps(S.tokens(" ".join(copy).encode(), S.TokenHashes()), table, 13))


def test_repetition_equals_all_diagonals():
    """Few different words, so that seeds stand in many places and are not listed."""
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.choice("ab") if rng.random() < 0.3 else "a" for _ in range(rng.randint(13, 60))]
        text = [rng.choice("abc") if rng.random() < 0.4 else "a" for _ in range(rng.randint(5, 150))]
        table = S.SeedTable([(1, " ".join(item).encode(), 1)])
        got = list(S.overlaps(S.tokens(" ".join(text).encode(), S.TokenHashes()), table, 13))
        want = exhaustive(" ".join(text), " ".join(item))
        if any(shifts is None for shifts in table.diagonals(S.tokens(" ".join(text).encode(), S.TokenHashes())).values()):
            assert got == ([(1, *want)] if want else [])
        elif got:
            assert want and got[0][4] <= want[3]


@pytest.mark.parametrize("kind", ["one word", "numbers", "no spaces"])
def test_ten_megabytes(kind):
    text = {"one word": b"the " * 2_500_000, "numbers": b" ".join(b"%d" % (i % 977) for i in range(2_600_000)), "no spaces": b"abcdefghij" * 1_000_000}[kind]
    items = [(i, b" ".join([b"the"] * 200 if i % 2 else [b"%d" % (j % 977) for j in range(i, i + 200)]), 1) for i in range(20)]
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    found = list(S.overlaps(S.tokens(text, S.TokenHashes()), S.SeedTable(items), 13))
    assert len(found) == {"one word": 10, "numbers": 10, "no spaces": 0}[kind] and all(n == 200 for *_, n in found)
    assert time.time() - start < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def test_query(spark, sf):
    from subjectloom.llm.queries import QUERIES

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_spaced_seeds"](spark, sf).collect()
    assert rows and all(exhaustive(texts[r["doc_id"]], items[r["item_id"]])[3] >= r["n_match"] for r in rows)
    inside = {(d, i) for d, t in texts.items() for i, x in items.items() if " ".join(split(x)) in " ".join(split(t))}
    assert inside <= {(r["doc_id"], r["item_id"]) for r in rows}


def longest(a, b):
    """Length of the longest stretch with four fifths equal, by trying all of them."""
    return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if 5 * sum(x == y for x, y in zip(a[i:j], b[i:j], strict=True)) >= 4 * (j - i)), default=0)


def test_substitutions_near_the_ends(spark):
    """Whole items with substitutions anywhere: all that a mask hits are found."""
    rng = np.random.default_rng(5)
    items, texts = [], []
    for n, edits in ((13, 1), (13, 2), (16, 1), (16, 2), (18, 2), (20, 3), (25, 5), (9, 1), (20, 7)):
        for _ in range(25):
            own = words(rng, n, 50_000).split()
            copy = list(own)
            for at in rng.choice(n, edits, replace=False):
                copy[at] = "other"
            items.append(own)
            texts.append(copy)
    want = set()
    for i, (own, copy) in enumerate(zip(items, texts, strict=True)):
        masks = S.MASKS if len(own) >= S.WHOLE else S.whole_masks(len(own))
        hit = any(all(own[at + k] == copy[at + k] for k in m) for m in masks for at in range(len(own) - m[-1] if len(own) >= S.WHOLE else 1))
        if hit and longest(own, copy) >= min(13, len(own)):
            want.add((i, i))
    padded = ["x y " + " ".join(t) + " z" for t in texts]
    hits = {(r["doc_id"], r["item_id"]) for r in S.overlap_rows(docs(spark, padded), bench(spark, [" ".join(x) for x in items])).collect()}
    assert hits == want and len(want) >= 100
