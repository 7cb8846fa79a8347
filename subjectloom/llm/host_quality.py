"""Host-level quality rules with rates shrunk by an empirical beta prior.

Per document: word, symbol, repeated-line and repeated-window counts, all by
built-in functions on one row (no shuffle of texts).  Per host: for each rule,
failures f of n documents; a beta prior for each rule is fitted to the hosts'
rates by the method of moments (weighted by documents, the binomial noise of
small hosts taken off), and the posterior mean (f + a) / (n + a + b) is the shrunk
rate.  A host whose shrunk rate passes ``host_limit`` for any rule is rejected, and
its verdict is joined back to its documents.

The counts are staged once, so that texts are read once; hosts are aggregated
before the shuffle, and the join back carries numbers only.  The verdicts are
staged with the hosts' sizes, and a host with a large share of all documents is
dealt into parts (``spread_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, clean_text, spread_join, stage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def host_of(column: Column) -> Column:
    """The host of a URL, or the source name itself; null counts as an empty name."""
    name = F.coalesce(column.cast("string"), F.lit(""))
    return F.when(name.contains("://"), F.lower(F.regexp_extract(name, "://([^/:?#]+)", 1))).otherwise(name)


def text_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the five counts of each text.

    Each layer refers to columns of the layer below, so an array is built once
    a row although the lambdas read it at every element.
    """
    at = lambda array, i: F.get(F.col(array), i)
    one = docs.select(*keep, clean_text(text_col).alias("t"))
    two = one.select(
        *keep,
        F.array_remove(F.split("t", SPACE), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    three = two.select(
        *keep,
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("w", 1, F.greatest(F.size("w") - 4, F.lit(0))), lambda x, i: F.xxhash64(x, at("w", i + 1), at("w", i + 2), at("w", i + 3), at("w", i + 4))).alias("grams"),
    )
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    four = three.select(*keep, *COUNTS[:4], F.when(repeated, F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("sorted"))
    twice = F.filter("sorted", lambda x, j: (at("sorted", j - 1)["g"] == x["g"]) | (at("sorted", j + 1)["g"] == x["g"]))
    five = four.select(*keep, *COUNTS[:4], F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))).alias("starts"))
    start = F.struct(F.lit(0).alias("total"), F.lit(-5).alias("last"))
    covered = F.aggregate("starts", start, lambda acc, p: F.struct((acc["total"] + F.least(F.lit(5), p - acc["last"])).alias("total"), p.alias("last")), lambda acc: acc["total"])
    return five.select(*keep, *COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    """Failure of each rule by a document's counts, in integer arithmetic."""
    c = F.col
    return {
        "base": (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words")),
        "symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "lines": 10 * c("n_dup_lines") > 3 * c("n_words"),
        "length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
    }


def host_verdicts(counts: DataFrame, host_limit: float = 0.5, strongest: float = 1000.0) -> DataFrame:
    """``host, n_rows, host_failed``.

    A beta prior of mean m and strength s = a + b makes a host's rate vary by
    m(1-m)(1 + (n-1) r) / n with r = 1 / (1 + s).  The sum of n (rate - m)^2 over k hosts of
    N documents, S, has mean m(1-m) ((k-1) + r (N - k + 1 - sum n^2 / N)), which gives r;
    s is held to [1, ``strongest``] (``strongest`` where the rates vary no more than by
    chance)."""
    names = list(rules())
    hosts = counts.groupBy("host").agg(F.count("*").cast("double").alias("n"), *[F.count_if(test).cast("double").alias(r) for r, test in rules().items()])
    n = F.col("n")
    sums = [F.count("*").cast("double").alias("k"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"), *[F.sum(r).alias(r) for r in names], *[F.sum(F.col(r) * F.col(r) / n).alias(f"q_{r}") for r in names]]
    joined = hosts.withColumn("all", hosts.select(F.struct(*sums)).scalar())
    at = lambda name: F.col(f"all.{name}")
    failed = F.lit(False)
    for r in names:
        m = at(r) / at("n")
        spread = at(f"q_{r}") - at(r) * at(r) / at("n")
        share = F.try_divide(F.try_divide(spread, m * (1 - m)) - (at("k") - 1), at("n") - at("k") + 1 - at("nn") / at("n"))
        strength = F.when(share > 0, F.greatest(F.lit(1.0), F.least(F.lit(strongest), 1 / share - 1))).otherwise(F.lit(strongest))
        failed = failed | ((F.col(r) + m * strength) / (n + strength) > host_limit)
    return joined.select("host", n.cast("long").alias("n_rows"), failed.alias("host_failed"))


def host_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed`` and ``kept`` of every row.

    Defined results: a null text is empty (0 words, so it fails the base rule);
    a null host is the host named ''; repeated rows count as often as they stand;
    an empty table gives an empty result; other columns of the input are ignored.
    Windows of five words are compared by a 64-bit hash inside one document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host_of(F.col(host_col)).alias("host"))
    counts = stage(text_counts(rows, ["doc_id", "host"]), "counts")
    out = spread_join(counts, stage(host_verdicts(counts, host_limit), "verdicts"), "host", ["doc_id", *COUNTS])
    return out.select("doc_id", *COUNTS, rules()["base"].alias("base_failed"), (~rules()["base"] & ~F.col("host_failed")).alias("kept"))


def op6_host_rules(spark, sf_dir: str) -> DataFrame:
    """``host_quality`` over the whole of ``documents``."""
    return host_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, CASE WHEN contains(source, '://') THEN lower(regexp_extract(source, '://([^/:?#]+)', 1)) ELSE coalesce(source, '') END AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS gram FROM g),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM h) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM r) GROUP BY doc_id),
c AS (SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN n USING (doc_id)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base, 10 * n_symbols > 3 * n_words AS symbols,
      10 * n_dup_lines > 3 * n_words AS lines, (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS length FROM c),
k AS (SELECT host, rule, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS x
      FROM (UNPIVOT (SELECT host, base, symbols, lines, length FROM f) ON base, symbols, lines, length INTO NAME rule VALUE failed) GROUP BY 1, 2),
m AS (SELECT rule, sum(x) / sum(n) AS m, sum(x * x / n) - sum(x) * sum(x) / sum(n) AS v, count(*) - 1 AS hosts, sum(n) - count(*) + 1 - sum(n * n) / sum(n) AS room FROM k GROUP BY rule),
o AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND room <> 0 THEN (v / (m * (1 - m)) - hosts) / room END AS r FROM m),
s AS (SELECT host, x, n, m, CASE WHEN r > 0 THEN greatest(1.0, least(1000.0, 1 / r - 1)) ELSE 1000.0 END AS s FROM k JOIN o USING (rule)),
b AS (SELECT host, bool_or((x + m * s) / (n + s) > 0.5) AS host_failed FROM s GROUP BY host)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base AS base_failed,
       (NOT base AND NOT host_failed) AS kept
FROM f JOIN b USING (host)
"""
