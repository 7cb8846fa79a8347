"""How the sources of a language differ in their terms: a sort-based audit.

Terms are stretches of ASCII letters (lower-cased) and characters beyond ASCII.  Each
language keeps the terms of at least ``least_docs`` of its documents; a group (language,
source) gives each kept term a smoothed share in billionths, and groups are compared
term by term.

The method.

1. Each task counts its documents in blocks of bounded memory: one row for each block,
   language, source and term, with the documents and the occurrences (pre-aggregation:
   the "documents" of the sort are blocks of them).
2. The rows are dealt by a hash of (language, term, source) and sorted by (language,
   term, source, block); a scan of run lengths adds up each run.  However frequent a
   term, a run has one row a block at most.
3. Runs are summed up by (language, term) for document frequencies and kept terms, by
   (language, source) and language for the totals.
4. Each group's kept runs are dealt to pairs of blocks of sources (about ``sources_a_block``
   each) and to ranges of terms, and sorted by term; a second scan turns each run of one
   term into the differences of all pairs in its two blocks, adds them up in one matrix, and
   emits it as partial pairs, which are summed up.  Terms that no source of the two blocks has
   differ by the same amount each, so they are counted and never formed.

All arithmetic is in integers; shares are divided as decimals.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, groups_of, small_batches, spread_join, stage, text_bytes

#: Every byte of a term as itself, A-Z in lower case; every other one as a space.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: Entries that a task counts before it emits a block and starts anew.
BLOCK_ENTRIES = 400_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20

_COUNTED = "key binary, source string, block long, docs long, n long"
_RUNS = "key binary, source string, docs long, n long"
PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("part_value", pa.int64())])


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text; those of a long one in several lists."""
    plain = text.translate(TERM_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE) if len(plain) - at > PIECE else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents as counts.  A key is the language, a zero byte and the term (which has none), so
    keys sort by language and term; the empty term has the documents of a group, terms or not."""
    groups: defaultdict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    block = size = 0

    def emitted() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in groups.items():
            head, terms = lang.encode() + b"\0", list(docs)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([head + t for t in part], pa.binary()), pa.array([source] * m, pa.string()), pa.array(np.full(m, block)), pa.array(np.fromiter(map(docs.__getitem__, part), np.int64, m)), pa.array(np.fromiter(map(n.__getitem__, part), np.int64, m))], ["key", "source", "block", "docs", "n"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_bytes(batch, "text"), strict=True):
            docs, n = groups[lang, source]
            before, own = len(docs), {b""}
            for terms in pieces(text):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(docs) - before
            if size >= BLOCK_ENTRIES:
                yield from emitted()
                groups.clear()
                block, size = block + 1, 0
    yield from emitted()


def _run_lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of (key, source) in sorted rows, with its sums."""
    held: pa.RecordBatch | None = None
    names = ["key", "source", "docs", "n"]
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.select(names)
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        same = np.ones(batch.num_rows - 1, bool)
        for name in names[:2]:
            same &= pc.equal(batch.column(name)[1:], batch.column(name)[:-1]).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        sums = [pa.array(np.add.reduceat(batch.column(c).to_numpy(), start)) for c in names[2:]]
        runs = pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(start)) for c in names[:2]), *sums], names)
        # The last run may go on in the next batch.
        held = runs.slice(runs.num_rows - 1)
        if runs.num_rows > 1:
            yield runs.slice(0, runs.num_rows - 1)
    if held is not None:
        yield held


def runs_of(docs: DataFrame) -> DataFrame:
    """``key, source, docs, n`` of ``docs(lang, source, text)``: documents with the key's term and occurrences of
    it; the empty term stands for each group, with all its documents.

    One binary key sorts by its first bytes, most of which are the term's."""
    small_batches(docs.sparkSession)
    ordered = docs.mapInArrow(_count, _COUNTED).repartition("key", "source").sortWithinPartitions("key", "source", "block")
    return ordered.mapInArrow(_run_lengths, _RUNS)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact for any counts; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * whole(n + 5)
    return F.when(terms > 0, F.call_function("div", top, whole(total + 5 * terms)) + 1)


def _differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial pairs of each group of sorted rows: sources of two blocks (``left``: those of the first)
    over a range of terms.  Rows without a term name a source with its share of an absent one."""
    for _, rows in groups_of(batches, "grp"):
        names: list[dict[str, int]] = [{}, {}]
        absent: list[list[int]] = [[], []]
        at = 0
        while at < len(rows["term"]) and not rows["term"][at]:
            for side in (0, 1):
                if rows["left"][at] != bool(side) or rows["alone"][at]:
                    names[side][rows["source"][at]] = len(absent[side])
                    absent[side].append(rows["p"][at])
            at += 1
        low, high = (np.array(a, np.int64) for a in absent)
        apart = np.abs(low[:, None] - high[None])
        # The first range of terms brings what all kept terms would differ by if they were absent.
        total = apart * (rows["terms"][0] if rows["range"][0] == 0 else 0)
        terms, left, sources, p = (rows[c][at:] for c in ("term", "left", "source", "p"))
        run = np.cumsum([i > 0 and t != terms[i - 1] for i, t in enumerate(terms)]) if terms else np.zeros(0, np.int64)
        seen = int(run[-1]) + 1 if len(run) else 0
        p, alone = np.array(p, np.int64), bool(rows["alone"][0])
        on = [np.ones(len(p), bool) if alone else np.array(left, bool) == (side == 0) for side in (0, 1)]
        code = [np.array([names[side].get(s, -1) for s in sources], np.int64) if len(p) else np.zeros(0, np.int64) for side in (0, 1)]
        for first in range(0, seen, 1024):
            width = min(1024, seen - first)
            values = [np.tile(base, (width, 1)) for base in (low, high)]
            for side in (0, 1):
                own = on[side] & (run >= first) & (run < first + width)
                values[side][run[own] - first, code[side][own]] = p[own]
            for j in range(len(high)):
                total[:, j] += np.abs(values[0] - values[1][:, j : j + 1]).sum(0) - width * apart[:, j]
        pairs = [(a, b, int(total[i, j])) for a, i in names[0].items() for b, j in names[1].items() if a != b]
        lang = rows["lang"][0]
        yield from bounded(((lang, a, b, v) for a, b, v in pairs), PAIRS)
        if not alone:
            yield from bounded(((lang, b, a, v) for a, b, v in pairs), PAIRS)


def source_divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, sources_a_block: int = 256, rows_a_range: int = 20_000) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from each other one of its
    language (part ``pair``: summed differences of shares over all kept terms), and the
    terms in which it exceeds its language most (part ``term``, to rank ``top``).

    Defined results: null texts, languages and sources are empty strings; a repeated row is a
    document of its own; a group without terms, or a language without kept terms (values 0), still
    has its pairs; equal values rank by the item's bytes; a language with one source has no pairs;
    an empty table gives an empty result; columns other than the three named are ignored; very
    long texts are counted in pieces.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    runs = stage(runs_of(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))), "runs")

    zero = F.instr(F.reverse(F.col("key").cast("string")), "\0")
    lang = F.expr("substring(cast(key as string), 1, char_length(cast(key as string)) - z)")
    term = F.expr("right(cast(key as string), z - 1)")
    named = runs.where(F.substring("key", -1, 1) == F.lit(b"\0")).withColumn("z", zero).select(lang.alias("lang"), "source")
    words = runs.where(F.substring("key", -1, 1) != F.lit(b"\0"))
    terms = words.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.count("*").alias("n_rows")).where(F.col("docs") >= least_docs)
    terms = stage(terms.withColumn("z", zero).select("key", lang.alias("lang"), term.alias("term"), "n_lang", "n_rows"), "terms")
    kept = stage(spread_join(words.drop("docs"), terms, "key", ["source"]).drop("key"), "kept")

    # One row a group; the groups of a language are counted and given blocks and ranges.
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("all_n"), F.sum("n_rows").alias("all_rows"))
    groups = named.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("n_rows")), ["lang", "source"], "left")
    groups = groups.join(named.groupBy("lang").agg(F.count("*").alias("sources")), "lang").join(langs, "lang", "left").na.fill(0)
    blocks = F.ceil(F.col("sources") / sources_a_block).cast("int")
    ranges = (1 + F.floor(F.col("all_rows") / F.lit(rows_a_range) / blocks)).cast("int")
    groups = stage(groups.select("lang", "source", "n_rows", "own_n", "terms", "all_n", blocks.alias("blocks"), ranges.alias("ranges"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("own")), "groups")
    shares = spread_join(kept, groups, ["lang", "source"], ["term"])
    shares = shares.select("lang", "source", "term", "terms", "blocks", "own", "ranges", share(F.col("n"), F.col("own_n"), F.col("terms")).alias("p"), share(F.col("n_lang"), F.col("all_n"), F.col("terms")).alias("q"), F.pmod(F.xxhash64("term"), F.col("ranges")).cast("int").alias("range"))

    # Each block of sources meets every block, itself included; its own side of a pair is ``left``.
    names = groups.select("lang", "source", F.lit("").alias("term"), "terms", "blocks", "own", F.coalesce(share(F.lit(0), F.col("own_n"), F.col("terms")), F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"))
    faced = names.unionByName(shares.select(*names.columns)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    faced = faced.select("lang", "source", "term", "terms", "range", "p", (F.col("own") <= F.col("other")).alias("left"), (F.col("own") == F.col("other")).alias("alone"), F.concat_ws(",", F.least("own", "other"), F.greatest("own", "other"), "range", "lang").alias("grp"))
    partial = faced.repartition("grp").sortWithinPartitions("grp", "term", "source").mapInArrow(_differences, "lang string, source string, item string, part_value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("part_value").alias("value")).withColumn("part", F.lit("pair"))
    exceeding = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order))

    columns = ("lang", "source", "part", "item", "value", "rank")
    return ranked(pairs).select(*columns).union(ranked(exceeding).where(F.col("rank") <= top).select(*columns))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """``source_divergence`` over the whole of ``documents``."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(any_value(s), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS s FROM own GROUP BY ALL) USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(o.n, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 5) // (g.n + 5 * l.v) AS p,
      1 + 1000000000::HUGEINT * (k.n + 5) // (l.n + 5 * l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
      ON z.lang = a.lang AND s1 = a.source AND s2 = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
every AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
WHERE part = 'pair' OR rank <= 50
"""
