"""Language identification by Bayesian evidence fusion.

log P(language | row) is, up to a constant, the sum of

* a text log-likelihood: character trigrams of words under one smoothed
  multinomial a language, fitted here on a bounded sample of rows with a declared
  language, tempered to ``EVIDENCE_WORDS`` words (neighbouring trigrams are not
  independent); a uniform background model stands for text in no language;
* log P(declared markup language | language), from the counts of declared against
  text-only decisions over the whole corpus;
* log P(address suffix | language), from the counts of suffixes likewise;
* a host prior, smoothed hierarchically: host counts by the suffix's, those by
  the corpus's, each with a Dirichlet weight.

Texts are scored once (Arrow batches, whole texts, word scores cached) and the
scores staged; every count is a grouped aggregation combined before the shuffle,
and the fusion is plain column arithmetic.  The one shuffled join carries a row a
document with a handful of doubles, no text; a host with a large share of all rows is
dealt into parts (``spread_join``).  All declared languages are modelled, a bounded
number in each pass over the texts, so a worker's tables have a bound.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, clean_text, small_batches, spread_join, stage, text_bytes
from .host_quality import host_of

#: Rows of each declared language that the trigram models are fitted on, at most.
SAMPLE_ROWS = 300
#: Languages whose models a worker holds at once; more take more passes over the texts.
LANGUAGES_A_PASS = 200
#: A text counts as at most this many words of evidence.
EVIDENCE_WORDS = 25.0
#: The background spreads its mass evenly over this many trigrams.
BACKGROUND = 40.0**3
UNKNOWN = "und"

_letters = re.compile(r"[\W\d_]+").sub


def trigrams(word: bytes) -> list[str]:
    w = _letters("", word.decode("utf-8", "replace").lower())
    return [f" {w} "[i : i + 3] for i in range(len(w))] if w else []


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch, "text"), strict=True):
            words = Counter(text.split())
            for word, n in words.items():
                for g in trigrams(word):
                    found[lang, g] += n
    yield from bounded(((lang, g, n) for (lang, g), n in found.items()), pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))


class TrigramModel:
    """Log-probabilities of trigrams for each language, the background last."""

    def __init__(self, languages: list[str], grams: dict[str, int], logs: np.ndarray):
        self.languages, self.grams, self.logs = languages, grams, logs

    @classmethod
    def of(cls, rows: list[tuple[str, str, int]], languages: list[str], smooth: float = 0.1, vocabulary: int | None = None) -> TrigramModel:
        """``vocabulary``: trigrams of all languages, where these are not all of them."""
        grams = {g: i for i, g in enumerate(sorted({g for _, g, _ in rows}))}
        counts = np.zeros((len(grams) + 1, len(languages)))
        at = {x: i for i, x in enumerate(languages)}
        for lang, g, n in rows:
            counts[grams[g], at[lang]] += n
        logs = np.log((counts + smooth) / (counts.sum(axis=0) + smooth * ((vocabulary or len(grams)) + 1)))
        return cls(languages, grams, np.hstack([logs, np.full((len(logs), 1), -np.log(BACKGROUND))]))

    def parts(self) -> tuple:
        """What is broadcast: plain values, which workers can read without this package."""
        return self.languages, self.grams, self.logs


#: The largest dense trigram table; larger alphabets are looked up by bisection.
DENSE = 1 << 22


class _Scorer:
    """Scores whole texts by array lookups: code points to letters, letters to trigrams."""

    def __init__(self, model: TrigramModel):
        self.logs = model.logs
        letters = sorted({c for g in model.grams for c in g if c != " "})
        self.size = len(letters) + 2  # 0 is the space, the last one any other letter
        self.table = np.full(0x110000, self.size - 1, np.int32)
        every = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        for run in re.finditer(r"[\W\d_]+", every):
            self.table[run.start() : run.end()] = -1
        self.table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.table[list(b" \t\n\v\f\r")] = 0
        at = {" ": 0} | {c: i + 1 for i, c in enumerate(letters)}
        codes = np.array([(at[g[0]] * self.size + at[g[1]]) * self.size + at[g[2]] for g in model.grams], np.int64)
        rows = np.array(list(model.grams.values()), np.int64)
        self.dense = None
        if self.size**3 <= DENSE:
            self.dense = np.full(self.size**3, len(model.grams), np.int32)
            self.dense[codes] = rows
        else:
            order = np.argsort(codes)
            self.codes, self.rows = codes[order], rows[order]

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.rows[at], len(self.logs) - 1)

    def score(self, text: bytes) -> tuple[np.ndarray, int]:
        """Summed log-likelihoods of a text and its number of words with letters."""
        points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.table[points]
        c = np.concatenate([[0], c[c >= 0], [0]])
        c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]  # runs of spaces become one
        middle = np.flatnonzero(c)
        if not len(middle):
            return np.zeros(self.logs.shape[1]), 0
        codes = (c[middle - 1].astype(np.int64) * self.size + c[middle]) * self.size + c[middle + 1]
        counts = np.bincount(self._rows(codes), minlength=len(self.logs))
        return counts @ self.logs, int(np.count_nonzero(c[middle - 1] == 0))


def _score(model, last: bool):
    """Appends the block's scores to ``logs`` (before the background's, which the ``last``
    block adds), tempered by the number of words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(TrigramModel(*model.value))
        for batch in batches:
            scores = [scorer.score(t) for t in text_bytes(batch, "text")]
            logs = [(s * (min(n, EVIDENCE_WORDS) / n if n else 0.0)).tolist() for s, n in scores]
            found = dict(zip(batch.schema.names, batch.columns, strict=True))
            found["n_words"] = pa.array([n for _, n in scores], pa.int64())
            found["logs"] = pa.array([a + (x if last else x[:-1]) for a, x in zip(batch.column("logs").to_pylist(), logs, strict=True)], pa.list_(pa.float64()))
            if last:
                found.pop("text")
            yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    return run


def suffix_of(host: Column) -> Column:
    """The last label of a host that has a dot, else '' (no evidence)."""
    return F.regexp_extract(host, r"\.([a-z]{2,})$", 1)


def declared_of(html: Column) -> Column:
    """The language that a page's markup declares, without region: '' if none."""
    return F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-z]{2,3})", 1))


def fit(docs: DataFrame) -> list[TrigramModel]:
    """Trigram models of ``docs(id, text, declared)``, blocks of LANGUAGES_A_PASS declared
    languages by name, from at most SAMPLE_ROWS rows of each, those of least id hash."""
    spark = docs.sparkSession
    named = docs.where("declared != ''")
    mark = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    # About twice as many rows as wanted pass by their hash alone, so the ranking below sees few.
    share = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / (1 << 32)
    sizes = named.groupBy("declared").agg(F.count("*").alias("n_rows")).withColumn("part", 2.0 * SAMPLE_ROWS / F.col("n_rows"))
    sizes = stage(sizes, "languages")
    first = F.row_number().over(Window.partitionBy("declared").orderBy("mark"))
    near = spread_join(named.select("declared", mark.alias("mark"), share.alias("share")), sizes, "declared", ["mark"]).where(F.col("share") < F.col("part"))
    chosen = stage(near.select("declared", "mark").distinct().withColumn("r", first).where(F.col("r") <= SAMPLE_ROWS).select("declared", "mark"), "chosen")
    # The marks are a table of known size: Spark broadcasts it where that allows.
    sample = named.withColumn("mark", mark).join(chosen, ["declared", "mark"]).dropDuplicates(["declared", "mark"]).coalesce(8)
    rows = stage(sample.select(F.col("declared").alias("lang"), "text").mapInArrow(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    languages = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    vocabulary = rows.select("gram").distinct().count()
    out = []
    for k in range(0, len(languages), LANGUAGES_A_PASS):
        block = languages[k : k + LANGUAGES_A_PASS]
        held = rows.where((F.col("lang") >= block[0]) & (F.col("lang") <= block[-1])).collect()
        out.append(TrigramModel.of([(r["lang"], r["gram"], r["n"]) for r in held], block, vocabulary=vocabulary))
    return out


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, keep: tuple[str, ...] = (), accept: tuple[str, ...] | None = None, floor: float = 0.5, prior_weight: float = 20.0) -> DataFrame:
    """``id``, the columns ``keep``, ``language``, ``posterior``, ``text_language``,
    ``n_words`` and ``kept`` of every row.

    ``kept``: the language is known (and in ``accept`` where given) with a posterior
    of ``floor`` or more.  Defined results: null or letterless text (0 words) is
    'und' with posterior 0 and not kept; a null declaration or host is no
    evidence; repeated rows are judged alike; of languages with equal scores the
    alphabetically first wins, 'und' last; where no row declares a language there is
    no model and every row with words is 'und' and kept; an empty table gives an empty
    result; columns of the input other than those asked for are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    declared = declared if declared is not None else F.col("lang")
    host = host_of(host if host is not None else F.col("source"))
    source = docs.select(F.col(id_col).alias("id"), clean_text(text_col).alias("text"), F.coalesce(F.lower(declared), F.lit("")).alias("declared"), host.alias("host"), *[F.col(c).alias(f"_{c}") for c in keep])
    source = source.withColumn("suffix", suffix_of(F.col("host")))
    kept = [F.col(f"_{c}").alias(c) for c in keep]
    models = fit(source.select("id", "text", "declared"))
    if not models:
        words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long")
        return source.select("id", *kept, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.lit(UNKNOWN).alias("text_language"), words.alias("n_words"), (words > 0).alias("kept"))
    names = [x for m in models for x in m.languages] + [UNKNOWN]
    scored = source.select(*source.drop("text").columns, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<double>").alias("logs"))
    for i, model in enumerate(models):
        last = i == len(models) - 1
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema if f.name != "text" or not last]
        scored = scored.mapInArrow(_score(spark.sparkContext.broadcast(model.parts()), last), ", ".join(fields))
    fused = fuse(stage(scored, "scored"), names, prior_weight)
    good = (F.col("language") != UNKNOWN) & (F.col("posterior") >= floor)
    if accept is not None:
        good = good & F.col("language").isin(*accept)
    return fused.select("id", *kept, "language", "posterior", "text_language", "n_words", good.alias("kept"))


def fuse(scored: DataFrame, names: list[str], prior_weight: float = 20.0) -> DataFrame:
    """``scored(declared, host, suffix, n_words, logs, ...)`` with ``language, posterior,
    text_language``: the text's scores (one a name, UNKNOWN last) plus host prior, suffix
    and declaration, all counted from the text-only decisions of ``scored`` itself."""
    k = len(names)
    scored = scored.withColumn("best", F.when(F.col("n_words") > 0, F.array_position("logs", F.array_max("logs")) - 1))

    def table(key: str) -> DataFrame:
        """Counts of text-only decisions for each value of ``key``."""
        return scored.where("best is not null").groupBy(key).agg(F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(k)]).alias("c"))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    scale = lambda a, w: F.transform(a, lambda x: x * w)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    corpus = scored.where("best is not null").select(F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(k)])).scalar()
    base = F.transform("all", lambda x: (x + 1.0) / (total(F.col("all")) + k))

    def likelihood(key: str) -> DataFrame:
        """log P(value | language) by corpus counts, one pseudo-count spread by the value's share."""
        rows = table(key).withColumn("all", corpus)
        share = (total(F.col("c")) + 1.0) / (total(F.col("all")) + 1.0)
        logs = F.zip_with("c", "all", lambda c, n: F.log((c + 10.0 * share) / (n + 10.0)))
        return rows.select(key, F.when(F.col(key) == "", F.transform("c", lambda x: F.lit(0.0))).otherwise(logs).alias(f"{key}_logs"))

    # A host has one suffix, so the host's row carries both its prior and its suffix's evidence.
    suffixes = table("suffix").withColumnRenamed("c", "sc").withColumn("all", corpus)
    suffixes = suffixes.select("suffix", scale(add(F.col("sc"), scale(base, F.lit(prior_weight))), 1.0 / (total(F.col("sc")) + prior_weight)).alias("sp")).join(likelihood("suffix"), "suffix")
    hosts = scored.where("best is not null").groupBy("host", "suffix").agg(F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(k)]).alias("c")).join(suffixes, "suffix")
    prior = scale(add(F.col("c"), scale(F.col("sp"), F.lit(prior_weight))), 1.0 / (total(F.col("c")) + prior_weight))
    hosts = hosts.select("host", total(F.col("c")).alias("n_rows"), add(F.transform(prior, lambda x: F.log(x)), F.col("suffix_logs")).alias("host_logs"))
    # Declarations other than a modelled language are no evidence; those are one row a name.
    named = likelihood("declared").where(F.col("declared").isin(*names[:-1]))

    fused = spread_join(scored.join(F.broadcast(named), "declared", "left"), stage(hosts, "hosts"), "host", ["id", "n_words"], "left")
    flat = F.transform("logs", lambda x: F.lit(0.0))
    for part in ("host_logs", "declared_logs"):
        fused = fused.withColumn("logs", add(F.col("logs"), F.coalesce(F.col(part), flat)))
    fused = fused.withColumn("top", F.array_max("logs")).withColumn("at", F.array_position("logs", F.col("top")))
    fused = fused.withColumn("posterior", F.when(F.col("n_words") > 0, 1.0 / total(F.transform("logs", lambda x: F.exp(x - F.col("top"))))).otherwise(0.0))
    label = lambda i: F.element_at(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    fused = fused.withColumn("language", F.when(F.col("n_words") > 0, label(F.col("at"))).otherwise(UNKNOWN))
    return fused.withColumn("text_language", F.coalesce(label(F.col("best") + 1), F.lit(UNKNOWN)))


def identify_pages(pages: DataFrame) -> DataFrame:
    """``identify`` over raw pages (``page_id, url, html``): markup language, address suffix
    and host from the page.  Defined results are those of ``identify``; a null page is an
    empty text, markup without letters is 'und', a null address is the host ''."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    return identify(pages.withColumn("text", text), id_col="page_id", declared=declared_of(F.col("html")), host=F.col("url"))


def op9_evidence_fusion(spark, sf_dir: str) -> DataFrame:
    """``identify`` over the whole of ``documents``: the declared language is ``lang``,
    the host is ``source``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs).select(F.col("id").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "n_words", "kept")


def pages_evidence_fusion(spark, sf_dir: str) -> DataFrame:
    """``identify_pages`` over the whole of ``pages``, where markup, suffix and host all have something to say."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return identify_pages(pages).select(F.col("id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "n_words", "kept")
