"""Transcripts to utterances, suggested boundaries, spans, labelled segments and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ANY_TAG = r"<<\s*[^>]+?\s*>>"


def tagged(text: Column) -> Column:
    """The (marker, content) pairs of a transcript, in order, as an array of structs."""
    markers = F.regexp_extract_all(text, F.lit(r"<<\s*([^>]+?)\s*>>"), 1)
    contents = F.split(text, ANY_TAG)
    return F.zip_with(markers, F.slice(contents, 2, F.greatest(F.size(contents) - 1, F.lit(0))), lambda m, c: F.struct(F.trim(m).alias("marker"), T.trim_ws(c).alias("content")))


def utterances(protocols: DataFrame) -> DataFrame:
    """``doc_id, idx, speaker, text, suggested``: every non-empty content behind a marker
    other than the topic marker; ``suggested`` is the last plausible topic title since
    the utterance before it.  An implausible title does not clear a pending one."""
    rows = protocols.select("doc_id", F.posexplode(tagged(F.col("text"))).alias("pos", "x")).select("doc_id", "pos", "x.marker", "x.content").where("content != ''")
    is_topic = F.col("marker") == T.TOPIC_TAG
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.sum(F.when(is_topic, 0).otherwise(1)).over(w) - F.when(is_topic, 0).otherwise(1)
    rows = rows.withColumn("idx", before.cast("long"))
    # A gap: the rows from just after one utterance up to the next one.
    gap = Window.partitionBy("doc_id", "idx").orderBy("pos")
    title = F.last(F.when(is_topic & T.plausible_title(F.col("content")), F.col("content")), ignorenulls=True).over(gap)
    return rows.withColumn("suggested", title).where(~is_topic).select("doc_id", "idx", F.col("marker").alias("speaker"), F.col("content").alias("text"), "suggested")


def boundary_bands(bounds: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, seg_idx, label, start, end``: each boundary up to the next one (the last
    to the end); blank labels and empty ranges go, keeping the numbers of the rest."""
    w = Window.partitionBy("doc_id").orderBy("before_idx", "label")
    rows = bounds.join(sizes, "doc_id").withColumns({"seg_idx": F.row_number().over(w).cast("long") - 1, "end": F.coalesce(F.lead("before_idx").over(w), F.col("n"))})
    return rows.where((F.trim("label") != "") & (F.col("before_idx") < F.col("end"))).select("doc_id", "seg_idx", "label", F.col("before_idx").alias("start"), "end")


def gold_segments(said: DataFrame, bands: DataFrame) -> DataFrame:
    """``doc_id, seg_idx, label, span_text, n_words``.  A boundary starts a band, so each
    utterance meets its band by the last start at or before it: an as-of join by window."""
    starts = bands.select("doc_id", F.col("start").alias("idx"), F.struct("seg_idx", "label", "end").alias("band"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = said.join(starts, ["doc_id", "idx"], "left").withColumn("band", F.last("band", ignorenulls=True).over(w)).where(F.col("band").isNotNull() & (F.col("idx") < F.col("band.end")))
    text = T.normalize_ws(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " "))
    out = rows.groupBy("doc_id", F.col("band.seg_idx").alias("seg_idx"), F.col("band.label").alias("label")).agg(text.alias("span_text"))
    return out.withColumn("n_words", T.word_count(F.col("span_text")).cast("long"))


def chains(segments: DataFrame, label: str, order: list[str], least: int = 2) -> DataFrame:
    """``label, n, members``: chronological members of labels with ``least`` or more."""
    members = F.array_sort(F.collect_list(F.struct(*order)))
    return segments.groupBy(label).agg(F.count("*").alias("n"), members.alias("members")).where(F.col("n") >= least)


def spans_of(protocols: DataFrame, topics: Column) -> DataFrame:
    """Spans in three modes: ``single`` (one topic: the body is one span), ``marker_split``
    (as many body headers as topics, or more: one span a header), ``frontloaded`` (the body
    once for each topic, not clean for evaluation)."""
    base = protocols.select("doc_id", "committee", "date", "text", topics.alias("topics"))
    base = base.withColumn("body", F.substring("text", T.first_speaker(F.col("text")).cast("int"), F.length("text")))
    header = "(?s)<<(?U:\\s)*(" + "|".join(T.TOPIC_TAGS) + ")(?U:\\s)*>>.*?<<(?U:\\s)*\\1(?U:\\s)*>>"
    titles = F.transform(F.regexp_extract_all("body", F.lit(header), 0), lambda h: T.strip_numbering(T.normalize_ws(F.regexp_replace(h, ANY_TAG, " "))))
    base = base.withColumns({"titles": titles, "parts": F.split("body", header)})
    n_topics, n_heads = F.size("topics"), F.size("titles")
    mode = F.when(n_topics == 1, "single").when(n_heads >= n_topics, "marker_split").otherwise("frontloaded")
    base = base.withColumn("segmentation", mode)
    # Between the tags a header holds its title, which cleaning keeps as plain text.
    split = F.transform("titles", lambda t, i: F.struct(t.alias("topic"), T.clean_span(F.concat(t, F.lit(" "), F.get("parts", i + 1))).alias("span_text")))
    whole = F.transform("topics", lambda t: F.struct(t.alias("topic"), T.clean_span(F.col("body")).alias("span_text")))
    rows = base.select("doc_id", "committee", "date", "segmentation", F.explode(F.when(F.col("segmentation") == "marker_split", split).otherwise(whole)).alias("s"))
    return rows.select("doc_id", "committee", "date", "s.topic", "s.span_text", F.length("s.span_text").cast("long").alias("n_chars"), T.word_count(F.col("s.span_text")).cast("long").alias("n_words"), "segmentation", (F.col("segmentation") != "frontloaded").alias("clean_for_eval"))


def dedup_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the last by ``order``: what a lookup built in order would hold."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def encode_labels(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Codes from 0 in the order of distinct values; only the distinct values are ranked."""
    codes = df.select(column).distinct().withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
    return df.join(codes, column)


def override(base: DataFrame, corrections: DataFrame, key: str, value: str) -> DataFrame:
    """A map with corrections laid over it."""
    c = corrections.select(key, F.col(value).alias("_new"))
    return base.join(c, key, "full").select(key, F.coalesce("_new", value).alias(value))
