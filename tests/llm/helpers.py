"""Small tables for the training-data operators."""

from subjectloom.llm import queries  # noqa: F401  (these tests need the subpackage)

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0, lang="en", source="s"):
    rows = [(first + i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def clash(df):
    """The table with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for name in ("key", "t", "w", "label", "one", "host", "rank", "s", "e", "n", "path", "cls", "p", "period", "slots", "id", "source_", "n_rows", "_part", "_hot", "_s", "_h", "_r", "_shard", "_key", "row", "suffix", "logs", "best", "seq", "grp", "size", "sig", "mix_slot"):
        df = df.withColumn(name, F.lit(7))
    return df


def words(rng, n, size=400):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, size, n))
