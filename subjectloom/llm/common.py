"""Shared helpers of the training-data operators: staging, hashing, grouping.

Words are maximal runs of anything but the six ASCII white-space characters;
``bytes.split()`` of the UTF-8 text finds exactly these.  A null text counts
as an empty one everywhere in this subpackage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a regular-expression class; valid in Java, Python and RE2.
SPACE = r"[\x20\x09-\x0D]+"

#: Entries that a task's word-hash cache may hold before it starts anew.
CACHE_ENTRIES = 120_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (single-machine sessions such as tests) the
    session gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="subjectloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/subjectloom/{uuid.uuid4().hex}"


#: A staged table of known size has FILES_A_CORE files a core, or one for each ROWS_A_FILE rows
#: where that is more.
FILES_A_CORE, ROWS_A_FILE = 4, 500_000


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts lineage (a lost executor costs no recomputation of what came
    before) and keeps a costly scan from running once for each of its readers.
    ``rows``: about how many rows there are at most, where the caller knows; many
    partitions of a small table would be as many small files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    if rows is not None:
        df = df.coalesce(max(FILES_A_CORE * spark.sparkContext.defaultParallelism, rows // ROWS_A_FILE))
    # Small row groups: a writer holds one in memory, and each core has a writer.
    df.write.option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts hold 4 MB and 2,000 rows at most, so that Python
    workers stay small; settings already lower are kept."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000)):
        now = spark.conf.get(name)
        if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > most or int(now.rstrip("bB")) <= 0:
            spark.conf.set(name, str(most))


def clean_text(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class WordHashes(dict):
    """64-bit hashes of words, cached up to a bound so that memory stays flat."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def bounded(rows: Iterable[tuple], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)


def groups_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict[str, list]]]:
    """Consecutive rows with one key, across batch borders, as column lists.

    The input must be sorted by the key in each partition and every group must
    be small; callers split larger ones first.
    """
    held_key, held = None, None
    for batch in batches:
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        keys = columns[key]
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            piece = {name: values[at:end] for name, values in columns.items()}
            if held is not None and held_key == keys[at]:
                for name, values in piece.items():
                    held[name].extend(values)
            else:
                if held is not None:
                    yield held_key, held
                held_key, held = keys[at], piece
            at = end
    if held is not None:
        yield held_key, held


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


#: A key with more than 1 / HOT of a table's rows is hot; there are fewer than HOT of them.
HOT = 1024


def spread_join(big: DataFrame, small: DataFrame, on: str | list[str], salt: list[str], how: str = "inner", spread: int = 64) -> DataFrame:
    """``big.join(small, on, how)`` for a ``small`` with one row a key and a column
    ``n_rows``: how many rows of ``big`` have the key.

    The hot keys (fewer than HOT, so their names may be broadcast) are dealt: their rows of
    ``big`` by a hash of the columns ``salt`` into ``spread`` parts, with one copy of the
    key's row of ``small`` for each part.  No task gets more than its share of a key, with
    or without adaptive execution.
    """
    on = [on] if isinstance(on, str) else on
    total = small.select(F.sum("n_rows")).scalar()
    hot = F.col("n_rows") * HOT > total
    named = F.broadcast(small.where(hot).select(*on, F.lit(True).alias("_hot")))
    dealt = big.join(named, on, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt), F.lit(spread))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(hot, spread - 1).otherwise(0)))).drop("n_rows")
    return dealt.join(copies, [*on, "_part"], how).drop("_part")
