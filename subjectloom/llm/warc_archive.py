"""WARC archives: writing, normalising monolithic gzip files, reading by index.

Many crawls hold archives that are one gzip stream from end to end, in which no
record can be reached without inflating all before it.  The normaliser inflates
such a file once, as a stream, rewrites every record as a gzip member of its own
and notes where each member begins: the sidecar offset index, beside the archive
(``.idx``, one JSON object a line) and as a table.  Afterwards any record is one
seek and one small inflate away.

Records follow WARC 1.1 with HTTP response blocks.  Of records with equal payloads
the one with the largest page id is the response; the others are revisits
(profile identical-payload-digest) whose block is the HTTP head alone, so equal
payloads are stored once, however many there are.

Files are reached through ``pyarrow.fs`` by URI, in the shared folder.  Every attempt of a
task writes under a name of its own and gives that name in its output; the staged table
of names is committed by Spark, so it names the files of the attempts that won.  What a
lost or repeated attempt leaves is named nowhere, and nothing is moved or overwritten.
A task streams: it holds one record (and one batch of rows) at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_dir, small_batches, stage

#: The compression levels of the monolithic input and of the members.
COARSE, FINE = 1, 5
CHUNK = 1 << 18
_HEAD_END = b"\r\n\r\n"
INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("target", pa.string()), ("warc_type", pa.string()), ("digest", pa.string())])
INDEX_DDL = "archive string, offset long, length long, record_id string, target string, warc_type string, digest string"
PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
PAGE_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return system, path


def _new(folder: str):
    """A file name that no other attempt has: system, path, URI."""
    uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system, path, uri


def record(page_id, url: str, n_bytes: int, payload: bytes | None, sha: str, refers_to) -> bytes:
    """One WARC record, a revisit where the payload is None.  A null page id is the id ``none``."""
    revisit, digest = payload is None, base64.b32encode(bytes.fromhex(sha)).decode()
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    heads = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        heads += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head = "WARC/1.1\r\n" + "".join(h + "\r\n" for h in heads) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


def _write(folder: str):
    """Rows (page_id, url, n_bytes, payload, sha, leader) to one monolithic gzip file a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = uri = None
        packer = zlib.compressobj(COARSE, zlib.DEFLATED, 31)
        n = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "n_bytes", "payload", "sha", "leader")]
            for row in zip(*columns, strict=True):
                if stream is None:
                    system, path, uri = _new(folder)
                    stream = system.open_output_stream(path, compression=None)
                stream.write(packer.compress(record(*[v.as_py() for v in row])))
                n += 1
        if stream is not None:
            stream.write(packer.flush())
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["archive", "n"])

    return run


def inflated(stream) -> Iterator[bytes]:
    """The inflated chunks of a gzip file of one or many members, read once; a file that ends
    inside a member is an error, wherever the cut lies."""
    engine, inside = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            inside = True
            if out := engine.decompress(data, CHUNK * 4):
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data = engine.unused_data
                engine, inside = zlib.decompressobj(31), False
    if inside:
        raise ValueError("archive ends inside a gzip member")


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record bytes) of each record; only one record is held."""
    held = bytearray()
    source = iter(chunks)

    def more() -> bool:
        chunk = next(source, None)
        if chunk is not None:
            held.extend(chunk)
        return chunk is not None

    while True:
        while (end := held.find(_HEAD_END)) < 0:
            if not more():
                if held.strip():
                    raise ValueError("archive ends inside a record head")
                return
        head = headers(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("archive ends inside a record")
        yield head, bytes(held[:size])
        del held[:size]


def _normalise(folder: str):
    """Archive names to one index row a record of the rewritten archive."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                out, to, target = _new(folder)
                system, path = _open(source)

                def rows() -> Iterator[tuple]:
                    at = 0
                    with system.open_input_stream(path, compression=None) as stream, out.open_output_stream(to, compression=None) as archive, out.open_output_stream(f"{to}.idx", compression=None) as index:
                        for head, whole in records(inflated(stream)):
                            packer = zlib.compressobj(FINE, zlib.DEFLATED, 31)
                            member = packer.compress(whole) + packer.flush()
                            archive.write(member)
                            row = (at, len(member), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-type"), head.get("warc-payload-digest"))
                            index.write((json.dumps(row, ensure_ascii=False) + "\n").encode())
                            yield target, *row
                            at += len(member)

                yield from bounded(rows(), INDEX, 20_000)

    return run


def _id(name: str | None):
    found = re.search(r"urn:page:(-?[0-9]+)", name or "")
    return int(found[1]) if found else None


def _read(payloads: bool):
    """Index rows to pages: seek, inflate one member, parse, check the digest of responses."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            name, stream = None, None
            for batch in batches:
                for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                    if archive != name:
                        if stream is not None:
                            stream.close()
                        system, path = _open(archive)
                        name, stream = archive, system.open_input_file(path)
                    stream.seek(offset)
                    whole = zlib.decompress(stream.read(length), 31)
                    at = whole.index(_HEAD_END)
                    head = headers(whole[:at])
                    block = whole[at + 4 : at + 4 + int(head["content-length"])]
                    cut = block.index(_HEAD_END)
                    payload, kind = block[cut + 4 :], head["warc-type"]
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                    yield _id(head["warc-record-id"]), int(headers(block[:cut])["content-length"]), digest, kind, _id(head.get("warc-refers-to")) if kind == "revisit" else None, head["warc-target-uri"], payload if payloads and kind == "response" else None

        yield from bounded(rows(), PAGE, 500 if payloads else 5_000)

    return run


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Monolithic archives of ``pages`` in ``folder``: rows ``archive, n``.

    The html is shuffled once, by its digest, to meet the one row that names the
    leader of its group; a digest with a third of all rows may be split.
    """
    small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    source = source.withColumns({"sha": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    leaders = stage(source.groupBy("sha").agg(F.max("page_id").alias("leader")), "leaders")
    revisit = F.coalesce(F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")), F.lit(False))
    rows = source.join(leaders, "sha").select("page_id", "url", "n_bytes", F.when(~revisit, F.col("payload")).alias("payload"), "sha", "leader")
    return stage(rows.mapInArrow(_write(folder), "archive string, n long"), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One index row for each record of the archives, rewritten into ``folder``."""
    files = archives.select("archive").repartition(max(1, archives.count()))
    return stage(files.mapInArrow(_normalise(folder), INDEX_DDL), "index")


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The pages that an index names (``payload`` of responses where asked for)."""
    return index.select("archive", "offset", "length").mapInArrow(_read(payloads), PAGE_DDL)


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages``, normalise, and read back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, url``.

    Defined results: a null html is the empty payload; a null url is empty (line
    breaks in urls are dropped); a null page id is never a leader, and a group of
    null ids alone is all responses; rows that repeat the leader's id are
    responses; an empty table gives an empty result; other columns of the input
    are ignored.
    """
    folder = shared_dir(pages.sparkSession)
    archives = write_archives(pages, f"{folder}/monolithic", **columns)
    return read_records(normalise_archives(archives, f"{folder}/members")).drop("payload")


def op4_gzip_normaliser(spark, sf_dir: str) -> DataFrame:
    """``warc_round_trip`` over the whole of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
d AS (SELECT page_id, n, s, array_to_string(list_transform(range(0, 4), lambda i: lpad(bin(('0x' || s[10 * i + 1:10 * i + 10])::BIGINT), 40, '0')), '') AS bits,
      max(page_id) OVER (PARTITION BY s) AS leader FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_sum(list_transform(range(0, 5), lambda k: bits[5 * i + k + 1]::INT * (16 >> k)))::INT + 1]), '') AS payload_digest,
       CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM d
"""
