import gzip
import io
import json
import zlib
from pathlib import Path

import pytest

from subjectloom.llm import warc_archive as W
from subjectloom.llm.common import shared_dir
from subjectloom.llm.queries import ORACLES, QUERIES

from ..compare import connect, same_rows


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_members_and_index(spark):
    """Each index row is one gzip member; the sidecar file says the same as the table."""
    folder = shared_dir(spark)
    index = W.normalise_archives(W.write_archives(pages(spark, [(i, f"http://x/{i}", f"<p>{i % 3}é</p>") for i in range(9)]), f"{folder}/a"), f"{folder}/b").collect()
    assert sum(r["warc_type"] == "response" for r in index) == 3
    for r in index:
        path = Path(r["archive"].removeprefix("file:").replace("//", "/", 1))
        data = path.read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert zlib.decompress(data, 31).startswith(b"WARC/1.1\r\n")
        sidecar = [json.loads(x) for x in Path(f"{path}.idx").read_text().splitlines()]
        assert [r["offset"], r["length"]] in [x[:2] for x in sidecar]
    for p in {r["archive"] for r in index}:
        whole = gzip.decompress(Path(p.removeprefix("file:").replace("//", "/", 1)).read_bytes())
        assert len(list(W.records([whole]))) == sum(r["archive"] == p for r in index)


def test_payloads_come_back(spark):
    folder = shared_dir(spark)
    html = "<html>" + "é\r\n\r\nWARC/1.1 " * 40_000
    index = W.normalise_archives(W.write_archives(pages(spark, [(1, "u", html), (2, "v", "")]), f"{folder}/a"), f"{folder}/b")
    back = {r["page_id"]: r["payload"] for r in W.read_records(index, payloads=True).collect()}
    assert bytes(back[1]).decode() == html and bytes(back[2]) == b""


def test_streams_in_pieces_and_truncation():
    rec = W.record(5, "u", 3, b"abc", "00" * 20, None) + W.record(6, "u", 3, None, "00" * 20, 5)
    for size in (1, 7, 1000):
        heads = [h["warc-type"] for h, _ in W.records(rec[i : i + size] for i in range(0, len(rec), size))]
        assert heads == ["response", "revisit"]
    with pytest.raises(ValueError):
        list(W.records([rec[:-20]]))
    for whole in (gzip.compress(rec[: rec.index(b"WARC/1.1", 8)]) + gzip.compress(rec[rec.index(b"WARC/1.1", 8) :])[:-9], gzip.compress(rec)[:-8]):
        with pytest.raises(ValueError):
            list(W.records(W.inflated(io.BytesIO(whole))))
    data = gzip.compress(rec[:100]) + gzip.compress(rec[100:])
    assert b"".join(W.inflated(io.BytesIO(data))) == rec


def test_edges(spark):
    rows = [(1, "u", "x"), (3, "u", "x"), (3, "u", "x"), (None, "u", "x"), (None, None, "y"), (4, "a\r\nb", None), (5, "u", "")]
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in W.warc_round_trip(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "revisit", 3, 1), (3, "response", None, 1), (3, "response", None, 1), (None, "revisit", 3, 1), (None, "response", None, 1), (4, "revisit", 5, 0), (5, "response", None, 0)], key=str)
    assert W.warc_round_trip(pages(spark, rows).where("false")).count() == 0


def test_every_attempt_has_names_of_its_own(spark):
    """Two runs into one folder, as a repeated task writes, disturb nothing; clashing columns are ignored."""
    folder = shared_dir(spark)
    df = pages(spark, [(i, "u", f"x{i % 4}") for i in range(8)]).selectExpr("*", "1 as sha", "2 as leader", "3 as payload", "4 as n_bytes", "5 as archive")
    one = W.normalise_archives(W.write_archives(df, f"{folder}/a"), f"{folder}/b")
    two = W.normalise_archives(W.write_archives(df, f"{folder}/a"), f"{folder}/b")
    assert not {r["archive"] for r in one.collect()} & {r["archive"] for r in two.collect()}
    assert sorted(map(tuple, W.read_records(one).collect()), key=str) == sorted(map(tuple, W.read_records(two).collect()), key=str)


def test_query(spark, sf):
    same_rows(QUERIES["op4_gzip_normaliser"](spark, sf), connect(sf), ORACLES["op4_gzip_normaliser"])
