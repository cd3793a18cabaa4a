import hashlib

import pytest
from pyspark.sql import types as T

from quillspark.llm import queries, warc

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("digest", T.StringType()), ("key", T.StringType()))])


def brute(rows):
    out = []
    for p, _, h in rows:
        payload = (h or "").encode()
        same = [q for q, _, x in rows if (x or "").encode() == payload and q is not None]
        keep = max(same) if len(payload) >= 1000 and same else p
        out.append((p, len(payload), hashlib.sha1(payload).hexdigest(), "response" if keep == p else "revisit", None if keep == p else keep))
    return sorted(out, key=str)


def test_chunked_framing():
    for n in (0, 1, 15, 16, 17, 1000):
        data = bytes(range(256)) * 4
        assert warc.unchunked(warc.chunked(data[:n], 16)) == data[:n]
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_records_and_segments():
    block = b"WARC/1.1\r\n\r\n\r\n\r\n" * 9
    made = list(warc.segments([("WARC-Type", "response"), ("WARC-Record-ID", "<u>")], "u", block, 20))
    read = list(warc.parse(b"".join(m + b"\r\n\r\n" for m in made)))
    assert b"".join(b for _, b in read) == block and len(read) == 8
    assert [f["warc-segment-number"] for f, _ in read] == [str(k) for k in range(1, 9)]
    assert read[-1][0]["warc-segment-total-length"] == str(len(block)) and read[3][0]["warc-segment-origin-id"] == "<u>"
    with pytest.raises(ValueError):
        list(warc.parse(made[0][:-1] + b"\r\n\r\n"))


def test_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op5_warc(spark, "/root/testdata/sf0.01").collect()), key=str) == brute(rows)


def test_odd_pages(spark, monkeypatch):
    long_ = "é中\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9000
    rows = [(1, "u", None), (2, None, ""), (3, "a b\r\nX: y", "x" * 999), (4, "u", "x" * 999), (5, "u", "é" * 500), (6, "u", "é" * 500), (7, "u", long_), (9, "u", long_), (8, "u", long_ + "z"), (None, "u", "short"), (10, "u", "\x00\r\n0\r\n\r\n" * 200)]
    docs = spark.createDataFrame([(*r, "d", "k") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in warc.report(docs).collect()), key=str) == brute(rows)
    twice = spark.createDataFrame([(1, "u", "y" * 2000, "d", "k")] * 3 + [(1, "u", "z", "d", "k")], SCHEMA)
    assert sorted((r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(twice).collect()) == [(1, "response", None), (2000, "response", None), (2000, "revisit", 1), (2000, "revisit", 1)]
    assert warc.report(spark.createDataFrame([], SCHEMA)).count() == 0
    payloads = {r.uid.split(":")[2]: r.payload for r in warc.archive_and_read(docs).collect() if r.type == "response"}
    assert payloads["9"].decode() == long_ and payloads["10"] == (b"\x00\r\n0\r\n\r\n" * 200)
