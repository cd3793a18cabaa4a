"""WARC archives: written with segmented records and chunked payloads, and read back by reassembly.

Writing.  A page is an HTTP response with chunked transfer framing in a ``response`` record; a page whose payload has been kept
elsewhere is a ``revisit`` record that names it.  A block larger than SEGMENT bytes is cut: the first record has
WARC-Segment-Number 1, the others are ``continuation`` records with the first one's id, their number and, on the last, the
total length.  Spark's text writer puts the records into compressed archives where they are made, its line separator being the
end of a record; as records are bounded and counted, so is an archive, however long a page is.

Reading.  Archives are parsed one by one; segments are grouped by their origin's id, put in order, checked for gaps and against
the total length, and joined; the chunked framing is taken off.  A revisit's payload is that of the record it refers to.

Cases: a null html is an empty payload; repeated pages are a record each, told apart by a number in their ids; ties between equal payloads go
to the largest page id, then to the first copy; html may hold line ends, framing or header text of any kind, as blocks are
read by length; an empty table gives empty archives and no row.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import scratch, written

VERSION = b"WARC/1.1"
#: Payloads of fewer bytes are always kept.
REVISIT_BYTES = 1000
SEGMENT = 64 << 10
CHUNK = 16 << 10
#: Records of an archive at most; none is larger than SEGMENT and its fields.
ARCHIVE_RECORDS = 512
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after its block."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block


def segments(fields: list[tuple[str, object]], uid: str, block: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """The records of a block: one, or a first and continuations."""
    parts = [block[k : k + size] for k in range(0, len(block), size)] or [b""]
    if len(parts) == 1:
        yield record(fields, block)
        return
    yield record([*fields, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uid}/{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{uid}>"), ("WARC-Segment-Number", k)]
        yield record(own + [("WARC-Segment-Total-Length", len(block))] * (k == len(parts)), part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION[:5], at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = end + 4
        at = begin + int(fields["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, data[begin:at]
        at += 4


def _uid(page: object, digest: str, copy: int) -> str:
    return f"urn:page:{'' if page is None else page}:{digest}:{copy}"


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for each of ``pages`` (page_id, copy_no, url, html, digest, refers_id or null) under ``path``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page in enumerate(batch.select(["page_id", "copy_no", "digest", "refers_id"]).to_pylist()):
                payload = (batch.column("html")[k].as_py() or "").encode()
                uid, again = _uid(page["page_id"], page["digest"], page["copy_no"]), page["refers_id"] is not None
                url = " ".join((batch.column("url")[k].as_py() or "").split())
                fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<{uid}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{page['digest']}"), ("Content-Type", "application/http; msgtype=response")]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if again:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_uid(page['refers_id'], page['digest'], 0)}>")]
                    block = head + b"\r\n"
                else:
                    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
                made = list(segments(fields, uid, block))
                yield pa.record_batch([pa.array(made, pa.binary())], names=["record"])

    records = pages.mapInArrow(make, "record binary")
    # The text writer puts a value's bytes as they are; the separator ends the record.
    rows = records.select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", ARCHIVE_RECORDS).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """uid, type, refers_to, digest, number, total and block of every record (segments apart) under ``path``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for f, block in parse(gzip.decompress(data.as_buffer())):
                    origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                    rows.append((origin[1:-1], f["warc-type"], f.get("warc-refers-to", "")[1:-1] or None, (f.get("warc-payload-digest") or "").removeprefix("sha1:").lower() or None,
                                 int(f.get("warc-segment-number", 0)), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block))
                    if len(rows) == 256:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uid", "type", "refers_to", "digest", "number", "total", "block"])

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return archives.mapInArrow(make, "uid string, type string, refers_to string, digest string, number int, total long, block binary")


def _checked(rows: pd.DataFrame) -> bytes:
    rows = rows.sort_values("number")
    block = b"".join(rows["block"])
    if rows["number"].tolist() != list(range(1, len(rows) + 1)) or rows["total"].iloc[-1] != len(block):
        raise ValueError(f"segments of {rows['uid'].iloc[0]} are missing or too many")
    return block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """uid, type, refers_to, digest and payload of every page under ``path``; a revisit's own payload is null.

    Records in one piece are not shuffled; segments are, by their origin.
    """
    records = read_records(spark, path)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows[rows["type"] != "continuation"].iloc[0]
        return pd.DataFrame({"uid": [first["uid"]], "type": [first["type"]], "refers_to": [first["refers_to"]], "digest": [first["digest"]], "block": [_checked(rows)]})

    schema = "uid string, type string, refers_to string, digest string, block binary"
    cut = records.where("number > 0").groupBy("uid").applyInPandas(joined, schema)
    whole = records.where("number = 0").select("uid", "type", "refers_to", "digest", "block").unionByName(cut)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, block in zip(batch.column("type").to_pylist(), batch.column("block").to_pylist(), strict=True):
                head, _, body = block.partition(b"\r\n\r\n")
                framed = b"transfer-encoding: chunked" in head.lower()
                out.append(None if kind == "revisit" else unchunked(body) if framed else body)
            yield pa.record_batch([*(batch.column(n) for n in ("uid", "type", "refers_to", "digest")), pa.array(out, pa.binary())], names=["uid", "type", "refers_to", "digest", "payload"])

    return whole.mapInArrow(decode, "uid string, type string, refers_to string, digest string, payload binary")


def with_verdicts(pages: DataFrame) -> DataFrame:
    """page_id, copy_no, url, html, digest and, for what is to be a revisit, refers_id of every page."""
    text = F.coalesce("html", F.lit("")).cast("binary")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("-")).alias("key")
    # Only digests and ids are compared across pages; html is dealt once, by page.
    counted = written(pages.select("page_id", key, F.sha1(text).alias("digest"), F.octet_length(text).alias("bytes")).groupBy("page_id", "key", "digest", "bytes").agg(F.count("*").alias("c")), "digests")
    keepers = counted.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.sum("c").alias("c")).where("c > 1")
    told = written(counted.select("key", "digest").join(written(keepers, "keepers").select("digest", "keeper"), "digest"), "told")
    own = Window.partitionBy("key", "digest").orderBy("url")
    html = pages.select("page_id", "url", "html", key, F.sha1(text).alias("digest"))
    numbered = html.withColumn("copy_no", F.row_number().over(own) - 1)
    again = ~F.col("page_id").eqNullSafe(F.col("keeper")) | (F.col("copy_no") > 0)
    return numbered.join(told, ["key", "digest"], "left").select("page_id", "copy_no", "url", "html", "digest", F.when(again, F.col("keeper")).alias("refers_id"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives, equal payloads once, and returns what is read back of each page."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(with_verdicts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")), path)
    return read_archives(pages.sparkSession, path)


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back."""
    read = archive_and_read(pages)
    facts = written(read.select("uid", "type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")), "facts")
    page = lambda c: F.nullif(F.get(F.split(c, ":"), F.lit(2)), F.lit("")).cast("long")
    kept = facts.where("type = 'response'").select(F.col("uid").alias("kept"), F.col("bytes").alias("kept_bytes"), F.col("sha1").alias("kept_sha1"))
    again = facts.where("type = 'revisit'").join(kept, F.col("refers_to") == F.col("kept"), "left")
    again = again.select("uid", "type", "refers_to", "digest", F.col("kept_bytes").alias("bytes"), F.col("kept_sha1").alias("sha1"))
    sound = F.when(F.col("sha1") == F.col("digest"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("uid"))).cast("string"))
    out = facts.where("type = 'response'").select(*again.columns).unionByName(again)
    return out.select(page("uid").alias("page_id"), F.col("bytes").alias("payload_bytes"), sound.alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


# The same in SQL, over a table pages whose ids are distinct.
ORACLE = f"""
with sized as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
told as (select *, case when n >= {REVISIT_BYTES} then max(page_id) over (partition by html) else page_id end as keeper from sized)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest, case when keeper = page_id then 'response' else 'revisit' end as record_type,
  case when keeper <> page_id then keeper end as refers_to from told
"""
