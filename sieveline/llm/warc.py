"""WARC archives as a table of chunks: records of any size are written and read as bounded pieces."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_worker

CHUNK = 1 << 20
MARK = b"\r\nWARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(payload: bytes, chunk: int) -> Iterator[bytes]:
    """Pieces of at most ``chunk`` bytes that start at a code point and never hold the mark between records.

    A piece's block follows a header, so a mark that starts in one piece and ends in the next is no mark: the
    cut falls inside it.
    """
    at, n = 0, len(payload)
    while True:
        end = min(n, at + chunk)
        while at < end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        if end == at < n:
            end = min(n, at + chunk)
        # a mark may also begin with the blank line's end or the header's, so its first two bytes are optional
        found = payload.find(MARK[2:], at, end)
        if found >= 0:
            end = found + 4
        yield payload[at:end]
        at = end
        if at >= n:
            return


def chunk_rows(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """record, chunk_no, data, page_id, url, payload_bytes, payload_sha1: payloads as rows of at most ``chunk`` bytes.

    record numbers the rows of ``pages``; a record's chunks stand together in order.  No Python worker sees a payload.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    n = F.octet_length("html").cast("long")
    p = p.select(F.monotonically_increasing_id().alias("record"), "page_id", "url", n.alias("payload_bytes"), F.sha1("html").alias("payload_sha1"), "html")
    last = F.greatest(F.ceil(F.col("payload_bytes") / chunk) - 1, F.lit(0)).cast("int")
    p = p.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.substring("html", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data")
    return p.select("record", "chunk_no", data, "page_id", "url", "payload_bytes", "payload_sha1")


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_sha1 (hex) of every row."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_sha1"),
    )


def with_types(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds refers_to and revisit to rows with payload_bytes, payload_sha1 and page_id.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest page_id (then url) is the
    response.  Groups are counted before they are shuffled, so a payload that a third of the rows share costs
    one row a task; the join back meets one row a payload and its hot side can be split.
    """
    owner = rows.groupBy("payload_sha1", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("o"))
    a, b = rows.alias("a"), owner.alias("b")
    both = a.join(b, ["payload_sha1", "payload_bytes"])
    own = F.col("a.page_id").eqNullSafe(F.col("b.o.page_id")) & F.col("a.url").eqNullSafe(F.col("b.o.url"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~own
    return both.select("a.*", revisit.alias("revisit"), F.when(revisit, F.col("b.o.page_id")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, chunk: int = CHUNK) -> None:
    """Write a WARC record for each row of ``pages`` as gzipped archives in ``path``.

    The chunked record table (``chunk_rows``) is made first, so that nothing from there on, shuffles included, holds
    more than a chunk; chunks meet their record's type and are put in order again.  A record is one or more WARC
    records: the first chunk is the response, later ones its continuations, each with the digest of its own block and
    the running digest of the payload up to it.  Revisits hold a header only.  Rows go out through Spark's text writer
    (any file system), records being parted by the blank lines that the format asks for.

    Null html: an empty payload.  Null url: an empty address.  Null page_id: a record whose id says null.
    Repeated rows of the response are written as responses too.  Empty table: no record.
    """
    k = with_types(payloads(pages), min_bytes).distinct().alias("k")
    c = chunk_rows(pages, chunk).alias("c")
    on = F.col("c.page_id").eqNullSafe(F.col("k.page_id")) & F.col("c.url").eqNullSafe(F.col("k.url")) & (F.col("c.payload_sha1") == F.col("k.payload_sha1"))
    rows = c.join(k, on).where("not revisit or chunk_no = 0").select(
        "record", "chunk_no", F.when(~F.col("revisit"), F.col("data")).alias("data"), F.col("c.page_id").cast("long").alias("page_id"), "c.url",
        "c.payload_bytes", "c.payload_sha1", "revisit", "refers_to",
    ).sortWithinPartitions("record", "chunk_no")

    def run(batches):
        writer = RecordWriter(chunk)
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for i in range(batch.num_rows):
                for rec in writer.chunk(*(batch.column(c)[i].as_py() for c in range(9))):
                    out.append(rec)
                    size += len(rec)
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        if not writer.done:
            raise ValueError("the last chunk of a record is missing")

    lines = rows.mapInArrow(in_worker(run, "warc"), "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _name(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


class RecordWriter:
    """Turns a record's chunks, in order, into WARC records without the blank lines after them."""

    def __init__(self, most: int):
        self.most = most
        self.done = True

    def chunk(self, record, chunk_no, data, page, url, n: int, sha: str, revisit: bool, refers) -> Iterator[bytes]:
        if chunk_no == 0:
            if not self.done:
                raise ValueError("the last chunk of a record is missing")
            self.record, self.next, self.number, self.seen, self.tail, self.running = record, 0, 0, 0, b"", hashlib.sha1()
            self.done = False
        if (record, chunk_no) != (self.record, self.next):
            raise ValueError(f"chunk {chunk_no} of a record is out of place")
        self.next += 1
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
        common, digest = [f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"], b32(bytes.fromhex(sha))
        if revisit:
            fields = ["WARC-Type: revisit", f"WARC-Record-ID: {_name(page)}", *common, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      f"WARC-Refers-To: {_name(refers)}", f"WARC-Payload-Digest: sha1:{digest}"]
            self.done = True
            yield _record(fields, head)
            return
        data = self.tail + data
        whole = self.seen + len(data) == n
        # what begins a code point at the end waits for the next chunk
        end = len(data)
        if not whole:
            start = next((i for i in range(end - 1, max(-1, end - 5), -1) if data[i] & 0xC0 != 0x80), end)
            if start < end and data[start] >= 0xC0 and end - start < 2 + (data[start] >= 0xE0) + (data[start] >= 0xF0):
                end = start
        data, self.tail = data[:end], data[end:]
        for piece in cuts(data, self.most) if data or n == 0 else ():
            self.number += 1
            self.seen += len(piece)
            self.running.update(piece)
            last = self.seen == n
            if self.number == 1:
                fields = ["WARC-Type: response", f"WARC-Record-ID: {_name(page)}", *common, f"WARC-Payload-Digest: sha1:{digest}"]
            else:
                fields = ["WARC-Type: continuation", f"WARC-Record-ID: {_name(page)[:-1]}:{self.number}>", *common, f"WARC-Segment-Origin-ID: {_name(page)}"]
            if self.number > 1 or not last:
                fields.append(f"WARC-Segment-Number: {self.number}")
            if self.number > 1 and last:
                fields.append(f"WARC-Segment-Total-Length: {len(head) + n}")
            fields.append(f"X-Running-Payload-Digest: sha1:{b32(self.running.digest())}")
            yield _record(fields, head + piece if self.number == 1 else piece)
        self.done = self.seen == n
        if self.done and b32(self.running.digest()) != digest:
            raise ValueError(f"the payload of {_name(page)} differs from its digest")


def _record(fields: list[str], block: bytes) -> bytes:
    fields = [*fields, "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, chunks of every record in ``path``.

    Files are read as a stream of pieces between marks; the payload's digest is carried from chunk to chunk and
    held against the running one after every chunk, so a damaged, missing or misplaced chunk raises an error.
    """

    def run(batches):
        open_ = None  # [row, hash, bytes, expected bytes, chunks]
        for batch in batches:
            out = []
            for value in batch.column(0):
                raw = value.as_py().removeprefix(MARK[2:])
                head, found, block = raw.partition(b"\r\n\r\n")
                if not found:
                    if raw.strip():
                        raise ValueError("a piece between marks has no header")
                    continue
                f = dict(line.split(b": ", 1) for line in head.split(b"\r\n") if b": " in line)
                f = {k.decode().lower(): v.decode() for k, v in f.items()}
                size = int(f["content-length"])
                block = block[:size]
                if len(block) != size or f"sha1:{b32(hashlib.sha1(block).digest())}" != f["warc-block-digest"]:
                    raise ValueError(f"damaged block of {f['warc-record-id']}")
                if f["warc-type"] != "continuation":
                    if open_:
                        raise ValueError(f"a chunk is missing after {open_[0]}")
                    page = f["warc-record-id"][10:-1]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    row = [None if page == "null" else int(page), f["warc-target-uri"], n, f["warc-payload-digest"][5:], f["warc-type"]]
                    if f["warc-type"] == "revisit":
                        to = f["warc-refers-to"][10:-1]
                        out.append([*row, None if to == "null" else int(to), 0])
                        continue
                    open_ = [row, hashlib.sha1(), 0, n, 0]
                else:
                    payload = block
                    if not open_ or int(f["warc-segment-number"]) != open_[4] + 1:
                        raise ValueError(f"chunk {f['warc-record-id']} is out of place")
                open_[1].update(payload)
                open_[2] += len(payload)
                open_[4] += 1
                now = b32(open_[1].copy().digest())
                if f["x-running-payload-digest"] != f"sha1:{now}":
                    raise ValueError(f"the payload differs at {f['warc-record-id']}")
                if open_[2] >= open_[3]:
                    row = open_[0]
                    if now != row[3]:
                        raise ValueError(f"the payload of {f['warc-record-id']} differs")
                    out.append([*row, None, open_[4]])
                    open_ = None
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()))],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunks"],
                )
        if open_:
            raise ValueError(f"the end of {open_[0]} is missing")

    pieces = spark.read.option("lineSep", MARK.decode()).text(path)
    return pieces.select(F.col("value").cast("binary").alias("value")).mapInArrow(in_worker(run, "warc"), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, chunks int")
