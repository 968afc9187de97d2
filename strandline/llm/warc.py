"""WARC records kept as a table of chunks, written and read as streams.

A record is the bytes of WARC/1.1: its header, an HTTP response head and the
payload, or for a revisit the heads alone.  The table holds them cut into chunks:
``archive`` and ``record`` name the record, ``chunk_no`` its place of ``chunks``,
``body`` the bytes and ``digest_so_far`` the SHA-1 of the payload up to there.  The
bodies of an archive, in the order of record and chunk number, are the bytes of a
WARC file.  Neither side ever joins the chunks of a record: the writer cuts
slices of a payload, the reader feeds one chunk after the other to the running
digest and compares it with the one that the chunk carries.  Records of one chunk
are read where they lie; only longer ones are brought together by record.

Of pages with equal payloads, the one with the smallest id is written as a
response, the others as revisits that refer to it, if the payload has at least
``min_bytes`` bytes; smaller ones are all responses.

Defined cases: null html is an empty payload.  Repeated rows are repeated records;
rows that share the smallest id of their payload are all responses.  A row
without an id is a revisit if a row with an id has its payload, else a response.
Control characters in a URL are escaped; a null URL leaves its header out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import in_arrow, slices
from strandline.operators.skew import lookup_join
from strandline.session import materialise

CHUNK_BYTES = 32 * 1024
OUT_BYTES = 8 << 20  # of chunks that leave a task together
DATE = "2020-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
CHUNKS = "archive int, record long, chunk_no int, chunks int, body binary, digest_so_far string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def originals(pages: DataFrame, id_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """(sha, size, original) of the payloads that several rows share."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size"))
    sums = rows.groupBy("sha", "size").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    return materialise(sums.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).drop("n"), "originals")


def heads(page_id: int | None, url: str | None, digest: str, size: int, original: int | None) -> bytes:
    """Everything of a record before its payload."""
    revisit = original is not None and original != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{original}>")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
        names=["archive", "record", "chunk_no", "chunks", "body", "digest_so_far"],
    )


def write_chunks(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK_BYTES, min_bytes: int = 0
) -> DataFrame:
    """The chunk table of one record per page, written to the shared folder."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    shared = originals(pages, id_col, payload, min_bytes)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha"),
        F.octet_length(payload).alias("size"),
    )
    rows = lookup_join(rows, shared, ["sha", "size"], "left").select(
        F.spark_partition_id().alias("archive"), F.monotonically_increasing_id().alias("record"), "page_id", "url", "payload", "original"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in slices(batches):
            for i in range(batch.num_rows):
                archive, record, page_id, url, original = (batch.column(c)[i].as_py() for c in (0, 1, 2, 3, 5))
                view = memoryview(batch.column(4)[i].as_buffer())
                size = len(view)
                digest = base32(hashlib.sha1(view).digest())
                head = heads(page_id, url, digest, size, original)
                if original is not None and original != page_id:
                    view = view[:0]
                running = hashlib.sha1()
                count = max(1, -(-len(view) // chunk))
                for k in range(count):
                    part = view[k * chunk : (k + 1) * chunk]
                    running.update(part)
                    body = b"".join([head if k == 0 else b"", part, b"\r\n\r\n" if k == count - 1 else b""])
                    out.append((archive, record, k, count, body, running.hexdigest()))
                    held += len(body)
                    # beside the payload itself, a task holds some chunks and never a second copy of it
                    if held >= OUT_BYTES:
                        yield _chunk_rows(out)
                        out, held = [], 0
        if out:
            yield _chunk_rows(out)

    return materialise(in_arrow(rows, work, CHUNKS), "warc")


class RecordReader:
    """Takes the chunks of one record in order."""

    def __init__(self, first: bytes):
        end = first.index(b"\r\n\r\n")
        lines = first[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        self.fields = dict(line.split(": ", 1) for line in lines[1:])
        start = first.index(b"\r\n\r\n", end + 4) + 4
        http = first[end + 4 : start].decode().split("\r\n")
        self.stated = int(dict(line.split(": ", 1) for line in http[1:] if line)["Content-Length"])
        self.left = int(self.fields["Content-Length"]) - (start - end - 4)
        self.size, self.start, self.digest = 0, start, hashlib.sha1()

    def take(self, body: bytes, digest_so_far: str) -> None:
        part = memoryview(body)[self.start : self.start + self.left]
        self.start = 0
        self.left -= len(part)
        self.size += len(part)
        self.digest.update(part)
        if self.digest.hexdigest() != digest_so_far:
            raise ValueError(f"damaged record {self.fields['WARC-Record-ID']}")

    def row(self) -> tuple:
        if self.left:
            raise ValueError(f"record {self.fields['WARC-Record-ID']} ends early")
        page = self.fields["WARC-Record-ID"][10:-1]
        kind = self.fields["WARC-Type"]
        digest = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "revisit":
            return int(page) if page else None, self.stated, digest, kind, int(self.fields["WARC-Refers-To"][10:-1])
        if base32(self.digest.digest()) != digest or self.size != self.stated:
            raise ValueError(f"record {self.fields['WARC-Record-ID']} differs from its header")
        return int(page) if page else None, self.size, digest, kind, None


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record, from the bytes and running digests of the chunk table.

    A revisit has no payload; its length and digest are those its heads state.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, expected, kinds = None, 0, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in slices(batches):
            done = []
            for chunk_no, count, body, so_far in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if chunk_no == 0:
                    reader, expected = RecordReader(body), 0
                if reader is None or chunk_no != expected:
                    raise ValueError("a chunk is missing")
                reader.take(body, so_far)
                expected += 1
                if expected == count:
                    done.append(reader.row())
                    reader = None
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*done), kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )
        if reader is not None:
            raise ValueError("the last record ends early")

    parts = ["chunk_no", "chunks", "body", "digest_so_far"]
    single = chunks.where("chunks = 1").select(*parts)
    long = chunks.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk_no").select(*parts)
    return in_arrow(single, work, RECORDS).unionByName(in_arrow(long, work, RECORDS))


def pages_sql() -> str:
    """The expected rows over ``pages``, for DuckDB."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = " || ".join(
        f"list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('{alphabet}', (((('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT >> s) & 31) + 1)::BIGINT, 1)), lambda a, b: a || b)"
        for i in range(8)
    )
    return f"""WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS sha, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS original FROM p)
SELECT page_id, payload_bytes, {five} AS payload_digest,
  CASE WHEN original IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to FROM o"""
