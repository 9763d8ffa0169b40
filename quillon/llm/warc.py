"""WARC archives as a table of chunks.

An archive is a table with a row for each chunk of a record: the record's identifier in the
table, the chunk's number, whether it is the last, and bytes.  The bytes of a record's chunks, in order, are
the record as a WARC file would hold it, and all records one after another are a WARC
file.  Most records are one chunk, which is parsed where it is read; the chunks of larger
ones are brought together by identifier and read as a stream, with a running digest and at
most one chunk in memory.

Pages with the same payload of a certain size are stored once: the one with the largest id
is a response, the others revisits that refer to it.

* a null payload counts as empty; null ids and URLs are stored as such
* rows with the same id stay rows of their own; if theirs is the largest of equal payloads,
  they are all responses
* a record's own identifier is made of the page's id and the payload's digest, so revisits
  name their response; repeated rows make equal records
* URLs come back as they were; pages have no date, so that of all records is the epoch
* an empty table gives an empty archive; columns that aren't named are not stored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

CHUNK = 1 << 18
#: Rows of Arrow data that are held at a time.
ROWS = 32
#: Repeated digests, of less than a hundred bytes each, are sent to all executors up to this number.
BROADCAST = 500_000
_CHUNKS = "record_id string, chunk int, last boolean, data binary"
_RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def revisits(pages: DataFrame, least: int = 1000, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, size and refers_to, which is null for responses.

    Which pages revisit is decided on ids, digests and sizes alone.  Payloads stay where they
    are read unless more than ``BROADCAST`` digests repeat.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(payload).cast("long"))
    large = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    large = materialise(large.filter("n > 1").select("digest", "first"), "revisited")
    if large.count() <= BROADCAST:
        large = F.broadcast(large)
    rows = rows.join(large, "digest", "left")
    return rows.select("page_id", "url", "html", "digest", "size", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def _name(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def _record(page_id: int | None, url: str | None, digest: str, refers_to: int | None, size: int) -> bytes:
    """Head of a record up to its payload of ``size`` bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_name(page_id, digest)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        uri = quote(url, safe=_SAFE + "%")
        lines.append(f"WARC-Target-URI: {uri}")
        if uri != url:
            lines.append(f"WARC-Page-URL: {quote(url, safe=_SAFE)}")  # as it was, percent-encoded once more
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_name(refers_to, digest)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        http = b""
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + size * (refers_to is None)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


_SAFE = "".join(map(chr, range(33, 127))).replace("%", "")


def _pieces(head: bytes, html: str, digest: str, chunk: int) -> Iterator[tuple[bool, bytes]]:
    """A record's bytes in chunks; the payload is encoded slice by slice, with a running digest."""
    held, running = bytearray(head), hashlib.sha1()
    for at in range(0, len(html), chunk):
        part = html[at : at + chunk].encode()
        running.update(part)
        held += part
        while len(held) > chunk:
            yield False, bytes(held[:chunk])
            del held[:chunk]
    if html and running.hexdigest() != digest:
        raise ValueError("the payload isn't the one that was digested")
    yield True, bytes(held) + b"\r\n\r\n"


def write(rows: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Writes the rows of ``revisits`` as a chunk table (Parquet) at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        out: list[tuple[str, int, bool, bytes]] = []
        held = 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, size, refers_to = (c[row].as_py() for c in batch.columns)
                record_id, n = f"{task}-{n}", n + 1
                head = _record(page_id, url, digest, refers_to, size)
                for k, (last, data) in enumerate(_pieces(head, html or "" if refers_to is None else "", digest, chunk)):
                    out.append((record_id, k, last, data))
                    held += len(data)
                    if held >= 8 * chunk or len(out) >= ROWS:
                        yield _chunks(out)
                        out, held = [], 0
        if out:
            yield _chunks(out)

    rows.select("page_id", "url", "html", "digest", "size", "refers_to").mapInArrow(run, _CHUNKS).write.parquet(path)


def _chunks(rows: list[tuple[str, int, bool, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "chunk", "last", "data"])


class Reader:
    """Reads one record from its chunks, keeping no more than a head or a chunk's rest."""

    def __init__(self) -> None:
        self.head, self.fields, self.inner = b"", None, b""
        self.left, self.in_http = 0, False
        self.digest, self.size = hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            first, *lines = self.head[:end].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            self.fields = dict(line.split(": ", 1) for line in lines)
            self.left = int(self.fields["Content-Length"])
            self.in_http = self.fields["WARC-Type"] == "response"
            data, self.head = self.head[end + 4 :], b""
        data = data[: self.left]
        self.left -= len(data)
        if self.in_http:
            self.inner += data
            end = self.inner.find(b"\r\n\r\n")
            if end < 0:
                return
            data, self.inner, self.in_http = self.inner[end + 4 :], b"", False
        self.digest.update(data)
        self.size += len(data)

    def row(self) -> tuple:
        if self.fields is None or self.left or self.in_http:
            raise ValueError("the record is cut off")
        f, digest = self.fields, self.digest.hexdigest()
        stored = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and stored != digest:
            raise ValueError(f"payload of {f['WARC-Record-ID']} is damaged")
        to = f.get("WARC-Refers-To")
        page = f.get("WARC-Page-ID")
        url = unquote(f["WARC-Page-URL"]) if "WARC-Page-URL" in f else f.get("WARC-Target-URI")
        return int(page) if page else None, url, f["WARC-Type"], int(to.strip("<>").split(":")[2]) if to else None, self.size, stored


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, out = Reader(), []
    for batch in batches:
        last = batch.column("last")
        for row, data in enumerate(batch.column("data")):
            reader.feed(data.as_py())
            if last[row].as_py():
                out.append(reader.row())
                reader = Reader()
        if out:
            yield _records(out)
            out = []


def read(archive: DataFrame) -> DataFrame:
    """Per record of a chunk table page_id, url, record_type, refers_to, payload_bytes and
    payload_digest, the last two from the payload as read; a revisit's are those of the
    response it refers to."""
    single = (F.col("chunk") == 0) & F.col("last")
    whole = archive.filter(single).select("last", "data").mapInArrow(_stream, _RECORDS)
    parts = archive.filter(~single).repartition("record_id").sortWithinPartitions("record_id", "chunk")
    found = whole.union(parts.select("last", "data").mapInArrow(_stream, _RECORDS))
    return found


def resolve(records: DataFrame) -> DataFrame:
    """Gives revisits the payload size of their response, and checks that there is one."""
    sizes = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("__size"))
    responses, others = (records.filter(f"record_type {sign} 'response'") for sign in ("=", "!="))
    others = others.drop("payload_bytes").join(sizes, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("__size", F.raise_error(F.lit("a revisit refers to no response")).cast("bigint")))
    return responses.unionByName(others.select(*responses.columns))
