"""WARC archives: writing with segmentation, and reassembly of what was written.

The writer makes one record a page: a ``response`` whose HTTP body uses chunked
transfer framing, or a ``revisit`` if a page of larger id has the same payload.
A response block over ``segment_bytes`` is cut into a first segment and
``continuation`` records.  Records are written by Spark's own text writer, with
the blank line that ends a record as line separator, so archives land in any
store Spark can write, and a lost executor's tasks are simply written again.

The reader takes whole archive files, parses records by their Content-Length,
and decodes unsegmented ones at once.  Only segments shuffle: by origin
identifier, ordered by segment number, streamed through the chunked decoder and
the digest, and checked against WARC-Segment-Total-Length; no record is ever
held whole.

Defined cases: a null html counts as empty; a null url is left out; a null page
id has an empty header and comes back null; of equal payloads without any page
id all are responses; repeated rows stay rows of their own; records that share
the largest page id are all responses; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch, shuffle_partitions

REVISIT_BYTES = 1000
SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 20_000
#: Decompressed text the parser takes at a time, and compressed bytes it gives the engine.
READ_BYTES, FEED_BYTES = 1 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("5f0c7a1e-6f3b-4a52-9f6e-3f1f6f1d2a77")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _cut(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most ``size`` bytes that end between characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload under chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in _cut(payload, size)]
    return b"".join(parts) + b"0\r\n\r\n"


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _common(kind: str, identity: str, page_id: int | None, url: str | None, row: int) -> list[tuple[str, object]]:
    fields: list[tuple[str, object]] = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~")))
    return [*fields, ("X-Page-ID", "" if page_id is None else page_id), ("X-Row", row)]


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def response_records(page_id: int | None, url: str | None, payload: bytes, row: int, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A response, in segments if its block is large; without the blank line at the end."""
    digest = hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    origin = record_id(page_id, digest)
    parts = list(_cut(block, segment_bytes))
    for n, part in enumerate(parts, 1):
        if n == 1:
            fields = _common("response", origin, page_id, url, row) + [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _base32(digest))]
        else:
            fields = _common("continuation", record_id(page_id, f"{digest}/{n}"), page_id, url, row) + [("WARC-Segment-Origin-ID", origin)]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", n))
            if n == len(parts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield _header([*fields, ("Content-Length", len(part))]) + part


def revisit_record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int, row: int) -> bytes:
    fields = _common("revisit", record_id(page_id, digest), page_id, url, row)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", refers_to), ("WARC-Payload-Digest", _base32(digest)), ("X-Payload-Length", size)]
    return _header([*fields, ("Content-Length", 0)])


def _write_responses(segment_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page_id, url, html, row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "row")), strict=True):
                for record in response_records(page_id, url, (html or "").encode(), row, segment_bytes):
                    out.append(record.decode())
                    held += len(record)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return write


def _write_revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "refers_to", "row")), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([revisit_record(*r).decode() for r in rows], pa.string())], ["value"])


def write_archives(spark: SparkSession, scratch: Scratch, pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write all pages as gzipped WARC files below ``path``."""
    html = F.coalesce("html", F.lit(""))
    hashed = pages.select("page_id", "url", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    hashed = scratch.table(hashed, "hashed")
    large = hashed.where(F.col("payload_bytes") >= REVISIT_BYTES)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    groups = scratch.table(groups.select("payload_digest", "refers_to"), "groups")
    revisits = large.join(groups, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = scratch.table(revisits.withColumn("row", F.monotonically_increasing_id()), "revisits")
    gone = revisits.select(F.col("page_id").alias("gone_id"), F.col("payload_digest").alias("gone_digest"))
    kept = pages.select("page_id", "url", "html").join(gone, F.col("page_id").eqNullSafe(F.col("gone_id")) & (F.sha1(html) == F.col("gone_digest")), "left_anti")
    responses = kept.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_write_responses(segment_bytes), "value string")
    for records, part in ((responses, "responses"), (revisits.mapInArrow(_write_revisits, "value string"), "revisits")):
        records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(f"{path}/{part}")


def _inflated(content: bytes, name: str) -> Iterator[bytes]:
    """The content in parts of at most READ_BYTES; a gzip file may have any number of members."""
    if not name.endswith(".gz"):
        yield content
        return
    view, at, engine = memoryview(content), 0, zlib.decompressobj(31)
    while at < len(view) or engine.unconsumed_tail:
        given = engine.unconsumed_tail
        if not given:
            given = view[at : at + FEED_BYTES]
            at += len(given)
        data = engine.decompress(given, READ_BYTES)
        if engine.eof:  # the next member begins inside what was given
            at -= len(engine.unused_data)
            engine = zlib.decompressobj(31)
        if data:
            yield data


def parse_records(content: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, by Content-Length."""
    source, held, at = _inflated(content, name), b"", 0

    def more() -> bool:
        """Drop what has been read and take the next part."""
        nonlocal held, at
        part = next(source, None)
        if part is not None:
            held, at = held[at:] + part, 0
        return part is not None

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        first, *lines = held[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size, at = int(fields["content-length"]), end + 4
        if len(held) - at < size + 4:
            parts, have = [held[at:]], len(held) - at
            while have < size + 4 and (part := next(source, None)) is not None:
                parts.append(part)
                have += len(part)
            held, at = b"".join(parts), 0
        if len(held) - at < size:
            raise ValueError("the archive ends inside a record's block")
        yield fields, held[at : at + size]
        at += size + 4


class Dechunker:
    """Incremental: HTTP head, then chunked framing; hands payload bytes to a digest."""

    def __init__(self):
        self.digest, self.size, self.length = hashlib.sha1(), 0, 0
        self._held, self._left, self._stage = b"", 0, "head"

    def feed(self, data: bytes) -> None:
        self.length += len(data)
        self._held += data
        while True:
            if self._stage == "data":
                take = self._held[: self._left]
                self.digest.update(take)
                self.size += len(take)
                self._left -= len(take)
                self._held = self._held[len(take) :]
                if self._left or len(self._held) < 2:
                    return
                if self._held[:2] != b"\r\n":
                    raise ValueError("a chunk is longer than its size says")
                self._held, self._stage = self._held[2:], "size"
            mark = b"\r\n\r\n" if self._stage == "head" else b"\r\n"
            end = self._held.find(mark)
            if end < 0 or self._stage == "end":
                return
            line, self._held = self._held[:end], self._held[end + len(mark) :]
            if self._stage == "head":
                self._stage = "size"
            elif self._stage == "size":
                self._left = int(line.split(b";")[0], 16)
                self._stage = "data" if self._left else "trailer"
            elif not line:  # trailer fields end with an empty line
                self._stage = "end"

    @property
    def complete(self) -> bool:
        return self._stage == "end"


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean"
_PARSED = _PAGES + ", origin string, segment long, total long, block binary"


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _bare(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_digest": pa.string(), "record_type": pa.string(), "complete": pa.bool_(), "origin": pa.string(), "block": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names)


_NAMES = [c.split()[0] for c in _PARSED.split(", ")]


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            out, held = [], 0
            for fields, block in parse_records(content.as_py(), path.as_py()):
                page, kind, total = _number(fields.get("x-page-id")), fields["warc-type"], _number(fields.get("warc-segment-total-length"))
                if kind == "revisit":
                    out.append((page, int(fields["x-payload-length"]), _bare(fields["warc-payload-digest"]), kind, int(fields["x-refers-to-page"]), True, None, None, None, None))
                elif "warc-segment-number" in fields:
                    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"]) + fields.get("x-row", "")
                    out.append((page, None, None, None, None, None, origin, int(fields["warc-segment-number"]), total, block))
                    held += len(block)
                elif kind == "response":
                    whole = Dechunker()
                    whole.feed(block)
                    found = whole.digest.hexdigest()
                    out.append((page, whole.size, found, kind, None, whole.complete and found == _bare(fields["warc-payload-digest"]), None, None, None, None))
                if held > 1 << 23 or len(out) >= 5000:
                    yield _batch(out, _NAMES)
                    out, held = [], 0
            yield _batch(out, _NAMES)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of origin and number, to one page each."""
    origin, page, number, total, whole, ordered = None, None, 0, None, None, True
    out: list[tuple] = []

    def close() -> None:
        if whole is not None:
            complete = ordered and whole.complete and total == whole.length
            out.append((page, whole.size, whole.digest.hexdigest(), "response", None, complete))

    for batch in batches:
        for o, n, t, p, block in zip(*(batch.column(c).to_pylist() for c in ("origin", "segment", "total", "page_id", "block")), strict=True):
            if o != origin:
                close()
                origin, page, number, total, whole, ordered = o, p, 0, None, Dechunker(), True
            ordered &= n == number + 1
            number, total = n, total if t is None else t
            whole.feed(block)
        if out:
            yield _batch(out, _NAMES[:6])
            out = []
    close()
    yield _batch(out, _NAMES[:6])


def read_archives(spark: SparkSession, scratch: Scratch, path: str) -> DataFrame:
    """One row per page in the archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    parsed = scratch.table(files.mapInArrow(_parse_files, _PARSED), "parsed")
    names = _NAMES[:6]
    whole = parsed.where("origin is null").select(*names)
    segments = parsed.where("origin is not null").select("origin", "segment", "total", "page_id", "block")
    segments = segments.repartition(shuffle_partitions(spark), "origin").sortWithinPartitions("origin", "segment")
    return whole.unionByName(segments.mapInArrow(_reassemble, _PAGES))


def round_trip(spark: SparkSession, pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the pages as archives and return what reading them back gives."""
    with Scratch(spark, "warc") as scratch:
        path = scratch.path("archives")
        write_archives(spark, scratch, pages, path, segment_bytes)
        return scratch.keep(read_archives(spark, scratch, path))
