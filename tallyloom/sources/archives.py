"""Archives of archives as a data source that tasks read in parallel.

An archive is a ZIP of shops' ZIPs, or a TAR (plain or with Zstandard) of their
files or ZIPs.  What is in it, and where, is read first, by jumps: a ZIP's
directory, a TAR's headers, and the headers of Zstandard's frames and blocks.
Then every inner ZIP is a partition of its own, and a product file that lies in
a TAR is cut into pieces of SPLIT bytes: a piece's first record is the first
that begins in it, and its last one is read to its end.  Where a Zstandard
stream is a single frame, or its frames don't tell their sizes, it can't be
entered in the middle, and one task reads it.

``part`` is ``records`` (the small files of chains and branches, and the names
of all members) or ``products``.  Products take filters on ``member`` and
``shop`` (the branch's three ids, joined by bars): other members aren't opened,
and of the rest only wanted lines are parsed.  Between the two, every byte of a
product file is inflated once, and frames that nobody asks for are inflated to
check them, so that a damaged archive fails wherever the damage is.

A task opens archives as files, so they must lie in a mounted folder; of other
stores Spark hands each archive to a task (at most 2 GB).
"""

from __future__ import annotations

import io
import json
import re
import tarfile
import tempfile
import zipfile
from collections.abc import Collection, Iterator, Sequence
from itertools import islice
from typing import IO, NamedTuple
from urllib.parse import urlparse
from urllib.request import url2pathname

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tallyloom.session import ship_code
from tallyloom.sources import feed
from tallyloom.sources.feed import IDENTITY, MEMBERS

SOURCE = "shop_archives"
#: Bytes of a product file in one task, of an inner archive kept in memory.
SPLIT, SPOOL = 64 * 1024 * 1024, 8 * 1024 * 1024
#: What ``scan`` calls the rows that hold a member's path.
NAME = "name"
#: Branches whose keys are sent to the tasks; more are left to the join.
MAX_KEYS = 100_000
RECORDS = "archive string, member string, kind string, line string, names array<string>, fields array<string>"


class Frame(NamedTuple):
    """A Zstandard frame: where it lies in the file, and in what it inflates to."""

    at: int
    stop: int
    start: int
    end: int


class Member(NamedTuple):
    """A file of interest in an archive: the shop it belongs to, its kind, and where its bytes are."""

    group: str
    kind: str
    at: int
    size: int


class Layout(NamedTuple):
    """What an archive holds; ``entered`` says whether its members can be read one by one."""

    names: list[str]
    members: list[Member]
    frames: list[Frame] | None
    entered: bool


INNER = "zip"


def is_tar(path: str) -> bool:
    return re.search(r"\.tar(\.zst)?$", path) is not None


def local_path(uri: str) -> str:
    return url2pathname(urlparse(uri).path)


# Zstandard frames.


def frames(file: IO[bytes]) -> list[Frame] | None:
    """The frames of a Zstandard file from their headers; None if one doesn't tell its size.

    A frame's end is found by walking its blocks' headers of three bytes.
    """
    import zstandard

    found, at, start, whole = [], 0, 0, file.seek(0, 2)
    while True:
        if at > whole:
            raise ValueError("a Zstandard frame ends early")
        file.seek(at)
        head = file.read(18)
        if not head:
            return found
        magic = int.from_bytes(head[:4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # a skippable frame
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        told = zstandard.get_frame_parameters(head)
        if told.content_size >= 1 << 63:  # unknown
            return None
        end = at + zstandard.frame_header_size(head)
        last = False
        while not last:
            file.seek(end)
            block = file.read(3)
            if len(block) < 3:
                raise ValueError("a Zstandard frame ends early")
            number = int.from_bytes(block, "little")
            last, kind, size = bool(number & 1), number >> 1 & 3, number >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * told.has_checksum
        found.append(Frame(at, end, start, start + told.content_size))
        at, start = end, start + told.content_size


class Inflated(io.RawIOBase):
    """What a file of frames inflates to, with jumps: a jump forward beyond a frame, or back, begins at the frame it lands in."""

    def __init__(self, path: str, found: Sequence[Frame]):
        self._file, self._frames, self._at, self._read_to, self._stream, self._frame = open(path, "rb"), found, 0, 0, None, -1
        self.size = found[-1].end if found else 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (self._at if whence == 1 else self.size if whence == 2 else 0)
        return self._at

    def _reach(self) -> None:
        import bisect

        import zstandard

        frame = max(0, bisect.bisect_right(self._frames, self._at, key=lambda f: f.start) - 1)
        if self._stream is None or self._at < self._read_to or frame > self._frame + 1:
            self._file.seek(self._frames[frame].at)
            self._stream = zstandard.ZstdDecompressor().stream_reader(self._file, read_across_frames=True, closefd=False)
            self._read_to = self._frames[frame].start
        while self._read_to < self._at:
            part = self._stream.read(min(1 << 20, self._at - self._read_to))
            if not part:
                raise ValueError("a Zstandard frame ends early")
            self._read_to += len(part)
        self._frame = frame

    def readinto(self, buffer) -> int:
        if self._at >= self.size:
            return 0
        self._reach()
        part = self._stream.read(min(len(buffer), self.size - self._at))
        if not part:
            raise ValueError("a Zstandard frame ends early")
        buffer[: len(part)] = part
        self._at += len(part)
        self._read_to = self._at
        self._frame = max(self._frame, next(i for i, f in enumerate(self._frames) if self._at <= f.end))
        return len(part)

    def close(self) -> None:
        if not self.closed:
            self._file.close()
        super().close()


# What an archive holds.


def layout(path: str) -> Layout:
    """An archive's members, found by jumps from header to header."""
    if not is_tar(path):
        with zipfile.ZipFile(path) as outer:
            names = outer.namelist()
        return Layout(names, [Member(n, INNER, 0, 0) for n in names if n.endswith(".zip")], None, True)
    found = None
    if path.endswith(".zst"):
        with open(path, "rb") as file:
            found = frames(file)
        if found is None or len(found) < 2:
            return Layout([], [], None, False)
    with _content(path, found) as content, tarfile.open(fileobj=content, mode="r:") as archive:
        files = [m for m in archive if m.isfile()]
    members = []
    for m in files:
        folder, _, base = m.name.rpartition("/")
        if base in MEMBERS:
            members.append(Member(folder, base, m.offset_data, m.size))
        elif base.lower().endswith(".zip"):
            members.append(Member(m.name, INNER, m.offset_data, m.size))
    return Layout([m.name for m in files], members, found, True)


def _content(path: str, found: Sequence[Frame] | None) -> IO[bytes]:
    return open(path, "rb") if found is None else io.BufferedReader(Inflated(path, found), 1 << 20)


class Piece(io.RawIOBase):
    """The records that begin in a range of a file that lies in a larger one: whole records, from first to last."""

    def __init__(self, content: IO[bytes], base: int, size: int, start: int, end: int):
        self._content, self._end, self._left = content, end, size - start
        self._pos = start
        if start > 0:  # a record begins here only if a line ends just before
            content.seek(base + start - 1)
            self._left += 1
            self._pos -= 1
            self._skip_line()
        else:
            content.seek(base)

    def _skip_line(self) -> None:
        line = self._content.readline(min(self._left, feed.MAX_RECORD + 1))
        if len(line) > feed.MAX_RECORD:
            raise ValueError("a record exceeds 16 MiB")
        self._pos += len(line)
        self._left -= len(line)

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        inside = max(0, min(self._end - self._pos, self._left))
        part = self._content.read(inside if n < 0 else min(n, inside)) if inside else b""
        if inside and not part:
            raise ValueError("an archive ends early")
        self._pos += len(part)
        self._left -= len(part)
        if part and self._pos >= self._end and self._left and not part.endswith(b"\n"):
            line = self._content.readline(min(self._left, feed.MAX_RECORD + 1))
            if len(line) > feed.MAX_RECORD:
                raise ValueError("a record exceeds 16 MiB")
            self._pos += len(line)
            self._left -= len(line)
            part += line
        return part


class Window(io.RawIOBase):
    """A file that lies in a larger one, with jumps."""

    def __init__(self, content: IO[bytes], base: int, size: int):
        self._content, self._base, self._size, self._at = content, base, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (self._at if whence == 1 else self._size if whence == 2 else 0)
        return self._at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self._size - self._at))
        self._content.seek(self._base + self._at)
        part = self._content.read(n) if n else b""
        buffer[: len(part)] = part
        self._at += len(part)
        return len(part)


# The data source.


class Split(InputPartition):
    """A task's share of an archive: an inner ZIP, a file or a range of one, frames to check, names to tell, or all of a stream."""

    def __init__(self, archive: str, what: str, member: Member | None = None, start: int = 0, end: int = 0, found: list | None = None):
        super().__init__(None)
        self.archive, self.what, self.member, self.start, self.end, self.found = archive, what, member, start, end, found


class ShopArchives(DataSource):
    """Options: paths (JSON list of archives), part (records or products), columns (JSON list, of products)."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        if self.options["part"] == "records":
            return RECORDS
        return ", ".join(f"`{c}` string" for c in ("archive", "member", "shop", *IDENTITY, *json.loads(self.options["columns"])))

    def reader(self, schema):
        paths = json.loads(self.options["paths"])
        return RecordReader(paths) if self.options["part"] == "records" else ProductReader(paths, json.loads(self.options["columns"]))


class RecordReader(DataSourceReader):
    """Names of all members, and records of the files of chains and branches."""

    def __init__(self, paths: Sequence[str]):
        self.paths = paths

    def pushFilters(self, filters: list[Filter]):
        yield from filters

    def partitions(self) -> list[Split]:
        out = []
        for archive in self.paths:
            found = layout(local_path(archive))
            if not found.entered:
                out.append(Split(archive, "stream"))
                continue
            out.append(Split(archive, "names", found=found.names))
            out += [Split(archive, "member", m, found=found.frames) for m in found.members if m.kind != MEMBERS[2]]
            if found.frames:  # all that no product file covers, the end included
                spans = sorted((m.at, m.at + m.size) for m in found.members if m.kind == MEMBERS[2])
                rest = [f for f in found.frames if not any(a <= f.start and f.end <= b for a, b in spans)]
                out += [Split(archive, "check", found=rest)] if rest else []
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        rows = self._rows(split)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [*[pa.string()] * 4, *[pa.list_(pa.string())] * 2]
        while held := list(islice(rows, 5_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    def _rows(self, split: Split) -> Iterator[tuple]:
        if split.what == "names":
            yield from ((split.archive, n, NAME, n, None, None) for n in split.found)
        elif split.what == "check":
            check(local_path(split.archive), split.found)
        else:
            opened = stream_files(local_path(split.archive), MEMBERS[:2]) if split.what == "stream" else member_files(split, MEMBERS[:2])
            for group, kind, stream in opened:
                if stream is None:
                    yield split.archive, group, NAME, group, None, None
                else:
                    yield from ((split.archive, group, kind, None, names, values) for names, values in feed.records(stream))


class ProductReader(DataSourceReader):
    """Records of product files; filters on member and shop reach the files."""

    def __init__(self, paths: Sequence[str], columns: Sequence[str]):
        self.paths, self.columns = paths, columns
        self.members: set[str] | None = None
        self.shops: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = set(f.value) if isinstance(f, In) else {f.value} if isinstance(f, EqualTo) else None
            if values is not None and f.attribute == ("member",):
                self.members = values if self.members is None else self.members & values
            elif values is not None and f.attribute == ("shop",):
                self.shops = values if self.shops is None else self.shops & values
            else:
                yield f

    def _wants(self, m: Member) -> bool:
        return m.kind in (INNER, MEMBERS[2]) and (self.members is None or m.group in self.members)

    def partitions(self) -> list[Split]:
        out = []
        for archive in self.paths:
            found = layout(local_path(archive))
            if not found.entered:
                out.append(Split(archive, "stream"))
                continue
            for m in filter(self._wants, found.members):
                if m.kind == INNER:
                    out.append(Split(archive, "member", m, found=found.frames))
                else:
                    out += [Split(archive, "piece", m, a, min(a + SPLIT, m.size), found.frames) for a in range(0, m.size, SPLIT)]
            if found.frames:  # product files that nobody asks for are inflated too, to check them
                spans = [(m.at, m.at + m.size) for m in found.members if m.kind == MEMBERS[2] and not self._wants(m)]
                rest = [f for f in found.frames if any(a <= f.start and f.end <= b for a, b in spans)]
                out += [Split(archive, "check", found=rest[i : i + 16]) for i in range(0, len(rest), 16)]
        return out or [Split("", "names")]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        names = ["archive", "member", "shop", *IDENTITY, *self.columns]
        rows = self._rows(split)
        while held := list(islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names)

    def _rows(self, split: Split) -> Iterator[tuple]:
        if split.what == "names":
            return
        path, keys = local_path(split.archive), None if self.shops is None else feed.by_length(sorted(self.shops))
        if split.what == "check":
            check(path, split.found)
            return
        if split.what == "piece":
            m = split.member
            with _content(path, split.found) as content:
                names, begins = feed.product_header(io.BufferedReader(Window(content, m.at, m.size)))
                if names is None or begins >= m.size or begins >= split.end:
                    return
                rows = feed.products(Piece(content, m.at, m.size, max(begins, split.start), split.end), names, keys, self.columns)
                yield from ((split.archive, m.group, "|".join(r[:3]), *r) for r in rows)
            return
        opened = stream_files(path, MEMBERS[2:], self.members) if split.what == "stream" else member_files(split, MEMBERS[2:])
        for group, _, stream in opened:
            if stream is not None:
                names, _ = feed.product_header(stream)
                if names is not None:
                    yield from ((split.archive, group, "|".join(r[:3]), *r) for r in feed.products(stream, names, keys, self.columns))


def check(path: str, found: Sequence[Frame]) -> None:
    """Fails unless the frames inflate to what they tell."""
    import zstandard

    with open(path, "rb") as file:
        for frame in found:
            file.seek(frame.at)
            inflate, n = zstandard.ZstdDecompressor().decompressobj(), 0
            while (left := frame.stop - file.tell()) > 0 and (part := file.read(min(1 << 17, left))):
                n += len(inflate.decompress(part))
            if n != frame.end - frame.start or not inflate.eof:
                raise ValueError("a Zstandard frame ends early")


def member_files(split: Split, kinds: Collection[str]) -> Iterator[tuple[str, str, IO[bytes]]]:
    """(group, kind, stream) of a member's files of the given kinds; an inner ZIP of a ZIP that can't be read is passed over."""
    path, m = local_path(split.archive), split.member
    if not is_tar(path):
        try:
            with zipfile.ZipFile(path) as outer, outer.open(m.group) as f:
                for kind, stream in inner_files(f, kinds):
                    yield m.group, kind, stream
        except zipfile.BadZipFile:
            return
        return
    with _content(path, split.found) as content:
        window = io.BufferedReader(Window(content, m.at, m.size), 1 << 16)
        if m.kind == INNER:
            with zipfile.ZipFile(window) as inner:
                yield from ((m.group, kind, stream) for kind, stream in _opened(inner, kinds))
        else:
            yield m.group, m.kind, window


def _opened(inner: zipfile.ZipFile, kinds: Collection[str]) -> Iterator[tuple[str, IO[bytes]]]:
    for kind, name in feed.member_kinds(inner.namelist()).items():
        if kind in kinds:
            with inner.open(name) as f:
                yield kind, f


def inner_files(stream: IO[bytes], kinds: Collection[str]) -> Iterator[tuple[str, IO[bytes]]]:
    """The wanted files of an inner ZIP; large ones spill to the task's temporary folder."""
    with tempfile.SpooledTemporaryFile(max_size=SPOOL) as spool:
        while chunk := stream.read(1 << 20):
            spool.write(chunk)
        spool.seek(0)
        with zipfile.ZipFile(spool) as inner:
            yield from _opened(inner, kinds)


def stream_files(path: str, kinds: Collection[str], wanted: Collection[str] | None = None, content: bytes | None = None) -> Iterator[tuple[str, str, IO[bytes] | None]]:
    """(group, kind, stream) of an archive read from end to end, and (path, NAME, None) of each of its members."""
    with io.BytesIO(content) if content is not None else open(path, "rb") as file:
        if not is_tar(path):
            yield from _zip_files(file, kinds, wanted)
        elif path.endswith(".zst"):
            import zstandard

            yield from _tar_files(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True), kinds, wanted)
        else:
            yield from _tar_files(file, kinds, wanted)


def _zip_files(file: IO[bytes], kinds: Collection[str], wanted: Collection[str] | None) -> Iterator[tuple[str, str, IO[bytes] | None]]:
    with zipfile.ZipFile(file) as outer:
        for name in outer.namelist():
            yield name, NAME, None
            if name.endswith(".zip") and (wanted is None or name in wanted):
                try:
                    with outer.open(name) as f:
                        for kind, stream in inner_files(f, kinds):
                            yield name, kind, stream
                except zipfile.BadZipFile:
                    continue


def _tar_files(file: IO[bytes], kinds: Collection[str], wanted: Collection[str] | None) -> Iterator[tuple[str, str, IO[bytes] | None]]:
    with tarfile.open(fileobj=file, mode="r|") as archive:
        for member in archive:
            if not member.isfile():
                continue
            yield member.name, NAME, None
            folder, _, base = member.name.rpartition("/")
            if base in kinds and (wanted is None or folder in wanted):
                yield folder, base, archive.extractfile(member)
            elif base.lower().endswith(".zip") and (wanted is None or member.name in wanted):
                for kind, stream in inner_files(archive.extractfile(member), kinds):
                    yield member.name, kind, stream
    while file.read(1 << 20):  # what follows the end mark is checked too
        pass


# Tables of archives.


def _uris(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    return sorted(spark.read.format("binaryFile").load(path).inputFiles())


def is_mounted(uris: Sequence[str]) -> bool:
    return all(urlparse(u).scheme in ("", "file") for u in uris)


def _source(spark: SparkSession, uris: Sequence[str], part: str, columns: Sequence[str] = ()) -> DataFrame:
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShopArchives)
    return spark.read.format(SOURCE).option("paths", json.dumps(list(uris))).option("part", part).option("columns", json.dumps(list(columns))).load()


def _handed_over(spark: SparkSession, path: str | Sequence[str], read, schema: str) -> DataFrame:
    """Archives of a store that only Spark opens, each in one task; ``read`` takes (archive, content)."""
    ship_code(spark)
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    kinds = [pa.list_(pa.string()) if c.endswith(">") else pa.string() for c in schema.split(", ")]

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = read(archive, content.as_py())
                while held := list(islice(rows, 20_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(batches, schema)


def scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """What archives hold beside their products: archive, member, kind, line, names, fields.

    One row per record of the files of chains and branches, with its file's
    column names, and one per member with its path (kind NAME, in ``line``).
    Product files aren't opened.  An inner ZIP that can't be read is passed over
    in a ZIP; a TAR whose tail is corrupt fails.
    """
    uris = _uris(spark, path)
    if is_mounted(uris):
        return _source(spark, uris, "records")

    def read(archive: str, content: bytes) -> Iterator[tuple]:
        for group, kind, stream in stream_files(archive, MEMBERS[:2], content=content):
            if stream is None:
                yield archive, group, NAME, group, None, None
            else:
                yield from ((archive, group, kind, None, names, values) for names, values in feed.records(stream))

    return _handed_over(spark, path, read, RECORDS)


def selected_products(spark: SparkSession, path: str | Sequence[str], branches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Product records of chosen branches of the same archive member, with the branch's columns.

    Keys of at most MAX_KEYS branches (the shops of one area are a few hundred a
    day) become filters of the scan, so that only their lines leave the reader;
    with more, the join alone decides.
    """
    uris = _uris(spark, path)
    keyed = branches.select("archive", "member", F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in IDENTITY)).alias("shop")).distinct()
    held = keyed.limit(MAX_KEYS + 1).collect()
    few = len(held) <= MAX_KEYS
    members, shops = sorted({r["member"] for r in held}), sorted({r["shop"] for r in held})
    on = ["archive", "member", *IDENTITY]
    if is_mounted(uris):
        found = _source(spark, uris, "products", columns)
        if few:
            found = found.where(F.col("member").isin(members) & F.col("shop").isin(shops))
    else:
        keys = feed.by_length(shops) if few else None

        def read(archive: str, content: bytes) -> Iterator[tuple]:
            for group, _, stream in stream_files(archive, MEMBERS[2:], members if few else None, content):
                names = feed.product_header(stream)[0] if stream is not None else None
                if names is not None:
                    yield from ((archive, group, *r) for r in feed.products(stream, names, keys, columns))

        found = _handed_over(spark, path, read, ", ".join(f"`{c}` string" for c in (*on, *columns)))
    return found.drop("shop").join(branches, on)
