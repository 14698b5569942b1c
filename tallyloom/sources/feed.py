"""The price feed's text: pipe-delimited records under a header line."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import IO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.numbers import stripped

# Beginnings of lines that aren't records (footers and their
# mis-decoded forms), the files of a shop, the columns that name a branch, the
# columns a product file must have, and the longest record.
FOOTERS = ("Ultima", "Última", "Ã")
MEMBERS = ("comercio.csv", "sucursales.csv", "productos.csv")
IDENTITY = ("id_comercio", "id_bandera", "id_sucursal")
NEEDED = ("id_producto", "productos_precio_lista")
MAX_RECORD = 16 * 1024 * 1024
#: Bytes of a product file looked at together.
CHUNK = 4 * 1024 * 1024


def feed_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Record lines of plain feed files, header included, without marks, blanks or footers."""
    return clean_lines(spark.read.text(path))


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    text = F.regexp_replace(F.col(column), "^﻿", "")
    kept = stripped(text) != ""
    for f in FOOTERS:
        kept = kept & ~text.startswith(f)
    return lines.withColumn(column, text).where(kept)


def read_feed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Feed files, each under a header of its own, as one table of text columns.

    A file's first record names its columns, in any order; a column that a file
    lacks is null there, and the columns of all files are those of the result,
    in order of first mention by file name.  Fields may be quoted; lines that
    repeat their file's header are headers too.  Reading begins with one pass
    for the headers, a row a file; distinct ones, a few schemas, reach the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    lines = clean_lines(lines)
    headers = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    schemas = headers.groupBy("header").agg(F.min("file").alias("first")).orderBy("first").collect()
    named = [(r["header"], header_names(r["header"])) for r in schemas]
    columns = list(dict.fromkeys(n for _, names in named for n in names))
    if not columns:
        return spark.createDataFrame([], "value string")
    width = max(len(names) for _, names in named)
    record = F.from_csv("value", ", ".join(f"`{i}` string" for i in range(width)), {"sep": "|", "escape": "\"", "mode": "PERMISSIVE"})
    rows = lines.join(headers, "file").where("value <> header").select("header", record.alias("r"))

    def field(column: str):
        value = F.lit(None).cast("string")
        for header, names in named:
            if column in names:
                value = F.when(F.col("header") == header, F.col(f"r.`{names.index(column)}`")).otherwise(value)
        return value.alias(column)

    return rows.select(*map(field, columns))


def fields(line: str) -> list[str]:
    """The fields of a record, quotes resolved."""
    return next(csv.reader([line], delimiter="|"), [])


def header_names(header: str) -> list[str]:
    return [h.strip() for h in fields(header.lstrip("﻿").strip())]


def checked_header(header: str) -> list[str]:
    """Column names of a product file; its identity columns must come first."""
    names = header_names(header)
    if tuple(names[:3]) != IDENTITY:
        raise ValueError(f"unexpected identity columns: {names[:3]}")
    if not set(NEEDED) <= set(names):
        raise ValueError("required product columns are missing")
    return names


def member_kinds(names: Sequence[str]) -> dict[str, str]:
    """The file of each kind in an inner archive; two of one kind are an error."""
    found: dict[str, str] = {}
    for name in names:
        kind = re.split(r"[\\/]", name)[-1]
        if kind in MEMBERS:
            if kind in found:
                raise ValueError(f"ambiguous members for {kind}")
            found[kind] = name
    return found


def records(stream: IO[bytes]) -> Iterator[tuple[list[str], list[str]]]:
    """(column names, fields) of every record of a small feed file."""
    names = None
    while raw := stream.readline(MAX_RECORD + 1):
        if len(raw) > MAX_RECORD:
            raise ValueError("a record exceeds 16 MiB")
        line = raw.decode("utf-8", errors="ignore").lstrip("﻿").rstrip("\r\n")
        if not line.strip() or line.startswith(FOOTERS):
            continue
        if names is None:
            names = header_names(line)
        else:
            yield names, fields(line)


def product_header(stream: IO[bytes]) -> tuple[list[str] | None, int]:
    """Column names of a product file that is read from its beginning, and where its records begin."""
    at = 0
    while raw := stream.readline(MAX_RECORD + 1):
        if len(raw) > MAX_RECORD:
            raise ValueError("a record exceeds 16 MiB")
        at += len(raw)
        line = raw.decode("utf-8-sig", errors="replace").strip()
        if line and not line.startswith(FOOTERS):
            return checked_header(line), at
    return None, at


def by_length(keys: Sequence[str]) -> dict[int, np.ndarray]:
    """Branch keys, each with its closing bar, by their number of bytes."""
    found: dict[int, list[bytes]] = {}
    for k in keys:
        raw = f"{k}|".encode()
        found.setdefault(len(raw), []).append(raw)
    return {n: np.array(sorted(set(k)), f"S{n}") for n, k in found.items()}


def lines_of_branches(block: bytes, keys: Mapping[int, np.ndarray] | None) -> list[bytes]:
    """Lines of a block of whole lines that begin with one of the keys (all, if none are given), found in numpy."""
    if keys is None:
        return [line for line in block.split(b"\n") if line.strip()]
    data = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate((np.zeros(1, np.int64), ends + 1))
    wanted: list[np.ndarray] = []
    for length, known in keys.items():
        fit = starts[starts + length <= len(data)]
        fit = fit[data[fit + length - 1] == 124]
        if len(fit):
            heads = np.ascontiguousarray(data[fit[:, None] + np.arange(length)]).view(f"S{length}").ravel()
            wanted.append(fit[np.isin(heads, known)])
    out = []
    for start in np.sort(np.concatenate(wanted)).tolist() if wanted else ():
        end = block.find(b"\n", start)
        out.append(block[start : len(block) if end < 0 else end])
    return out


def products(stream: IO[bytes], names: Sequence[str], keys: Mapping[int, np.ndarray] | None, columns: Sequence[str]) -> Iterator[list[str | None]]:
    """The branch and the named columns of the records whose branch is among ``keys``, from a stream of whole records.

    Lines are looked at as bytes; only those of wanted branches are decoded and
    parsed.
    """
    at = [names.index(c) if c in names else None for c in (*IDENTITY, *columns)]
    held = b""
    while True:
        part = stream.read(CHUNK)
        held += part
        end = held.rfind(b"\n") + 1 if part else len(held)
        if not end and len(held) > MAX_RECORD:
            raise ValueError("a record exceeds 16 MiB")
        for raw in lines_of_branches(held[:end], keys):
            values = fields(raw.decode("utf-8", errors="replace").rstrip("\r"))
            yield [None if i is None or i >= len(values) else values[i] for i in at]
        held = held[end:]
        if not part:
            return


def parsed(rows: DataFrame, kind: str, columns: Sequence[str]) -> DataFrame:
    """Records of one kind with the named columns, found by each file's own header."""
    field = lambda c: F.get("fields", F.array_position("names", c).cast("int") - 1)
    return rows.where(F.col("kind") == kind).select("archive", "member", *(field(c).alias(c) for c in columns))
