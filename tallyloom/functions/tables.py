"""Table functions for SQL: their schemas follow from their arguments.

``tl_records(TABLE(lines), 'a|b|c')`` turns lines of a feed into records with
the columns of the header given; ``tl_sizes(TABLE(descriptions), 'kg')`` gives a
row for every size that a description prints, in a unit or in all.  Both take a
table, so Spark deals its rows out as usual and a function sees one row at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tallyloom.functions.numbers import unit_aliases
from tallyloom.functions.text import SIZE
from tallyloom.session import ship_code
from tallyloom.sources.feed import FOOTERS, fields, header_names


def _constant(argument: AnalyzeArgument, what: str) -> str:
    if argument.isTable or not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError(f"{what} must be a constant text")
    return argument.value


def _table(argument: AnalyzeArgument) -> StructType:
    if not argument.isTable:
        raise ValueError("the first argument must be a table")
    return argument.dataType


@udtf
class Records:
    """Records of lines: the last column of the table is the line; columns before it are handed on."""

    def __init__(self):
        self._names: list[str] = []

    @staticmethod
    def analyze(lines: AnalyzeArgument, header: AnalyzeArgument) -> AnalyzeResult:
        given, names = _table(lines), header_names(_constant(header, "the header"))
        if len(set(names)) < len(names) or not all(names):
            raise ValueError(f"a header needs names of its own for all columns: {names}")
        schema = StructType()
        for f in given.fields[:-1]:
            schema = schema.add(f.name, f.dataType)
        for n in names:
            schema = schema.add(n, StringType())
        return AnalyzeResult(schema)

    def eval(self, row: Row, header: str) -> Iterator[tuple]:
        names = self._names or header_names(header)
        self._names = names
        *kept, line = row
        line = (line or "").lstrip("﻿").rstrip("\r")
        if not line.strip() or line.startswith(FOOTERS) or header_names(line) == names:
            return
        values = fields(line)[: len(names)]
        yield (*kept, *values, *[None] * (len(names) - len(values)))


def _printed(text: str | None) -> str:
    upper = unicodedata.normalize("NFKD", (text or "").upper())
    plain = "".join(c for c in upper if unicodedata.category(c) != "Mn")
    return re.sub(r"(?<=[0-9])-(?=[A-Z])", " ", plain)


@udtf
class Sizes:
    """Sizes printed in descriptions: the last column of the table is the description; columns before it are handed on."""

    @staticmethod
    def analyze(descriptions: AnalyzeArgument, unit: AnalyzeArgument) -> AnalyzeResult:
        schema, wanted = StructType(), _constant(unit, "the unit")
        if wanted not in ("kg", "L", "u", "*"):
            raise ValueError(f"no such unit: {wanted}")
        for f in _table(descriptions).fields[:-1]:
            schema = schema.add(f.name, f.dataType)
        schema = schema.add("nth", IntegerType()).add("amount", DoubleType())
        schema = schema.add("unit", StringType()) if wanted == "*" else schema  # a single unit needs no column
        return AnalyzeResult(schema.add("times", DoubleType()))

    def eval(self, row: Row, unit: str) -> Iterator[tuple]:
        *kept, description = row
        nth = 0
        for found in re.finditer(SIZE, _printed(description)):
            before, amount, alias, _, after = found.groups()
            base, scale = unit_aliases()[alias]
            if unit not in ("*", base):
                continue
            nth += 1
            times = before or after
            head = (*kept, nth, float(amount.replace(",", ".")) * scale)
            yield (*head, *([base] if unit == "*" else []), None if times is None else float(times))


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to a session's SQL."""
    ship_code(spark)
    spark.udtf.register("tl_records", Records)
    spark.udtf.register("tl_sizes", Sizes)
    return ["tl_records", "tl_sizes"]
