"""Reading the driver's tables by path, whatever store holds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyloom.session import ship_code


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def parts_of(batch: pa.RecordBatch, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def map_rows(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: Sequence[StructField] = ()) -> DataFrame:
    """``df.mapInArrow`` for tables whose columns have any names (Spark's own looks dots up as fields); ``added`` columns follow the table's."""
    given, fields = df.columns, [*df.schema.fields, *added]
    plain = [f"c{i}" for i in range(len(fields))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Maps hold no batch while the next one is made; parts of a batch keep what a function makes of its texts small.
        parts = chain.from_iterable(map(parts_of, batches))
        return map(lambda out: pa.RecordBatch.from_arrays(out.columns, plain), function(map(lambda b: pa.RecordBatch.from_arrays(b.columns, given), parts)))

    schema = StructType([StructField(p, f.dataType) for p, f in zip(plain, fields, strict=True)])
    return df.toDF(*plain[: len(given)]).mapInArrow(renamed, schema).toDF(*(f.name for f in fields))
