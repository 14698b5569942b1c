"""Snapshots, indices and currency series as stored JSON or CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = r"(\d{4}-\d{2}-\d{2})"


def read_snapshots(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """Snapshot files, plain or gzipped; an unreadable one is dropped.  The day is the field, else the file name's."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    rows = (reader.schema(schema) if schema else reader).json(path)
    named = F.regexp_extract(F.input_file_name(), _DAY, 1)
    field = F.col("date") if "date" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("date", F.coalesce(field, F.when(named != "", named)))


def digests(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SHA-256 and size of every file under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def newest(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.max_by(F.struct(*snapshots.columns), "date").alias("r")).select("r.*")


def read_currency(spark: SparkSession, path: str) -> DataFrame:
    """Currency history rows (date, source, value_sell, value_buy); the last value of a date and source stays."""
    rows = spark.read.option("multiLine", True).schema("date string, source string, value_sell double, value_buy double").json(path)
    rows = rows.withColumn("d", F.to_date("date")).withColumn("_o", F.monotonically_increasing_id())
    best = F.max(F.struct("_o", "value_sell", "value_buy")).alias("m")
    return rows.where("d is not null").groupBy("d", "source").agg(best).select("d", "source", "m.value_sell", "m.value_buy")


def currency_panel(rows: DataFrame) -> DataFrame:
    """One row a day with a column a source.  A source that can't be had stays null; nothing is made up."""
    return rows.groupBy("d").pivot("source", ["Blue", "Oficial"]).agg(F.first("value_sell")).withColumnsRenamed({"Blue": "fx_blue", "Oficial": "fx_oficial"}).withColumn("fx_mep", F.lit(None).cast("double"))


def read_monthly_index(spark: SparkSession, path: str) -> DataFrame:
    """Pairs [month, value] of a JSON list under ``data``; null values are dropped."""
    rows = spark.read.option("multiLine", True).schema("data array<array<string>>").json(path)
    pair = rows.select(F.explode("data").alias("p"))
    return pair.select(F.to_date(F.get("p", 0)).alias("month"), F.get("p", 1).try_cast("double").alias("value")).where("value is not null")
