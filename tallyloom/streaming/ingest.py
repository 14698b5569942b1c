"""Incremental import: a file stream whose batches replace whole days, and late-data windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def observation_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def replace_days(stream: DataFrame, path: str, checkpoint: str, day: str = "date") -> StreamingQuery:
    """Write each batch over the days it holds; a batch that is run again gives the same table."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_minimum(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Lowest value per key and window; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.min(value).alias("low")).select(F.col("window.start").alias("start"), *keys, "low")
