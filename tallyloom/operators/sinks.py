"""Sinks: partitioned observations, snapshots, manifests, small atomic files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a cell of a snapshot shows.
CELL = ("price", "price_lista", "unit_name", "descripcion", "marca", "price_basis", "normalized_quantity", "product_id", "branch_id", "bandera_id")


def write_observations(rows: DataFrame, path: str, fmt: str = "parquet", day: str = "date") -> None:
    """Raw observations by day; only the days written are replaced."""
    writer = rows.write.mode("overwrite").partitionBy(day).option("partitionOverwriteMode", "dynamic")
    (writer.option("compression", "gzip") if fmt == "json" else writer).format(fmt).save(path)


def snapshot_rows(cells: DataFrame, totals: DataFrame, branches: DataFrame, labels: DataFrame, date: str, version: str, source: dict | None = None) -> DataFrame:
    """The nested snapshot of a day as one JSON text.

    ``cells`` has zone ('all' for the whole area), ord, item, chain and what a
    cell shows (CELL); ``totals`` zone, chain, total, items_found; ``branches``
    zone and branches; ``labels`` chain and label.  The whole area stands at the
    top, each zone under ``zones`` in the same shape; an item that a zone lacks
    has an empty map, and ``cheapest_chain`` is the first chain in text order of
    those with the lowest price.  Baskets and cells are dimensions here (zones
    by chains by 25 items), so lists of them stay small whatever the feed's size.
    """
    chains = F.array_sort(F.collect_list(F.struct(F.col("chain").alias("id"), "label"))).alias("chains")
    named = totals.join(labels, "chain", "left").withColumn("label", F.coalesce("label", "chain"))
    # Ranked by total, equal ones by the chain's id.
    hero = F.array_sort(F.collect_list(F.struct("total", F.col("chain").alias("chain_id"), F.col("label").alias("chain_label"), "items_found"))).alias("hero")
    heroes = named.groupBy("zone").agg(chains, hero)
    cheapest = F.min(F.struct("price", "chain"))["chain"].alias("cheapest_chain")
    prices = F.map_from_entries(F.array_sort(F.collect_list(F.struct("chain", F.struct(*CELL))))).alias("prices")
    rows = cells.groupBy("zone", "ord", "item").agg(prices, cheapest)
    table = rows.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("ord", "item", "cheapest_chain", F.to_json("prices").alias("prices")))).alias("table"))
    zones = branches.join(heroes, "zone", "left").join(table, "zone", "left")
    whole = zones.agg(F.array_sort(F.collect_list(F.struct("zone", F.struct(F.col("branches").alias("branches_count"), "chains", "hero", "table").alias("z")))).alias("zs"))
    area = F.try_element_at(F.filter("zs", lambda z: z["zone"] == "all"), F.lit(1))["z"]
    parts = F.map_from_entries(F.filter("zs", lambda z: z["zone"] != "all"))
    made = whole.select(
        F.lit(date).alias("date"), area["branches_count"].alias("branches_count"), area["chains"].alias("chains"), area["hero"].alias("hero"), area["table"].alias("table"), parts.alias("zones"),
        F.lit(version).alias("price_normalization_version"), F.current_timestamp().cast("string").alias("generated_at"),
        F.lit(None if source is None else json.dumps(source, ensure_ascii=False, sort_keys=True)).cast("string").alias("source"),
    )
    return made.select(F.to_json(F.struct("*")).alias("value"))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.coalesce(1).write.mode("overwrite").text(path)


def latest(snapshots: DataFrame, day: str = "date") -> DataFrame:
    """The newest day's rows: a view of the table, so importing an older day can't rewind it."""
    newest = snapshots.agg(F.max(day).alias("newest"))
    return snapshots.join(F.broadcast(newest), snapshots[day] == newest["newest"]).drop("newest")


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of each day."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c != "d"]
    return log.groupBy("d").agg(F.max(F.struct("written_at", *[c for c in rest if c != "written_at"])).alias("m")).select("d", "m.*")


def publish(spark: SparkSession, text: str, path: str) -> None:
    """A small file in any store that Spark writes: readers see the old one or the new one.

    The text goes to a name of its own beside the target, which then replaces
    the target in one rename of the store's file system.
    """
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    files = fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    target = files.makeQualified(target)
    fresh = fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target.getParent())
    out = fresh.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(fresh)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = getattr(fs, "Options$Rename")
    choice = spark.sparkContext._gateway.new_array(how, 1)
    choice[0] = how.OVERWRITE
    files.rename(fresh, target, choice)


def publish_json(spark: SparkSession, value: object, path: str) -> None:
    publish(spark, json.dumps(value, ensure_ascii=False, indent=2) + "\n", path)


def forecast_file(forecasts: DataFrame, path: str, version: str, about: dict | None = None) -> int:
    """Next-day forecasts of all series as one JSON file, after what there is to say ``about`` them; one row a series."""
    rows = [r.asDict() for r in forecasts.toLocalIterator()]
    items = {str(r["series"]): {k: (str(v) if k == "as_of" else v) for k, v in r.items() if k != "series"} for r in rows}
    publish_json(forecasts.sparkSession, {"mode": "real", "price_normalization_version": version, **(about or {}), "items": items}, path)
    return len(items)
