"""Data-quality operators: gaps, revisions, work lists, counters, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.panel import calendar


def day_range(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))


def missing_days(present: DataFrame, column: str = "d") -> DataFrame:
    """Days between the first and the last that have no row."""
    return calendar(present, column).join(present.select(F.col(column).alias("d")).distinct(), "d", "left_anti")


def unresolved_days(days: DataFrame, linked: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linked days that weren't imported; and days that are neither linked nor present."""
    open_ = linked.select("d").distinct().join(present.select("d"), "d", "left_anti")
    dark = days.join(linked.select("d"), "d", "left_anti").join(present.select("d"), "d", "left_anti")
    return open_, dark


def work_list(days: DataFrame, present: DataFrame, linked: DataFrame) -> DataFrame:
    """State of each day: existing, unavailable or to do."""
    have = present.select("d").distinct().withColumn("have", F.lit(True))
    link = linked.select("d").distinct().withColumn("link", F.lit(True))
    state = F.when(F.col("have"), "existing").when(F.col("link").isNull(), "unavailable").otherwise("to do")
    return days.join(have, "d", "left").join(link, "d", "left").select("d", state.alias("state"))


def revision_order() -> Column:
    """What revisions are tried by: without warnings first, then first seen, then smallest id."""
    return F.struct(F.coalesce(F.col("has_warnings"), F.lit(False)).alias("w"), F.coalesce("first_seen", F.lit("")).alias("s"), F.col("id").alias("i"))


def linked(entries: DataFrame) -> DataFrame:
    return entries.where("link is not null and link <> ''")


def best_revision(entries: DataFrame, by: str = "d") -> DataFrame:
    """The entry with a link that is tried first."""
    best = linked(entries).groupBy(by).agg(F.min(revision_order()).alias("k"))
    return best.select(by, F.col("k.i").alias("id"), F.col("k.s").alias("first_seen"), F.col("k.w").alias("has_warnings"))


def latest_attempts(attempts: DataFrame, by: str, order: str) -> DataFrame:
    """The attempts of the latest manifest of each day; later ones overwrite."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return attempts.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def revision_verdict(attempts: DataFrame, by: str = "d") -> DataFrame:
    """A day is rejected if all its revisions were tried and every error is a date mismatch."""
    return attempts.groupBy(by).agg(
        F.count(F.lit(1)).alias("revisions"),
        F.bool_and("tried").alias("all_tried"),
        F.bool_and(F.coalesce(F.col("mismatch"), F.lit(False))).alias("all_mismatch"),
    ).withColumn("rejected", F.col("all_tried") & F.col("all_mismatch"))


def overlap(left: DataFrame, right: DataFrame, key: Sequence[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Cells of two collections of the same day: same, changed, or on one side only."""
    a = left.select(*key, F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(*key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    status = (
        F.when(F.col("in_b").isNull(), "only_local").when(F.col("in_a").isNull(), "only_archive")
        .when(F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("a") - F.col("b")) <= tolerance), "same_price").otherwise("changed")
    )
    return a.join(b, list(key), "full_outer").select(*key, "a", "b", status.alias("status"))


def cell_counters(cells: DataFrame, day: str = "d", value: str = "price") -> DataFrame:
    """Non-null cells a day, and from them the range over days."""
    daily = cells.groupBy(day).agg(F.count(value).alias("cells"))
    return daily.agg(F.min("cells").alias("min_cells"), F.max("cells").alias("max_cells"), F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("days"))


def import_counters(days: DataFrame) -> DataFrame:
    """Days, compressed bytes, observations and conflicts of the imported days, by importer version."""
    done = days.where("status = 'imported'")
    return done.groupBy("import_version").agg(
        F.count(F.lit(1)).alias("days"), F.sum("compressed_bytes").alias("bytes"), F.sum("observations").alias("observations"), F.sum("conflicts").alias("conflicts"),
    )


def inconsistent_cells(cells: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Cells whose price isn't finite and above 0, or isn't their list price by their quantity."""
    price, expected = F.col("price"), F.try_divide(F.col("price_lista"), F.col("normalized_quantity"))
    sane = (price > 0) & (price < float("inf"))
    off = F.coalesce(F.abs(price - expected) > tolerance, F.lit(False))
    return cells.where("price is not null").where(~sane | off)


def single_version(rows: DataFrame, column: str) -> Column:
    """Fails unless a column has exactly one value."""
    return F.assert_true(F.count_distinct(column) == 1, F.lit(f"{column} must have one value"))


def rematch(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts of rows by old and new category: dropped, changed, unchanged."""
    both = before.select(*key, F.col("item").alias("old")).join(after.select(*key, F.col("item").alias("new")), list(key), "left")
    change = F.when(F.col("new").isNull(), "dropped").when(F.col("new") == F.col("old"), "unchanged").otherwise("changed")
    return both.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"), F.min(change).alias("outcome"))


def archive_dates(names: DataFrame, column: str, expected: str, by: Sequence[str] = ()) -> DataFrame:
    """The dates in archive member names, and whether they are just the expected one."""
    found = names.select(*by, F.explode_outer(F.regexp_extract_all(column, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))).alias("x"))
    days = found.groupBy(*by).agg(F.array_sort(F.collect_set("x")).alias("dates"))
    return days.withColumn("valid", F.col("dates") == F.array(F.lit(expected)))


def with_known_source(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows whose url and revision the index lists."""
    return rows.join(index.select("url", "revision").distinct(), ["url", "revision"], "left_semi")
