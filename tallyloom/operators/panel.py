"""The daily panel: a dense calendar per series, bounded fills, contiguous segments.

Frames are long: ``series, d, p`` (null where nothing was observed).  All
windows partition by series, of which there are many; a series has one row a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILL_DAYS, FX_FILL_DAYS = 2, 10
WEEK = 7


def series_window(*extra: str) -> Window:
    return Window.partitionBy("series", *extra).orderBy("d")


def calendar(days: DataFrame, column: str = "d") -> DataFrame:
    """All days from the first to the last of a frame."""
    return days.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("d"))


def dense(cells: DataFrame) -> DataFrame:
    """Every series on every day.  The calendar is one row a day, so it is broadcast."""
    spine = cells.select("series").distinct().crossJoin(F.broadcast(calendar(cells)))
    return spine.join(cells, ["series", "d"], "left").withColumn("observed", F.col("p").isNotNull())


def filled(panel: DataFrame, days: int = FILL_DAYS, source: str = "p", target: str = "pf") -> DataFrame:
    """Carry the last value over at most ``days`` days."""
    return panel.withColumn(target, F.last(source, ignorenulls=True).over(series_window().rowsBetween(-days, 0)))


def filled_between(rows: DataFrame, start: str, end: str, days: int = FX_FILL_DAYS) -> DataFrame:
    """Published values of a span, each carried over at most ``days`` days; none from before the span is carried in."""
    inside = rows.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    span = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    spine = rows.select("series").distinct().crossJoin(F.broadcast(span))  # one row a day
    return filled(spine.join(inside.select("series", "d", "p"), ["series", "d"], "left"), days)


def segmented(panel: DataFrame) -> DataFrame:
    """Number the contiguous segments of filled values, and positions within (``n``)."""
    running = series_window().rowsBetween(Window.unboundedPreceding, 0)
    out = panel.withColumn("seg", F.sum(F.when(F.col("pf").isNull(), 1).otherwise(0)).over(running))
    return out.withColumn("n", F.count("pf").over(series_window("seg").rowsBetween(Window.unboundedPreceding, 0)))


def build(cells: DataFrame) -> DataFrame:
    """Dense, filled and segmented panel of observed cells."""
    return segmented(filled(dense(cells)))


def eligible(panel: DataFrame) -> DataFrame:
    """Marks targets: observed on the day and the day before."""
    return panel.withColumn("eligible", F.col("observed") & F.coalesce(F.lag("observed").over(series_window()), F.lit(False)))


def last_days(panel: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days of the panel."""
    end = panel.agg(F.max("d").alias("end"))
    return panel.crossJoin(F.broadcast(end)).where(F.col("d") > F.date_sub("end", days)).drop("end")


def fill_defaults(source: str, default: float, look_ahead: bool = False) -> Column:
    """Forward fill without bound, then (only if asked: it looks ahead) backward, then a default."""
    back = F.first(source, ignorenulls=True).over(series_window().rowsBetween(0, Window.unboundedFollowing))
    forward = F.last(source, ignorenulls=True).over(series_window().rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(forward, back, F.lit(default)) if look_ahead else F.coalesce(forward, F.lit(default))


def enough_observations(panel: DataFrame, least: int = 4) -> DataFrame:
    """Series with at least ``least`` observed values."""
    many = panel.groupBy("series").agg(F.count("p").alias("k")).where(F.col("k") >= least).select("series")
    return panel.join(many, "series", "left_semi")


def context(days: int = 60) -> Column:
    """The last ``days`` filled values before each day, oldest first."""
    return F.collect_list("pf").over(series_window().rowsBetween(-days, -1))
