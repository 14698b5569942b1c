"""Rules of the shopping page that decide on data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 0.011
DIRECTIONS = ("sube", "baja", "estable")


def comparable(price: Column, unit: Column, expected: Column) -> Column:
    return price.isNotNull() & (unit == expected) & ~F.isnan(price) & (price > 0) & (price < float("inf"))


def highlighted(cells: DataFrame, item: str = "item", price: str = "price") -> DataFrame:
    """Marks all lowest comparable prices of an item that more than one chain has.

    ``cells`` has one row per item and chain, a few million at most; the lowest
    and the number are aggregated and joined, not windowed, so they combine early.
    """
    best = cells.where("comparable").groupBy(item).agg(F.min(price).alias("_lowest"), F.count(F.lit(1)).alias("_priced"))
    out = cells.join(best, item, "left")
    return out.withColumn("best", F.coalesce(F.col("comparable") & (F.col("_priced") > 1) & (F.col(price) == F.col("_lowest")), F.lit(False))).drop("_lowest", "_priced")


def with_forecast(cells: DataFrame, forecasts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells with the forecast that may be shown beside them, else null.

    Shown only if its direction is known, its numbers are finite, the predicted
    price is above 0, and its last price is the one displayed.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = F.col("dir").isin(*DIRECTIONS) & finite("last") & finite("pred") & finite("delta_pct") & (F.col("pred") > 0) & (F.abs(F.col("last") - F.col("price")) <= GAP)
    joined = cells.join(forecasts, list(key), "left")
    shown = F.coalesce(usable, F.lit(False))
    return joined.withColumn("shown", shown).withColumn("shown_dir", F.when(shown, F.col("dir")))


def accepted_forecasts(forecasts: DataFrame, date: str, version: str, wide: bool = True) -> DataFrame:
    """Forecasts made for the snapshot's day, version and area, from real data."""
    good = (F.col("as_of") == F.lit(date)) & (F.col("mode") == "real") & (F.col("version") == version) & F.lit(bool(version) and wide)
    return forecasts.where(good & (F.col("item_as_of") == F.lit(date)))


def visible_zones(zones: DataFrame, totals: DataFrame) -> DataFrame:
    """Zones with at least one basket."""
    return zones.join(totals.select("zone").distinct(), "zone", "left_semi")


def in_group_order(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Known groups in their given order, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    return rows.withColumn("place", F.when(place == 0, len(order) + 1).otherwise(place))


def rankable(totals: DataFrame) -> Column:
    """Whether all totals cover the same number of items; if not, they aren't ranked."""
    whole = Window.partitionBy("zone")
    return F.min("items_found").over(whole) == F.max("items_found").over(whole)


def top_and_bottom(rows: DataFrame, by: str, tie: Sequence[str], top: int = 10, bottom: int = 5) -> DataFrame:
    """The smallest and the largest rows; ties are settled by further columns."""
    low = rows.orderBy(F.col(by).asc(), *tie).limit(top).withColumn("end", F.lit("low"))
    high = rows.orderBy(F.col(by).desc(), *tie).limit(bottom).withColumn("end", F.lit("high"))
    return low.unionByName(high)


def rejected_sample(rows: DataFrame, order: Sequence[str], size: int = 15) -> DataFrame:
    """The first rejected rows, for a reader to look at."""
    return rows.orderBy(*order).limit(size)


def example_series(panel: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    """One series to show: of the category, that with the most observed values (the first in order wins ties); else the first of all."""
    counted = panel.groupBy("series").agg(F.count("p").alias("observations")).join(categories, "series", "left")
    inside = F.coalesce(F.col("category") == category, F.lit(False))
    key = F.struct((~inside).alias("outside"), F.when(inside, -F.col("observations")).otherwise(0).alias("few"), F.col("series"))
    return counted.agg(F.min(key).alias("k")).where("k is not null").select("k.series")


def superseded(evaluations: DataFrame) -> DataFrame:
    """Accuracy is withheld from evaluations that a later one replaces."""
    return evaluations.withColumn("mae_shown", F.when(~F.coalesce("superseded", F.lit(False)), F.col("mae")))
