"""Covariates: competitors, published indices, gaps and rolling volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyloom.operators import timeline

PUBLICATION_LAG, STALE_DAYS = 60, 75


def competitor_min(cells: DataFrame) -> DataFrame:
    """Per (item, day, chain), the lowest price of the other chains.

    The two lowest prices of a group answer for every chain, so nothing joins
    with itself: a chain that holds the lowest gets the second.  Two aggregations
    combine before they shuffle.
    """
    per_chain = cells.where("price is not null").groupBy("item", "d", "chain").agg(F.min("price").alias("price"))
    w = Window.partitionBy("item", "d").orderBy("price", "chain")
    placed = per_chain.withColumn("place", F.row_number().over(w))
    low = F.min(F.when(F.col("place") == 1, F.col("price"))).over(Window.partitionBy("item", "d"))
    second = F.min(F.when(F.col("place") == 2, F.col("price"))).over(Window.partitionBy("item", "d"))
    return placed.select("item", "d", "chain", "price", F.when(F.col("place") == 1, second).otherwise(low).alias("competitor_price"))


def published(index: DataFrame, lag_days: int = PUBLICATION_LAG) -> DataFrame:
    """Monthly values (``month, value``) with the day each is known."""
    return index.select(F.date_add(F.last_day("month"), lag_days).alias("known_on"), F.last_day("month").alias("month_end"), "value")


def as_of(days: DataFrame, known: DataFrame) -> DataFrame:
    """For each day, the last value known by then; ``days`` may have more rows a day, and other columns.

    Days and values share one order of time, dealt out by range; the last value
    known before a task's stretch is carried into it.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in days.columns))
    kind = known.schema["value"].dataType.simpleString()
    line = days.select(F.col("d").alias("t"), F.lit(1).alias("asks"), F.lit(None).cast(kind).alias("index_value"), row.alias("row"))
    values = known.where("value is not null and known_on is not null").select(F.col("known_on").alias("t"), F.lit(0).alias("asks"), F.col("value").alias("index_value"))
    filled = timeline.last_known(line.unionByName(values, allowMissingColumns=True), ["t", "asks", "index_value"], "index_value")
    return filled.where("asks = 1").select("row.*", F.when(F.col("t").isNotNull(), F.col("index_value")).alias("index_value"))


def stale(known: DataFrame, end: Column, days: int = STALE_DAYS) -> DataFrame:
    """Whether the last month of an index ended more than ``days`` days before ``end``."""
    return known.agg((F.datediff(end, F.max("month_end")) > days).alias("stale"))


def gap(blue: Column, official: Column) -> Column:
    return F.try_divide(blue - official, official)


def rolling_volatility(daily: DataFrame, value: str, rows: int = 7, least: int = 3, order: str = "d", by: tuple[str, ...] = ()) -> DataFrame:
    """Sample deviation of log-returns over the last rows, where enough of them exist.

    Without ``by`` the frame is one series: its time line is dealt out by range,
    with the last rows before each stretch carried in.
    """

    def add(held: DataFrame, w: WindowSpec) -> DataFrame:
        before = F.lag(value).over(w)
        change = F.when((F.col(value) > 0) & (before > 0), F.ln(F.col(value)) - F.ln(before))
        frame = w.rowsBetween(-(rows - 1), 0)
        out = held.withColumn("log_return", change)
        return out.withColumn("volatility", F.when(F.count("log_return").over(frame) >= least, F.stddev_samp("log_return").over(frame)))

    return add(daily, Window.partitionBy(*by).orderBy(order)) if by else timeline.over_last_rows(daily, [order], rows, add)


def rolling_cv(daily: DataFrame, value: str, by: str, rows: int = 14, least: int = 7) -> DataFrame:
    """Coefficient of variation over the last rows, where enough of them exist."""
    frame = Window.partitionBy(by).orderBy("d").rowsBetween(-(rows - 1), 0)
    cv = F.try_divide(F.stddev_samp(value).over(frame), F.avg(value).over(frame))
    return daily.withColumn("cv", F.when(F.count(value).over(frame) >= least, cv))


def last_per_day(rows: DataFrame, day: str, value: str, order: str) -> DataFrame:
    """One value a day and source: the last by ``order``."""
    return rows.groupBy(day, "source").agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("m")).select(day, "source", F.col("m.v").alias(value))


# The configurations of covariates that are compared.
CONFIGURATIONS = ("price_only", "plus_fx", "plus_fx_ipim", "plus_fx_competitor")


def configured(rows: DataFrame, days: int = 60) -> DataFrame:
    """Every row once per configuration, with the covariates that it gives a model.

    ``rows`` has series, d, fx_gap, fx_volatility, index_value, competitor; the
    scales bring them near one.  Where the competitor has nothing but zeros or
    nulls in the context before a day, its configuration falls back to the
    currency alone, which ``dropped`` says.
    """
    before = Window.partitionBy("series").orderBy("d").rowsBetween(-days, -1)
    silent = F.coalesce(F.max(F.abs(F.col("competitor"))).over(before), F.lit(0.0)) == 0
    held = rows.withColumn("silent", silent)
    none = F.lit(None).cast("double")
    fx = (F.col("fx_gap"), F.col("fx_volatility"))
    given = {
        "price_only": (none, none, none, none, F.lit(False)),
        "plus_fx": (*fx, none, none, F.lit(False)),
        "plus_fx_ipim": (*fx, (F.col("index_value") - 100) / 10, none, F.lit(False)),
        "plus_fx_competitor": (*fx, none, F.when(~F.col("silent"), F.col("competitor") / 1000), F.col("silent")),
    }
    names = ("fx_gap", "fx_volatility", "index_scaled", "competitor_scaled", "dropped")
    made = F.array(*(F.struct(F.lit(c).alias("config"), *(x.alias(n) for x, n in zip(given[c], names, strict=True))) for c in CONFIGURATIONS))
    return held.select("series", "d", F.explode(made).alias("c")).select("series", "d", "c.*")
