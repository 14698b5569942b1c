"""Next-day forecasts as window expressions over a segmented panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import direction
from tallyloom.functions.text import bound
from tallyloom.operators.panel import WEEK, eligible, series_window

MOVE_PCT, MOVE = 0.8, 0.008
MIN_HISTORY = 4
NAMES = ("sube", "baja", "estable")


def with_differences(panel: DataFrame) -> DataFrame:
    """Differences within a segment; the first row of a segment has none."""
    return panel.withColumn("diff", F.col("pf") - F.lag("pf").over(series_window("seg")))


def drift5() -> Column:
    """Mean of the last five differences of the segment."""
    return F.avg("diff").over(series_window("seg").rowsBetween(-4, 0))


def volatility() -> Column:
    """Sample deviation of the last six differences of the segment."""
    return F.stddev_samp("diff").over(series_window("seg").rowsBetween(-5, 0))


def confidence(drift: Column, vol: Column, last: Column) -> Column:
    return F.when(vol > F.abs(last) * 0.08, "baja").when(F.abs(drift) > vol * 0.5, "alta").otherwise("media")


def next_day(panel: DataFrame) -> DataFrame:
    """The forecast made at the end of each series' last day, where four contiguous values end it."""
    made = with_differences(panel).withColumn("drift", drift5()).withColumn("vol", volatility())
    end = panel.agg(F.max("d").alias("end"))
    made = made.crossJoin(F.broadcast(end)).where((F.col("d") == F.col("end")) & (F.col("n") >= MIN_HISTORY) & (F.col("pf") != 0))
    pred = F.col("pf") + F.col("drift")
    delta = F.col("drift") / F.abs("pf") * 100  # not by way of pred, whose last bits are lost again
    return made.select("series", F.col("d").alias("as_of"), direction(delta, MOVE_PCT, NAMES).alias("dir"), delta.alias("delta_pct"), pred.alias("pred"), F.col("pf").alias("last"), confidence(F.col("drift"), F.col("vol"), F.col("pf")).alias("conf"))


def targets(panel: DataFrame, identity: str | None = None) -> DataFrame:
    """Walk-forward targets with the forecasts that yesterday's history allows.

    One row per (series, day) observed today and yesterday with a history of at
    least four contiguous values: last, actual, drift, persistence and weekly
    persistence forecasts.
    """
    w = series_window()
    weekly = F.coalesce(F.lag("pf", WEEK - 1).over(series_window("seg")), F.col("pf"))
    state = with_differences(eligible(panel)).withColumn("drift", drift5()).withColumn("weekly", F.when(F.col("n") >= WEEK, weekly).otherwise(F.col("pf")))
    out = state.select(
        "series", "d", "eligible", F.col("p").alias("actual"),
        F.lag("pf").over(w).alias("last"), F.lag("n").over(w).alias("history"),
        (F.lag("pf").over(w) + F.lag("drift").over(w)).alias("drift5"),
        F.lag("pf").over(w).alias("persistence"), F.lag("weekly").over(w).alias("weekly"),
        *([F.coalesce(F.col(identity), F.lit("")).alias("identity"), F.coalesce(F.lag(identity).over(w), F.lit("")).alias("identity_before")] if identity else []),
    )
    return out.where(F.col("eligible") & (F.col("history") >= MIN_HISTORY) & (F.col("actual") != 0)).drop("eligible")


def first_weekly_move(panel: DataFrame) -> DataFrame:
    """For each day, the first move against yesterday's value within the week that starts that day.

    Only weeks of seven observed days inside the calendar count.
    """
    w = series_window()
    ahead = w.rowsBetween(0, WEEK - 1)
    out = panel.withColumn("last", F.lag("pf").over(w)).withColumn("history", F.lag("n").over(w))
    out = out.withColumn("week", F.collect_list("p").over(ahead)).withColumn("days", F.count(F.lit(1)).over(ahead))
    moves = F.transform("week", lambda v: (v - F.col("last")) / F.abs("last") * 100)
    first = F.try_element_at(F.filter(moves, lambda c: F.abs(c) >= MOVE_PCT), F.lit(1))
    label = F.when(first.isNull(), NAMES[2]).otherwise(direction(first, MOVE_PCT, NAMES))
    full = (F.size("week") == WEEK) & (F.col("days") == WEEK) & F.col("last").isNotNull() & (F.col("last") != 0)
    return out.where(full).select("series", "d", "history", "last", label.alias("weekly_move"))


def naive_band(panel: DataFrame, days: int = 60) -> DataFrame:
    """Last value plus drift over compacted history, with a band of 1.28 deviations.

    Unlike the drift forecast it skips over gaps: nulls leave the history.
    """
    before = Window.partitionBy("series").orderBy("d").rowsBetween(-days, -1)
    h = F.col("h")
    out = panel.withColumn("h", F.collect_list("p").over(before))  # nulls don't enter a list
    n, last = F.size(h), F.try_element_at(h, F.lit(-1))
    diffs = lambda k: F.expr(f"transform(sequence(1, least({k}, size(h) - 1)), i -> element_at(h, -i) - element_at(h, -i - 1))")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    off = lambda a: bound(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))
    drift = F.when(n >= 3, bound(diffs(4), mean)).otherwise(F.lit(0.0))
    spread = F.when(n >= 4, bound(diffs(6), off)).otherwise(last * 0.03)
    out = out.where(n >= 1).select("series", "d", F.col("p").alias("actual"), n.alias("n"), last.alias("last"), (last + drift).alias("mid"), spread.alias("spread"))
    one = F.col("n") == 1
    low = F.when(one, F.col("last") * 0.97).otherwise(F.col("mid") - F.col("spread") * 1.28)
    high = F.when(one, F.col("last") * 1.03).otherwise(F.col("mid") + F.col("spread") * 1.28)
    return out.select("series", "d", "actual", "n", F.when(one, F.col("last")).otherwise(F.col("mid")).alias("mid"), low.alias("low"), high.alias("high"))
