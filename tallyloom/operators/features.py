"""Features of a panel's history and the pooled ridge on returns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.forecast import MIN_HISTORY, MOVE
from tallyloom.operators.panel import eligible, series_window
from tallyloom.session import ship_code

NUMERIC = ("r1", "r3", "r7", "r28", "std7", "low28", "high28", "move_age")
DAYS = tuple(f"dow{i}" for i in range(7))
ALPHA, CLIP = 100.0, 0.3


def _clip(x: Column, bound: float) -> Column:
    return F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def history_features(panel: DataFrame) -> DataFrame:
    """Features of the contiguous history that ends on each row's day.

    Returns look back within the segment as far as it goes: means of 3, 7 and 28
    returns, deviation of 7, range of 28 values, days since the last move.
    """
    w = series_window("seg")
    back = lambda k: w.rowsBetween(-(k - 1), 0)
    out = panel.withColumn("r", F.col("pf") / F.lag("pf").over(w) - 1)
    last_move = F.last(F.when(F.abs("r") >= MOVE, F.col("n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        out.withColumn("r1", _clip(F.col("r"), 0.5))
        .withColumns({f"r{k}": _clip(F.avg("r").over(back(k)), 0.5) for k in (3, 7, 28)})
        .withColumn("std7", F.least(F.stddev_pop("r").over(back(7)), F.lit(0.5)))
        .withColumn("low28", _clip(F.min("pf").over(back(28)) / F.col("pf") - 1, 0.5))
        .withColumn("high28", _clip(F.max("pf").over(back(28)) / F.col("pf") - 1, 0.5))
        .withColumn("move_age", F.least(F.coalesce(F.col("n") - last_move, F.col("n") - 1), F.lit(28)) / 28.0)
    )


def examples(panel: DataFrame) -> DataFrame:
    """One row per target: features of yesterday's history, the target's weekday and return."""
    w = series_window()
    made = history_features(eligible(panel))
    named = made.select("series", "d", "eligible", F.col("p").alias("actual"), F.lag("pf").over(w).alias("last"), F.lag("n").over(w).alias("history"), *(F.lag(c).over(w).alias(c) for c in NUMERIC))
    rows = named.where(F.col("eligible") & (F.col("history") >= MIN_HISTORY))
    days = {c: (F.weekday("d") == i).cast("double") for i, c in enumerate(DAYS)}
    return rows.withColumns(days).withColumn("target_return", F.col("actual") / F.col("last") - 1).drop("eligible")


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and day, the products of all columns (the first is 1) with each other, row after row."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        days = batch.column("d").cast(pa.int32()).to_numpy()
        x = np.column_stack([np.ones(len(days)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])])
        usable = np.isfinite(x).all(axis=1)
        for day in np.unique(days[usable]).tolist():
            own = x[usable & (days == day)]
            sums[day] = sums.get(day, 0) + own.T @ own
    for day, m in sums.items():
        k = m.size
        yield pa.RecordBatch.from_arrays([pa.array([day] * k, pa.int32()).cast(pa.date32()), pa.array(range(k), pa.int32()), pa.array(m.ravel())], ["d", "k", "v"])


def _moments(rows: DataFrame, columns: list[str], target: str) -> tuple[list, np.ndarray]:
    """Days, and per day the matrix of sums and cross products of 1, the columns and the target.

    A task sends one small matrix a day; the driver gets one a day.
    """
    ship_code(rows.sparkSession)
    x = [*columns, target]
    parts = rows.select("d", *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x))).mapInArrow(_partial_moments, "d date, k int, v double")
    days = parts.groupBy("d", "k").agg(F.sum("v").alias("v")).groupBy("d").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("m")).orderBy("d").collect()
    size = len(x) + 1
    return [r["d"] for r in days], np.array([[c["v"] for c in r["m"]] for r in days]).reshape(-1, size, size)


def solve_ridge(moments: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, float]:
    """Closed-form ridge on standardised columns (population deviation); weights on the raw scale."""
    k, n = len(moments) - 2, moments[0, 0]
    if not n:
        return np.zeros(k), 0.0
    mean = moments[0, 1:] / n
    spread = moments[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread)[:k], 0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    w = np.linalg.solve(spread[:k, :k] / np.outer(scale, scale) + alpha / n * np.eye(k), spread[:k, k] / scale) / scale
    return w, float(mean[k] - w @ mean[:k])


def one_hot(rows: DataFrame, column: str, levels: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns of 0 and 1 for given levels; pass those seen before the target to stay causal."""
    names = [f"{column}_{i}" for i in range(len(levels))]
    return rows.withColumns({n: (F.col(column).cast("string") == str(v)).cast("double") for n, v in zip(names, levels, strict=True)}), names


def walk_forward_ridge(rows: DataFrame, test_days: int | tuple[str, str], columns: list[str]) -> DataFrame:
    """For each test day, a ridge fitted on strictly earlier days; predicted prices of that day's targets.

    ``test_days`` is the number of last days, or the first and the last day of a window.
    """
    rows = rows.withColumn("clipped", _clip(F.col("target_return"), CLIP))
    days, moments = _moments(rows, columns, "clipped")
    before = np.cumsum(moments, axis=0) - moments
    fitted = []
    pairs = list(zip(days, before, strict=True))
    chosen = pairs[-test_days:] if isinstance(test_days, int) else [p for p in pairs if test_days[0] <= p[0].isoformat() <= test_days[1]]
    for day, m in chosen:
        w, b = solve_ridge(m)
        fitted.append((day, w.tolist(), b, int(m[0, 0])))
    spark = rows.sparkSession
    weights = F.broadcast(spark.createDataFrame(fitted, "d date, _weights array<double>, _bias double, training_examples long"))
    r = F.aggregate(F.zip_with("_weights", F.array(*columns), lambda a, x: a * x), F.col("_bias"), lambda s, x: s + x)
    return rows.join(weights, "d").select("series", "d", "last", "actual", (F.col("last") * (1 + _clip(r, CLIP))).alias("ridge"), "training_examples")


def external_forecasts(contexts: DataFrame, predict=None) -> DataFrame:
    """Plug-in for a zero-shot model: ``predict(list of floats) -> float`` over (series, d, h).

    Equal contexts are asked once; without a model, or where it fails, the
    forecast is null and counted, never replaced.
    """
    ship_code(contexts.sparkSession)
    if predict is None:
        return contexts.select("series", "d", F.lit(None).cast("double").alias("external"), F.lit(True).alias("failed"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for h in batch.column("h").to_pylist():
                try:
                    values.append(one_price(predict(h)))
                except Exception:  # a model's own failure is data here
                    values.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(values, pa.float64())], ["h", "external"])

    asked = contexts.select("h").distinct().mapInArrow(ask, "h array<double>, external double")
    return contexts.join(asked, "h", "left").select("series", "d", "external", F.col("external").isNull().alias("failed"))


def one_price(output: object) -> float:
    """The first price in whatever a model returns: a number, nested lists, an array, or an object that has a ``forecast``."""
    prices = np.ravel(np.asarray(getattr(output, "forecast", output), float))
    if not prices.size or not np.isfinite(prices[0]) or prices[0] <= 0:
        raise ValueError("the model gave no price")
    return float(prices[0])


def with_fallback(forecasts: DataFrame, naive: DataFrame) -> DataFrame:
    """A model's forecasts (series, d, external) with the naive one (series, d, mid) where it has none, which ``fallback`` says."""
    both = forecasts.select("series", "d", "external").join(naive.select("series", "d", "mid"), ["series", "d"], "left")
    return both.select("series", "d", F.coalesce("external", "mid").alias("forecast"), F.col("external").isNull().alias("fallback"))


def fallback_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Forecasts per group, and how many of them fell back or lost a covariate."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("fallback").alias("fallbacks"), F.count_if("dropped").alias("covariates_dropped"))
