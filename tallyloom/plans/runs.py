"""Runs over stored days: the next day's forecast, staged evaluation, the audit, and covariates.

All start from the snapshots and the manifest that imports leave below a folder,
and leave a file or a table there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.numbers import round_exact
from tallyloom.operators import audit, covariates, forecast, panel, sinks
from tallyloom.plans import backfill, daily, evaluation
from tallyloom.sources import snapshots

_CELL = "price double, price_lista double, normalized_quantity double, descripcion string, marca string"
_SNAPSHOT = "date string, price_normalization_version string, source string, table array<struct<item: string, prices: string>>"
FORECAST_DAYS = 30


def stored_snapshots(spark: SparkSession, output: str) -> DataFrame:
    """The days' snapshots: one row a day."""
    rows = spark.read.text(f"{output}/snapshots/date=*", wholetext=True)
    return rows.select(F.from_json("value", _SNAPSHOT).alias("s")).select("s.*").where("date is not null")


def cells_of(days: DataFrame) -> DataFrame:
    """Cells of whole-area tables: date, item, chain and what a cell shows."""
    rows = days.select("date", "price_normalization_version", F.explode("table").alias("t"))
    prices = F.from_json("t.prices", f"map<string, struct<{_CELL.replace(' ', ': ').replace(',:', ',')}>>")
    return rows.select("date", "price_normalization_version", F.col("t.item").alias("item"), F.explode(prices).alias("chain", "cell")).select("date", "price_normalization_version", "item", "chain", "cell.*")


def price_panel(cells: DataFrame) -> DataFrame:
    """The panel of cheapest prices by series, with its item and chain in columns of their own."""
    made = daily.price_panel(cells.where(F.col("price").isNotNull()))
    return made.withColumns({"item": F.split_part("series", F.lit("__"), F.lit(1)), "chain": F.split_part("series", F.lit("__"), F.lit(2))})


def checked_cells(spark: SparkSession, output: str) -> DataFrame:
    """All days' cells; days of different normalisation versions don't compare, so they fail."""
    days = stored_snapshots(spark, output)
    versions = [r[0] for r in days.select("price_normalization_version").distinct().collect()]  # one, or an error
    if versions != [daily.VERSION]:
        raise ValueError(f"mixed or unknown normalisation versions: {sorted(map(str, versions))}" if versions else "no snapshots")
    return cells_of(days)


def forecast_run(spark: SparkSession, output: str, path: str) -> int:
    """The next day's forecast of every series, from the last FORECAST_DAYS days, as one file; returns the number of series."""
    days = panel.last_days(price_panel(checked_cells(spark, output)), FORECAST_DAYS)
    made = forecast.next_day(days)
    made = made.withColumns({c: round_exact(F.col(c), 2) for c in ("delta_pct", "pred", "last")})
    span = days.agg(F.max("d").cast("string").alias("as_of")).first()["as_of"]
    return sinks.forecast_file(made, path, daily.VERSION, {"as_of": span, "real_days": stored_snapshots(spark, output).count()})


def evaluation_run(spark: SparkSession, output: str, stage: str, window: tuple[str, str], since: str | None = None, earlier: str | None = None, predict: Callable | None = None) -> dict:
    """A stage of the evaluation over the days from ``since`` on; ``earlier`` names the stage whose targets it must have, and compares with."""
    cells = checked_cells(spark, output)
    price = price_panel(cells if since is None else cells.where(F.col("date") >= since))
    levels = {c: sorted(r[0] for r in cells.select(c).distinct().collect()) for c in ("item", "chain")}  # 25 items, 8 chains
    folder = f"{output}/evaluation"
    cohort = None if earlier is None else spark.read.parquet(f"{folder}/{earlier}/predictions")
    return evaluation.evaluate(spark, stage, evaluation.predictions(price, window, levels, cohort, predict), folder, earlier)


def audit_frames(days: DataFrame, cells: DataFrame, entries: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """What an audit finds, each as a table.

    ``days`` has d and source (null for days that weren't imported), ``entries``
    the index (d, id, link), ``manifest`` the latest record of each day.  A
    linked day without snapshot is rejected if every linked revision was tried
    and each held another day; else it is unresolved.
    """
    linked = audit.linked(entries)
    span = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("d"))
    open_, dark = audit.unresolved_days(span, linked, days)
    tried = manifest.select("d", F.explode("rejected").alias("r")).select("d", F.col("r.revision").alias("id"), F.col("r.error").contains("expected").alias("mismatch"))
    tried = tried.groupBy("d", "id").agg(F.bool_and("mismatch").alias("mismatch"), F.lit(True).alias("was"))
    attempts = linked.join(open_, "d", "left_semi").join(tried, ["d", "id"], "left").select("d", F.coalesce("was", F.lit(False)).alias("tried"), "mismatch")
    verdict = audit.revision_verdict(attempts)
    counted = audit.cell_counters(cells.select(F.to_date("date").alias("d"), "price"))
    return {
        "rejected": verdict.where("rejected").select("d"), "unresolved": verdict.where("not rejected").select("d"), "unavailable": dark,
        "inconsistent": audit.inconsistent_cells(cells), "cells": counted, "imports": audit.import_counters(manifest),
    }


def audit_run(spark: SparkSession, output: str, index: Mapping[str, Sequence[Mapping]]) -> tuple[dict, bool]:
    """The audit of all stored days as a file, and whether every linked day is accounted for and every cell consistent."""
    stored = stored_snapshots(spark, output)
    days = stored.select(F.to_date("date").alias("d"), "source")
    found = audit_frames(days, checked_cells(spark, output), backfill.index_entries(spark, index), sinks.read_manifest(spark, f"{output}/manifest"))
    dates = lambda k: sorted(str(r["d"]) for r in found[k].collect())  # noqa: E731  one row a day
    made = {k: dates(k) for k in ("rejected", "unresolved", "unavailable")}
    made |= days.agg(F.count(F.lit(1)).alias("snapshots"), F.count("source").alias("new_snapshots"), F.min("d").cast("string").alias("first_date"), F.max("d").cast("string").alias("last_date")).first().asDict()
    made |= found["cells"].first().asDict() | {"inconsistent_cells": found["inconsistent"].count(), "imports": [r.asDict() for r in found["imports"].collect()]}
    sinks.publish_json(spark, made, f"{output}/audit.json")
    return made, not made["unresolved"] and not made["inconsistent_cells"]


def covariate_table(days: DataFrame, currency: DataFrame, index: DataFrame) -> DataFrame:
    """One row a day: both rates carried at most ten days, their gap, the volatility of the free one, and the index known by then.

    A source that has nothing stays null, and so does an index whose last month
    ended too long before the last day.
    """
    span = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    if span["a"] is None:
        return days.select("d").limit(0)
    wide = covariates_by_day(currency, str(span["a"]), str(span["b"]))
    known = covariates.published(index)
    old = known.where("value is not null").agg((F.datediff(F.lit(span["b"]), F.max("month_end")) > covariates.STALE_DAYS).alias("stale")).first()["stale"]
    asked = covariates.as_of(days.select("d").distinct(), known if not old else known.limit(0))
    return asked.join(wide, "d", "left").withColumnRenamed("index_value", "ipim_index")


def covariates_by_day(currency: DataFrame, start: str, end: str) -> DataFrame:
    rates = {"Blue": "fx_blue", "Oficial": "fx_oficial"}
    long = currency.where(F.col("source").isin(*rates)).select(F.col("source").alias("series"), "d", F.col("value_sell").alias("p"))
    filled = panel.filled_between(long, start, end)
    wide = filled.groupBy("d").agg(*(F.max(F.when(F.col("series") == k, F.col("pf"))).alias(v) for k, v in rates.items()))
    wide = wide.withColumns({"fx_mep": F.lit(None).cast("double"), "fx_gap": covariates.gap(F.col("fx_blue"), F.col("fx_oficial"))})
    return covariates.rolling_volatility(wide, "fx_blue").withColumnRenamed("volatility", "fx_volatility").drop("log_return")


def covariates_run(spark: SparkSession, output: str, currency_path: str, index_path: str) -> int:
    """Covariates of all stored days, and the competitors' lowest prices, as tables below ``output``; returns the number of days."""
    cells = checked_cells(spark, output)
    days = cells.select(F.to_date("date").alias("d")).distinct()
    table = covariate_table(days, snapshots.read_currency(spark, currency_path), snapshots.read_monthly_index(spark, index_path))
    table.write.mode("overwrite").parquet(f"{output}/covariates")
    rivals = covariates.competitor_min(cells.select("item", F.to_date("date").alias("d"), "chain", "price"))
    rivals.write.mode("overwrite").parquet(f"{output}/competitors")
    return spark.read.parquet(f"{output}/covariates").count()
