"""Staged evaluation: a fixed window of targets, models side by side, changes against an earlier stage.

Every stage predicts the targets of the same window from a longer panel.  The
first stage's targets are the cohort of all later ones; a stage that can't
predict one of them fails, since its means would no longer compare.
"""

from __future__ import annotations

import importlib.metadata
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import features, forecast, panel, scoring, sinks

MODELS = ("persistence", "drift5", "weekly", "ridge", "external")
CONTEXT_DAYS = 60


def in_window(targets: DataFrame, start: str, end: str) -> DataFrame:
    """Targets of the days from ``start`` to ``end``, both included."""
    return targets.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def of_cohort(targets: DataFrame, cohort: DataFrame) -> DataFrame:
    """The targets that the cohort has; a cohort's target that is missing is an error."""
    key = ["series", "d"]
    if not cohort.select(*key).join(targets.select(*key), key, "left_anti").isEmpty():
        raise ValueError("the panel can't predict every target of the cohort")
    return targets.join(cohort.select(*key), key, "left_semi")


def predictions(price: DataFrame, window: tuple[str, str], categorical: dict[str, list[str]], cohort: DataFrame | None = None, predict: Callable | None = None) -> DataFrame:
    """One row per target of the window with the forecast of every model, ordered by day and series.

    ``price`` is a built panel with ``identity`` and the columns that
    ``categorical`` names with their levels.  The ridge learns from strictly
    earlier days; the weekly forecast falls back to persistence where the
    history is shorter than a week, which ``weekly_fallback`` says.
    """
    key = ["series", "d"]
    rows = in_window(forecast.targets(price, "identity"), *window)
    if cohort is not None:
        rows = of_cohort(rows, cohort)
    examples, columns = features.examples(price).join(price.select(*key, *categorical), key), [*features.NUMERIC, *features.DAYS]
    for column, levels in categorical.items():
        examples, made = features.one_hot(examples, column, levels)
        columns += made
    ridge = features.walk_forward_ridge(examples.na.fill(0.0, list(features.NUMERIC)), window, columns).select(*key, "ridge", "training_examples")
    contexts = rows.select(*key).join(price.select(*key, panel.context(CONTEXT_DAYS).alias("h")), key)
    external = features.external_forecasts(contexts, predict)
    rows = rows.join(ridge, key, "left").join(external, key, "left")
    rows = rows.withColumn("description_changed", F.col("identity") != F.col("identity_before")).withColumn("weekly_fallback", F.col("history") < panel.WEEK)
    rows = rows.withColumn("context_days", F.least("history", F.lit(CONTEXT_DAYS)))
    return rows.select("d", "series", "last", "actual", "description_changed", *MODELS, "failed", "weekly_fallback", "context_days", "training_examples").orderBy("d", "series")


def metrics(rows: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Per model: targets, error in units and percent, direction accuracy, percent of the error saved."""
    def of(model: str) -> DataFrame:
        scored = scoring.labelled(rows.where(F.col(model).isNotNull()), model)
        return scoring.skill(scored, model).crossJoin(scoring.errors(scored, model).select("mape")).withColumn("model", F.lit(model))

    out = of(models[0])
    for model in models[1:]:
        out = out.unionByName(of(model))
    return out


def evaluate(spark: SparkSession, stage: str, rows: DataFrame, folder: str, earlier: str | None = None) -> dict:
    """Store a stage's predictions and its summary; ``earlier`` names a stored stage to compare with.

    The summary holds the models' metrics, how often each fell back or failed,
    the moves that came with another product, the versions of the engines, and
    per model the change of the error against the earlier stage with the
    interval of whole days drawn anew.
    """
    path = f"{folder}/{stage}"
    rows.write.mode("overwrite").parquet(f"{path}/predictions")
    rows = spark.read.parquet(f"{path}/predictions")
    moves = scoring.labelled(rows).where(F.col("real_dir") != forecast.NAMES[2])
    counts = rows.agg(F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"), F.count(F.lit(1)).alias("targets"), F.count_if("weekly_fallback").alias("weekly_fallbacks"), F.count_if("failed").alias("external_failures"))
    made = {
        "stage": stage, **counts.first().asDict(),
        "metrics": {r["model"]: {k: v for k, v in r.asDict().items() if k != "model"} for r in metrics(rows).collect()},
        "assortment": moves.agg(F.count(F.lit(1)).alias("moves"), F.count_if("description_changed").alias("with_description_change")).first().asDict(),
        "engines": {"ridge_alpha": features.ALPHA, "packages": {p: importlib.metadata.version(p) for p in ("pyspark", "numpy", "pyarrow")}},
    }
    if earlier is not None:
        before = spark.read.parquet(f"{folder}/{earlier}/predictions")
        made["change"] = {m: scoring.bootstrap_frame(scoring.paired(before, rows, m, m)).first().asDict() for m in MODELS}
        made["compared_with"] = earlier
    sinks.publish_json(spark, made, f"{path}/summary.json")
    return made
