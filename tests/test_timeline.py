"""Order over stretches against plain Python, with every number of tasks."""

import random
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import covariates, offers, timeline


@pytest.mark.parametrize("tasks", [1, 3, 16])
def test_medians_of_hot_and_small_groups(spark, tasks):
    rng = random.Random(tasks)
    rows = [("hot", float(rng.randint(1, 40))) for _ in range(901)] + [("even", 1.0), ("even", 4.0), ("odd", 3.0), ("odd", 9.0), ("odd", 1.0), ("same", 7.0), ("same", 7.0), ("none", None), (None, 2.0), (None, 5.0), ("half", None), ("half", 8.0)]
    got = {r["g"]: r["median"] for r in timeline.medians(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", tasks).collect()}
    groups = {g: [x for h, x in rows if h == g and x is not None] for g, _ in rows}
    assert got == {g: statistics.median(x) if x else None for g, x in groups.items()}


def test_reference_prices_spread_over_tasks_are_the_same(spark):
    rows = spark.createDataFrame([(f"i{k % 3}", f"c{k % 17}", float(k % 29)) for k in range(400)], "item string, chain string, price double")
    show = lambda df: sorted(map(tuple, df.collect()))
    assert show(offers.reference_prices(rows)) == show(offers.reference_prices(rows, spread=True))
    assert offers.reference_prices(rows.limit(0), spread=True).count() == 0


@pytest.mark.parametrize("tasks", [1, 4, 30])
def test_last_known_value_crosses_stretches(spark, tasks):
    rng = random.Random(tasks)
    rows = [(t, rng.choice([None, None, None, rng.random()])) for t in range(200)] + [(None, 0.5)]
    got = {r["t"]: r["x"] for r in timeline.last_known(spark.createDataFrame(rows, "t int, x double"), ["t"], "x", tasks).collect()}
    known, want = None, {}
    for t, x in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        known = x if x is not None else known
        want[t] = known
    assert got == want


@pytest.mark.parametrize("tasks", [1, 4, 40])
def test_windows_look_back_over_stretches(spark, tasks):
    rng = random.Random(tasks)
    rows = [(date(2024, 1, 1) + timedelta(days=i), rng.choice([None, rng.uniform(-5, 50), rng.uniform(1, 9)])) for i in range(90)]
    df = spark.createDataFrame(rows, "d date, v double")
    plain = covariates.rolling_volatility(df.withColumn("one", F.lit(1)), "v", by=("one",)).select("d", "log_return", "volatility").orderBy("d").collect()
    add = []
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        found = covariates.rolling_volatility(df, "v")
        add.append(found._jdf.queryExecution().executedPlan().toString())
        got = found.select("d", "log_return", "volatility").orderBy("d").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain and any(r["volatility"] is not None for r in got)
    assert "SinglePartition" not in add[0]


def test_as_of_keeps_rows_columns_and_the_larger_of_equal_days(spark):
    day = lambda n: date(2024, 1, n)
    known = spark.createDataFrame([(day(3), 1.0), (day(3), 2.0), (day(8), None), (day(10), 3.0), (None, 9.0)], "known_on date, value double")
    days = spark.createDataFrame([(day(1), "a"), (day(3), "b"), (day(9), "c"), (day(9), "d"), (day(12), "e"), (None, "f")], "d date, `x.y` string")
    got = {r["x.y"]: r["index_value"] for r in covariates.as_of(days, known).collect()}
    assert got == {"a": None, "b": 2.0, "c": 2.0, "d": 2.0, "e": 3.0, "f": None}
    assert covariates.as_of(days, known.limit(0)).where("index_value is not null").count() == 0
    assert covariates.as_of(days.limit(0), known).count() == 0
