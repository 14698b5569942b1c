"""Offers, baskets, identities and presentation rules."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit, offers, present, sinks
from tallyloom.operators.basket_catalogue import items


def frame(spark, rows):
    return spark.createDataFrame(rows, "zone string, chain string, item string, price double, k int")


def test_outliers_keep_the_band_inclusive(spark):
    rows = frame(spark, [("r", "1", "a", 100.0, 1), ("r", "2", "a", 100.0, 2), ("r", "3", "a", 15.0, 3), ("r", "3", "a", 650.0, 4), ("r", "3", "a", 651.0, 5), ("r", "9", "a", None, 6), ("r", "9", "a", 0.0, 7)])
    # Minima are 100, 100 and 15: the median is 100, so 15 and 650 just stay.
    verdicts = {r["k"]: r["verdict"] for r in offers.judged(rows).collect()}
    assert verdicts == {1: "kept", 2: "kept", 3: "kept", 4: "kept", 5: "outlier", 6: "no price", 7: "no price"}


def test_median_of_even_number_of_chains(spark):
    rows = frame(spark, [("r", c, "a", p, 1) for c, p in (("1", 1.0), ("2", 2.0), ("3", 10.0), ("4", 20.0), ("4", 99.0))])
    assert offers.reference_prices(rows).first()["median_price"] == 6.0


def test_cheapest_first_seen_wins_ties(spark):
    rows = frame(spark, [("r", "1", "a", 5.0, 2), ("r", "1", "a", 5.0, 1), ("r", "1", "a", 6.0, 0)])
    assert offers.cheapest(rows, ["chain", "item"], ["k"]).first()["k"] == 1


def test_cheapest_chain_ties_in_text_order(spark):
    rows = frame(spark, [("r", "2", "a", 5.0, 1), ("r", "10", "a", 5.0, 1)])
    assert offers.cheapest_chain(rows).first()["chain"] == "10"


def test_zone_baskets(spark):
    rows = frame(spark, [("r", "1", "a", 5.0, 1), ("g", "1", "a", 4.0, 2), ("g", "1", "b", 1.0, 3)]).withColumn("need_qty", F.lit(2.0))
    got = {(r["zone"], r["chain"]): (r["total"], r["items_found"]) for r in offers.zone_baskets(rows, ["k"]).collect()}
    assert got == {("r", "1"): (10.0, 1), ("g", "1"): (10.0, 2), ("all", "1"): (10.0, 2)}


def test_quarantine(spark):
    rows = spark.createDataFrame([("1", "x", 1500.0), ("1", "x", 2000.0), ("2", "y", 3.0), ("2", "y", 3.0), ("3", "z", None)], "id string, d string, price double")
    got = {r["id"]: r for r in offers.quarantine(rows, ["id"], ["d", "price"], "price").collect()}
    assert got["1"]["price"] is None and got["1"]["identity_conflict"] and len(got["1"]["source_variants"]) == 2
    assert got["2"]["price"] == 3.0 and got["2"]["duplicate_rows"] == 1 and not got["2"]["identity_conflict"]
    counts = {r["id"]: (r["n_rows"], r["n_variants"]) for r in offers.identities(rows, ["id"], ["d", "price"]).collect()}
    assert counts == {"1": (2, 2), "2": (2, 1), "3": (1, 1)}


@pytest.mark.parametrize(("province", "place", "lat", "lon", "narrow", "wide"), [("AR-S", "Rosario", None, None, True, True), (" AR-S", "funes ", "", "", False, True), ("AR-S", "X", "-33,1", "-60.4", False, True), ("AR-S", "X", "-33,2", "-60.4", False, False), ("AR-B", "Rosario", None, None, False, False), ("AR-S", None, "bad", "-60.7", False, False), (None, None, None, None, False, False)])
def test_area(spark, province, place, lat, lon, narrow, wide):
    df = spark.createDataFrame([(province, place, lat, lon)], "p string, l string, a string, o string")
    got = df.select(*(offers.in_area(F.col("p"), F.col("l"), F.col("a"), F.col("o"), w) for w in (False, True))).first()
    assert got[:] == (narrow, wide)


def test_basket_dimension(spark):
    df = items(spark)
    assert df.count() == 25 and df.select("item_id").distinct().count() == 25


def test_highlight_needs_two_and_marks_all_ties(spark):
    rows = frame(spark, [("r", "1", "a", 5.0, 1), ("r", "2", "a", 5.0, 1), ("r", "3", "a", 6.0, 1), ("r", "1", "b", 2.0, 1)]).withColumn("comparable", F.lit(True))
    got = {(r["item"], r["chain"]): r["best"] for r in present.highlighted(rows).collect()}
    assert got == {("a", "1"): True, ("a", "2"): True, ("a", "3"): False, ("b", "1"): False}


def test_forecast_shown_only_beside_its_own_price(spark):
    cells = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 10.0), ("d", 10.0)], "series string, price double")
    made = spark.createDataFrame([("a", "sube", 10.01, 11.0, 9.0), ("b", "sube", 10.1, 11.0, 9.0), ("c", "sube", 10.0, float("nan"), 1.0), ("d", "quizás", 10.0, 11.0, 9.0)], "series string, dir string, last double, pred double, delta_pct double")
    got = {r["series"]: r["shown"] for r in present.with_forecast(cells, made, ["series"]).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_revision_choice(spark):
    rows = [("d", 1, "2024-02-01", False, "u"), ("d", 2, "2024-01-01", True, "u"), ("d", 3, "2024-01-15", False, "u"), ("d", 4, "2023-01-01", False, None)]
    df = spark.createDataFrame(rows, "d string, id int, first_seen string, has_warnings boolean, link string")
    assert audit.best_revision(df).first()["id"] == 3


def test_overlap_and_work_list(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, price double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.5), ("w", 3.0)], "k string, price double")
    assert {r["k"]: r["status"] for r in audit.overlap(a, b, ["k"], "price").collect()} == {"x": "same_price", "y": "changed", "z": "only_local", "w": "only_archive"}


def test_archive_dates(spark):
    names = spark.createDataFrame([("2024-01-01/a.csv",), ("2024-01-01/b/2024-01-02.csv",)], "n string")
    got = audit.archive_dates(names, "n", "2024-01-01").first()
    assert got["dates"] == ["2024-01-01", "2024-01-02"] and not got["valid"]


def test_older_import_does_not_rewind_latest(spark, tmp_path):
    path = str(tmp_path / "snap")
    for day in ("2024-05-02", "2024-05-01"):
        sinks.write_observations(spark.createDataFrame([(day, 1.0)], "date string, price double"), path)
    got = sinks.latest(spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))).collect()
    assert [r["date"] for r in got] == ["2024-05-02"]
    sinks.write_observations(spark.createDataFrame([("2024-05-01", 9.0)], "date string, price double"), path)
    assert spark.read.parquet(path).count() == 2  # the day was replaced, not added


def test_manifest_keeps_the_latest_state(spark, tmp_path):
    path = str(tmp_path / "log")
    for state in ("failed", "imported"):
        sinks.append_manifest(spark.createDataFrame([("2024-05-01", state)], "d string, status string"), path)
    assert [r["status"] for r in sinks.read_manifest(spark, path).collect()] == ["imported"]
