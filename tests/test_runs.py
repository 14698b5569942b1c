"""Runs over stored days: forecast, evaluation, audit and covariates, from snapshots written here."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyloom import __main__ as command
from tallyloom.operators import sinks
from tallyloom.plans import backfill, daily, runs

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]


def snapshot(day, k, chains=("10", "12"), version=daily.VERSION, price=None):
    cell = lambda p: {"price": p, "price_lista": p * 2, "normalized_quantity": 2.0, "descripcion": f"d{k // 5}", "marca": "m"}
    prices = lambda n: {c: cell(price or round(100.0 + n * 10 + (k * (n + 1 + i) % 7), 2)) for i, c in enumerate(chains)}
    table = [{"ord": n, "item": item, "cheapest_chain": chains[0], "prices": json.dumps(prices(n))} for n, item in enumerate(("arroz", "pan_lactal"))]
    return {"date": str(day), "price_normalization_version": version, "source": json.dumps({"revision": k}) if k % 2 else None, "table": table}


@pytest.fixture
def stored(spark, tmp_path):
    for k, day in enumerate(DAYS):
        if k in (20, 30):
            continue
        folder = tmp_path / "snapshots" / f"date={day}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(json.dumps(snapshot(day, k)))
    return str(tmp_path)


def test_cells_keep_item_and_chain_apart(spark, stored):
    cells = runs.checked_cells(spark, stored)
    assert cells.count() == 38 * 4
    made = runs.price_panel(cells)
    assert {(r["series"], r["item"], r["chain"]) for r in made.select("series", "item", "chain").distinct().collect()} == {(f"{i}__{c}", i, c) for i in ("arroz", "pan_lactal") for c in ("10", "12")}
    assert made.where("observed").count() == 38 * 4 and made.count() == 40 * 4


def test_forecast_command(spark, stored, capsys):
    assert command.main(["forecast", "--output", stored]) == 0
    assert json.loads(capsys.readouterr().out) == {"series": 4}
    made = json.loads(open(f"{stored}/forecast-next.json", encoding="utf-8").read())
    assert made["as_of"] == str(DAYS[-1]) and made["real_days"] == 38 and set(made["items"]) == {f"{i}__{c}" for i in ("arroz", "pan_lactal") for c in ("10", "12")}
    one = made["items"]["arroz__10"]
    values = [100.0 + (k * 1 % 7) for k in range(34, 40)]
    drift = sum(b - a for a, b in zip(values, values[1:], strict=False)) / 5
    assert one["last"] == values[-1] and one["pred"] == pytest.approx(values[-1] + drift, abs=0.006) and one["dir"] in ("sube", "baja", "estable")


def test_evaluation_command_compares_stages(spark, stored, capsys):
    window = ["--start", "2024-02-05", "--end", "2024-02-09", "--output", stored]
    assert command.main(["evaluate", "--stage", "baseline", "--since", "2024-01-22", *window]) == 0
    assert command.main(["evaluate", "--stage", "full", "--earlier", "baseline", *window]) == 0
    first, second = map(json.loads, capsys.readouterr().out.strip().split("\n"))
    assert first["targets"] == second["targets"] == 20
    summary = json.loads(spark.read.text(f"{stored}/evaluation/full/summary.json", wholetext=True).first()["value"])
    assert summary["change"]["persistence"]["mae_delta"] == 0 and summary["compared_with"] == "baseline"


def test_audit_command_finds_what_is_open(spark, stored, tmp_path, capsys):
    error = lambda r, text: {"revision": r, "url": "u", "error": text}
    gone, open_ = str(DAYS[20]), str(DAYS[30])
    records = [
        {"d": DAYS[20], "status": "failed", "rejected": [error(1, "a.tar: expected x, found y"), error(2, "a.tar: expected x, found z")]},
        {"d": DAYS[30], "status": "failed", "rejected": [error(3, "a.tar: expected x, found y")]},
        {"d": DAYS[1], "status": "imported", "observations": 5, "conflicts": 1, "compressed_bytes": 7, "import_version": "v"},
    ]
    sinks.append_manifest(spark.createDataFrame(records, backfill.MANIFEST), f"{stored}/manifest")
    entry = lambda i, link="u": {"id": i, "name": "n", "link": link}
    index = {gone: [entry(1), entry(2), entry(9, None)], open_: [entry(3), entry(4)], str(DAYS[1]): [entry(5)]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    assert command.main(["audit", "--index", str(tmp_path / "index.json"), "--output", stored]) == 1
    made = json.loads(capsys.readouterr().out)
    assert (made["rejected"], made["unresolved"], made["unavailable"]) == ([gone], [open_], [])
    assert (made["snapshots"], made["new_snapshots"], made["min_cells"], made["max_cells"], made["inconsistent_cells"]) == (38, 20, 4, 4, 0)
    assert made["imports"] == [{"import_version": "v", "days": 1, "bytes": 7, "observations": 5, "conflicts": 1}]
    del index[open_]
    (tmp_path / "index.json").write_text(json.dumps(index))
    assert command.main(["audit", "--index", str(tmp_path / "index.json"), "--output", stored]) == 0
    assert json.loads(capsys.readouterr().out)["unavailable"] == [open_]


def test_mixed_versions_fail(spark, stored, tmp_path):
    (tmp_path / "snapshots" / "date=2024-03-01").mkdir()
    (tmp_path / "snapshots" / "date=2024-03-01" / "part-0.txt").write_text(json.dumps(snapshot(dt.date(2024, 3, 1), 1, version="old")))
    with pytest.raises(ValueError, match="mixed"):
        runs.checked_cells(spark, stored)


def test_covariates_command(spark, stored, tmp_path, capsys):
    rates = [{"date": str(d), "source": s, "value_sell": 100.0 + 10 * (s == "Blue") + k, "value_buy": 1.0} for k, d in enumerate(DAYS) for s in ("Blue", "Oficial") if not 5 <= k < 18]
    (tmp_path / "fx.json").write_text(json.dumps(rates))
    (tmp_path / "ix.json").write_text(json.dumps({"data": [["2023-10-01", 1.5], ["2023-11-01", 2.5], ["2023-12-01", None]]}))
    args = ["covariates", "--currency", str(tmp_path / "fx.json"), "--prices-index", str(tmp_path / "ix.json"), "--output", stored]
    assert command.main(args) == 0 and json.loads(capsys.readouterr().out) == {"days": 38}
    rows = {r["d"]: r for r in spark.read.parquet(f"{stored}/covariates").collect()}
    assert (rows[DAYS[14]]["fx_blue"], rows[DAYS[15]]["fx_blue"], rows[DAYS[18]]["fx_blue"]) == (114.0, None, 128.0)
    assert rows[DAYS[0]]["fx_gap"] == pytest.approx(0.1) and rows[DAYS[0]]["fx_mep"] is None and rows[DAYS[4]]["fx_volatility"] > 0
    assert (rows[DAYS[27]]["ipim_index"], rows[DAYS[28]]["ipim_index"], rows[DAYS[29]]["ipim_index"]) == (1.5, 2.5, 2.5)
    assert spark.read.parquet(f"{stored}/competitors").where(F.col("competitor_price").isNull()).count() == 0
    (tmp_path / "ix.json").write_text(json.dumps({"data": [["2023-09-01", 1.5]]}))
    command.main(args)
    assert spark.read.parquet(f"{stored}/covariates").where("ipim_index is not null").count() == 0
