"""A day from archive to snapshot, reprocessing, and the backtest of a small panel."""

import datetime as dt
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom import __main__ as command
from tallyloom.operators import audit, panel, sinks
from tallyloom.plans import backfill, daily, evaluation
from tallyloom.sources import archives

BRANCHES = """id_comercio|id_bandera|id_sucursal|sucursales_nombre|sucursales_localidad|sucursales_provincia|sucursales_latitud|sucursales_longitud
{c}|1|01|uno|Rosario|AR-S|-32,9|-60,7
{c}|1|02|dos|Funes|AR-S||
{c}|1|03|tres|Lejos|AR-B||
"""
HEAD = "id_comercio|id_bandera|id_sucursal|id_producto|productos_descripcion|productos_cantidad_presentacion|productos_unidad_medida_presentacion|productos_marca|productos_precio_lista\n"
ROWS = [
    ("01", "p1", "Arroz largo fino", "1", "KG", "m", "{a}"), ("02", "p1", "Arroz largo fino", "1", "KG", "m", "{b}"), ("03", "p1", "Arroz largo fino", "1", "KG", "m", "1"),
    ("01", "p2", "Leche entera 1 L", "1", "UNI", "m", "50"), ("01", "p3", "Huevo blanco", "1", "UNI", "m", "9"), ("01", "p4", "Clavos", "1", "KG", "m", "9"),
    ("01", "p5", "Manteca 200 g", "200", "GRM", "m", "20"), ("01", "p5", "Manteca 200 g", "200", "GRM", "m", "30"), ("02", "p6", "Azúcar 1 kg", "1", "KG", "m", "inf"),
]


def archive(path):
    with zipfile.ZipFile(path, "w") as outer:
        for chain, a, b in (("10", "100", "90"), ("12", "110", "5000"), ("23", "1", "1")):
            inner = io.BytesIO()
            with zipfile.ZipFile(inner, "w") as z:
                z.writestr("sucursales.csv", BRANCHES.format(c=chain))
                if chain == "10":
                    z.writestr("comercio.csv", "id_comercio|id_bandera|comercio_razon_social|comercio_bandera_nombre\n10|1|SA|Diez\n")
                z.writestr("productos.csv", HEAD + "\n".join("|".join((chain, "1", *r)).format(a=a, b=b) for r in ROWS) + "\n")
            outer.writestr(f"{chain}.zip", inner.getvalue())


def test_day(spark, tmp_path):
    archive(tmp_path / "a.zip")
    raw, snap = str(tmp_path / "raw"), str(tmp_path / "snap")
    path = str(tmp_path / "a.zip")
    rows = daily.observations(spark, path, daily.area_branches(archives.scan(spark, path)))
    got = {(r["chain_id"], r["branch_id"], r["product_id"], r["price_lista"]): (r["item"], r["price"], r["price_basis"]) for r in rows.collect()}
    assert got["10", "01", "p2", 50.0] == ("leche_entera", 50.0, "description") and got["10", "01", "p1", 100.0] == ("arroz", 100.0, "presentation")
    assert got["10", "01", "p3", 9.0] == ("huevo", None, "unverified") and not any(k[0] == "23" or k[1] == "03" or k[2] in ("p4", "p6") for k in got)
    counts = daily.run_day(spark, path, "2024-05-01", raw, snap, source={"revision": 7})
    assert counts == {"observations": 10, "duplicate_rows": 2, "conflicts": 2, "branches": 4}
    stored = {(r["chain_id"], r["product_id"], r["branch_id"]): r for r in daily.raw_day(spark, raw, "2024-05-01").collect()}
    butter = stored["10", "p5", "01"]
    assert butter["price"] is None and butter["identity_conflict"] and len(butter["source_variants"]) == 2
    made = json.loads(spark.read.text(f"{snap}/date=2024-05-01").first()["value"])
    totals = {h["chain_id"]: h["total"] for h in made["hero"]}
    # The 5000 of chain 12 is an outlier; rice needs 1 kg and milk 1 litre.
    assert totals == {"10": 140.0, "12": 160.0} and [(h["chain_id"], h["chain_label"]) for h in made["hero"]] == [("10", "Diez"), ("12", "12")]
    assert made["branches_count"] == 4 and {z: v["branches_count"] for z, v in made["zones"].items()} == {"rosario": 2, "gran": 2}
    rice = next(r for r in made["table"] if r["item"] == "arroz")
    shown = json.loads(rice["prices"])
    assert rice["cheapest_chain"] == "10" and shown["10"]["price"] == 90.0 and shown["10"]["branch_id"] == "02" and shown["12"]["price_basis"] == "presentation"
    assert {h["chain_id"]: h["total"] for h in made["zones"]["gran"]["hero"]} == {"10": 90.0}
    assert json.loads(made["source"]) == {"revision": 7} and made["chains"][0] == {"id": "10", "label": "Diez"}
    before = sorted(map(str, daily.raw_day(spark, raw, "2024-05-01").collect()))
    for options in ({"rematch": True}, {"drop_outliers": False}):
        daily.rebuild_day(spark, raw, "2024-05-01", str(tmp_path / "again"), **options)
        again = json.loads(spark.read.text(f"{tmp_path}/again/date=2024-05-01").first()["value"])
        assert {h["chain_id"]: h["total"] for h in again["hero"]} == totals
    assert sorted(map(str, daily.raw_day(spark, raw, "2024-05-01").collect())) == before


def test_day_of_another_date_is_refused(spark, tmp_path):
    with tarfile.open(tmp_path / "d.tar", "w") as t:
        for name, text in (("2024-05-02/shop/sucursales.csv", BRANCHES.format(c="10")), ("2024-05-02/shop/productos.csv", HEAD + "10|1|01|p1|Arroz|1|KG|m|5\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    path, raw, snap = str(tmp_path / "d.tar"), str(tmp_path / "raw"), str(tmp_path / "snap")
    with pytest.raises(ValueError, match="expected 2024-05-01, found .*2024-05-02"):
        daily.run_day(spark, path, "2024-05-01", raw, snap)
    assert daily.run_day(spark, path, "2024-05-02", raw, snap)["observations"] == 1


def test_backtest_summary(spark, tmp_path):
    rows = [(str(dt.date(2024, 1, 1) + dt.timedelta(days=i)), "arroz", c, 100.0 + 10 * ((i * k) % 3), f"d{i // 4}", "m") for i in range(25) for k, c in enumerate(("10", "12"), 1)]
    best = spark.createDataFrame(rows, "date string, item string, chain string, price double, descripcion string, marca string")
    made = daily.backtest(daily.price_panel(best))
    assert made["rates"]["n"] == sum(made["distribution"].values()) > 30
    assert set(made["daily"]) == {"sube", "baja", "estable"} and made["assortment"]["moves"] > 0
    names = spark.createDataFrame([("arroz__10", "Almacén")], "series string, category string")
    written = daily.write_backtest(daily.price_panel(best), str(tmp_path / "backtest.json"), names)
    assert json.loads((tmp_path / "backtest.json").read_text(encoding="utf-8")) == written and written["series"] == 2
    assert set(written["categories"]) == {"Almacén", "Otro"} and sum(c["n"] for c in written["categories"].values()) == made["rates"]["n"]
    assert daily.checked_versions(best.withColumn("price_normalization_version", F.lit("v"))).count() == 1


class Reply(io.BytesIO):
    headers = None


def day_tar(day):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, text in ((f"{day}/shop/sucursales.csv", BRANCHES.format(c="10")), (f"{day}/shop/productos.csv", HEAD + "10|1|01|p1|Arroz|1|KG|m|5\n")):
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            t.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_backfill_tries_revisions_resumes_and_keeps_a_manifest(spark, tmp_path):
    # Of the second day, the revision without warnings holds another day; of the fourth, all do.
    index = {
        "2024-05-01": [{"id": 1, "name": "a.tar", "link": "u/2024-05-01", "firstSeenAt": "1"}],
        "2024-05-02": [{"id": 3, "name": "b.tar", "link": "u/2024-05-02", "warnings": "late"}, {"id": 2, "name": "c.tar", "link": "u/2024-05-09"}],
        "2024-05-03": [{"id": 4, "name": "d.tar", "link": None}],
        "2024-05-04": [{"id": 5, "name": "e.tar", "link": "u/2024-05-08"}, {"id": 6, "name": "../f.tar", "link": "u/2024-05-04"}],
    }
    asked = []

    def opener(url):
        asked.append(url)
        return Reply(day_tar(url[2:]))

    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    done = {str(r["d"]): r for r in backfill.backfill(spark, index, "2024-05-01", "2024-05-04", out, cache, opener=opener).collect()}
    assert {d: r["status"] for d, r in done.items()} == {"2024-05-01": "imported", "2024-05-02": "imported", "2024-05-03": "unavailable", "2024-05-04": "failed"}
    second = done["2024-05-02"]
    assert second["revision"] == 3 and [x["revision"] for x in second["rejected"]] == [2] and "2024-05-09" in second["rejected"][0]["error"]
    assert second["observations"] == 1 and len(second["sha256"]) == 64 and "unsafe" in done["2024-05-04"]["rejected"][1]["error"]
    known = audit.with_known_source(spark.createDataFrame([second["url"], "x"], "string").selectExpr("value as url", "3L as revision"), backfill.index_entries(spark, index).selectExpr("link as url", "id as revision"))
    assert known.count() == 1
    asked.clear()
    again = {str(r["d"]): r["status"] for r in backfill.backfill(spark, index, "2024-05-01", "2024-05-03", out, cache, opener=opener).collect()}
    assert again == {"2024-05-01": "existing", "2024-05-02": "existing", "2024-05-03": "unavailable"} and not asked


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "day.tar").write_bytes(day_tar("2024-05-01"))
    out = str(tmp_path / "out")
    assert command.main(["day", str(tmp_path / "day.tar"), "--date", "2024-05-01", "--output", out]) == 0
    assert json.loads(capsys.readouterr().out)["observations"] == 1
    assert command.main(["rebuild", "--date", "2024-05-01", "--output", out, "--rematch"]) == 0
    (tmp_path / "index.json").write_text(json.dumps({"2024-05-02": [{"id": 1, "name": "x.tar", "link": (tmp_path / "none").as_uri()}]}))
    args = ["backfill", "--index", str(tmp_path / "index.json"), "--start", "2024-05-01", "--end", "2024-05-02", "--cache", str(tmp_path / "cache"), "--output", out]
    assert command.main(args) == 1 and json.loads(capsys.readouterr().out) == {"existing": 1, "failed": 1}


def test_stages_compare_on_the_first_one_s_targets(spark, tmp_path):
    rows = [(f"s{k}", dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + 7 * ((i * (k + 1)) % 5) + k, f"o{i // 3}") for i in range(40) for k in range(4)]
    cells = spark.createDataFrame(rows, "series string, d date, p double, identity string")
    window, levels = ("2024-02-05", "2024-02-08"), {"chain": ["s0", "s1", "s2", "s3"]}
    build = lambda first: panel.build(cells.where(F.col("d") >= first)).withColumn("chain", F.col("series"))
    folder = str(tmp_path / "stages")
    first = evaluation.predictions(build("2024-01-20"), window, levels, predict=lambda h: [h[-1] * 1.01])
    base = evaluation.evaluate(spark, "baseline", first, folder)
    assert base["targets"] == 16 and base["external_failures"] == 0 and set(base["metrics"]) == set(evaluation.MODELS) and base["metrics"]["ridge"]["n"] == 16
    stored = spark.read.parquet(f"{folder}/baseline/predictions")
    order = [(r["d"], r["series"]) for r in first.collect()]
    assert order == sorted(order)
    full = evaluation.evaluate(spark, "full", evaluation.predictions(build("2024-01-01"), window, levels, stored), folder, "baseline")
    assert full["change"]["persistence"]["mae_delta"] == 0 and full["change"]["ridge"]["days"] == 4 and full["change"]["external"]["n"] == 0
    assert full["external_failures"] == 16 and json.loads(spark.read.text(f"{folder}/full/summary.json", wholetext=True).first()["value"])["stage"] == "full"
    with pytest.raises(ValueError, match="every target"):
        evaluation.predictions(build("2024-02-04"), window, levels, stored)


def test_published_files_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "new" / "x.json")
    for value in ({"a": "ñ"}, {"b": 2}):
        sinks.publish_json(spark, value, path)
        assert json.loads((tmp_path / "new" / "x.json").read_text(encoding="utf-8")) == value
    assert [p.name for p in (tmp_path / "new").iterdir() if not p.name.endswith(".crc")] == ["x.json"]
    forecasts = spark.createDataFrame([("s", "2024-01-01", "sube", 1.0)], "series string, as_of string, dir string, pred double")
    assert sinks.forecast_file(forecasts, path, "v") == 1 and json.loads((tmp_path / "new" / "x.json").read_text())["items"]["s"]["dir"] == "sube"
