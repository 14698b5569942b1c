"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one line of JSON.

Each query runs once to warm up (JIT, file listing) and then twice; the better
time counts.  Results are written to Spark's no-op sink, so every row and column
is computed and none is collected.

``day_import`` is a whole day from an archive built here to stored observations
and a snapshot: a ZIP of twelve chains' ZIPs with 12 million product lines (550
MB), of which 120,000 belong to branches of the area, as in a real day.
"""

from __future__ import annotations

import io
import json
import multiprocessing
import os
import tempfile
import time
import zipfile
from concurrent.futures import ProcessPoolExecutor

from pyspark.sql import SparkSession

from tallyloom.plans import daily
from tallyloom.plans.catalogue import QUERIES

HEADLINE = (
    "a3_basket_total_by_chain", "a4_zone_baskets", "a7_identity_quarantine", "f8_outlier_split", "j7_competitor_min", "j8_asof_published_index",
    "j14_overlap_compare", "m6_description_quantity", "m9_keyword_classifier", "w5_drift5_forecast", "w11_weekly_first_move", "w15_features",
    "a11_class_stats", "a10_metrics_coverage", "x1_ridge_returns",
)


BRANCH = "id_comercio|id_bandera|id_sucursal|sucursales_nombre|sucursales_localidad|sucursales_provincia|sucursales_latitud|sucursales_longitud\n"
PRODUCT = "id_comercio|id_bandera|id_sucursal|id_producto|productos_descripcion|productos_cantidad_presentacion|productos_unidad_medida_presentacion|productos_marca|productos_precio_lista\n"
KINDS = (("Arroz largo fino {} 1 kg", "1", "KG"), ("Leche entera {} 1 L", "1", "LT"), ("Harina {} 1 kg", "1000", "GR"), ("Yerba mate {} 500 g", "1", "UNI"), ("Clavos {}", "1", "UNI"), ("Pintura {} 1 L", "1", "UNI"))


def chain_archive(task: tuple[int, int, int, int]) -> tuple[str, bytes]:
    """A chain's ZIP; every ``near``-th of its branches lies in the area."""
    c, branches, products, near = task
    shops = [(c, 1, b, f"shop {b}", *(("Rosario", "AR-S") if b % near == 0 else ("Lejos", "AR-B")), "", "") for b in range(branches)]
    kinds = [(f"|p{k}|{text.format(k)}|{quantity}|{unit}|m|", k * 7) for k in range(products) for text, quantity, unit in (KINDS[k % len(KINDS)],)]
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("comercio.csv", f"id_comercio|id_bandera|comercio_razon_social|comercio_bandera_nombre\n{c}|1|SA|Chain {c}\n")
        z.writestr("sucursales.csv", BRANCH + "\n".join("|".join(map(str, s)) for s in shops) + "\n")
        with z.open("productos.csv", "w") as f:
            f.write(PRODUCT.encode())
            for b in range(branches):
                head, shift = f"{c}|1|{b}", b * c
                f.write(("\n".join([f"{head}{middle}{100 + (price + shift) % 90},5" for middle, price in kinds]) + "\n").encode())
    return f"{c}.zip", inner.getvalue()


def build_archive(path: str, chains: int = 12, branches: int = 500, products: int = 2000, near: int = 100) -> None:
    with ProcessPoolExecutor(mp_context=multiprocessing.get_context("spawn")) as pool, zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as outer:
        for name, content in pool.map(chain_archive, [(c, branches, products, near) for c in range(2, 2 + chains)]):
            outer.writestr(name, content)


def import_seconds(spark: SparkSession) -> float:
    with tempfile.TemporaryDirectory() as folder:
        build_archive(f"{folder}/day.zip")
        runs = []
        for n in range(3):
            began = time.perf_counter()
            daily.run_day(spark, f"{folder}/day.zip", "2024-05-01", f"{folder}/raw{n}", f"{folder}/snap{n}")
            runs.append(time.perf_counter() - began)
    return min(runs[1:])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tallyloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs[1:]), 3)
    seconds["day_import"] = round(import_seconds(spark), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
