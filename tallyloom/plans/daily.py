"""Whole runs: a day's feed to observations and a snapshot, reprocessing, and the backtest.

Everything is one DataFrame plan from the archive's records on; only the final
summaries, a few hundred rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import numbers as num
from tallyloom.functions import text as txt
from tallyloom.functions.keywords import keyword_item
from tallyloom.operators import audit, forecast, offers, panel, scoring, sinks
from tallyloom.operators.basket_catalogue import CHAINS, items, rules
from tallyloom.session import ship_code
from tallyloom.sources import archives as arc
from tallyloom.sources import feed

VERSION = "package-price-v2"
BRANCH_COLUMNS = ("sucursales_nombre", "sucursales_localidad", "sucursales_provincia", "sucursales_latitud", "sucursales_longitud")
PRODUCT_COLUMNS = ("id_producto", "productos_descripcion", "productos_cantidad_presentacion", "productos_unidad_medida_presentacion", "productos_marca", "productos_precio_lista")
ORDER = ("chain_id", "bandera_id", "branch_id", "product_id")


def area_branches(lines: DataFrame, wide: bool = True, chains: Sequence[str] | None = None) -> DataFrame:
    """Branches of the area by archive member; backfills restrict chains here, daily runs after the minimum."""
    rows = feed.parsed(lines, "sucursales.csv", [*feed.IDENTITY, *BRANCH_COLUMNS])
    rows = rows.where(offers.in_area(F.col("sucursales_provincia"), F.col("sucursales_localidad"), F.col("sucursales_latitud"), F.col("sucursales_longitud"), wide))
    rows = offers.retail_only(rows, "id_comercio")
    return rows if chains is None else offers.allowed_chains(rows, "id_comercio", chains)


def verified_contents(rows: DataFrame) -> DataFrame:
    """Adds the package's contents in the item's unit, where they come from, and the price per unit.

    The presentation counts if its unit is the item's and it isn't a bare "1
    unit"; otherwise the sizes that the description prints.  What can't be
    verified, or conflicts, has no price per unit but stays for auditing.
    """
    quantity, alias = F.col("cantidad_presentacion"), F.col("unidad_presentacion")
    stated = num.base_quantity(quantity, alias)
    usable = stated.isNotNull() & (num.unit_base(alias) == F.col("unit")) & ~((F.col("unit") == "u") & (stated == 1))
    printed = F.col("printed_quantity") if "printed_quantity" in rows.columns else txt.description_quantity(F.col("descripcion"), F.col("unit"))
    conflict = F.coalesce(F.col("identity_conflict"), F.lit(False)) if "identity_conflict" in rows.columns else F.lit(False)
    rows = rows.withColumn("normalized_quantity", F.when(usable, stated).otherwise(printed))
    price = num.positive_number(F.col("price_lista")) / F.col("normalized_quantity")
    good = ~conflict & price.isNotNull() & (price < float("inf")) & (num.round_exact(price, 2) > 0)
    basis = F.when(conflict, "conflicting-source-rows").when(~F.coalesce(good, F.lit(False)), "unverified").when(usable, "presentation").otherwise("description")
    made = (
        rows.withColumn("price_basis", basis)
        .withColumn("price", F.when(good, num.round_exact(price, 2)))
        .withColumn("unit_name", F.when(F.col("price").isNotNull(), F.col("unit")).otherwise("?"))
        .withColumn("normalized_quantity", F.when(F.col("price").isNotNull(), F.col("normalized_quantity")))
        .withColumn("price_normalization_version", F.lit(VERSION))
    )
    return made.drop("printed_quantity")


def classified(spark: SparkSession, rows: DataFrame, exclusions: dict | None = None) -> DataFrame:
    """Rows of the basket with their item, and the contents that the description prints in the item's unit.

    Each distinct description is looked at once, by the automaton of all words;
    ``rows`` is read twice, so it should be a stored table or a persisted one.
    """
    ship_code(spark)
    descriptions = rows.select("descripcion").distinct()
    found = descriptions.withColumn("item", keyword_item(txt.normalize_text(F.col("descripcion")), rules(exclusions))).where("item is not null")
    dimension = items(spark).select(F.col("item_id").alias("item"), "unit", "need_qty")
    known = found.join(F.broadcast(dimension), "item")
    known = known.withColumn("printed_quantity", txt.description_quantity(F.col("descripcion"), F.col("unit")))
    # Few rows, but each is worked on for long: without this, adaptive execution gives them all to one task.
    return rows.join(known, "descripcion").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def selected(spark: SparkSession, archives: str | Sequence[str], branches: DataFrame) -> DataFrame:
    """Priced product records of the given branches: what leaves the archives."""
    branches = branches.drop("sucursales_provincia", "sucursales_latitud", "sucursales_longitud")
    rows = offers.with_price(arc.selected_products(spark, archives, branches, PRODUCT_COLUMNS), "productos_precio_lista", "price_lista")
    return rows.select(
        F.col("id_comercio").alias("chain_id"), F.col("id_bandera").alias("bandera_id"), F.col("id_sucursal").alias("branch_id"),
        num.stripped(F.coalesce("id_producto", F.lit(""))).alias("product_id"), F.coalesce("productos_descripcion", F.lit("")).alias("descripcion"),
        F.coalesce("productos_marca", F.lit("")).alias("marca"), "price_lista",
        F.coalesce(num.positive_number(F.col("productos_cantidad_presentacion")), F.lit(0.0)).alias("cantidad_presentacion"),
        F.coalesce("productos_unidad_medida_presentacion", F.lit("")).alias("unidad_presentacion"),
        offers.zone_of(F.col("sucursales_localidad")).alias("zone"),
    )


def observations(spark: SparkSession, archives: str | Sequence[str], branches: DataFrame, exclusions: dict | None = None) -> DataFrame:
    """Offers of basket items at the given branches, with verified prices per unit."""
    return verified_contents(classified(spark, selected(spark, archives, branches), exclusions))


def quarantined(rows: DataFrame) -> DataFrame:
    """One row per exact identity; contradictory ones have no price per unit and keep their variants."""
    content = [c for c in rows.columns if c not in ORDER]
    held = offers.quarantine(rows, list(ORDER), content, "price")
    conflict = F.col("identity_conflict")
    return held.withColumn("unit_name", F.when(conflict, "?").otherwise(F.col("unit_name"))).withColumn("price_basis", F.when(conflict, "conflicting-source-rows").otherwise(F.col("price_basis")))


def summary(rows: DataFrame, chains: Sequence[str] = CHAINS, drop_outliers: bool = True) -> tuple[DataFrame, DataFrame]:
    """The cheapest offers, and the baskets of each zone."""
    best = cheapest_offers(rows, chains, drop_outliers)
    return best, offers.baskets(best, ["zone", "chain"])


def cheapest_offers(rows: DataFrame, chains: Sequence[str] = CHAINS, drop_outliers: bool = True) -> DataFrame:
    """Cheapest offers by zone ('all': the whole area), chain and item.

    Outliers are judged over all chains and zones, before either is narrowed.
    Re-zoning leaves outliers in (``drop_outliers=False``).
    """
    rows = rows.withColumn("chain", F.col("chain_id"))
    kept = offers.keep_plausible(rows) if drop_outliers else rows.where(F.col("price") > 0)
    kept = offers.allowed_chains(kept.where(F.col("unit_name") == F.col("unit")), "chain", chains)
    columns = dict.fromkeys([*ORDER, "zone", "chain", "item", "need_qty", *sinks.CELL])
    by_zone = offers.cheapest(kept, ["zone", "chain", "item"], list(ORDER), list(columns))
    whole = offers.cheapest(by_zone.drop("zone"), ["chain", "item"], list(ORDER)).withColumn("zone", F.lit("all"))
    return by_zone.unionByName(whole)


def checked_dates(spark: SparkSession, scanned: DataFrame, date: str) -> None:
    """Fails unless the members of every TAR name this day and no other; daily ZIPs carry no day."""
    tars = scanned.where((F.col("kind") == arc.NAME) & F.col("archive").rlike(r"\.tar(\.zst)?$"))
    wrong = [r for r in audit.archive_dates(tars, "line", date, ["archive"]).where("not valid").collect()]  # one row an archive
    if wrong:
        raise ValueError(f"{wrong[0]['archive']}: expected {date}, found {wrong[0]['dates']}")


def run_day(spark: SparkSession, archives: str | Sequence[str], date: str, raw_path: str, snapshot_path: str, chains: Sequence[str] | None = None, exclusions: dict | None = None, source: dict | None = None) -> dict[str, int]:
    """A day's archives to raw observations (rejects included) and its snapshot; returns the counts of the manifest."""
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.DISK_ONLY))
        return kept[-1]

    try:
        scanned = keep(arc.scan(spark, archives))
        checked_dates(spark, scanned, date)
        branches = keep(area_branches(scanned, chains=chains))
        offered = keep(selected(spark, archives, branches))  # read twice, but archives are opened once
        rows = quarantined(verified_contents(classified(spark, offered, exclusions))).withColumn("date", F.lit(date))
        sinks.write_observations(rows, raw_path)
        stored = raw_day(spark, raw_path, date)
        counts = stored.agg(F.count(F.lit(1)).alias("observations"), F.coalesce(F.sum("duplicate_rows"), F.lit(0)).alias("duplicate_rows"), F.count_if("identity_conflict").alias("conflicts")).first().asDict()
        if not counts["observations"]:
            raise ValueError("no basket observations; nothing is published")
        labels = offers.chain_labels(feed.parsed(scanned, "comercio.csv", ["id_comercio", "id_bandera", "comercio_bandera_nombre"]))
        write_summary(stored, branches, labels, date, snapshot_path, source=source)
        return counts | {"branches": branches.count()}
    finally:
        for df in kept:
            df.unpersist()


def raw_day(spark: SparkSession, raw_path: str, date: str) -> DataFrame:
    return spark.read.parquet(raw_path).where(F.col("date").cast("string") == date)


def write_summary(rows: DataFrame, branches: DataFrame, labels: DataFrame, date: str, snapshot_path: str, drop_outliers: bool = True, source: dict | None = None) -> None:
    spark = rows.sparkSession
    # What a snapshot shows is zones x chains x items, a few hundred rows: in one partition it needs no further exchange.
    best = cheapest_offers(rows, drop_outliers=drop_outliers).coalesce(1).persist(StorageLevel.DISK_ONLY)
    totals = offers.baskets(best, ["zone", "chain"])
    counted = offers.branch_counts(branches.withColumn("zone", offers.zone_of(F.col("sucursales_localidad")))).coalesce(1)
    cells = best.join(F.broadcast(items(spark).select("ord", F.col("item_id").alias("item"))), "item")
    made = sinks.snapshot_rows(cells, totals, counted, labels.coalesce(1), date, VERSION, source)
    try:
        sinks.write_snapshot(made, f"{snapshot_path}/date={date}")
    finally:
        best.unpersist()


def rebuild_day(spark: SparkSession, raw_path: str, date: str, snapshot_path: str, rematch: bool = False, drop_outliers: bool = True, exclusions: dict | None = None) -> None:
    """A snapshot from stored observations, which stay as they are; ``rematch`` classifies and prices anew.

    Its branches are those with observations, its chains' labels their ids.
    """
    rows = raw_day(spark, raw_path, date)
    if rematch:
        derived = ["item", "unit", "need_qty", "normalized_quantity", "price", "unit_name", "price_basis", "price_normalization_version"]
        rows = verified_contents(classified(spark, rows.drop(*derived), exclusions)).where("price is not null")
    branches = rows.select("chain_id", "bandera_id", "branch_id", F.when(F.col("zone") == "rosario", "rosario").alias("sucursales_localidad")).distinct()
    labels = rows.select(F.col("chain_id").alias("chain"), F.col("chain_id").alias("label")).distinct()
    write_summary(rows, branches, labels, date, snapshot_path, drop_outliers)


def price_panel(best: DataFrame) -> DataFrame:
    """The panel of cheapest prices: ``best`` has date, item, chain, price, descripcion, marca."""
    key = F.concat_ws("__", "item", "chain")
    cells = best.select(key.alias("series"), F.to_date("date").alias("d"), F.col("price").alias("p"), F.concat_ws("|", "descripcion", "marca").alias("identity"))
    return panel.build(cells)


def checked_versions(rows: DataFrame, column: str = "price_normalization_version") -> DataFrame:
    """Fails unless all rows carry one normalisation version."""
    return rows.agg(audit.single_version(rows, column).alias("checked"))


def backtest(price: DataFrame, categories: DataFrame | None = None) -> dict:
    """Walk-forward scores of the drift forecast: one small dictionary.

    ``categories`` (series, category) adds the rates of each category; a series
    without one counts as OTHER.
    """
    scored = scoring.labelled(forecast.targets(price, "identity"))
    weekly = forecast.first_weekly_move(price).select("series", "d", "weekly_move")
    pairs = scored.select("series", "d", "pred_dir").join(weekly, ["series", "d"]).withColumnRenamed("weekly_move", "real_dir")
    one = lambda df: df.first().asDict()
    classes = lambda df: {r["class"]: r.asDict() for r in scoring.class_stats(df).collect()}
    grouped = {}
    if categories is not None:
        named = scored.join(categories, "series", "left").withColumn("category", F.coalesce("category", F.lit(offers.OTHER)))
        grouped = {r["category"]: {k: v for k, v in r.asDict().items() if k != "category"} for r in scoring.hit_rates(named, ["category"]).collect()}
    return {
        "categories": grouped,
        "rates": one(scoring.hit_rates(scored)), "errors": one(scoring.errors(scored, "drift5")), "persistence": one(scoring.errors(scored, "persistence")),
        "daily": classes(scored), "weekly": classes(pairs), "assortment": one(scoring.assortment_rate(scored)),
        "distribution": {r["pred_dir"]: r["n"] for r in scoring.prediction_distribution(scored).collect()},
    }


def write_backtest(price: DataFrame, path: str, categories: DataFrame | None = None) -> dict:
    """The backtest's summary as a JSON file."""
    spark = price.sparkSession
    span = price.agg(F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"), F.count_distinct("series").alias("series")).first().asDict()
    made = {**span, "price_normalization_version": VERSION, **backtest(price, categories)}
    sinks.publish_json(spark, made, path)
    return made
