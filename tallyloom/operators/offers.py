"""Offers: area and chain filters, outliers, cheapest offers, baskets, identities.

An offer frame has at least ``zone, chain, item, price`` and an ordering that
settles ties (a list of columns, first seen first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import positive_number, stripped
from tallyloom.operators import timeline
from tallyloom.operators.basket_catalogue import CHAINS, NOT_RETAIL

LOW, HIGH = 0.15, 6.5


def in_area(province: Column, locality: Column, lat: Column, lon: Column, wide: bool = False) -> Column:
    """Whether a branch lies in the area; the wide one adds suburbs and a box of coordinates."""
    place = F.upper(stripped(F.coalesce(locality, F.lit(""))))
    inside = place == "ROSARIO"
    if wide:
        number = lambda c: F.replace(stripped(c.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
        box = number(lat).between(-33.1, -32.7) & number(lon).between(-61.0, -60.4)
        inside = inside | place.isin("FUNES", "FISHERTON", "FISHERTON ROSARIO") | F.coalesce(box, F.lit(False))
    return (stripped(F.coalesce(province, F.lit(""))) == "AR-S") & inside


def zone_of(locality: Column) -> Column:
    return F.when(F.lower(stripped(F.coalesce(locality, F.lit("")))) == "rosario", "rosario").otherwise("gran")


def retail_only(df: DataFrame, chain: str = "chain", excluded: Sequence[str] = NOT_RETAIL) -> DataFrame:
    return df.where(~F.col(chain).isin(*excluded))


def allowed_chains(df: DataFrame, chain: str = "chain", chains: Sequence[str] = CHAINS) -> DataFrame:
    return df.where(F.col(chain).isin(*chains))


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Add the label of a key, the key itself where it has none."""
    return df.join(labels, key, "left").withColumn(label, F.coalesce(F.col(label), F.col(key).cast("string")))


def chain_labels(chains: DataFrame) -> DataFrame:
    """A label per chain: the name of its first banner in text order."""
    named = chains.where("id_comercio is not null and id_bandera is not null and comercio_bandera_nombre <> ''")
    first = F.min(F.struct("id_bandera", "comercio_bandera_nombre"))["comercio_bandera_nombre"]
    return named.groupBy(F.col("id_comercio").alias("chain")).agg(first.alias("label"))


def comparable_units(offers: DataFrame, items: DataFrame) -> DataFrame:
    """Offers whose unit is the item's and whose price is sane, with the item's need."""
    return offers.join(F.broadcast(items), "item").where((F.col("unit_name") == F.col("unit")) & (F.col("price") > 0))


def reference_prices(offers: DataFrame, spread: bool = False) -> DataFrame:
    """Per item, the median over chains of each chain's lowest price.

    An item has a row a chain here, some dozens, which one task may hold; where
    "chains" are shops or sellers without number, ``spread`` deals an item's
    prices out over tasks.
    """
    sane = offers.where(F.col("price") > 0)
    lowest = sane.groupBy("item", "chain").agg(F.min("price").alias("low"))
    if spread:
        return timeline.medians(lowest, ["item"], "low").withColumnRenamed("median", "median_price")
    return lowest.groupBy("item").agg(F.median("low").alias("median_price"))


def judged(offers: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Every offer with its item's reference price and a verdict: kept, no price, or outlier.

    The reference has one row an item, so Spark broadcasts it; the offers
    themselves never shuffle for the verdict.
    """
    with_median = offers.join(reference_prices(offers), "item", "left")
    sane = F.coalesce(F.col("price") > 0, F.lit(False))
    outside = (F.col("price") < F.col("median_price") * low) | (F.col("price") > F.col("median_price") * high)
    return with_median.withColumn("verdict", F.when(~sane, "no price").when(F.coalesce(outside, F.lit(False)), "outlier").otherwise("kept"))


def keep_plausible(offers: DataFrame) -> DataFrame:
    return judged(offers).where("verdict = 'kept'").drop("verdict", "median_price")


def cheapest(offers: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The cheapest offer per group; the first in ``order`` wins ties.

    The minimum of a struct is combined before the shuffle, so a group of any
    size sends one row a task.
    """
    rest = [c for c in (columns or offers.columns) if c not in by and c != "price" and c not in order]
    best = F.min(F.struct("price", *order, *rest)).alias("best")
    return offers.groupBy(*by).agg(best).select(*by, "best.*")


def baskets(best: DataFrame, by: Sequence[str]) -> DataFrame:
    """Basket total and number of items found per group of cheapest offers; nothing is imputed."""
    return best.groupBy(*by).agg(F.sum(F.col("price") * F.col("need_qty")).alias("total"), F.count(F.lit(1)).alias("items_found"))


def ranked(totals: DataFrame) -> DataFrame:
    """Totals ascending; equal totals in text order of the chain."""
    return totals.orderBy("total", "chain")


def zone_baskets(offers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Baskets per chain for each zone and, as zone 'all', overall: one pass over the cheapest per zone.

    The overall cheapest of an item is the cheapest of its zones' cheapest.
    """
    per_zone = cheapest(offers, ["zone", "chain", "item"], order, ["zone", "chain", "item", "price", "need_qty", *order])
    overall = cheapest(per_zone.drop("zone"), ["chain", "item"], order).withColumn("zone", F.lit("all"))
    return baskets(per_zone.unionByName(overall), ["zone", "chain"])


def branch_counts(branches: DataFrame, zone: str = "zone") -> DataFrame:
    """Branches overall and per zone."""
    return branches.groupBy(F.coalesce(F.col(zone), F.lit("")).alias("zone")).agg(F.count(F.lit(1)).alias("branches")).unionByName(branches.agg(F.count(F.lit(1)).alias("branches")).select(F.lit("all").alias("zone"), "branches"))


def grid(best: DataFrame, items: DataFrame, chains: DataFrame) -> DataFrame:
    """Every item with every chain, and its cheapest price or null.  Both sides are dimensions."""
    return F.broadcast(items.select("item")).crossJoin(F.broadcast(chains.select("chain"))).join(best.select("item", "chain", "price"), ["item", "chain"], "left")


def cheapest_chain(best: DataFrame) -> DataFrame:
    """Per item the chain with the lowest price; the first chain in text order wins ties."""
    low = F.min(F.struct("price", "chain"))
    return best.groupBy("item").agg(low.alias("low")).select("item", F.col("low.chain").alias("chain"), F.col("low.price").alias("price"))


def identities(rows: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """One row per identity with its numbers of rows and of distinct contents.

    Equal rows collapse before the identity's rows meet, in two aggregations on
    keys that contain the identity.
    """
    distinct = rows.groupBy(*key, *content).agg(F.count(F.lit(1)).alias("copies"))
    out = distinct.groupBy(*key).agg(F.sum("copies").alias("n_rows"), F.count(F.lit(1)).alias("n_variants"))
    return out.withColumn("identity_conflict", F.col("n_variants") > 1)


def quarantine(rows: DataFrame, key: Sequence[str], content: Sequence[str], price: str) -> DataFrame:
    """``identities`` with the price of a conflicting identity withheld and its variants kept."""
    found = rows.groupBy(*key).agg(F.collect_set(F.struct(*content)).alias("variants"), F.count(F.lit(1)).alias("n_rows"))
    conflict = F.size("variants") > 1
    first = F.array_min("variants")
    return found.select(
        *key,
        *(F.when(conflict & F.lit(c == price), F.lit(None)).otherwise(first[c]).alias(c) for c in content),
        conflict.alias("identity_conflict"),
        F.when(conflict, F.array_sort("variants")).alias("source_variants"),
        (F.col("n_rows") - 1).alias("duplicate_rows"),
    )


def at_selected_branches(products: DataFrame, branches: DataFrame, key: Sequence[str]) -> DataFrame:
    return products.join(branches.select(*key).distinct(), list(key), "left_semi")


def with_price(rows: DataFrame, column: str, name: str = "price") -> DataFrame:
    """Rows whose price is a finite number above 0."""
    return rows.withColumn(name, positive_number(F.col(column))).where(F.col(name).isNotNull())


OTHER = "Otro"


def with_category(rows: DataFrame, items: DataFrame, key: str = "item") -> DataFrame:
    """Rows with the category of their item, OTHER where the item has none."""
    return rows.join(F.broadcast(items.select(key, "category")), key, "left").withColumn("category", F.coalesce("category", F.lit(OTHER)))
