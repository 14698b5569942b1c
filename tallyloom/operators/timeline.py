"""Order over a whole table without gathering it in one task.

Rows are dealt out by range, so every task holds a stretch of the order, and are
stored in the shared folder with the number of their stretch (a stored table
keeps its stretches whatever executors are lost).  What a row needs from before
its stretch is carried in: a sum, the last known value, or the last few rows.
A carry has a row a stretch, or one more for each key that a stretch begins in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import shared_folder

STRETCH = "stretch"


def stretches(rows: DataFrame, order: Sequence[str], tasks: int | None = None) -> DataFrame:
    """The rows with the number of their stretch; lower stretches come first in the order."""
    spark = rows.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, "stretches")
    dealt = rows.repartitionByRange(n, *order).withColumn(STRETCH, F.spark_partition_id())
    dealt.write.parquet(folder)
    return spark.read.schema(dealt.schema).parquet(folder)


def last_known(rows: DataFrame, order: Sequence[str], value: str, tasks: int | None = None) -> DataFrame:
    """``value`` filled from the last row in order, itself included, that has one."""
    held = stretches(rows, order, tasks)
    has = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = held.groupBy(STRETCH).agg(F.max_by(value, has).alias("end"), F.max(has).alias("any")).orderBy(STRETCH).collect()  # a row a stretch
    carried, known = [], None
    for r in ends:
        carried.append((r[STRETCH], known))
        known = r["end"] if r["any"] is not None else known
    spark = rows.sparkSession
    kind = rows.schema[value].dataType.simpleString()
    before = spark.createDataFrame(carried, f"{STRETCH} int, carried {kind}")
    w = Window.partitionBy(STRETCH).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = held.withColumn(value, F.last(value, ignorenulls=True).over(w))
    return local.join(F.broadcast(before), STRETCH).withColumn(value, F.coalesce(value, "carried")).drop(STRETCH, "carried")


def over_last_rows(rows: DataFrame, order: Sequence[str], back: int, add: Callable[[DataFrame, Column], DataFrame], tasks: int | None = None) -> DataFrame:
    """Columns that look at most ``back`` rows back: ``add`` gets a table and a window specification without frame.

    Every stretch works on its own rows behind the ``back`` rows before them,
    which are carried in and dropped again.
    """
    spark = rows.sparkSession
    held = stretches(rows, order, tasks)
    near = Window.partitionBy(STRETCH).orderBy(*(F.desc_nulls_last(c) for c in order))
    tails = held.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= back).drop("nth")
    by_stretch: dict[int, list] = {}
    for r in tails.collect():  # at most `back` rows a stretch
        by_stretch.setdefault(r[STRETCH], []).append(r)
    key = lambda r: tuple((r[c] is not None, r[c]) for c in order)
    carried, before = [], []
    for k in sorted(by_stretch):
        carried += [(*(r[c] for c in rows.columns), k) for r in before]
        before = [*before, *sorted(by_stretch[k], key=key)][-back:]
    ghosts = spark.createDataFrame(carried, held.schema).withColumn("carried", F.lit(True))
    both = held.withColumn("carried", F.lit(False)).unionByName(ghosts)
    made = add(both, Window.partitionBy(STRETCH).orderBy(*order))
    return made.where(~F.col("carried")).drop("carried", STRETCH)


def medians(rows: DataFrame, by: Sequence[str], value: str, tasks: int | None = None) -> DataFrame:
    """The exact median of each group, however many rows it has: ``by`` and ``median``.

    Equal values are counted before anything shuffles; the counts are dealt out
    by group and value, so a group is spread over tasks.  Ranks come from sums
    within a stretch and, by group, over the stretches before it.  Null values
    don't count; a group without any has a null median.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    named = counts.select(*(F.col(c).alias(f"by{i}") for i, c in enumerate(by)), F.col(value).alias("v"), F.when(F.col(value).isNotNull(), F.col("n")).otherwise(0).alias("n"))
    keys = [f"by{i}" for i in range(len(by))]
    held = stretches(named, [*keys, "v"], tasks)
    sums = held.groupBy(*keys, STRETCH).agg(F.sum("n").alias("own"))
    over = Window.partitionBy(*keys)
    sums = sums.withColumn("before", F.sum("own").over(over.orderBy(STRETCH)) - F.col("own")).withColumn("whole", F.sum("own").over(over))
    placed = held.withColumn("upto", F.sum("n").over(Window.partitionBy(STRETCH, *keys).orderBy("v")))
    same = [placed[k].eqNullSafe(sums[k]) for k in keys]
    joined = placed.join(sums, [placed[STRETCH] == sums[STRETCH], *same]).select(*(placed[k] for k in keys), "v", "n", (F.col("before") + F.col("upto")).alias("upto"), "whole")
    # Ranks from 0: the lower and the upper middle are the same if the number is odd.
    first, low, high = F.col("upto") - F.col("n"), F.floor((F.col("whole") - 1) / 2), F.floor(F.col("whole") / 2)
    holds = lambda rank: (first <= rank) & (rank < F.col("upto"))
    found = joined.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("v"))).alias("low"), F.max(F.when(holds(high), F.col("v"))).alias("high"))
    return found.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), ((F.col("low") + F.col("high")) / 2).alias("median"))
