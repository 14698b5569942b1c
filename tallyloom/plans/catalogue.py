"""The registered queries and the SQL that says the same."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import numbers as num
from tallyloom.functions import registry
from tallyloom.functions import text as txt
from tallyloom.functions.keywords import keyword_item
from tallyloom.operators import audit, covariates, features, forecast, offers, panel, present, scoring, timeline
from tallyloom.operators.basket_catalogue import rules
from tallyloom.plans import analogues as an
from tallyloom.plans import daily, evaluation, runs
from tallyloom.session import shared_folder, ship_code
from tallyloom.sources import archives, feed
from tallyloom.streaming import attempts, daily_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, day: str | None = None):
    """Register a query under its function's name, with its SQL if there is any.

    A column of days leaves as ISO text on both sides, so that results compare
    whatever type a client gives to dates.
    """

    def add(f):
        QUERIES[f.__name__] = f if day is None else wraps(f)(lambda spark, sf: f(spark, sf).withColumn(day, F.col(day).cast("string")))
        if sql is not None:
            ORACLES[f.__name__] = sql if day is None else f"select * replace (cast({day} as varchar) as {day}) from ({sql})"
        return f

    return add


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: num.rounded(F.col(c), digits) for c in columns})


def _fitting(spark, sf):
    return offers.comparable_units(an.offers(spark, sf), an.items(spark, sf))


def _kept(spark, sf):
    return offers.keep_plausible(_fitting(spark, sf))


def _best(spark, sf):
    return offers.cheapest(_kept(spark, sf), ["chain", "item"], an.ORDER, [*an.ORDER, "chain", "item", "price", "need_qty"])


def _scored(spark, sf):
    return scoring.labelled(forecast.targets(an.panel(spark, sf), "identity"))


# Offers and baskets.


@query(f"""with {an.OFFERS_SQL}
select chain, round(sum(price * need_qty), 6) as total, count(*) as items_found from best group by chain""")
def a3_basket_total_by_chain(spark, sf):
    return _round(offers.ranked(offers.baskets(_best(spark, sf), ["chain"])), "total")


@query("""select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey
where n_regionkey = 1 and (n_name = 'NATION_1' or c_acctbal between 1000 and 5000 or c_mktsegment in ('BUILDING', 'MACHINERY'))""")
def f1_area_filter(spark, sf):
    # The predicate of the area filter over a customer's nation (locality) and balance (coordinate).
    nation = an.table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    rows = an.table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    place = F.when(F.col("n_name") == "NATION_1", " Rosario ").when(wide, "Funes").otherwise("elsewhere")
    lat = F.when(F.col("c_acctbal").between(1000, 5000), "-32,9").otherwise("0")
    return rows.where(offers.in_area(F.lit(" AR-S "), place, lat, F.lit("-60,7"), wide=True)).select("c_custkey", "n_name")


@query("""select s_suppkey, cast(s_nationkey as varchar) as chain from supplier
where cast(s_nationkey as varchar) not in ('23') and cast(s_nationkey as varchar) in ('2','9','10','11','12','13','15','16')""")
def f2_f3_chain_lists(spark, sf):
    rows = an.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("chain"))
    return offers.allowed_chains(offers.retail_only(rows))


@query(f"""with {an.OFFERS_SQL},
mixed as (select o.*, m.median_price from (
    select item, case when l_linenumber = 7 then -price else price end as price, unit_name, unit from offer join item_dim using (item) where unit_name = unit) o
  left join (select item, median(low) as median_price from (
    select item, chain, min(price) as low from fit where l_linenumber <> 7 group by item, chain) group by item) m using (item))
select item, case when not price > 0 then 'no price' when price < median_price * 0.15 or price > median_price * 6.5 then 'outlier' else 'kept' end as verdict,
  count(*) as n, round(min(median_price), 6) as median_price
from mixed group by 1, 2""")
def f8_outlier_split(spark, sf):
    rows = _fitting(spark, sf).withColumn("price", F.when(F.col("l_linenumber") == 7, -F.col("price")).otherwise(F.col("price")))
    out = offers.judged(rows).groupBy("item", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("median_price").alias("median_price"))
    return _round(out, "median_price")


@query(f"""with {an.OFFERS_SQL} select item, round(median_price, 6) as median_price from med""")
def a1_median_of_chain_minima(spark, sf):
    return _round(offers.reference_prices(_fitting(spark, sf)), "median_price")


@query("""select l_orderkey, l_linenumber, l_suppkey from lineitem where exists (
  select 1 from supplier where s_suppkey = l_suppkey and s_acctbal > 5000)""")
def j2_branch_semijoin(spark, sf):
    chosen = an.table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return offers.at_selected_branches(an.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), chosen, ["l_suppkey"])


@query("""select s_suppkey, coalesce(label, cast(s_nationkey as varchar)) as label
from supplier left join (select n_nationkey, n_name as label from nation where n_regionkey < 2) on s_nationkey = n_nationkey""")
def j4_label_default(spark, sf):
    labels = an.table(spark, sf, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label"))
    return offers.with_label(an.table(spark, sf, "supplier"), labels, "s_nationkey", "label").select("s_suppkey", "label")


@query(f"""with {an.OFFERS_SQL}
select item_dim.item, c.chain, round(price, 6) as price
from item_dim cross join (select distinct chain from best) c left join best on best.item = item_dim.item and best.chain = c.chain""")
def j6_item_chain_grid(spark, sf):
    best = _best(spark, sf)
    return _round(offers.grid(best, an.items(spark, sf), best.select("chain").distinct()), "price")


@query(f"""with {an.OFFERS_SQL}
select chain, item, round(price, 6) as price, l_orderkey, l_linenumber, l_partkey, l_suppkey from best""")
def a2_cheapest_offer(spark, sf):
    return _round(_best(spark, sf), "price").select("chain", "item", "price", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""with {an.OFFERS_SQL},
levels as (select zone, chain, item, min(price) as price, min(need_qty) as need_qty from kept group by grouping sets ((zone, chain, item), (chain, item)))
select coalesce(zone, 'all') as zone, chain, round(sum(price * need_qty), 6) as total, count(*) as items_found from levels group by 1, 2""")
def a4_zone_baskets(spark, sf):
    return _round(offers.zone_baskets(_kept(spark, sf), an.ORDER), "total")


@query("""select coalesce(zone, 'all') as zone, count(*) as branches from (
  select case when n_regionkey = 0 then 'core' else 'wide' end as zone from supplier join nation on s_nationkey = n_nationkey where s_nationkey <> 23)
group by grouping sets ((zone), ())""")
def a5_branch_counts(spark, sf):
    nation = an.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_regionkey") == 0, "core").otherwise("wide").alias("zone"))
    rows = an.table(spark, sf, "supplier").join(F.broadcast(nation), "s_nationkey").withColumn("chain", F.col("s_nationkey").cast("string"))
    return offers.branch_counts(offers.retail_only(rows))


@query(f"""with {an.OFFERS_SQL}
select item, chain, round(price, 6) as price from (select *, row_number() over (partition by item order by price, chain) as k from best) where k = 1""")
def a6_cheapest_chain(spark, sf):
    return _round(offers.cheapest_chain(_best(spark, sf)), "price")


@query("""select l_orderkey, l_linenumber, cast(sum(copies) as bigint) as n_rows, count(*) as n_variants, count(*) > 1 as identity_conflict from (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) as copies from lineitem group by all) group by 1, 2""")
def a7_identity_quarantine(spark, sf):
    return offers.identities(an.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


# Joins over time and between collections.


@query("""with c as (select p_brand as item, cast(l_shipdate as date) as d, s_nationkey as chain, min(l_extendedprice) as price
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by all)
select a.item, a.d, a.chain, a.price, min(b.price) as competitor_price
from c a left join c b on a.item = b.item and a.d = b.d and a.chain <> b.chain group by a.item, a.d, a.chain, a.price""", day="d")
def j7_competitor_min(spark, sf):
    part = an.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    supplier = an.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("chain"))
    lines = an.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("price"))
    return covariates.competitor_min(lines.join(part, "l_partkey").join(supplier, "l_suppkey"))


@query("""select case when l_partkey % 10 = 0 then 'p' || l_partkey % 100 else 'hot' end as item, median(price) as median_price
from (select l_partkey, l_orderkey, min(l_extendedprice) as price from lineitem group by 1, 2) group by 1
union all select 'flags ' || l_returnflag, median(l_quantity) from lineitem group by l_returnflag""")
def a1_hot_medians(spark, sf):
    """Medians of items of which one has nine tenths of all rows, and of groups with few distinct values."""
    lines = an.table(spark, sf, "lineitem")
    item = F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit("p"), F.col("l_partkey") % 100)).otherwise("hot")
    rows = lines.select(item.alias("item"), F.concat_ws("-", "l_partkey", "l_orderkey").alias("chain"), F.col("l_extendedprice").alias("price"))
    flags = timeline.medians(lines.select(F.concat(F.lit("flags "), "l_returnflag").alias("item"), "l_quantity"), ["item"], "l_quantity")
    return offers.reference_prices(rows, spread=True).unionByName(flags.withColumnRenamed("median", "median_price"))


@query("""with m as (select date_trunc('month', o_orderdate)::date as month, round(avg(o_totalprice), 4) as v from orders group by 1),
known as (select (last_day(month) + 60)::date as known_on, v from m),
days as (select distinct cast(l_shipdate as date) as d from lineitem)
select days.d, known.v as index_value from days asof left join known on days.d >= known.known_on""", day="d")
def j8_asof_published_index(spark, sf):
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    index = an.table(spark, sf, "orders").groupBy(month.alias("month")).agg(num.rounded(F.avg("o_totalprice"), 4).alias("value"))
    days = an.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return covariates.as_of(days, covariates.published(index))


@query(f"""with {an.PANEL_SQL}
select d, round(sum(abs(weekly - actual) - abs(drift5 - actual)), 6) as delta, count(*) as n from target where series % 3 <> 0 and series % 2 = 0 group by d""", day="d")
def j10_paired_targets(spark, sf):
    # Two runs that share some of their targets only.
    t = forecast.targets(an.panel(spark, sf))
    return _round(scoring.paired(t.where("series % 3 <> 0"), t.where("series % 2 = 0"), "drift5", "weekly"), "delta")


@query("""with p as (select distinct cast(o_orderdate as date) as d from orders)
select cast(unnest(generate_series((select min(d) from p), (select max(d) from p), interval 1 day)) as date) as d except select d from p""", day="d")
def j13_gap_dates(spark, sf):
    return audit.missing_days(an.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")))


@query("""with a as (select l_orderkey, l_linenumber, min(l_extendedprice) as price from lineitem where l_partkey % 3 <> 0 group by 1, 2),
b as (select l_orderkey, l_linenumber, max(l_extendedprice) as price from lineitem where l_partkey % 3 <> 1 group by 1, 2)
select l_orderkey, l_linenumber, a.price as a, b.price as b,
  case when b.price is null then 'only_local' when a.price is null then 'only_archive' when a.price = b.price then 'same_price' else 'changed' end as status
from a full outer join b using (l_orderkey, l_linenumber)""")
def j14_overlap_compare(spark, sf):
    key = ["l_orderkey", "l_linenumber"]
    lines = an.table(spark, sf, "lineitem").select(*key, "l_partkey", "l_extendedprice")
    a = lines.where("l_partkey % 3 <> 0").groupBy(*key).agg(F.min("l_extendedprice").alias("price"))
    b = lines.where("l_partkey % 3 <> 1").groupBy(*key).agg(F.max("l_extendedprice").alias("price"))
    return audit.overlap(a, b, key, "price")


@query("""select d, id, first_seen, has_warnings from (
  select cast(o_orderdate as date) as d, o_orderkey as id, o_orderpriority as first_seen, o_orderstatus = 'F' as has_warnings,
    row_number() over (partition by cast(o_orderdate as date) order by o_orderstatus = 'F', o_orderpriority, o_orderkey) as r
  from orders where o_custkey % 2 = 0) where r = 1""", day="d")
def s11_revision_choice(spark, sf):
    entries = an.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("first_seen"), (F.col("o_orderstatus") == "F").alias("has_warnings"), F.when(F.col("o_custkey") % 2 == 0, "link").alias("link"))
    return audit.best_revision(entries)


@query("""select l_orderkey as d, count(*) as revisions, bool_and(l_quantity > 2) as all_tried, bool_and(l_returnflag <> 'A') as all_mismatch,
  bool_and(l_quantity > 2) and bool_and(l_returnflag <> 'A') as rejected from lineitem group by 1""")
def s12_revision_verdict(spark, sf):
    rows = an.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("d"), (F.col("l_quantity") > 2).alias("tried"), (F.col("l_returnflag") != "A").alias("mismatch"))
    return audit.revision_verdict(rows)


@query("""with days as (select cast(unnest(generate_series(date '1995-01-01', date '1996-12-31', interval 1 day)) as date) as d),
have as (select distinct cast(o_orderdate as date) as d from orders where o_orderstatus = 'P'),
link as (select distinct cast(l_shipdate as date) as d from lineitem where l_linenumber = 1)
select d, case when d in (select d from have) then 'existing' when d not in (select d from link) then 'unavailable' else 'to do' end as state from days""", day="d")
def t5_work_list(spark, sf):
    have = an.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("d"))
    link = an.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.to_date("l_shipdate").alias("d"))
    return audit.work_list(audit.day_range(spark, "1995-01-01", "1996-12-31"), have, link)


# Scores.


@query(f"""with {an.PANEL_SQL}
select identity as "group", count(*) as n, cast(sum(case when pred_dir = real_dir then 1 else 0 end) as bigint) as hits,
  round(avg(case when pred_dir = real_dir then 1.0 else 0.0 end), 6) as hit_rate,
  round(avg(case when real_dir = 'estable' then 1.0 else 0.0 end), 6) as persistence_rate from scored group by 1""")
def a8_hit_rate_by_group(spark, sf):
    return _round(scoring.hit_rates(_scored(spark, sf).withColumnRenamed("identity", "group"), ["group"]), "hit_rate", "persistence_rate")


@query(f"""with {an.PANEL_SQL}
select series, round(avg(abs(drift5 - actual)), 6) as mae, round(avg(abs(drift5 - actual) / abs(actual) * 100), 4) as mape from scored group by 1""")
def a9_mae_mape(spark, sf):
    return _round(_round(scoring.errors(_scored(spark, sf), "drift5", ["series"]), "mae"), "mape", digits=4)


_NAIVE_SQL = f"""{an.PANEL_SQL},
hist as (select series, d, p as actual, list(p) filter (p is not null) over (partition by series order by d rows between 60 preceding and 1 preceding) as h from panel),
nb as (
  select *, len(h) as n, h[len(h)] as last,
    list_transform(range(greatest(len(h) - 4, 1), len(h)), lambda i: h[i + 1] - h[i]) as four,
    list_transform(range(greatest(len(h) - 6, 1), len(h)), lambda i: h[i + 1] - h[i]) as six
  from hist where len(h) >= 1),
mids as (
  select *, case when n = 1 then last when n >= 3 then last + list_avg(four) else last end as mid,
    case when n >= 4 then list_stddev_pop(six) else last * 0.03 end as spread from nb),
band as (
  select series, d, actual, n, mid, case when n = 1 then last * 0.97 else mid - 1.28 * spread end as low,
    case when n = 1 then last * 1.03 else mid + 1.28 * spread end as high from mids)"""


@query(f"""with {_NAIVE_SQL}
select series, d, n, round(mid, 4) + 0.0 as mid, round(low, 4) + 0.0 as low, round(high, 4) + 0.0 as high from band""", day="d")
def w7_naive_band(spark, sf):
    rows = forecast.naive_band(an.panel(spark, sf)).drop("actual").withColumn("n", F.col("n").cast("long"))
    return _round(rows, "mid", "low", "high", digits=4)


@query(f"""with {_NAIVE_SQL}
select round(avg(abs(actual - mid)), 6) as mae, round(avg(abs((actual - mid) / case when actual = 0 then 1.0 else actual end)) * 100, 4) as mape,
  round(sqrt(avg((actual - mid) * (actual - mid))), 6) as rmse, round(avg(case when actual between low and high then 1.0 else 0.0 end), 6) as coverage,
  count(*) as n from band where actual is not null and mid is not null""")
def a10_metrics_coverage(spark, sf):
    return _round(_round(scoring.interval_metrics(forecast.naive_band(an.panel(spark, sf))), "mae", "rmse", "coverage"), "mape", digits=4)


_CLASS_SQL = f"""{an.PANEL_SQL},
cls as (select unnest(['sube', 'baja', 'estable']) as class),
t as (
  select class, count(*) filter (pred_dir = class) as predicted, count(*) filter (real_dir = class) as actual,
    count(*) filter (pred_dir = class and real_dir = class) as hits from cls cross join scored group by class)"""


@query(f"""with {_CLASS_SQL},
r as (select *, case when predicted > 0 then hits * 100.0 / predicted else 0 end as p, case when actual > 0 then hits * 100.0 / actual else 0 end as q from t)
select class, predicted, actual, hits, round(p, 6) as precision, round(q, 6) as recall, round(case when p + q > 0 then 2 * p * q / (p + q) else 0 end, 6) as f1 from r""")
def a11_class_stats(spark, sf):
    return _round(scoring.class_stats(_scored(spark, sf)), "precision", "recall", "f1")


@query(f"""with {_CLASS_SQL}
select class, predicted, actual, hits, round(hits * 100.0 / nullif(predicted, 0), 6) as precision, round(hits * 100.0 / nullif(actual, 0), 6) as recall,
  round(2.0 * hits / nullif(predicted + actual, 0), 6) as f1 from t""")
def a12_class_stats_null(spark, sf):
    return _round(scoring.class_stats(_scored(spark, sf), undefined_is_zero=False), "precision", "recall", "f1")


@query(f"""with {an.PANEL_SQL}
select count(*) as n, round(avg(abs(drift5 - actual)), 6) as mae, round(avg(case when pred_dir = real_dir then 1.0 else 0.0 end) * 100, 6) as direction_accuracy_pct,
  round((1 - avg(abs(drift5 - actual)) / nullif(avg(abs(last - actual)), 0)) * 100, 4) as mae_skill_pct from scored""")
def a14_mae_skill(spark, sf):
    return _round(_round(scoring.skill(_scored(spark, sf), "drift5"), "mae", "direction_accuracy_pct"), "mae_skill_pct", digits=4)


@query(f"""with {an.PANEL_SQL}
select count(*) as moves, count(*) filter (identity <> identity_before) as identity_changes,
  round(count(*) filter (identity <> identity_before) * 100.0 / nullif(count(*), 0), 6) as rate_pct from scored where real_dir <> 'estable'""")
def a15_assortment_rate(spark, sf):
    return _round(scoring.assortment_rate(_scored(spark, sf)), "rate_pct")


def _config_metrics(spark, sf):
    """Metrics per series and context length, as configurations."""
    p = an.panel(spark, sf)
    return [(name, scoring.interval_metrics(forecast.naive_band(p, days), ["series"]).withColumn("config", F.lit(name))) for name, days in (("long", 60), ("short", 7))]


_CONFIG_SQL = f"""{an.PANEL_SQL},
hist as (
  select series, d, p as actual, config, case config when 'long' then h60 else h7 end as h from (
    select series, d, p, list(p) filter (p is not null) over (partition by series order by d rows between 60 preceding and 1 preceding) as h60,
      list(p) filter (p is not null) over (partition by series order by d rows between 7 preceding and 1 preceding) as h7 from panel)
  cross join (select unnest(['long', 'short']) as config)),
nb as (
  select *, len(h) as n, h[len(h)] as last,
    list_transform(range(greatest(len(h) - 4, 1), len(h)), lambda i: h[i + 1] - h[i]) as four,
    list_transform(range(greatest(len(h) - 6, 1), len(h)), lambda i: h[i + 1] - h[i]) as six
  from hist where len(h) >= 1),
mids as (
  select *, case when n = 1 then last when n >= 3 then last + list_avg(four) else last end as mid,
    case when n >= 4 then list_stddev_pop(six) else last * 0.03 end as spread from nb),
band as (
  select series, config, actual, mid, case when n = 1 then last * 0.97 else mid - 1.28 * spread end as low,
    case when n = 1 then last * 1.03 else mid + 1.28 * spread end as high from mids),
per as (
  select series, config, avg(abs(actual - mid)) as mae, avg(abs((actual - mid) / case when actual = 0 then 1.0 else actual end)) * 100 as mape,
    sqrt(avg((actual - mid) * (actual - mid))) as rmse, avg(case when actual between low and high then 1.0 else 0.0 end) as coverage, count(*) as n
  from band where actual is not null and mid is not null group by series, config)"""


@query(f"""with {_CONFIG_SQL}
select config, round(avg(mae), 6) as mae, round(avg(mape), 4) as mape, round(avg(rmse), 6) as rmse, round(avg(coverage), 6) as coverage, cast(sum(n) as bigint) as n from per group by config""")
def a17_macro_average(spark, sf):
    (_, a), (_, b) = _config_metrics(spark, sf)
    return _round(_round(scoring.macro(a.unionByName(b), ["config"]), "mae", "rmse", "coverage"), "mape", digits=4)


@query(f"""with {_CONFIG_SQL}
select series % 10 as bucket, round(avg(mae) filter (config = 'long'), 6) as long, round(avg(mae) filter (config = 'short'), 6) as short from per group by 1""")
def a18_pivot_mae(spark, sf):
    (_, a), (_, b) = _config_metrics(spark, sf)
    rows = a.unionByName(b).withColumn("bucket", F.col("series") % 10)
    return _round(scoring.pivoted(rows, "bucket", "config", ["long", "short"]), "long", "short")


@query(f"""with {an.PANEL_SQL}, daily as (select d, count(p) as cells from panel group by d)
select min(cells) as min_cells, max(cells) as max_cells, cast(sum(cells) as bigint) as cells, count(*) as days from daily""")
def a19_audit_counters(spark, sf):
    return audit.cell_counters(an.panel(spark, sf), value="p")


_RULES = [
    {"id": "ring", "keywords": ["ring", "small ring"], "negatives": ["old "]},
    {"id": "gear", "keywords": ["gear", "hot gear"], "required": [["hot"], ["red", "gear"], ["small"]]},
    {"id": "widget", "keywords": ["widget"], "negatives": ["blue"]},
    {"id": "bolt", "keywords": ["bolt", "blue bolt"]},
    {"id": "cold", "keywords": ["cold", "small"]},
]

_CLASS_OF = """case
    when p_name like '%small ring%' and p_name not like '%old %' then 'ring'
    when p_name like '%blue bolt%' then 'bolt'
    when p_name like '%hot gear%' then 'gear'
    when p_name like '%widget%' and p_name not like '%blue%' then 'widget'
    when p_name like '%small%' then 'cold'
    when regexp_matches(p_name, '\\bring\\b') and p_name not like '%old %' then 'ring'
    when regexp_matches(p_name, '\\bgear\\b') and (p_name like '%hot%' or (p_name like '%red%' and p_name like '%gear%') or p_name like '%small%') then 'gear'
    when regexp_matches(p_name, '\\bbolt\\b') then 'bolt'
    when regexp_matches(p_name, '\\bcold\\b') then 'cold' end"""


@query(f"select p_partkey, {_CLASS_OF} as class from part")
def m9_keyword_automaton(spark, sf):
    ship_code(spark)
    names = an.table(spark, sf, "part").select("p_name").distinct()
    return an.table(spark, sf, "part").select("p_partkey", "p_name").join(names.select("p_name", keyword_item(txt.normalize_text(F.col("p_name")), _RULES).alias("class")), "p_name").select("p_partkey", "class")


@query(f"select p_partkey, {_CLASS_OF} as class from part")
def m9_keyword_classifier(spark, sf):
    return an.table(spark, sf, "part").select("p_partkey", txt.keyword_class(txt.normalize_text(F.col("p_name")), _RULES).alias("class"))


@query(f"""with n as (select p_partkey, p_type as old, coalesce({_CLASS_OF}, '') as k from part),
m as (select old, case when k = '' then null when p_partkey % 5 = 0 then old else k end as new from n)
select old, new, count(*) as n, case when new is null then 'dropped' when new = old then 'unchanged' else 'changed' end as outcome from m group by 1, 2, 4""")
def a20_rematch_diagnostics(spark, sf):
    part = an.table(spark, sf, "part")
    before = part.select("p_partkey", F.col("p_type").alias("item"))
    found = txt.keyword_class(txt.normalize_text(F.col("p_name")), _RULES)
    after = part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.when(found.isNotNull(), F.col("p_type"))).otherwise(found).alias("item"))
    return audit.rematch(before, after, ["p_partkey"])


@query(f"""with {an.PANEL_SQL}
select pred_dir, count(*) as n, count(*) filter (pred_dir = real_dir) as hits from scored group by 1""")
def a22_prediction_distribution(spark, sf):
    return scoring.prediction_distribution(_scored(spark, sf))


@query(f"""with {an.PANEL_SQL}, t as (select d, sum(abs(weekly - actual) - abs(drift5 - actual)) as delta, count(*) as n from target group by d),
p as (select *, row_number() over (order by d) - 1 as place from t), w as (select count(*) as days from t),
draws as (select r, ('0x' || substr(md5('{scoring.SEED}:' || r || ':' || i), 1, {scoring.DIGITS}))::bigint % days as place
  from (select r, unnest(range(days)) as i, days from range({scoring.RESAMPLES}) x(r), w)),
m as (select r, sum(delta) / sum(n) as mean from draws join p using (place) group by r)
select (select sum(n) from t)::bigint as n, round((select sum(delta) / sum(n) from t), 6) as mae_delta,
  round(quantile_cont(mean, {scoring.ENDS[0]}), 6) as low, round(quantile_cont(mean, {scoring.ENDS[1]}), 6) as high, (select days from w) as days from m""")
def a16_counted_bootstrap(spark, sf):
    t = forecast.targets(an.panel(spark, sf))
    return _round(scoring.counted_bootstrap(scoring.paired(t, t, "drift5", "weekly")), "mae_delta", "low", "high")


@query()
def a16_bootstrap(spark, sf):
    t = forecast.targets(an.panel(spark, sf))
    return scoring.bootstrap_frame(scoring.paired(t, t, "drift5", "weekly"))


@query(f"""with {an.PANEL_SQL}, pairs as (select pred_dir, case when series % 4 <> 0 then real_dir end as real_dir, 'daily' as horizon from scored
  union all select real_dir, case when series % 3 <> 0 then pred_dir end, 'weekly' from scored),
cls as (select unnest(['sube', 'baja', 'estable']) as class),
t as (select horizon, class, count(*) filter (pred_dir = class) as predicted, count(*) filter (real_dir = class) as actual, count(*) filter (pred_dir = class and real_dir = class) as hits
  from cls cross join (from pairs where real_dir is not null) group by all)
select horizon, class, predicted, actual, hits, round(hits * 100.0 / nullif(predicted, 0), 6) as precision, round(hits * 100.0 / nullif(actual, 0), 6) as recall, round(2.0 * hits / nullif(predicted + actual, 0), 6) as f1 from t""")
def a13_event_bundle(spark, sf):
    rows = _scored(spark, sf).select("series", "pred_dir", "real_dir")
    daily = rows.withColumn("real_dir", F.when(F.col("series") % 4 != 0, F.col("real_dir")))
    weekly = rows.select("series", F.col("real_dir").alias("pred_dir"), F.when(F.col("series") % 3 != 0, F.col("pred_dir")).alias("real_dir"))
    return _round(scoring.event_stats(daily, weekly), "precision", "recall", "f1")


@query(f"""with {an.PANEL_SQL}
select series, d, round(avg(abs(drift5 - actual)) over (partition by series order by d rows between 2 preceding and current row), 6) as rolling_mae from scored""", day="d")
def w22_rolling_mae(spark, sf):
    return _round(scoring.rolling_mae(_scored(spark, sf), "drift5"), "rolling_mae")


# Panel and forecasts.


@query(f"with {an.PANEL_SQL} select series, d, p, pf, observed from panel", day="d")
def w1_ffill_limit2(spark, sf):
    return an.panel(spark, sf).select("series", "d", "p", "pf", "observed")


@query(f"with {an.PANEL_SQL} select series, d, p, pf, observed, n from panel where pf is not null", day="d")
def w1_j11_streamed_panel(spark, sf):
    """The panel from a stream in three batches, each of which leaves a third of its last two days to the next one."""
    folder = shared_folder(spark, "panel")
    cells = an.table(spark, sf, "events").where("value > 0").select(F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("p"), "event_id")
    first, last = cells.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    third = max(1, ((last - first).days + 1) // 3)
    age = F.datediff(F.to_date("ts"), F.lit(first))
    late = (F.col("event_id") % 3 == 0) & (age % third >= third - 2) & (age < 2 * third)
    dealt = cells.withColumn("part", F.least(F.floor(age / third), F.lit(2)) + F.when(late, 1).otherwise(0)).drop("event_id")
    closing = spark.createDataFrame([(None, datetime.datetime.combine(last + datetime.timedelta(days=30), datetime.time()), 0.0, 3)], "series long, ts timestamp, p double, part long")
    for k in range(4):
        (closing if k == 3 else dealt).where(F.col("part") == k).drop("part").withColumn("series", F.coalesce("series", F.lit(-1))).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema("series long, ts timestamp, p double").parquet(f"{folder}/in")
        told = daily_panel.panel_stream(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks")
        told.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(daily_panel.ROWS).parquet(f"{folder}/out").where((F.col("series") >= 0) & (F.col("d") <= F.lit(last))).select("series", "d", "p", "pf", "observed", "n")


@query(f"""with {an.PANEL_SQL}
select series, d, seg, n, observed and coalesce(lag(observed) over (partition by series order by d), false) as eligible from panel""", day="d")
def w3_contiguous_segment(spark, sf):
    return panel.eligible(an.panel(spark, sf)).select("series", "d", "seg", "n", "eligible")


@query(f"with {an.PANEL_SQL} select series, d, round(last, 6) as last, round(actual, 6) as actual, round(drift5, 6) as drift5, history from target", day="d")
def w5_drift5_forecast(spark, sf):
    return _round(forecast.targets(an.panel(spark, sf)).select("series", "d", "last", "actual", "drift5", "history"), "last", "actual", "drift5")


@query(f"""with {an.PANEL_SQL},
v as (select *, stddev_samp(diff) over (partition by series, seg order by d rows between 5 preceding and current row) as vol from state)
select series, d as as_of, case when abs(drift / abs(pf) * 100) < 0.8 then 'estable' when drift > 0 then 'sube' else 'baja' end as dir,
  round(drift / abs(pf) * 100, 4) as delta_pct, round(pf + drift, 4) as pred, pf as last,
  case when vol > abs(pf) * 0.08 then 'baja' when abs(drift) > vol * 0.5 then 'alta' else 'media' end as conf
from v where d = (select max(d) from v) and n >= 4 and pf <> 0""", day="as_of")
def w6_confidence(spark, sf):
    return _round(forecast.next_day(an.panel(spark, sf)), "delta_pct", "pred", digits=4)


@query(f"with {an.PANEL_SQL} select series, d, persistence, weekly, actual from target", day="d")
def w9_weekly_persistence(spark, sf):
    return forecast.targets(an.panel(spark, sf)).select("series", "d", "persistence", "weekly", "actual")


@query(f"""with {an.PANEL_SQL},
w as (
  select series, d, lag(pf) over (partition by series order by d) as last, lag(n) over (partition by series order by d) as history,
    list(p) over (partition by series order by d rows between current row and 6 following) as week from panel),
f as (select *, list_filter(list_transform(week, lambda x: (x - last) / abs(last) * 100), lambda c: abs(c) >= 0.8) as moves
  from w where len(week) = 7 and len(list_filter(week, lambda x: x is not null)) = 7 and last is not null and last <> 0)
select series, d, history, last, case when len(moves) = 0 then 'estable' when moves[1] > 0 then 'sube' else 'baja' end as weekly_move from f""", day="d")
def w11_weekly_first_move(spark, sf):
    return forecast.first_weekly_move(an.panel(spark, sf))


@query("""with t as (select cast(o_orderdate as date) as d, sum(o_totalprice) as total from orders group by 1),
l as (select *, case when total > 0 and lag(total) over (order by d) > 0 then ln(total) - ln(lag(total) over (order by d)) end as r from t)
select d, round(case when count(r) over w >= 3 then stddev_samp(r) over w end, 6) as volatility from l window w as (order by d rows between 6 preceding and current row)""", day="d")
def w13_rolling_volatility(spark, sf):
    return _round(covariates.rolling_volatility(an.daily_orders(spark, sf), "total").select("d", "volatility"), "volatility")


@query(f"""with {an.PANEL_SQL}, c as (select series % 10 as grp, d, avg(pf) as value from panel group by 1, 2)
select grp, d, round(case when count(value) over w >= 7 then stddev_samp(value) over w / avg(value) over w end, 6) as cv
from c window w as (partition by grp order by d rows between 13 preceding and current row)""", day="d")
def w14_rolling_cv(spark, sf):
    daily = an.panel(spark, sf).groupBy((F.col("series") % 10).alias("grp"), "d").agg(F.avg("pf").alias("value"))
    return _round(covariates.rolling_cv(daily, "value", "grp").select("grp", "d", "cv"), "cv")


@query(f"""with {an.PANEL_SQL},
r0 as (select *, pf / lag(pf) over s - 1 as r from panel window s as (partition by series, seg order by d)),
f as (
  select *, least(greatest(r, -0.5), 0.5) as r1,
    least(greatest(avg(r) over (s rows between 2 preceding and current row), -0.5), 0.5) as r3,
    least(greatest(avg(r) over (s rows between 6 preceding and current row), -0.5), 0.5) as r7,
    least(greatest(avg(r) over (s rows between 27 preceding and current row), -0.5), 0.5) as r28,
    least(stddev_pop(r) over (s rows between 6 preceding and current row), 0.5) as std7,
    least(greatest(min(pf) over (s rows between 27 preceding and current row) / pf - 1, -0.5), 0.5) as low28,
    least(greatest(max(pf) over (s rows between 27 preceding and current row) / pf - 1, -0.5), 0.5) as high28,
    least(coalesce(n - last_value(case when abs(r) >= 0.008 then n end ignore nulls) over (s rows unbounded preceding), n - 1), 28) / 28.0 as move_age
  from r0 window s as (partition by series, seg order by d)),
e as (
  select series, d, observed and coalesce(lag(observed) over w, false) as eligible, p / lag(pf) over w - 1 as target_return, lag(n) over w as history,
    lag(r1) over w as r1, lag(r3) over w as r3, lag(r7) over w as r7, lag(r28) over w as r28, lag(std7) over w as std7,
    lag(low28) over w as low28, lag(high28) over w as high28, lag(move_age) over w as move_age
  from f window w as (partition by series order by d))
select series, d, round(r1, 6) as r1, round(r3, 6) as r3, round(r7, 6) as r7, round(r28, 6) as r28, round(std7, 6) as std7, round(low28, 6) as low28,
  round(high28, 6) as high28, round(move_age, 6) as move_age, round(target_return, 6) as target_return, isodow(d) - 1 as weekday
from e where eligible and history >= 4""", day="d")
def w15_features(spark, sf):
    rows = features.examples(an.panel(spark, sf)).withColumn("weekday", F.weekday("d").cast("long"))
    return _round(rows.select("series", "d", *features.NUMERIC, "target_return", "weekday"), *features.NUMERIC, "target_return")


@query(f"""with {an.PANEL_SQL}
select series, d, coalesce(last_value(p ignore nulls) over (partition by series order by d rows unbounded preceding), 100.0) as causal,
  coalesce(last_value(p ignore nulls) over (partition by series order by d rows unbounded preceding),
    first_value(p ignore nulls) over (partition by series order by d rows between current row and unbounded following), 100.0) as looking_ahead from panel""", day="d")
def w20_fill_defaults(spark, sf):
    return an.panel(spark, sf).select("series", "d", panel.fill_defaults("p", 100.0).alias("causal"), panel.fill_defaults("p", 100.0, True).alias("looking_ahead"))


_FEATURES = ("r1", "r3", "r7", "r28", "std7", "low28", "high28", "move_age")
_X1_COLUMNS = ", ".join(["{}"] * len(_FEATURES) + [*(f"(isodow(d) = {i + 1})::int" for i in range(7)), *(f"(series % 5 = {i})::int" for i in range(5))])



def _ridge_sql(numeric, only: str, days: str) -> str:
    """Tables up to ``r``: targets of the test days with the return that a ridge on strictly earlier days predicts.

    Test days are told by ``days``, examples by ``only``; ``numeric`` says how
    the features enter.
    """
    return f"""r0 as (select *, pf / lag(pf) over s - 1 as r from panel window s as (partition by series, seg order by d)),
f as (
  select *, least(greatest(r, -0.5), 0.5) as r1, least(greatest(avg(r) over (s rows between 2 preceding and current row), -0.5), 0.5) as r3,
    least(greatest(avg(r) over (s rows between 6 preceding and current row), -0.5), 0.5) as r7, least(greatest(avg(r) over (s rows between 27 preceding and current row), -0.5), 0.5) as r28,
    least(stddev_pop(r) over (s rows between 6 preceding and current row), 0.5) as std7,
    least(greatest(min(pf) over (s rows between 27 preceding and current row) / pf - 1, -0.5), 0.5) as low28,
    least(greatest(max(pf) over (s rows between 27 preceding and current row) / pf - 1, -0.5), 0.5) as high28,
    least(coalesce(n - last_value(case when abs(r) >= 0.008 then n end ignore nulls) over (s rows unbounded preceding), n - 1), 28) / 28.0 as move_age
  from r0 window s as (partition by series, seg order by d)),
e as (
  select series, d, observed and coalesce(lag(observed) over w, false) as eligible, p as actual, lag(pf) over w as last, lag(n) over w as history, {", ".join(f"lag({c}) over w as {c}" for c in _FEATURES)}
  from f window w as (partition by series order by d)),
x as (
  select series, d, last, actual, [1.0, {_X1_COLUMNS.format(*numeric)}]::double[] as v, least(greatest(actual / last - 1, -{features.CLIP}), {features.CLIP})::double as y
  from e where eligible and history >= 4 and {only}),
-- Sums and products by day, then over all days before each of the last eight.
products as (select d, i, j, sum(z[i] * z[j]) as m from (select d, list_append(v, y) as z from x), range(1, 23) a(i), range(1, 23) b(j) group by d, i, j),
moments as (select d, i, j, sum(m) over (partition by i, j order by d rows between unbounded preceding and 1 preceding) as m from products qualify {days}),
n as (select d, m as n from moments where i = 1 and j = 1), means as (select d, j, m / n as mean from moments join n using (d) where i = 1),
spread as (select o.d, o.i, o.j, o.m / n.n - a.mean * b.mean as c from moments o join n using (d) join means a on a.d = o.d and a.j = o.i join means b on b.d = o.d and b.j = o.j where o.i > 1 and o.j > 1),
scale as (select d, i, case when sqrt(greatest(c, 0)) > 1e-12 then sqrt(greatest(c, 0)) else 1.0 end as s from spread where i = j and i < 22),
-- The standardised normal equations with the penalty, a row of each with its right side, solved by elimination.
entry as (select p.d, p.i, p.j, p.c / a.s / coalesce(b.s, 1.0) + case when p.i = p.j then {features.ALPHA} / n.n else 0 end as c
  from spread p join n using (d) join scale a on a.d = p.d and a.i = p.i left join scale b on b.d = p.d and b.i = p.j where p.i < 22),
start as (select d, list(line order by i) as m from (select d, i, list(c order by j) as line from entry group by d, i) group by d),
solve(d, k, m) as (
  select d, 1, m from start
  union all
  select d, k + 1, list_transform(m, lambda line, i: case when i = k then list_transform(line, lambda c: c / m[k][k]) else list_transform(line, lambda c, j: c - line[k] * m[k][j] / m[k][k]) end) from solve where k <= 20),
weights as (select s.d, list(m[i - 1][21] / scale.s order by i) as w from solve s join scale on scale.d = s.d where s.k = 21 group by s.d),
bias as (select d, any_value(w) as w, max(mean) filter (j = 22) - sum(case when j between 2 and 21 then w[j - 1] * mean else 0 end) as b from weights join means using (d) group by d),
r as (select x.*, b + list_sum(list_transform(w, lambda c, i: c * v[i + 1])) as r, n.n from x join bias using (d) join n using (d))"""


_RIDGE = f"last * (1 + least(greatest(r, -{features.CLIP}), {features.CLIP}))"


@query(f"""with recursive {an.PANEL_SQL}, {_ridge_sql(_FEATURES, "r28 is not null", "dense_rank() over (order by d desc) <= 8")}
select series, d, round(last, 6) as last, round(actual, 6) as actual, round({_RIDGE}, 6) as ridge, n::bigint as training_examples from r""", day="d")
def x1_ridge_returns(spark, sf):
    rows = features.examples(an.panel(spark, sf)).where("r28 is not null")
    rows, chains = features.one_hot(rows.withColumn("chain", F.col("series") % 5), "chain", [str(i) for i in range(5)])
    return _round(features.walk_forward_ridge(rows, 8, [*features.NUMERIC, *features.DAYS, *chains]), "last", "actual", "ridge")


_EXTERNAL_SQL = f"""{an.PANEL_SQL},
ctx as (select series, d, list(pf) filter (pf is not null) over (partition by series order by d rows between 60 preceding and 1 preceding) as h from panel),
ext as (select t.*, h, case when len(h) >= 6 and len(h) % 5 <> 0 then list_avg(h[-3:]) end as external from target t join ctx using (series, d))"""


def _predictor(h: list[float]) -> list[list[float]]:
    """Stands for a zero-shot model: the mean of three prices, in nested lists; it fails on some contexts."""
    if len(h) < 6 or len(h) % 5 == 0:
        raise ValueError("no forecast")
    return [[sum(h[-3:]) / 3, h[-1]]]


def _external(spark, sf):
    p = an.panel(spark, sf)
    rows = forecast.targets(p).select("series", "d").join(p.select("series", "d", panel.context().alias("h")), ["series", "d"])
    return p, features.external_forecasts(rows, _predictor)


@query(f"with {_EXTERNAL_SQL} select series, d, round(external, 6) as external, external is null as failed from ext", day="d")
def x2_external_model(spark, sf):
    return _round(_external(spark, sf)[1], "external")


@query(f"""with {_EXTERNAL_SQL}, b as (
  select series, d, h as hist, case when len(h) = 1 then h[1] when len(h) >= 3 then h[len(h)] + list_avg(list_transform(range(greatest(len(h) - 4, 1), len(h)), lambda i: h[i + 1] - h[i])) else h[len(h)] end as mid
  from (select series, d, list(p) filter (p is not null) over (partition by series order by d rows between 60 preceding and 1 preceding) as h from panel) where len(h) >= 1)
select series % 5 as config, count(*) as n, count(*) filter (external is null) as fallbacks, 0 as covariates_dropped, round(avg(coalesce(external, mid)), 4) as mean_forecast
from ext join b using (series, d) group by 1""")
def a23_fallback_counts(spark, sf):
    p, external = _external(spark, sf)
    rows = features.with_fallback(external, forecast.naive_band(p)).withColumn("config", F.col("series") % 5).withColumn("dropped", F.lit(False))
    return _round(features.fallback_counts(rows, ["config"]).join(rows.groupBy("config").agg(F.avg("forecast").alias("mean_forecast")), "config"), "mean_forecast", digits=4)


# Scalars.

_TEXTS = """case p_partkey % 7 when 0 then ' ' || p_size || ',' || (p_partkey % 10) || ' ' when 1 then '-' || p_size when 2 then p_size || '.5'
  when 3 then p_size || 'kg' when 4 then '0' when 5 then '' else p_size || '.000,' || p_size end"""


@query(f"""with t as (select p_partkey, {_TEXTS} as s from part), u as (select *, replace(trim(s), ',', '.') as c from t)
select p_partkey, case when regexp_full_match(c, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') and try_cast(c as double) > 0 then try_cast(c as double) end as number from u""")
def m1_positive_number(spark, sf):
    return an.table(spark, sf, "part").select("p_partkey", num.positive_number(F.expr(_TEXTS)).alias("number"))


_UNITS = """case p_partkey % 6 when 0 then ' gr. ' when 1 then 'Kg' when 2 then 'cm3' when 3 then 'docena' when 4 then 'LTS..' else 'caja' end"""
_SCALE = """case p_partkey % 6 when 0 then 0.001::double when 1 then 1.0::double when 2 then 0.001::double when 3 then 12.0::double when 4 then 1.0::double end"""


@query(f"""select p_partkey, round(p_size * {_SCALE}, 9) as amount,
  case p_partkey % 6 when 0 then 'kg' when 1 then 'kg' when 2 then 'L' when 3 then 'u' when 4 then 'L' else '?' end as base from part""")
def m4_base_quantity(spark, sf):
    unit = F.expr(_UNITS)
    return _round(an.table(spark, sf, "part").select("p_partkey", num.base_quantity(F.col("p_size"), unit).alias("amount"), num.unit_base(unit).alias("base")), "amount", digits=9)


@query(f"select p_partkey, round(p_retailprice / (p_size * {_SCALE}), 6) as unit_price from part")
def m5_price_per_unit(spark, sf):
    return _round(an.table(spark, sf, "part").select("p_partkey", num.price_per_unit(F.col("p_retailprice"), F.col("p_size"), F.expr(_UNITS)).alias("unit_price")), "unit_price")


_DESCRIPTIONS = """case p_partkey % 6 when 0 then p_name || ' X ' || p_size || ' GR' when 1 then p_name || ' ' || p_size || ' x 125 g' when 2 then '75 G X ' || p_size || ' UN ' || p_name
  when 3 then p_name || ' PAQ-' || p_size || '-gr. ' || p_size || ' g' when 4 then p_name || ' ' || p_size || ' kg 7 kg' else p_name || ' ' || p_size || ' ml' end"""


@query("""select p_partkey, round(case p_partkey % 6 when 0 then p_size * 0.001 when 1 then p_size * 0.125 when 2 then p_size * 0.075
  when 3 then p_size * 0.001 when 4 then case when p_size = 7 then 7.0 end end, 9)::double as amount from part""")
def m6_description_quantity(spark, sf):
    rows = an.table(spark, sf, "part").select("p_partkey", txt.description_quantity(F.expr(_DESCRIPTIONS), F.lit("kg")).alias("amount"))
    return _round(rows, "amount", digits=9)


_VOLUMES = """case p_partkey % 5 when 0 then p_name || ' ' || p_size || ' ML x 6 UN' when 1 then 'Aceite ' || p_name || ' 1,5 lts' when 2 then 'HUEVO blanco X ' || p_size || ' C T'
  when 3 then p_name || ' ' || p_size || ' UNI' else p_name || ' ' || p_size || ' g' end"""


@query("""select p_partkey, round(case p_partkey % 5 when 0 then p_size * 0.006::double when 1 then 1.5::double end, 9) as litres,
  case p_partkey % 5 when 0 then 6 when 2 then p_size when 3 then p_size end::double as pieces from part""")
def m6_litres_and_pieces(spark, sf):
    quantity = lambda unit: txt.description_quantity(F.expr(_VOLUMES), F.lit(unit))
    return _round(an.table(spark, sf, "part").select("p_partkey", quantity("L").alias("litres"), quantity("u").alias("pieces")), "litres", digits=9)


@query("select doc_id, md5(strip_accents(lower(text))) as digest from documents")
def m8_normalize_text(spark, sf):
    return an.table(spark, sf, "documents").select("doc_id", F.md5(txt.normalize_text(F.col("text"))).alias("digest"))


@query("""select l_orderkey, l_linenumber, l_partkey, '$' || replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '#'), '.', ','), '#', '.') as shown,
  strftime(l_shipdate, '%d/%m/%Y') as day from lineitem""")
def m12_es_number_format(spark, sf):
    return an.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", num.money(F.col("l_extendedprice"), 2).alias("shown"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("day"))


@query("""select page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as safe from pages""")
def m13_html_escape(spark, sf):
    return an.table(spark, sf, "pages").select("page_id", txt.html_escape(F.col("url")).alias("safe"))


# Presentation.


@query(f"""with {an.OFFERS_SQL}, b as (select item, chain, price, count(*) over (partition by item) as k, min(price) over (partition by item) as low from best)
select item, chain, round(price, 6) as price, k > 1 and price = low as best from b""")
def v2_best_highlight(spark, sf):
    cells = _best(spark, sf).select("item", "chain", "price", present.comparable(F.col("price"), F.lit("kg"), F.lit("kg")).alias("comparable"))
    return _round(present.highlighted(cells).select("item", "chain", "price", "best"), "price")


@query(f"""with {an.PANEL_SQL},
f as (select series, d, pf as last, pf + drift as pred, drift / abs(pf) * 100 as delta_pct, n from state where d = (select max(d) from state) and n >= 4 and pf <> 0),
c as (select series, d, case when series % 3 = 0 then p + 1 else p end as price from panel where d = (select max(d) from panel) and p is not null)
select c.series, c.price, coalesce(abs(last - price) <= 0.011 and pred > 0, false) as shown,
  case when abs(last - price) <= 0.011 and pred > 0 then case when abs(delta_pct) < 0.8 then 'estable' when delta_pct > 0 then 'sube' else 'baja' end end as shown_dir
from c left join f using (series)""")
def v4_forecast_gate(spark, sf):
    p = an.panel(spark, sf)
    end = p.agg(F.max("d").alias("end"))
    last = p.where("p is not null").join(F.broadcast(end), F.col("d") == F.col("end"))
    cells = last.select("series", F.when(F.col("series") % 3 == 0, F.col("p") + 1).otherwise(F.col("p")).alias("price"))
    return present.with_forecast(cells, forecast.next_day(p), ["series"]).select("series", "price", "shown", "shown_dir")


@query(f"""with {an.PANEL_SQL}, m as (select series, round(avg(abs(drift5 - actual)), 6) as mae from scored group by 1)
(select series, mae, 'low' as "end" from m order by mae, series limit 10) union all (select series, mae, 'high' as "end" from m order by mae desc, series limit 5)""")
def o3_top_bottom_k(spark, sf):
    m = _round(scoring.errors(_scored(spark, sf), "drift5", ["series"]).select("series", "mae"), "mae")
    return present.top_and_bottom(m, "mae", ["series"])


@query(f"""with {an.ITEMS_SQL}, o as (select item, unit, coalesce(list_position(['u', 'kg'], unit), 3) as place from item_dim)
select item, unit, cast(place as int) as place from o""")
def o2_group_order(spark, sf):
    rows = present.in_group_order(an.items(spark, sf), "unit", ["u", "kg"]).select("item", "unit", F.col("place").cast("int").alias("place"))
    return rows.orderBy("place", "item")


@query(f"""with {an.PANEL_SQL}, c as (select series, count(p) as observations from panel group by series)
select series from c order by series % 3 <> 1, case when series % 3 = 1 then -observations else 0 end, series limit 1""")
def o5_example_series(spark, sf):
    p = an.panel(spark, sf)
    categories = p.select("series").distinct().withColumn("category", F.when(F.col("series") % 3 == 1, "shown"))
    return present.example_series(p, categories, "shown")


@query("select s_suppkey, s_name, s_acctbal from supplier where s_acctbal <= 2000 order by s_acctbal, s_suppkey limit 15")
def o4_reject_sample(spark, sf):
    rows = an.table(spark, sf, "supplier").where("s_acctbal <= 2000").select("s_suppkey", "s_name", "s_acctbal")
    return present.rejected_sample(rows, ["s_acctbal", "s_suppkey"])


# Rules of the import, over the driver's tables.


@query("""select p_partkey, case p_partkey % 6 when 0 then p_name else p_name || '|' || p_size end as value from part where p_partkey % 6 in (0, 5)""")
def s1_feed_lines(spark, sf):
    text = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("\ufeff"), F.col("p_name"))).when(F.col("p_partkey") % 6 == 1, " \t ").when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("Ultima "), F.col("p_name")))
    text = text.when(F.col("p_partkey") % 6 == 3, "Última").when(F.col("p_partkey") % 6 == 4, "").otherwise(F.concat_ws("|", "p_name", "p_size"))
    return feed.clean_lines(an.table(spark, sf, "part").select("p_partkey", text.alias("value")))


@query("""select cast(p_partkey as varchar) as id, p_name || '|"' || p_type as name, case when p_partkey % 2 = 0 then cast(p_size as varchar) end as size from part""")
def s1_mixed_headers(spark, sf):
    """Two sets of files whose headers differ in order and number of columns, with bars and quotes in fields."""
    rows = an.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit('|"'), "p_type").alias("name"), F.col("p_size").alias("size"))
    folder = shared_folder(spark, "feed")
    for k, columns in enumerate((["name", "size", "id"], ["id", "name"])):
        rows.where(F.col("id") % 2 == k).select(columns).write.options(header=True, sep="|", escape='"').csv(f"{folder}/{k}")
    return feed.read_feed(spark, [f"{folder}/0", f"{folder}/1"]).select("id", "name", "size")


def _area_products(spark, paths):
    shops = feed.parsed(archives.scan(spark, paths), "sucursales.csv", [*feed.IDENTITY, "sucursales_localidad"]).where("sucursales_localidad = 'Rosario'")
    rows = archives.selected_products(spark, paths, shops, feed.NEEDED)
    return rows.select(F.col("id_comercio").alias("chain"), F.col("id_bandera").alias("banner"), F.col("id_sucursal").alias("branch"), F.col("id_producto").alias("product"), F.col("productos_precio_lista").alias("price"))


_AREA_SQL = """select cast(l_suppkey % 4 as varchar) as chain, cast(l_linenumber % 3 as varchar) as banner, cast(l_orderkey % 50 as varchar) as branch,
l_orderkey || '-' || l_linenumber as product, cast(cast(l_quantity as int) as varchar) as price from lineitem where l_orderkey % 50 % 7 = 0"""


@query(_AREA_SQL)
def s2_zip_of_zips(spark, sf):
    return _area_products(spark, an.feed_archives(spark, sf, "zip"))


@query(_AREA_SQL)
def s3_tar_of_frames(spark, sf):
    return _area_products(spark, an.feed_archives(spark, sf, "tar.zst"))


@query("""select d, id, tried from (select cast(o_orderdate as date) as d, o_orderkey as id, o_orderpriority as tried,
  rank() over (partition by cast(o_orderdate as date) order by o_orderpriority desc) as r from orders) where r = 1""", day="d")
def t6_latest_attempts(spark, sf):
    rows = an.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tried"))
    return audit.latest_attempts(rows, "d", "tried")


@query("""with days as (select cast(unnest(generate_series(date '1995-01-01', date '1996-12-31', interval 1 day)) as date) as d),
have as (select distinct cast(o_orderdate as date) as d from orders where o_orderstatus = 'P'), link as (select distinct cast(l_shipdate as date) as d from lineitem where l_linenumber = 1)
select d, 'open' as state from link where d not in (select d from have) union all select d, 'dark' from days where d not in (select d from link) and d not in (select d from have)""", day="d")
def j13_unresolved_days(spark, sf):
    have = an.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("d"))
    link = an.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.to_date("l_shipdate").alias("d"))
    open_, dark = audit.unresolved_days(audit.day_range(spark, "1995-01-01", "1996-12-31"), link, have)
    return open_.withColumn("state", F.lit("open")).unionByName(dark.withColumn("state", F.lit("dark")))


@query("select l_orderkey, l_linenumber from lineitem where exists (select 1 from orders where o_orderpriority = '1-URGENT' and o_orderkey = l_orderkey and o_custkey % 100 = l_suppkey % 100)")
def j12_known_source(spark, sf):
    index = an.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("url"), (F.col("o_custkey") % 100).alias("revision"))
    rows = an.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("url"), (F.col("l_suppkey") % 100).alias("revision"))
    return audit.with_known_source(rows, index).select("l_orderkey", "l_linenumber")


@query("""with r as (select l_orderkey as id, l_returnflag as flag, l_linenumber % 2 as price from lineitem),
v as (select id, flag, price, count(*) as copies from r group by all)
select id, count(*) > 1 as identity_conflict, case when count(*) = 1 then min(price) end as price, cast(sum(copies) as bigint) - 1 as duplicate_rows,
  case when count(*) > 1 then string_agg(flag || ':' || price, ',' order by flag, price) end as variants from v group by id""")
def a7_withheld_prices(spark, sf):
    rows = an.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") % 2).alias("price"))
    held = offers.quarantine(rows, ["id"], ["flag", "price"], "price")
    shown = F.array_join(F.transform("source_variants", lambda v: F.concat_ws(":", v["flag"], v["price"])), ",")
    return held.select("id", "identity_conflict", "price", "duplicate_rows", shown.alias("variants"))


@query("""select o_orderpriority as import_version, count(*) as days, cast(sum(o_custkey) as bigint) as bytes, cast(sum(o_orderkey) as bigint) as observations, cast(sum(o_custkey % 3) as bigint) as conflicts
from orders where o_orderstatus = 'F' group by 1""")
def a19_import_counters(spark, sf):
    days = an.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "imported").otherwise("existing").alias("status"), F.col("o_orderpriority").alias("import_version"), F.col("o_custkey").alias("compressed_bytes"), F.col("o_orderkey").alias("observations"), (F.col("o_custkey") % 3).alias("conflicts"))
    return audit.import_counters(days)


@query("""select l_orderkey, l_linenumber from lineitem where l_quantity > 0 and not (l_extendedprice / l_quantity > 0 and abs(round(l_extendedprice / l_quantity, 1) - l_extendedprice / l_quantity) <= 0.011)""")
def a19_inconsistent_cells(spark, sf):
    unit = F.try_divide("l_extendedprice", "l_quantity")
    cells = an.table(spark, sf, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price_lista"), F.col("l_quantity").alias("normalized_quantity"), num.rounded(unit, 1).alias("price"))
    return audit.inconsistent_cells(cells).select("l_orderkey", "l_linenumber")


@query(f"""with {an.PANEL_SQL}, many as (select series from panel group by series having count(p) >= 25)
select series, d, p from panel where series in (select series from many) and d > (select max(d) from panel) - 30""", day="d")
def f10_w17_recent_of_long_series(spark, sf):
    return panel.last_days(panel.enough_observations(an.panel(spark, sf), 25)).select("series", "d", "p")


@query("""with r as (select o_orderpriority as series, cast(o_orderdate as date) as d, max(o_totalprice) as p from orders group by 1, 2),
days as (select cast(unnest(generate_series(date '1995-03-01', date '1995-12-31', interval 1 day)) as date) as d),
g as (select s.series, days.d, r.p from (select distinct series from r) s cross join days left join r on r.series = s.series and r.d = days.d)
select series, d, p, last_value(p ignore nulls) over (partition by series order by d rows between 10 preceding and current row) as pf from g""", day="d")
def w2_published_fill(spark, sf):
    rows = an.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("p"))
    return panel.filled_between(rows, "1995-03-01", "1995-12-31")


@query("""select d, source, max_by(value_sell, k) as value_sell from (select cast(o_orderdate as date) as d, o_orderpriority as source, o_orderkey as k, o_totalprice as value_sell from orders) group by 1, 2""", day="d")
def s13_last_per_day(spark, sf):
    rows = an.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value_sell"))
    return covariates.last_per_day(rows, "d", "value_sell", "k")


@query("""select l_orderkey, l_linenumber, round((l_extendedprice - l_quantity) / nullif(l_quantity, 0), 9) as gap, round(l_extendedprice / nullif(l_quantity, 0) - 1, 9) as change from lineitem""")
def m15_gap(spark, sf):
    blue, official = F.col("l_extendedprice"), F.col("l_quantity")
    return _round(an.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", covariates.gap(blue, official).alias("gap"), num.relative_change(blue, official).alias("change")), "gap", "change", digits=9)


@query("""with m as (select last_day(cast(o_orderdate as date)) as month_end from orders)
select max(month_end) + 75 < date '1998-10-01' as stale, max(month_end) + 75 < date '1998-11-30' as later from m""")
def m22_stale_index(spark, sf):
    index = covariates.published(an.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("month"), F.lit(1.0).alias("value")))
    return covariates.stale(index, F.lit("1998-10-01").cast("date")).crossJoin(covariates.stale(index, F.lit("1998-11-30").cast("date")).withColumnRenamed("stale", "later"))


@query(f"""with {an.PANEL_SQL}, r as (
  select series, d, pf / 100 as fx_gap, diff as fx_volatility, 100 + n as index_value, case when series % 2 = 0 then p else 0 end as competitor,
    coalesce(max(abs(case when series % 2 = 0 then p else 0 end)) over (partition by series order by d rows between 60 preceding and 1 preceding), 0) = 0 as silent from diffs)
select series, d, config, case when config <> 'price_only' then round(fx_gap, 6) end as fx_gap, case when config <> 'price_only' then round(fx_volatility, 6) end as fx_volatility,
  case when config = 'plus_fx_ipim' then round((index_value - 100) / 10, 6) end as index_scaled, case when config = 'plus_fx_competitor' and not silent then round(competitor / 1000, 6) end as competitor_scaled,
  config = 'plus_fx_competitor' and silent as dropped
from r cross join (select unnest(['price_only', 'plus_fx', 'plus_fx_ipim', 'plus_fx_competitor']) as config)""", day="d")
def x4_configurations(spark, sf):
    rows = forecast.with_differences(an.panel(spark, sf))
    rows = rows.select("series", "d", (F.col("pf") / 100).alias("fx_gap"), F.col("diff").alias("fx_volatility"), (100 + F.col("n")).cast("double").alias("index_value"), F.when(F.col("series") % 2 == 0, F.col("p")).otherwise(0.0).alias("competitor"))
    return _round(covariates.configured(rows), "fx_gap", "fx_volatility", "index_scaled", "competitor_scaled")


@query(f"""with {an.PANEL_SQL}, w as (select * from scored where d between (select max(d) from panel) - 20 and (select max(d) from panel) - 5)
select a.series, a.d, a.last, a.actual from w a where a.series % 7 = 1""", day="d")
def f9_f11_window_and_cohort(spark, sf):
    rows = _scored(spark, sf)
    end = an.panel(spark, sf).agg(F.max("d").alias("e")).first()["e"]
    window = [str(end - datetime.timedelta(days=k)) for k in (20, 5)]
    chosen = evaluation.in_window(rows, *window)
    return evaluation.of_cohort(chosen, chosen.where("series % 7 = 1")).select("series", "d", "last", "actual")


@query(f"""with recursive {an.PANEL_SQL}, w as (select * from scored where d >= (select max(d) from panel) - 7),
{_ridge_sql([f"coalesce({c}, 0)" for c in _FEATURES], "true", "d >= (select max(d) from panel) - 7")},
l as (select w.series, w.d, w.last, w.actual, case when identity <> identity_before then true else false end as description_changed, persistence, drift5, weekly, w.history, {_RIDGE.replace("last", "r.last", 1)} as ridge, r.n
  from w left join r on r.series = w.series and r.d = w.d)
select series, d, round(last, 6) as last, round(actual, 6) as actual, description_changed, round(persistence, 6) as persistence, round(drift5, 6) as drift5, round(weekly, 6) as weekly, round(ridge, 6) as ridge,
  n::bigint as training_examples, history < 7 as weekly_fallback, least(history, 60) as context_days from l""", day="d")
def k9_stage_predictions(spark, sf):
    p = an.panel(spark, sf).withColumn("chain", F.col("series") % 5)
    end = p.agg(F.max("d").alias("e")).first()["e"]
    rows = evaluation.predictions(p, (str(end - datetime.timedelta(days=7)), str(end)), {"chain": [str(i) for i in range(5)]})
    rows = rows.select("series", "d", "last", "actual", "description_changed", "persistence", "drift5", "weekly", "ridge", "training_examples", "weekly_fallback", "context_days")
    return _round(rows, "last", "actual", "persistence", "drift5", "weekly", "ridge")


_BASKET_TEXT = """case p_partkey % 9 when 0 then 'LECHE Entera ' || p_size || ' L' when 1 then 'Azúcar ' || p_name when 2 then 'dulce de leche entera' when 3 then 'Pan Lactal ' || p_size
  when 4 then 'Puré de tomate' when 5 then 'Papas ' || p_name when 6 then 'PAPA NEGRA x kg' when 7 then 'Jugo de manzana' else 'Jabón de tocador ' || p_name end"""


@query("""select p_partkey, case p_partkey % 9 when 0 then 'leche_entera' when 1 then 'azucar' when 3 then 'pan_lactal' when 4 then 'tomate_triturado' when 6 then 'papa' when 8 then 'jabon_tocador' end as item from part""")
def m9_basket_items(spark, sf):
    excluded = {"leche_entera": ["dulce de leche"], "manzana": ["jugo"]}
    return an.table(spark, sf, "part").select("p_partkey", txt.keyword_class(txt.normalize_text(F.expr(_BASKET_TEXT)), rules(excluded)).alias("item"))


@query(f"""with t as (select p_partkey, p_size, p_retailprice as price, case p_partkey % 6 when 0 then 0.001::double when 1 then 1.0::double end as scale from part),
q as (select *, case when p_partkey % 11 = 0 then null when scale is not null then p_size * scale when p_partkey % 6 = 2 then p_size * 0.075 when p_partkey % 6 = 3 then p_size * 0.001
  when p_partkey % 6 = 4 and p_size = 7 then 7.0 end as quantity from t)
select p_partkey, round(quantity, 9) as normalized_quantity, case when quantity is not null then 'kg' else '?' end as unit_name,
  case when p_partkey % 11 = 0 then 'conflicting-source-rows' when quantity is null then 'unverified' when scale is not null then 'presentation' else 'description' end as price_basis,
  round(price / quantity, 1) as price from q""")
def m7_verified_contents(spark, sf):
    rows = an.table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("price_lista"), F.col("p_size").cast("double").alias("cantidad_presentacion"), F.expr(_UNITS).alias("unidad_presentacion"),
        F.expr(_DESCRIPTIONS).alias("descripcion"), F.lit("kg").alias("unit"), (F.col("p_partkey") % 11 == 0).alias("identity_conflict"),
    )
    made = daily.verified_contents(rows).withColumn("price", num.rounded(F.when(F.col("price").isNotNull(), num.positive_number(F.col("price_lista")) / F.col("normalized_quantity")), 1))
    return _round(made.select("p_partkey", "normalized_quantity", "unit_name", "price_basis", "price"), "normalized_quantity", digits=9)


@query("""with t as (select p_partkey, regexp_replace(p_brand || '-' || p_partkey, '[^0-9]', '', 'g') as k from part)
select p_partkey, k = '12' or k = '1212345' or starts_with(k, '1212345') or k = '99' as found from t""")
def m10_barcode_prefixes(spark, sf):
    code = F.concat_ws("-", "p_brand", "p_partkey")
    return an.table(spark, sf, "part").select("p_partkey", txt.digits_match(code, ["12", "12-12345", "99"]).alias("found"))


@query("""select c_custkey, case when c_nationkey % 3 = 0 then 'rosario' else 'gran' end as zone from customer""")
def m11_zone_of(spark, sf):
    place = F.when(F.col("c_nationkey") % 3 == 0, "\tRosario ").when(F.col("c_nationkey") % 3 == 1, "Funes")
    return an.table(spark, sf, "customer").select("c_custkey", offers.zone_of(place).alias("zone"))


@query("""select s_suppkey, coalesce(n_name, 'Otro') as category from supplier left join (select * from nation where n_regionkey > 1) on s_nationkey = n_nationkey""")
def m20_category_or_other(spark, sf):
    dimension = an.table(spark, sf, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("item"), F.col("n_name").alias("category"))
    rows = an.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("item"))
    return offers.with_category(rows, dimension).select("s_suppkey", "category")


@query("select p_partkey, p_retailprice as price from part where p_partkey % 3 = 0 and p_retailprice > 0")
def f4_f5_priced_rows(spark, sf):
    text = F.when(F.col("p_partkey") % 3 == 0, F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))).when(F.col("p_partkey") % 3 == 1, "-1").otherwise("n/a")
    return offers.with_price(an.table(spark, sf, "part").select("p_partkey", text.alias("t")), "t").select("p_partkey", "price")


@query(f"""with {an.OFFERS_SQL}, t as (select zone, chain, count(*) as items_found from kept group by zone, chain),
z as (select 'core' as zone union all select 'wide' union all select 'empty')
select zone, chain, items_found, min(items_found) over (partition by zone) = max(items_found) over (partition by zone) as rankable from t where zone in (select zone from z)""")
def v3_v6_zones_and_ranks(spark, sf):
    totals = _kept(spark, sf).groupBy("zone", "chain").agg(F.count(F.lit(1)).alias("items_found"))
    zones = spark.createDataFrame([("core",), ("wide",), ("empty",)], "zone string")
    return totals.join(present.visible_zones(zones, totals), "zone", "left_semi").withColumn("rankable", present.rankable(totals))


@query("""select p_partkey, p_name as name, case when p_partkey % 4 = 0 then null else p_brand || '|' || p_size end as brand, case when p_partkey % 4 = 0 then null else p_type end as kind from part where p_partkey % 7 > 0""")
def x5_feed_records(spark, sf):
    """Lines to records by a table function whose columns follow the header."""
    registry.register(spark)
    line = F.when(F.col("p_partkey") % 7 == 0, "Ultima linea").when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.format_string('%s|"%s|%s"|%s|more', "p_name", "p_brand", "p_size", "p_type"))
    an.table(spark, sf, "part").select("p_partkey", line.alias("line")).createOrReplaceTempView("tl_part_lines")
    return spark.sql("select * from tl_records(table(select p_partkey, line from tl_part_lines), 'name|brand|kind')")


@query("""with s as (select p_partkey, unnest([{'nth': 1, 'amount': p_size * 0.001::double, 'unit': 'kg', 'times': case when p_partkey % 3 = 0 then 6.0::double end},
  {'nth': 2, 'amount': 1.5::double, 'unit': 'L', 'times': null}]) as x from part)
select p_partkey, x.nth as nth, round(x.amount, 9) as amount, x.unit as unit, x.times as times from s""")
def x5_printed_sizes(spark, sf):
    """A row for every size a description prints."""
    registry.register(spark)
    text = F.concat(F.lit("caja "), F.when(F.col("p_partkey") % 3 == 0, "6 x ").otherwise(""), F.col("p_size").cast("string"), F.lit(" GR y botella de 1,5 lts"))
    an.table(spark, sf, "part").select("p_partkey", text.alias("text")).createOrReplaceTempView("tl_part_texts")
    return _round(spark.sql("select * from tl_sizes(table(select p_partkey, text from tl_part_texts), '*')"), "amount", digits=9)


@query("""with o as (select cast(o_orderdate as date) as d, case o_orderkey % 2 when 0 then 'blue' else 'oficial' end as source, o_totalprice as v from orders),
days as (select distinct d from o),
span as (select cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from days),
r as (select d, max(v) filter (source = 'blue') as blue, max(v) filter (source = 'oficial') as oficial from o where day(d) < 12 group by d),
f as (select d, last_value(blue ignore nulls) over w as blue, last_value(oficial ignore nulls) over w as oficial from span left join r using (d) window w as (order by d rows between 10 preceding and current row)),
l as (select *, case when blue > 0 and lag(blue) over (order by d) > 0 then ln(blue) - ln(lag(blue) over (order by d)) end as change from f),
x as (select *, case when count(change) over w >= 3 then stddev_samp(change) over w end as volatility from l window w as (order by d rows between 6 preceding and current row)),
m as (select (last_day(month) + 60)::date as known_on, v from (select date_trunc('month', d)::date as month, round(avg(v), 4) as v from o group by 1)),
a as (select days.d, m.v from days asof left join m on days.d >= m.known_on)
select d, a.v as ipim_index, blue as fx_blue, oficial as fx_oficial, null::double as fx_mep, round((blue - oficial) / oficial, 6) as fx_gap, round(volatility, 6) as fx_volatility from a join x using (d)""", day="d")
def s13_s14_covariate_table(spark, sf):
    orders = an.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 2 == 0, "Blue").otherwise("Oficial").alias("source"), F.col("o_totalprice").alias("value_sell"))
    rates = orders.where(F.dayofmonth("d") < 12).groupBy("d", "source").agg(F.max("value_sell").alias("value_sell"))
    index = orders.groupBy(F.to_date(F.date_trunc("month", "d")).alias("month")).agg(num.rounded(F.avg("value_sell"), 4).alias("value"))
    return _round(runs.covariate_table(orders.select("d"), rates, index), "fx_gap", "fx_volatility")


_AUDIT_SQL = """with days as (select distinct cast(o_orderdate as date) as d from orders where o_custkey % 3 = 0),
entry as (select distinct cast(l_shipdate as date) as d, l_linenumber as id from lineitem where l_suppkey % 5 > 0),
open as (select distinct d from entry where d not in (select d from days)),
tried as (select cast(l_shipdate as date) as d, l_linenumber as id, bool_and(l_quantity > 3) as mismatch from lineitem where l_partkey % 7 > 0 group by 1, 2),
v as (select d, bool_and(tried.id is not null and coalesce(mismatch, false)) as rejected from entry join open using (d) left join tried using (d, id) group by d),
span as (select cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) as d from days)
select d, case when rejected then 'rejected' else 'unresolved' end as state from v
union all select d, 'unavailable' from span where d not in (select d from days) and d not in (select d from entry)"""


@query(_AUDIT_SQL, day="d")
def t2_t1_audited_days(spark, sf):
    """Days without data: rejected, unresolved or unavailable, as the audit tells them."""
    lines = an.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.col("l_linenumber").cast("long").alias("id"), "l_suppkey", "l_partkey", "l_quantity")
    days = an.table(spark, sf, "orders").where("o_custkey % 3 = 0").select(F.to_date("o_orderdate").alias("d"), F.lit(None).cast("string").alias("source")).distinct()
    link = F.when(F.col("l_suppkey") % 5 > 0, "u")
    entries = lines.select("d", "id", link.alias("link")).distinct()
    error = F.when(F.col("l_quantity") > 3, "expected x, found y").otherwise("no download")
    tried = lines.where("l_partkey % 7 > 0").select("d", F.struct(F.col("id").alias("revision"), F.lit("u").alias("url"), error.alias("error")).alias("r"))
    manifest = tried.groupBy("d").agg(F.collect_set("r").alias("rejected"))
    none = [F.lit(None).cast(c).alias(n) for n, c in (("status", "string"), ("import_version", "string"), ("compressed_bytes", "long"), ("observations", "long"), ("conflicts", "long"))]
    cells = days.limit(0).select(F.col("d").cast("string").alias("date"), *(F.lit(None).cast("double").alias(c) for c in ("price", "price_lista", "normalized_quantity")))
    found = runs.audit_frames(days, cells, entries, manifest.select("*", *none))
    states = ("rejected", "unresolved", "unavailable")
    rows = [found[k].select("d", F.lit(k).alias("state")) for k in states]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_ATTEMPTS_SQL = """with a as (select cast(o_orderdate as date) as d, case when o_orderkey % 9 > 0 then o_custkey % 4 end as revision,
  case o_orderstatus when 'F' then 'imported' when 'O' then 'rejected' else 'listed' end as outcome, o_orderkey % 100 as f from orders),
l as (select d, revision, outcome = 'imported' as taken, f from a where outcome <> 'listed' and revision is not null
  qualify row_number() over (partition by d, revision order by f desc, outcome = 'imported' desc) = 1),
g as (select d, count(*) filter (taken) as n, arg_max(revision, f * 10 + revision) filter (taken) as revision, string_agg(revision, ',' order by revision) filter (not taken) as rejected, count(*) as attempts from l group by d)
select d, case when n > 1 then 'revised' when n = 1 then 'imported' when attempts > 0 then 'failed' else 'to do' end as status, revision, coalesce(rejected, '') as rejected, coalesce(attempts, 0) as attempts
from (select distinct d from a) left join g using (d)"""


def _attempts(spark, sf):
    outcome = F.when(F.col("o_orderstatus") == "F", attempts.IMPORTED).when(F.col("o_orderstatus") == "O", attempts.REJECTED).otherwise(attempts.LISTED)
    revision = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey") % 4).cast("long")
    return an.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), revision.alias("revision"), outcome.alias("outcome"), F.col("o_orderpriority").alias("error"), (F.col("o_orderkey") % 100).cast("long").alias("finished_at"))


@query(_ATTEMPTS_SQL, day="d")
def t5_t6_day_states(spark, sf):
    return attempts.states(_attempts(spark, sf)).withColumn("rejected", F.array_join("rejected", ","))


@query(_ATTEMPTS_SQL, day="d")
def t5_k6_day_states_streamed(spark, sf):
    """The same from a stream in four parts, of which every second attempt comes twice."""
    folder = shared_folder(spark, "attempts")
    rows = _attempts(spark, sf)
    for k in range(4):
        part = F.pmod(F.hash("d", "revision", "finished_at"), F.lit(4))
        rows.where((part == k) | ((part == (k + 1) % 4) & (F.col("finished_at") % 2 == 0))).write.parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema(attempts.ATTEMPT).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in/part=*")
    attempts.keep_manifest(attempts.state_updates(stream), f"{folder}/out", f"{folder}/marks").trigger(availableNow=True).start().awaitTermination()
    return attempts.compacted(spark, f"{folder}/out").withColumn("rejected", F.array_join("rejected", ","))


@query("""select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_custkey % 2 = 0 and o_custkey % 3 = 0""")
def v5_accepted_forecasts(spark, sf):
    day = lambda k: F.when(F.col("o_custkey") % k == 0, "2024-01-02").otherwise("2024-01-01")
    rows = an.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "real").otherwise("demo").alias("mode"), F.col("o_orderpriority").alias("version"), day(2).alias("as_of"), day(3).alias("item_as_of"))
    return present.accepted_forecasts(rows, "2024-01-02", "1-URGENT").select("o_orderkey")


@query("select s_suppkey, case when s_nationkey % 2 = 0 then null else s_acctbal end as mae_shown from supplier")
def v7_superseded(spark, sf):
    rows = an.table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("mae"), F.when(F.col("s_nationkey") % 2 == 0, True).alias("superseded"))
    return present.superseded(rows).select("s_suppkey", "mae_shown")
