"""The driver's tables as a price feed: offers from line items, a panel from events.

Each frame has its SQL twin, a list of common table expressions.
"""

from __future__ import annotations

import io
import os
import shutil
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from itertools import groupby
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import numbers as num
from tallyloom.operators import panel as pan
from tallyloom.session import shared_folder, ship_code
from tallyloom.sources.archives import local_path

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
UNIT_NAMES = ("GRM", "KG", "MLT", "UNI", "DOC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basket item per brand, with unit and need; a dimension of 25 rows."""
    k = F.substring("item", 7, 9).cast("int")
    unit = F.element_at(F.array(F.lit("kg"), F.lit("L"), F.lit("u")), k % 3 + 1)
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("item")).distinct()
    return brands.select("item", unit.alias("unit"), (F.lit(0.5) + (k % 4) * F.lit(0.5)).alias("need_qty"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as offers.  Part, supplier and nation are dimensions; Spark broadcasts those it measures small."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER)
    alias = F.element_at(F.array(*map(F.lit, UNIT_NAMES)), F.col("p_size") % 5 + 1)
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"), num.unit_base(alias).alias("unit_name"), num.unit_scale(alias).alias("scale"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") == 0, "core").otherwise("wide").alias("zone"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        *ORDER, "item", "zone", F.col("s_nationkey").cast("string").alias("chain"),
        "unit_name", F.try_divide("l_extendedprice", F.col("l_quantity") * F.col("scale")).alias("price"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest value of each user and day, with the kind of event it came from."""
    low = F.min(F.struct("value", "event_id", "event_type")).alias("m")
    rows = table(spark, sf_dir, "events").where("value > 0").groupBy(F.col("user_id").alias("series"), F.to_date("ts").alias("d")).agg(low)
    return rows.select("series", "d", F.col("m.value").alias("p"), F.col("m.event_type").alias("identity"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pan.build(cells(spark, sf_dir))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("total"))


# Line items as archives of a feed: a chain by supplier, banners by line number, 50 branches by order.

SHOP_HEAD = "id_comercio|id_bandera|id_sucursal|sucursales_localidad\n"
PRODUCT_HEAD = "id_comercio|id_bandera|id_sucursal|id_producto|productos_precio_lista\n"
FRAME = 1 << 16
#: Lines of an archive, about: one task sorts and writes it.
ARCHIVE_LINES = 500_000


def feed_archives(spark: SparkSession, sf_dir: str, kind: str) -> list[str]:
    """Archives of a chain, written by tasks: ZIPs of its banners' ZIPs (``zip``), or TARs of their files in Zstandard frames (``tar.zst``).

    A chain has as many as its lines fill, so a task's share doesn't grow with the table.
    """
    ship_code(spark)
    folder = shared_folder(spark, "archives")
    lineitem = table(spark, sf_dir, "lineitem")
    parts = 1 + lineitem.count() // (4 * ARCHIVE_LINES)
    lines = lineitem.select(
        F.pmod(F.hash("l_orderkey", "l_linenumber"), F.lit(parts)).cast("string").alias("part"),
        (F.col("l_suppkey") % 4).cast("string").alias("chain"), (F.col("l_linenumber") % 3).cast("string").alias("banner"), (F.col("l_orderkey") % 50).cast("string").alias("branch"),
        F.concat_ws("|", F.col("l_suppkey") % 4, F.col("l_linenumber") % 3, F.col("l_orderkey") % 50, F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("l_quantity").cast("int")).alias("line"),
    )
    target = local_path(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(target, exist_ok=True)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("chain", "banner", "branch", "line", "part")), strict=True))
        for (chain, part), of_chain in groupby(rows, lambda r: (r[0], r[4])):
            final = f"{target}/{chain}-{part}.{kind}"
            partial = f"{final}.{os.getpid()}.partial"
            with open(partial, "wb") as file:
                (_write_zip if kind == "zip" else _write_frames)(file, of_chain)
            os.replace(partial, final)
            yield pa.RecordBatch.from_pydict({"path": [final]})

    spread = lines.repartition(4 * parts, "chain", "part").sortWithinPartitions("chain", "part", "banner", "branch")
    return sorted(r["path"] for r in spread.mapInArrow(write, "path string").collect())  # one an archive


def _shop_files(of_banner: Iterator[tuple]) -> Iterator[tuple[str, IO[bytes], int]]:
    """The branch and product files of a banner, the latter in a temporary file."""
    shops: dict[str, None] = {}
    with tempfile.TemporaryFile() as products:
        products.write(PRODUCT_HEAD.encode())
        for chain, banner, branch, line, _ in of_banner:
            shops[f"{chain}|{banner}|{branch}|{'Rosario' if int(branch) % 7 == 0 else 'Lejos'}\n"] = None
            products.write(f"{line}\n".encode())
        text = (SHOP_HEAD + "".join(shops)).encode()
        yield "sucursales.csv", io.BytesIO(text), len(text)
        size = products.tell()
        products.seek(0)
        yield "productos.csv", products, size


def _write_zip(file: IO[bytes], of_chain: Iterator[tuple]) -> None:
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as outer:
        for banner, of_banner in groupby(of_chain, lambda r: r[1]):
            with outer.open(f"{banner}.zip", "w") as member, zipfile.ZipFile(member, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as inner:
                for name, content, _ in _shop_files(of_banner):
                    with inner.open(name, "w") as out:
                        shutil.copyfileobj(content, out)


class _Frames(io.RawIOBase):
    """Writes Zstandard frames of FRAME bytes."""

    def __init__(self, file: IO[bytes]):
        import zstandard

        self._file, self._held, self._compress = file, bytearray(), zstandard.ZstdCompressor(level=1, write_checksum=True).compress

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._held += data
        while len(self._held) >= FRAME:
            self._file.write(self._compress(bytes(self._held[:FRAME])))
            del self._held[:FRAME]
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._file.write(self._compress(bytes(self._held)))
        super().close()


def _write_frames(file: IO[bytes], of_chain: Iterator[tuple]) -> None:
    with _Frames(file) as out, tarfile.open(fileobj=out, mode="w|") as archive:
        for banner, of_banner in groupby(of_chain, lambda r: r[1]):
            for name, content, size in _shop_files(of_banner):
                info = tarfile.TarInfo(f"2024-05-01/{banner}/{name}")
                info.size = size
                archive.addfile(info, content)


ITEMS_SQL = """item_dim as (
  select distinct p_brand as item,
    case cast(substr(p_brand, 7) as int) % 3 when 0 then 'kg' when 1 then 'L' else 'u' end as unit,
    0.5 + (cast(substr(p_brand, 7) as int) % 4) * 0.5 as need_qty
  from part)"""

OFFERS_SQL = (
    ITEMS_SQL
    + """,
offer as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_brand as item,
    case when n_regionkey = 0 then 'core' else 'wide' end as zone, cast(s_nationkey as varchar) as chain,
    case p_size % 5 when 0 then 'kg' when 1 then 'kg' when 2 then 'L' else 'u' end as unit_name,
    l_extendedprice / (l_quantity * case p_size % 5 when 0 then 0.001::double when 1 then 1.0::double when 2 then 0.001::double when 3 then 1.0::double else 12.0::double end) as price
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
fit as (select offer.*, unit, need_qty from offer join item_dim using (item) where unit_name = unit and price > 0),
med as (select item, median(low) as median_price from (select item, chain, min(price) as low from fit group by item, chain) group by item),
kept as (select fit.* from fit join med using (item) where not (price < median_price * 0.15 or price > median_price * 6.5)),
best as (
  select * from (select *, row_number() over (partition by chain, item order by price, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as r from kept) where r = 1)"""
)

PANEL_SQL = """cell as (
  select series, d, p, identity from (
    select user_id as series, cast(ts as date) as d, value as p, event_type as identity,
      row_number() over (partition by user_id, cast(ts as date) order by value, event_id) as r
    from events where value > 0) where r = 1),
days as (select cast(unnest(generate_series((select min(d) from cell), (select max(d) from cell), interval 1 day)) as date) as d),
grid as (
  select s.series, days.d, p, identity, p is not null as observed
  from (select distinct series from cell) s cross join days left join cell on cell.series = s.series and cell.d = days.d),
fill as (select *, last_value(p ignore nulls) over (partition by series order by d rows between 2 preceding and current row) as pf from grid),
seg0 as (select *, cast(sum(case when pf is null then 1 else 0 end) over (partition by series order by d rows unbounded preceding) as bigint) as seg from fill),
panel as (select *, count(pf) over (partition by series, seg order by d rows unbounded preceding) as n from seg0),
diffs as (select *, pf - lag(pf) over (partition by series, seg order by d) as diff from panel),
state as (
  select *, avg(diff) over (partition by series, seg order by d rows between 4 preceding and current row) as drift,
    case when n >= 7 then coalesce(lag(pf, 6) over (partition by series, seg order by d), pf) else pf end as weekly
  from diffs),
target as (
  select * from (
    select series, d, observed and coalesce(lag(observed) over w, false) as eligible, p as actual,
      lag(pf) over w as last, lag(n) over w as history, lag(pf) over w + lag(drift) over w as drift5,
      lag(pf) over w as persistence, lag(weekly) over w as weekly,
      coalesce(identity, '') as identity, coalesce(lag(identity) over w, '') as identity_before
    from state window w as (partition by series order by d))
  where eligible and history >= 4 and actual <> 0),
scored as (
  select *,
    case when abs((drift5 - last) / abs(last) * 100) < 0.8 then 'estable' when (drift5 - last) > 0 then 'sube' else 'baja' end as pred_dir,
    case when abs((actual - last) / abs(last) * 100) < 0.8 then 'estable' when (actual - last) > 0 then 'sube' else 'baja' end as real_dir
  from target)"""
