"""Readers over archives built here, fetching with a fake opener, and the stream."""

import gzip
import hashlib
import io
import json
import tarfile
import zipfile

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from tallyloom.operators import report
from tallyloom.plans import analogues, catalogue
from tallyloom.sources import archives, feed, fetch, snapshots
from tallyloom.streaming import ingest

BRANCHES = "id_comercio|id_bandera|id_sucursal|sucursales_localidad|sucursales_provincia\n010|1|095|Rosario|AR-S\n010|1|096|Otra|AR-S\nUltima actualizacion: x\n"
PRODUCTS = "﻿id_comercio|id_bandera|id_sucursal|id_producto|productos_precio_lista\n010|1|095|p1|100,5\n\n010|1|096|p2|7\n"


def inner_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("productos.csv", PRODUCTS)
        z.writestr("sucursales.csv", BRANCHES)
    return out.getvalue()


def write_zip(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.zip", inner_zip())
        z.writestr("broken.zip", b"not a zip")


def write_tar(path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, data in (("2024-01-01/shop/productos.csv", PRODUCTS.encode()), ("2024-01-01/shop/sucursales.csv", BRANCHES.encode()), ("2024-01-01/other.zip", inner_zip())):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    path.write_bytes(zstandard.compress(raw.getvalue()) if path.suffix == ".zst" else raw.getvalue())


@pytest.mark.parametrize("name", ["day.zip", "day.tar", "day.tar.zst"])
def test_archives_give_the_products_of_selected_branches(spark, tmp_path, name):
    (write_zip if name.endswith(".zip") else write_tar)(tmp_path / name)
    path = str(tmp_path / name)
    lines = archives.scan(spark, path)
    branches = feed.parsed(lines, "sucursales.csv", [*feed.IDENTITY, "sucursales_localidad"]).where(F.lower("sucursales_localidad") == "rosario")
    got = archives.selected_products(spark, path, branches, ["id_producto", "productos_precio_lista", "productos_marca"]).collect()
    assert {(r["id_sucursal"], r["id_producto"], r["productos_precio_lista"], r["productos_marca"]) for r in got} == {("095", "p1", "100,5", None)}
    assert len(got) == (1 if name.endswith(".zip") else 2)
    names = {r["line"] for r in lines.where("kind = 'name'").collect()}
    assert names == ({"a.zip", "broken.zip"} if name.endswith(".zip") else {"2024-01-01/shop/productos.csv", "2024-01-01/shop/sucursales.csv", "2024-01-01/other.zip"})
    none = archives.selected_products(spark, path, branches.limit(0), ["id_producto"])
    assert none.count() == 0


def test_archives_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    write_zip(tmp_path / "day.zip")
    monkeypatch.setattr(archives, "is_mounted", lambda uris: False)
    path = str(tmp_path / "day.zip")
    lines = archives.scan(spark, path)
    assert lines.where("kind = 'sucursales.csv'").count() == 2
    branches = feed.parsed(lines, "sucursales.csv", [*feed.IDENTITY, "sucursales_localidad"]).where("sucursales_localidad = 'Rosario'")
    assert [r["id_producto"] for r in archives.selected_products(spark, path, branches, ["id_producto"]).collect()] == ["p1"]


HEAD = "id_comercio|id_bandera|id_sucursal|id_producto|productos_precio_lista\n"


def shops(n, wide):
    """Product lines of three branches, of very different lengths."""
    return [f"1|{k % 3}|{k % 7}|p{k}|{'9' * (k * k % wide)}" for k in range(n)]


def big_tar(lines, tail=b""):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, text in (("2024-01-01/s/sucursales.csv", BRANCHES), ("2024-01-01/s/productos.csv", "\nUltima x\n" + HEAD + "\n".join(lines)), ("2024-01-01/r/productos.csv", HEAD + "2|1|1|q|1\n" * 500), ("2024-01-01/z.zip", inner_zip())):
            data = text if isinstance(text, bytes) else text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return raw.getvalue() + tail


def in_frames(data, size):
    """Zstandard frames of ``size`` bytes each, with a skippable one between."""
    c = zstandard.ZstdCompressor(write_checksum=True)
    return b"\x50\x2a\x4d\x18\x03\0\0\0abc".join(c.compress(data[i : i + size]) for i in range(0, len(data), size))


def product_rows(spark, path, keys, monkeypatch=None):
    branches = spark.createDataFrame([(archives._uris(spark, path)[0], "2024-01-01/s", *k.split("|")) for k in keys], "archive string, member string, id_comercio string, id_bandera string, id_sucursal string")
    return archives.selected_products(spark, path, branches, ["id_producto", "productos_precio_lista"])


@pytest.mark.parametrize("name", ["d.tar", "d.tar.zst", "one.tar.zst"])
@pytest.mark.parametrize("split", [97, 700, 1 << 20])
def test_pieces_of_a_product_file_equal_a_single_read(spark, tmp_path, monkeypatch, name, split):
    lines = shops(400, 50)
    data, keys = big_tar(lines), ["1|0|0", "1|2|5", "1|1|1"]
    (tmp_path / name).write_bytes(data if name == "d.tar" else in_frames(data, 1000) if name == "d.tar.zst" else zstandard.compress(data))
    monkeypatch.setattr(archives, "SPLIT", split)
    reader = archives.ProductReader([str(tmp_path / name)], ["id_producto", "productos_precio_lista"])
    reader.members, reader.shops = {"2024-01-01/s"}, set(keys)
    splits = reader.partitions()
    pieces = [s for s in splits if s.what == "piece"]
    size = len("\nUltima x\n" + HEAD + "\n".join(lines))
    assert [s.what for s in splits] == ["stream"] if name == "one.tar.zst" else len(pieces) == -(-size // split)
    got = [tuple(r.values()) for s in splits for b in reader.read(s) for r in b.to_pylist()]
    want = [(*line.split("|")[3:],) for line in lines if line[: line.index("|p")] in keys]
    assert [r[6:] for r in got] == want
    assert {tuple(r)[5:] for r in product_rows(spark, str(tmp_path / name), keys).collect()} == set(want)


def test_an_inner_archive_is_a_task(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        for k in range(12):
            z.writestr(f"{k}.zip", inner_zip())
    path = str(tmp_path / "day.zip")
    found = archives._source(spark, archives._uris(spark, path), "products", ["id_producto"])
    assert found.rdd.getNumPartitions() == 12 and found.count() == 24
    two = found.where(F.col("member").isin("3.zip", "4.zip") & (F.col("shop") == "010|1|096"))
    assert two.rdd.getNumPartitions() == 2 and [(r["member"], r["id_producto"]) for r in two.orderBy("member").collect()] == [("3.zip", "p2"), ("4.zip", "p2")]
    assert found.where("member = 'none'").count() == 0


def test_more_branches_than_are_sent(spark, tmp_path, monkeypatch):
    (tmp_path / "d.tar").write_bytes(big_tar(shops(100, 9)))
    few = sorted(map(tuple, product_rows(spark, str(tmp_path / "d.tar"), ["1|0|0", "1|1|1"]).collect()))
    monkeypatch.setattr(archives, "MAX_KEYS", 1)
    assert few and sorted(map(tuple, product_rows(spark, str(tmp_path / "d.tar"), ["1|0|0", "1|1|1"]).collect())) == few


@pytest.mark.parametrize("where", ["last", "unwanted"])
def test_damaged_frames_fail(spark, tmp_path, where):
    data = big_tar(shops(400, 50), tail=b"\0" * 3000)
    whole = bytearray(in_frames(data, 1000))
    (tmp_path / "d.tar.zst").write_bytes(whole)
    path = str(tmp_path / "d.tar.zst")
    found = archives.layout(path)
    archives.scan(spark, path).count()
    unwanted = next(m for m in found.members if m.group.endswith("/r"))
    frame = found.frames[-1] if where == "last" else next(f for f in found.frames if f.start >= unwanted.at and f.end <= unwanted.at + unwanted.size)
    whole[frame.at + 14] ^= 0xFF
    (tmp_path / "d.tar.zst").write_bytes(whole)
    with pytest.raises(Exception, match="(?i)zst|decompress|corrupt|checksum|ends early"):
        archives.scan(spark, path).count()
        product_rows(spark, path, ["1|0|0"]).count()
    (tmp_path / "d.tar.zst").write_bytes(whole[:-3])
    with pytest.raises(Exception, match="ends early"):
        archives.scan(spark, path).count()


def test_frames_of_unknown_size_are_one_stream(tmp_path):
    data = big_tar(shops(50, 9))
    c = zstandard.ZstdCompressor()
    (tmp_path / "d.tar.zst").write_bytes(b"".join(c.compressobj().compress(b"") + zstandard.ZstdCompressor(write_content_size=False).compress(data[i : i + 2000]) for i in range(0, len(data), 2000)))
    assert not archives.layout(str(tmp_path / "d.tar.zst")).entered


def test_a_record_without_end_fails_in_a_piece(tmp_path, monkeypatch):
    (tmp_path / "d.tar").write_bytes(big_tar(["1|1|1|p|" + "x" * 5000]))
    monkeypatch.setattr(archives, "SPLIT", 600)
    monkeypatch.setattr(feed, "MAX_RECORD", 1000)
    reader = archives.ProductReader([str(tmp_path / "d.tar")], [])
    with pytest.raises(ValueError, match="exceeds"):
        [b for s in reader.partitions() if s.what == "piece" for b in reader.read(s)]


def test_products_are_read_in_chunks(monkeypatch):
    head, keys = "id_comercio|id_bandera|id_sucursal|id_producto|productos_precio_lista", ["1|1|2"]
    lines = ["", "Ultima x", head, "1|1|2|a|5", '1|1|2|"q|uoted"|6', "1|1|22|b|7", "1|1|2|c", "1|1|2|ñ|8|more"]
    data = "\r\n".join(lines).encode("utf-8-sig")
    want = [["1", "1", "2", "a", "5"], ["1", "1", "2", "q|uoted", "6"], ["1", "1", "2", "c", None], ["1", "1", "2", "ñ", "8"]]

    def read(data):
        stream = io.BytesIO(data)
        names, _ = feed.product_header(stream)
        return list(feed.products(stream, names, feed.by_length(keys), feed.NEEDED))

    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(feed, "CHUNK", size)
        assert read(data) == want
    monkeypatch.setattr(feed, "MAX_RECORD", 40)
    with pytest.raises(ValueError, match="exceeds"):
        read(data + b"x" * (1 << 21))
    with pytest.raises(ValueError, match="identity"):
        read(b"a|b|c|d\n1|1|2|x")


def test_plain_feed(spark, tmp_path):
    (tmp_path / "p.csv").write_text(PRODUCTS + "Última línea\n", encoding="utf-8")
    rows = {r["id_producto"]: r for r in feed.read_feed(spark, str(tmp_path / "p.csv")).collect()}
    assert set(rows) == {"p1", "p2"} and rows["p1"]["id_sucursal"] == "095"


def test_plain_feeds_have_headers_of_their_own(spark, tmp_path):
    for name, text in (("1", "a|b\n1|2\n"), ("2", "b|a\n3|4\n"), ("3", "\ufeffc|a\n\nUltima x\n5|6|7\n8\nc|a\n"), ("4", ""), ("5", "b|a\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = feed.read_feed(spark, str(tmp_path))
    assert got.columns == ["a", "b", "c"]
    assert {tuple(r) for r in got.collect()} == {("1", "2", None), ("4", "3", None), ("6", None, "5"), (None, None, "8")} and got.count() == 4


def test_fields_may_be_quoted(spark, tmp_path):
    (tmp_path / "p").write_text('a|"b|c"|d\n"x|y"|2|"q""r"\n', encoding="utf-8")
    got = feed.read_feed(spark, str(tmp_path / "p"))
    assert got.columns == ["a", "b|c", "d"] and tuple(got.first()) == ("x|y", "2", 'q"r')
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as y:
            y.writestr("sucursales.csv", 'id_comercio|"id_bandera"|id_sucursal|sucursales_localidad\n1|1|"0|1"|"San ""J"""\n')
        z.writestr("a.zip", inner.getvalue())
    row = feed.parsed(archives.scan(spark, str(tmp_path / "day.zip")), "sucursales.csv", ["id_bandera", "id_sucursal", "sucursales_localidad"]).first()
    assert tuple(row)[2:] == ("1", "0|1", 'San "J"')


def test_header_and_member_checks():
    with pytest.raises(ValueError, match="identity"):
        feed.checked_header("a|b|c|id_producto|productos_precio_lista")
    with pytest.raises(ValueError, match="ambiguous"):
        feed.member_kinds(["x/productos.csv", "y/productos.csv"])


def test_corrupt_tail_fails(spark, tmp_path):
    write_tar(tmp_path / "day.tar.zst")
    data = (tmp_path / "day.tar.zst").read_bytes()
    (tmp_path / "day.tar.zst").write_bytes(data[:-20] + b"\0" * 20)
    with pytest.raises(Exception, match="(?i)zst|decompress|corrupt|truncat|read|end"):
        archives.scan(spark, str(tmp_path / "day.tar.zst")).count()


def test_snapshots_take_the_day_from_field_or_name(spark, tmp_path):
    (tmp_path / "x-2024-01-01.json").write_text(json.dumps({"v": 1}))
    with gzip.open(tmp_path / "x-2024-01-03.json.gz", "wt") as f:
        json.dump({"v": 2, "date": "2024-01-02"}, f)
    (tmp_path / "x-2024-01-04.json").write_text("{broken")
    rows = snapshots.read_snapshots(spark, str(tmp_path), "v int, date string").where("v is not null")
    assert {(r["v"], r["date"]) for r in rows.collect()} == {(1, "2024-01-01"), (2, "2024-01-02")}
    assert snapshots.newest(rows).first()["v"] == 2


def test_indices(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"data": [["2024-01-01", 1.5], ["2024-02-01", None]]}))
    assert [(str(r["month"]), r["value"]) for r in snapshots.read_monthly_index(spark, str(tmp_path / "i.json")).collect()] == [("2024-01-01", 1.5)]
    (tmp_path / "fx.json").write_text(json.dumps([{"date": "2024-01-01", "source": "Blue", "value_sell": 10}, {"date": "2024-01-01", "source": "Blue", "value_sell": 11}, {"date": "2024-01-01", "source": "Oficial", "value_sell": 8}]))
    row = snapshots.currency_panel(snapshots.read_currency(spark, str(tmp_path / "fx.json"))).first()
    assert (row["fx_blue"], row["fx_oficial"], row["fx_mep"]) == (11.0, 8.0, None)


class Reply(io.BytesIO):
    headers = {"Content-Length": "5"}


def test_download_retries_and_checks_length(tmp_path):
    replies = [OSError("down"), Reply(b"abc"), Reply(b"hello")]

    def opener(_):
        r = replies.pop(0)
        if isinstance(r, OSError):
            raise r
        return r

    digest, size = fetch.download("u", str(tmp_path / "f"), wait_s=0, opener=opener)
    assert size == 5 and (tmp_path / "f").read_bytes() == b"hello" and len(digest) == 64 and not (tmp_path / "f.partial").exists()


def test_revisions_fall_back_in_order():
    entries = [{"id": 1, "link": "a"}, {"id": 2, "link": "b"}]

    def load(e):
        if e["id"] == 1:
            raise ValueError("date mismatch")
        return "ok"

    assert fetch.first_valid(entries, load) == ("ok", [{"revision": 1, "url": "a", "error": "date mismatch"}])
    assert fetch.weekday_name("2024-01-01") == "lunes" and fetch.is_safe_name("a-1.zip") and not fetch.is_safe_name("../a")


def test_stream_replaces_days(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "date string, price double"
    for price in (1.0, 2.0):
        spark.createDataFrame([("2024-01-01", price)], schema).coalesce(1).write.mode("append").parquet(source)
        ingest.replace_days(ingest.observation_stream(spark, source, schema), target, str(tmp_path / "ck")).awaitTermination(120)
    assert [r["price"] for r in spark.read.parquet(target).collect()] == [2.0]


def test_json_is_asked_again_and_caches_age(tmp_path):
    replies = [OSError("down"), io.BytesIO(b'{"a": 1}')]

    def opener(_):
        r = replies.pop(0)
        if isinstance(r, OSError):
            raise r
        return r

    assert fetch.get_json("u", wait_s=0, opener=opener) == {"a": 1}
    with pytest.raises(OSError):
        fetch.get_json("u", attempts=1, opener=lambda _: (_ for _ in ()).throw(OSError("down")))
    assert not fetch.is_fresh(str(tmp_path / "c"), 60)
    (tmp_path / "c").write_text("x")
    assert fetch.is_fresh(str(tmp_path / "c"), 60) and not fetch.is_fresh(str(tmp_path / "c"), -1)


def test_stream_of_window_minima(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("2024-01-01 01:00:00", "a", 3.0), ("2024-01-01 05:00:00", "a", 2.0), ("2024-01-02 05:00:00", "a", 1.0), ("2024-01-09 00:00:00", "b", 9.0)]
    spark.createDataFrame(rows, "t string, k string, v double").selectExpr("cast(t as timestamp) as t", "k", "v").write.parquet(source)
    stream = ingest.windowed_minimum(ingest.observation_stream(spark, source, "t timestamp, k string, v double"), "t", ["k"], "v")
    stream.writeStream.format("memory").queryName("lows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {(str(r["start"])[:10], r["k"], r["low"]) for r in spark.table("lows").collect()} == {("2024-01-01", "a", 2.0), ("2024-01-02", "a", 1.0), ("2024-01-09", "b", 9.0)}


def test_page_escapes_and_dashes(spark):
    cells = spark.createDataFrame([("G<", "a&b", "1", "$5", True)], "item_group string, item string, chain string, shown string, best boolean")
    html = report.page("t", cells, ["1", "2"], ["G<"])
    assert "a&amp;b" in html and "G&lt;" in html and "—" in html and 'class="best"' in html
    assert report.markdown_table(cells).startswith("| item_group |")


def test_page_ranks_baskets_of_equal_coverage_only(spark):
    cells = spark.createDataFrame([("G", "a", "1", "$5", True, "sube"), ("G", "a", "2", "$6", False, None)], "item_group string, item string, chain string, shown string, best boolean, shown_dir string")
    totals = spark.createDataFrame([("1", "Uno", 20.0, 3), ("2", "Dos", 10.0, 3)], "chain string, label string, total double, items_found int")
    html = report.page("t", cells, ["1", "2"], [], {"all": totals, "gran": totals.limit(0)})
    assert html.index("Dos: $10") < html.index("Uno: $20") and "gran" not in html and "$5 ▲" in html and "$6<" in html
    uneven = report.hero(totals.withColumn("items_found", F.col("chain").cast("int")))
    assert uneven.index("Uno") < uneven.index("Dos") and report.NOT_COMPARABLE in uneven


def test_files_have_digests(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    row = snapshots.digests(spark, str(tmp_path)).first()
    assert row["sha256"] == hashlib.sha256(b"abc").hexdigest() and row["bytes"] == 3


def test_old_copies_serve_when_the_source_is_away(tmp_path):
    path = str(tmp_path / "c")

    class Body(io.BytesIO):
        headers = None

    away = lambda _: (_ for _ in ()).throw(OSError("down"))
    with pytest.raises(OSError):
        fetch.cached("u", path, 60, away, 1, 0)
    assert fetch.cached("u", path, 60, lambda _: Body(b"1"), 1, 0) and fetch.cached("u", path, 60, away, 1, 0)
    assert not fetch.cached("u", path, -1, away, 1, 0) and (tmp_path / "c").read_bytes() == b"1"


def test_a_local_archive_comes_before_the_weekday_s_resource(tmp_path):
    class Body(io.BytesIO):
        headers = None

    asked = []
    opener = lambda url: (asked.append(url), Body(b"zip"))[1]
    resources = {"lunes": "u/monday", "martes": "u/tuesday"}
    assert fetch.daily_archive("2024-01-01", str(tmp_path), resources, opener).endswith("2024-01-01.zip") and asked == ["u/monday"]
    (tmp_path / "x-2024-01-02.tar.zst").write_bytes(b"")
    assert fetch.daily_archive("2024-01-02", str(tmp_path), resources, opener).endswith("x-2024-01-02.tar.zst") and asked == ["u/monday"]


@pytest.mark.parametrize("kind", ["zip", "tar.zst"])
def test_archives_made_from_the_tables_do_not_grow(spark, monkeypatch, kind):
    """more lines are more archives, whose products are the same in all."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(analogues, "ARCHIVE_LINES", 500)
    paths = analogues.feed_archives(spark, sf, kind)
    lines = analogues.table(spark, sf, "lineitem")
    assert len(paths) == 4 * (1 + lines.count() // 2_000) > 4
    monkeypatch.setattr(analogues, "feed_archives", lambda *_: paths)
    got = catalogue.QUERIES["s2_zip_of_zips"](spark, sf)
    want = duckdb.sql(f"with lineitem as (from '{sf}/lineitem.parquet') {catalogue.ORACLES['s2_zip_of_zips']}")
    assert sorted(map(tuple, got.collect())) == sorted(want.select(*map(duckdb.ColumnExpression, got.columns)).fetchall())
    each = archives.selected_products(spark, paths, feed.parsed(archives.scan(spark, paths), "sucursales.csv", feed.IDENTITY), ["id_producto"]).groupBy("archive").count().collect()
    assert sum(r["count"] for r in each) == lines.count() and max(r["count"] for r in each) < 1_000
