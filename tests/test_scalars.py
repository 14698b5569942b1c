"""Scalar expressions against cases worked out by hand."""

import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers as num
from tallyloom.functions import registry
from tallyloom.functions import text as txt
from tallyloom.functions.keywords import keyword_item
from tallyloom.operators.basket_catalogue import load_exclusions, rules
from tallyloom.plans import catalogue


def values(spark, texts, expression, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_positive_number(spark):
    texts = ["12,5", " 3 ", "-1", "0", "inf", "nan", "7d", "1.234,5", None, "", "1e3", ".5", "+2"]
    assert values(spark, texts, num.positive_number) == [12.5, 3.0, None, None, None, None, None, None, None, None, 1000.0, 0.5, 2.0]


@pytest.mark.parametrize(
    ("quantity", "unit", "amount", "base"),
    [("900", "GRM", 0.9, "kg"), ("1,5", "lt.", 1.5, "L"), ("500", " cm3 ", 0.5, "L"), ("2", "Docena", 24.0, "u"), ("1", "caja", None, "?"), ("0", "kg", None, "kg"), (None, "kg", None, "kg"), ("3", None, None, "?")],
)
def test_base_quantity(spark, quantity, unit, amount, base):
    row = spark.createDataFrame([(quantity, unit)], "q string, u string").select(num.base_quantity(F.col("q"), F.col("u")), num.unit_base(F.col("u"))).first()
    assert (row[0] is None) == (amount is None) and (amount is None or abs(row[0] - amount) < 1e-9)
    assert row[1] == base


@pytest.mark.parametrize(
    ("description", "unit", "amount"),
    [
        ("Fideos tallarin 500 g", "kg", 0.5), ("Fideos 500 g PAQ-500-gr.", "kg", 0.5), ("Atún 3 x 125 g", "kg", 0.375), ("Jabón 75 G X 3 UNI", "kg", 0.225),
        ("2 x 100 g x 3 un", "kg", None), ("Arroz 1 kg 500 g", "kg", None), ("0 x 100 g", "kg", None), ("Leche 1,5 L", "L", 1.5), ("Leche 1 lt", "kg", None),
        ("HUEVO BLANCO X 30 C T", "u", 30.0), ("Huevo 1 docena", "u", 12.0), ("sin tamaño", "kg", None), (None, "kg", None), ("ＡＲＲＯＺ 1 kg", "kg", 1.0),
    ],
)
def test_description_quantity(spark, description, unit, amount):
    row = spark.createDataFrame([(description, unit)], "d string, u string").select(txt.description_quantity(F.col("d"), F.col("u"))).first()
    assert row[0] == (None if amount is None else pytest.approx(amount))


def test_normalize_text_follows_nfd(spark):
    texts = ["Azúcar ÑANDÚ", "café", None, "", "Ǆ ß ﬁ", "naïve Åse", "ạ̄"]
    expected = ["".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if unicodedata.category(c) != "Mn") for t in texts]
    assert values(spark, texts, txt.normalize_text) == expected


def test_keyword_class(spark, tmp_path):
    (tmp_path / "out.json").write_text('{"leche_entera": ["dulce de leche", "Gato"], "arroz": ["galleta"], "papa": ["fritas"], "manzana": ["jugo"], "azucar": ["powerade"], "manteca": ["manteca de cacao"]}')
    out = load_exclusions(str(tmp_path / "out.json"))
    texts = ["LECHE ENTERA 1 L", "dulce de leche 400 g", "Arroz largo fino", "galleta de arroz", "Pan Lactal blanco", "papas fritas", "PAPA NEGRA kg", "azúcar común", "jugo de manzana", "Manteca 200", None, "purelado tomate", "cafe instantáneo", "LECHE ENTERA GATO 1 L", "AZUCAR POWERADE", "MANTECA DE CACAO"]
    found = values(spark, texts, lambda c: txt.keyword_class(txt.normalize_text(c), rules(out)))
    assert found == ["leche_entera", None, "arroz", None, "pan_lactal", None, "papa", "azucar", None, "manteca", None, None, "cafe", None, None, None]
    # Without a deployment's exclusions a mention is enough.
    assert values(spark, texts[1:2], lambda c: txt.keyword_class(txt.normalize_text(c), rules())) == ["leche_entera"]
    (tmp_path / "bad.json").write_text('{"nothing": ["x"]}')
    with pytest.raises(ValueError, match="unknown"):
        load_exclusions(str(tmp_path / "bad.json"))


def test_automaton_equals_the_expression(spark):
    rng = random.Random(5)
    terms = ["te", "te ", "mate", "mate cocido", "cafe", "a", "pan", "pan lactal", "ñu", "x_y", "9", "té verde", "ab c"]
    items = [
        {"id": f"i{n}", "keywords": rng.sample(terms, rng.randint(1, 4)), "negatives": rng.sample(terms, rng.randint(0, 2)), "required": [rng.sample(terms, rng.randint(1, 2)) for _ in range(rng.randint(0, 2))] or None}
        for n in range(20)
    ]
    pieces = [*terms, " ", " ", "_", "-", "é", "z", "T", "9", "\n", "日", ".", ""]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(3000)] + [None, "", "te", "mate cocido en saquitos"]
    many = {"leche_entera": [f"palabra {k}" for k in range(400)] + ["dulce de leche"]}
    expected = values(spark, texts, lambda c: txt.keyword_class(txt.normalize_text(c), items))
    assert values(spark, texts, lambda c: keyword_item(txt.normalize_text(c), items)) == expected and len(set(expected)) > 5
    assert values(spark, ["leche entera", "palabra 399 LECHE entera", "Dulce de Leche"], lambda c: keyword_item(txt.normalize_text(c), rules(many))) == ["leche_entera", None, None]
    small = spark.createDataFrame([("x",)], "t string").select(keyword_item(F.col("t"), rules(many)).alias("c"))
    large = spark.createDataFrame([("x",)], "t string").select(keyword_item(F.col("t"), rules({k["id"]: [f"w{i}" for i in range(100)] for k in rules()})).alias("c"))
    assert len(small._jdf.queryExecution().toString()) == len(large._jdf.queryExecution().toString())
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(txt.normalize_text(F.col("p_name")).alias("t"))
    named = [{"id": "ring", "keywords": ["ring", "small ring"], "negatives": ["old "]}, {"id": "gear", "keywords": ["gear"], "required": [["hot"], ["red", "gear"]]}, {"id": "blue", "keywords": ["blue"]}]
    both = part.select(txt.keyword_class(F.col("t"), named).alias("a"), keyword_item(F.col("t"), named).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and {r["a"] for r in both} > {None}


def test_white_space_of_any_kind_is_stripped(spark):
    assert values(spark, ["\t12,5\n", "\u00a07\r", "1 2"], num.positive_number) == [12.5, 7.0, None]
    assert values(spark, ["\tkg", "\nLTS.. "], num.unit_base) == ["kg", "L"]


def test_longest_keyword_and_first_item_win(spark):
    items = [{"id": "a", "keywords": ["rojo grande"]}, {"id": "b", "keywords": ["grande"]}, {"id": "c", "keywords": ["grande"]}, {"id": "d", "keywords": ["sol"]}]
    found = values(spark, ["rojo grande", "muy grande", "girasol", "el sol"], lambda c: txt.keyword_class(c, items))
    assert found == ["a", "b", None, "d"]


def test_barcode_prefixes(spark):
    assert values(spark, ["7790741234567", "779074", "12345", "12345678", None], lambda c: txt.digits_match(c, ["779074", "12345"])) == [True, True, True, False, False]


def test_direction_at_the_threshold_is_a_move(spark):
    assert values(spark, [0.8, -0.8, 0.79, None], lambda c: num.direction(c, 0.8), "double") == ["up", "down", "stable", None]


def test_formats(spark):
    assert values(spark, [1234567.891, None, float("nan")], lambda c: num.local_number(c, 1), "double") == ["1.234.567,9", "—", "—"]
    assert values(spark, ["<a href=\"x\">&'"], txt.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"]
    # Rounding follows the exact binary value.
    assert values(spark, [1.005, 0.285, 2.675, 1.115], lambda c: num.round_exact(c, 2), "double") == [round(x, 2) for x in (1.005, 0.285, 2.675, 1.115)]


def test_rounded_as_sql_rounds_doubles(spark):
    """F2: 951.3 / 18 lies just below 52.85 and goes up where numbers are scaled first."""
    given = [951.3 / 18, 0.25, -0.25, 0.35, 2.675, 1e300, float("inf"), None, 3.0]
    digits = duckdb.connect().execute("select round(x, 1) from (select unnest(?::double[]) as x)", [given]).fetchall()
    assert values(spark, given, lambda c: num.rounded(c, 1), "double") == [r[0] for r in digits]
    assert digits[0][0] == 52.9


def test_verified_contents_round_as_their_sql(spark, tmp_path):
    part = spark.createDataFrame([(1513, "blue ring", "Brand#1", "SMALL", 18, 951.3), (1514, "hot bolt", "Brand#2", "LARGE", 18, 951.4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.QUERIES["m7_verified_contents"](spark, str(tmp_path)).orderBy("p_partkey")
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert [tuple(r) for r in got.collect()] == duck.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLES['m7_verified_contents']}) order by p_partkey").fetchall()


def test_sql_functions(spark):
    registry.register(spark)
    assert spark.sql("select tl_positive_number('1,5'), tl_direction(-1, 0.8)").first()[:] == (1.5, "down")


def test_table_functions_follow_their_arguments(spark):
    assert {"tl_records", "tl_sizes"} <= set(registry.register(spark))
    spark.createDataFrame([(1, "a|b"), (2, '"x|y"|2|3'), (3, ""), (4, None), (5, "Ultima"), (6, "7"), (7, "\ufeff8|9\r")], "id int, line string").createOrReplaceTempView("lines")
    got = spark.sql("select * from tl_records(table(select id, line from lines), 'a|b')")
    assert got.columns == ["id", "a", "b"]
    assert sorted(map(tuple, got.collect())) == [(2, "x|y", "2"), (6, "7", None), (7, "8", "9")]
    assert spark.sql("select * from tl_records(table(select line from lines), 'one')").columns == ["one"]
    for bad in ("select * from tl_records(table(select line from lines), 'a|a')", "select * from tl_records('x', 'a')", "select * from tl_sizes(table(select line from lines), 'mile')"):
        with pytest.raises(Exception, match="names of its own|must be a table|no such unit"):
            spark.sql(bad)
    spark.createDataFrame([("Arroz 3 X 125 GR",), ("Leche 1,5 lt y 500 ml",), ("Huevo",), (None,)], "t string").createOrReplaceTempView("texts")
    assert sorted(map(tuple, spark.sql("select * from tl_sizes(table(select t, t from texts), '*')").collect())) == [("Arroz 3 X 125 GR", 1, 0.125, "kg", 3.0), ("Leche 1,5 lt y 500 ml", 1, 1.5, "L", None), ("Leche 1,5 lt y 500 ml", 2, 0.5, "L", None)]
    assert [tuple(r) for r in spark.sql("select * from tl_sizes(table(select t from texts), 'kg')").collect()] == [(1, 0.125, 3.0)]
