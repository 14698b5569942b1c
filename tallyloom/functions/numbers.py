"""Numeric scalars as Column expressions: prices, quantities, units, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit aliases, the base unit each stands for, and its size in that unit.
UNITS = (
    ("kg", 1.0, "KG KGM KGR K KILO KILOS KILOGRAMO KILOGRAMOS"),
    ("kg", 0.001, "G GR GRM GRS GRAMO GRAMOS"),
    ("L", 1.0, "L LT LTR LTS LITRO LITROS"),
    ("L", 0.001, "ML MLT CM3 CC MILILITRO MILILITROS"),
    ("u", 1.0, "U UN UNI UD UDS UNIDAD UNIDADES CU C/U"),
    ("u", 12.0, "DOC DOCENA DOCENAS"),
)

#: What a plain decimal number looks like; a cast alone would take '7d' or 'NaN' too.
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


#: What counts as white space around a value.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end; ``trim`` alone takes spaces only."""
    return F.btrim(text, F.lit(WHITE))


def unit_aliases() -> dict[str, tuple[str, float]]:
    return {alias: (base, scale) for base, scale, names in UNITS for alias in names.split()}


def _lookup(key: Column, values: dict[str, object]) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def positive_number(value: Column) -> Column:
    """A finite number above 0, with a decimal comma or point; null for anything else."""
    text = F.replace(stripped(value.cast("string")), F.lit(","), F.lit("."))
    number = F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
    return F.when((number > 0) & (number < float("inf")), number)


def unit_key(unit: Column) -> Column:
    """Upper-case unit name without surrounding blanks or trailing dots."""
    return F.regexp_replace(F.upper(stripped(F.coalesce(unit, F.lit("")))), r"\.+$", "")


def unit_base(unit: Column) -> Column:
    """kg, L or u; '?' for an unknown unit."""
    return F.coalesce(_lookup(unit_key(unit), {a: b for a, (b, _) in unit_aliases().items()}), F.lit("?"))


def unit_scale(unit: Column) -> Column:
    return _lookup(unit_key(unit), {a: s for a, (_, s) in unit_aliases().items()})


def base_quantity(quantity: Column, unit: Column) -> Column:
    """The quantity in its base unit, or null."""
    amount = positive_number(quantity) * unit_scale(unit)
    return F.when((amount > 0) & (amount < float("inf")), amount)


def price_per_unit(price: Column, quantity: Column, unit: Column) -> Column:
    return positive_number(price) / base_quantity(quantity, unit)


def round_exact(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value, as decimal formatting does it."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(pattern)).cast("double")


def rounded(value: Column, digits: int) -> Column:
    """Rounding as SQL engines on doubles do it: scaled, to the nearest whole number (halves away from 0), and scaled back.

    ``F.round`` rounds the shortest decimal form of a double, so that 951.3 / 18,
    just below 52.85, goes down there and up here.
    """
    scaled = value * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / F.lit(10.0**digits)).otherwise(value)


def local_number(value: Column, digits: int = 0) -> Column:
    """Points between thousands and a decimal comma; a dash where there is no number."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.translate(F.format_number(value, digits), ",.", ".,")).otherwise(F.lit("—"))


def money(value: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), local_number(value, digits))


def relative_change(now: Column, before: Column) -> Column:
    return F.try_divide(now, before) - 1


def direction(change: Column, threshold: float, names: tuple[str, str, str] = ("up", "down", "stable")) -> Column:
    """up, down or stable; a change of exactly the threshold is a move."""
    up, down, stable = names
    return F.when(change.isNull(), F.lit(None)).when(F.abs(change) < threshold, stable).when(change > 0, up).otherwise(down)
