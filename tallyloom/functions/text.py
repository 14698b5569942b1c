"""Text scalars as Column expressions: normalisation, sizes in descriptions, keyword classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.numbers import unit_aliases

_LATIN = (range(0xC0, 0x250), range(0x1E00, 0x1F00))


def _table(form: str) -> tuple[str, str]:
    """Characters whose decomposition is one base letter and marks, and those letters."""
    plain, base = [], []
    for code in (c for block in _LATIN for c in block):
        letters = [x for x in unicodedata.normalize(form, chr(code)) if not unicodedata.combining(x)]
        if len(letters) == 1 and letters[0] != chr(code):
            plain.append(chr(code))
            base.append(letters[0])
    return "".join(plain), "".join(base)


CANONICAL = _table("NFD")
COMPATIBLE = _table("NFKD")


def strip_marks(text: Column, table: tuple[str, str] = CANONICAL) -> Column:
    return F.regexp_replace(F.translate(text, *table), r"\p{Mn}", "")


def normalize_text(text: Column) -> Column:
    """Lower case without accents; empty for null."""
    return strip_marks(F.lower(F.coalesce(text, F.lit(""))))


def html_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def digits_match(code: Column, prefixes: Sequence[str]) -> Column:
    """Whether a barcode's digits equal a prefix, or begin with one of six digits or more."""
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")
    found = F.lit(False)
    for p in prefixes:
        p = "".join(x for x in p if x.isdigit())
        found = found | ((digits != "") & ((digits == p) | (digits.startswith(p) if len(p) >= 6 else F.lit(False))))
    return found


# How a description prints a size, with a pack's count before or
# after it, and an egg carton.  UNITS stands for the names of all known units.
BEFORE = r"(?:(?<![0-9.,])([0-9]+)\s*[X×]\s*)?"
AMOUNT = r"(?<![0-9.,])([0-9]+(?:[.,][0-9]+)?)\s*(UNITS)(?![A-Z0-9])"
AFTER = r"(?=(\s*[X×]\s*([0-9]+)\s*(?:UNI|UNIDADES|UN|UDS|UD|U)\b)?)"
CARTON = r"\bHUEVO.*\bX\s*([0-9]+)\s*C\s*T\s*$"
TOLERANCE = 1e-6

SIZE = BEFORE + AMOUNT.replace("UNITS", "|".join(sorted(unit_aliases(), key=len, reverse=True))) + AFTER
_BEGIN, _END = "\x01", "\x02"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def description_quantity(description: Column, expected_unit: Column) -> Column:
    """The package contents that a description prints, in the expected unit; null if none or ambiguous.

    Packs (``3 X 125 G``, ``75 G X 3 UN``) multiply; all sizes printed must
    agree; a count both before and after a size is ambiguous, one of zero void;
    egg cartons (``HUEVO ... X 30 C T``) count as units.

    One pass of the pattern writes the parts of every size between marks; they
    are split off, looked up and folded from there.
    """
    desc = strip_marks(F.upper(F.coalesce(description, F.lit(""))), COMPATIBLE)
    desc = F.regexp_replace(desc, r"(?<=[0-9])-(?=[A-Z])|[\x01\x02]", " ")
    return bound(F.struct(desc.alias("desc"), expected_unit.alias("unit")), lambda x: _quantity(x["desc"], x["unit"]))


def _quantity(desc: Column, expected_unit: Column) -> Column:
    marked = F.split(F.regexp_replace(desc, SIZE, f"{_BEGIN}$1|$2|$3|$5{_END}"), _BEGIN)
    scales = F.create_map(*[F.lit(x) for a, (b, s) in unit_aliases().items() for x in (a, f"{b} {s!r}")])
    sizes = F.transform(F.slice(marked, 2, F.size(marked)), lambda m: bound(F.split(F.substring_index(m, _END, 1), r"\|", -1), lambda parts: _size(parts, scales)))
    counted = expected_unit != "u"
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(False).alias("void"), F.lit(True).alias("same"))

    def fold(state: Column, s: Column) -> Column:
        times = F.coalesce(s["before"], s["after"])
        amount = s["amount"] * F.when(counted, F.coalesce(times, F.lit(1.0))).otherwise(1.0)
        first = F.coalesce(state["first"], amount)
        void = state["void"] | (s["before"].isNotNull() & s["after"].isNotNull()) | F.coalesce(counted & (times <= 0), F.lit(False))
        same = state["same"] & (F.abs(amount - first) <= TOLERANCE * F.greatest(F.abs(amount), F.abs(first)))
        fits = F.coalesce((s["base"] == expected_unit) & (s["amount"] > 0), F.lit(False))
        return F.when(fits, F.struct(first.alias("first"), void.alias("void"), same.alias("same"))).otherwise(state)

    def finish(state: Column) -> Column:
        carton = F.regexp_extract(desc, CARTON, 1)
        carton = F.when((expected_unit == "u") & (carton != ""), carton.try_cast("double"))
        return F.when(state["void"], F.lit(None)).when(state["first"].isNull(), carton).when(state["same"], state["first"])

    return F.aggregate(sizes, start, fold, finish)


def _size(parts: Column, scales: Column) -> Column:
    unit = F.split(F.try_element_at(scales, parts[2]), " ")
    count = lambda c: F.when(c != "", c.try_cast("double"))
    amount = F.replace(parts[1], F.lit(","), F.lit(".")).try_cast("double") * unit[1].cast("double")
    return F.struct(unit[0].alias("base"), amount.alias("amount"), count(parts[0]).alias("before"), count(parts[3]).alias("after"))


def keyword_class(normalized: Column, items: Sequence[dict]) -> Column:
    """The id of the item with the longest qualifying keyword; the earliest item wins ties.

    A keyword of up to five characters must stand between word ends.  An item is
    out if one of its ``negatives`` occurs, or if it has ``required`` groups and
    the text holds none of them whole.  The checks of an item's exclusions stand
    inside its branch, after its keywords, so most texts never reach them.
    """
    # The text is bound once, so that its normalisation isn't evaluated for every keyword.
    return bound(normalized, lambda text: _classify(text, items))


def _classify(text: Column, items: Sequence[dict]) -> Column:
    ranked = []
    for ord_, item in enumerate(items):
        hits = [F.when(_has_keyword(text, k), len(plain(k))).otherwise(0) for k in item["keywords"]]
        longest = F.greatest(*hits, F.lit(0))
        out = F.lit(False)
        for word in item.get("negatives", ()):
            out = out | text.contains(plain(word))
        if groups := item.get("required"):
            whole = F.lit(False)
            for group in groups:
                every = F.lit(True)
                for term in group:
                    every = every & text.contains(plain(term))
                whole = whole | every
            out = out | ~whole
        ranked.append(F.struct(F.when(longest > 0, F.when(out, 0).otherwise(longest)).otherwise(0).alias("n"), F.lit(-ord_).alias("o"), F.lit(item["id"]).alias("id")))
    best = F.array_max(F.array(*ranked))
    return F.when(best["n"] > 0, best["id"])


def plain(text: str) -> str:
    """The Python twin of ``normalize_text``, for literals."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def _has_keyword(text: Column, keyword: str) -> Column:
    word = plain(keyword)
    found = text.contains(word)
    if len(word.strip()) <= 5:
        found = found & text.rlike(rf"\b{word.strip()}\b")
    return found
