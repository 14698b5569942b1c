"""Code points of texts as arrays, and what kind of character each is."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

LOWER, UPPER, DIGIT, WHITE, STOP, SYMBOL, OTHER = range(7)
STOPS = ".,;:?!'\"()-"


def _kinds() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        category = unicodedata.category(c)
        if category == "Lu" or category == "Lt":
            table[cp] = UPPER
        elif category[0] == "L":
            table[cp] = LOWER
        elif category[0] == "N":
            table[cp] = DIGIT
        elif c.isspace():
            table[cp] = WHITE
        elif c in STOPS:
            table[cp] = STOP
        elif category[0] in "PS":
            table[cp] = SYMBOL
    return table


def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(cp))[0] == "L" for cp in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


KINDS = _kinds()
#: Whether a code point is a letter, for all of Unicode.
LETTERS = _letters()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
