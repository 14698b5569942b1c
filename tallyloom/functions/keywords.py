"""Keyword classes by one automaton over all keywords and exclusions.

``text.keyword_class`` says the rule as an expression, which grows with every
word; some hundreds of exclusions make its plan take longer than its rows.  Here
all words form one Aho-Corasick automaton, built once a worker; a text is read
once, however many words there are, and the plan is a single function.  Use it
on distinct texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import plain

SHORT = 5


class Rules(NamedTuple):
    """Per item, in order: id, keywords, words that rule it out, and groups of which one must occur whole."""

    items: tuple[tuple[str, tuple[str, ...], tuple[str, ...], tuple[tuple[str, ...], ...]], ...]

    @classmethod
    def of(cls, items: Sequence[dict]) -> Rules:
        texts = lambda words: tuple(plain(w) for w in words)
        return cls(tuple((i["id"], texts(i["keywords"]), texts(i.get("negatives") or ()), tuple(texts(g) for g in i.get("required") or ())) for i in items))


def _is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"


class Machine:
    """The automaton, and what its words mean: word w, if w >= 0, occurs; if it stands between word ends, ~w does."""

    def __init__(self, rules: Rules):
        import ahocorasick

        self.words: dict[str, int] = {}
        self.bounded: set[int] = set()
        self.items = []
        #: Items by the marks that may give them a keyword.
        self.of: dict[int, list[int]] = {}
        for n, (id_, keywords, negatives, groups) in enumerate(rules.items):
            marks = []
            for k in keywords:
                needs = {self._word(k)}
                if len(k.strip()) <= SHORT:
                    inner = self._word(k.strip())
                    self.bounded.add(inner)
                    needs.add(~inner)
                marks.append((len(k), frozenset(needs)))
                self.of.setdefault(self._word(k), []).append(n)
            self.items.append((id_, marks, frozenset(map(self._word, negatives)), [frozenset(map(self._word, g)) for g in groups]))
        self.automaton = ahocorasick.Automaton()
        for word, w in self.words.items():
            if word:
                self.automaton.add_word(word, (w, len(word)))
        self.automaton.make_automaton()
        self.always = {self.words[""]} if "" in self.words else set()

    def _word(self, word: str) -> int:
        return self.words.setdefault(word, len(self.words))

    def marks(self, text: str) -> set[int]:
        found = set(self.always)
        if not self.words or not len(self.automaton):
            return found
        for end, (w, n) in self.automaton.iter(text):
            found.add(w)
            if w in self.bounded and ~w not in found:
                begin, stop = end - n + 1, end + 1
                # A word end lies where just one of two neighbours belongs to a word.
                left = (begin > 0 and _is_word(text[begin - 1])) != _is_word(text[begin])
                right = (stop < len(text) and _is_word(text[stop])) != _is_word(text[end])
                if left and right:
                    found.add(~w)
        return found

    def item(self, text: str) -> str | None:
        found = self.marks(text)
        best, longest = None, 0
        for n in sorted({n for w in found if w in self.of for n in self.of[w]}):
            id_, keywords, negatives, groups = self.items[n]
            length = max((k for k, needs in keywords if needs <= found), default=0)
            if length > longest and not negatives & found and (not groups or any(g <= found for g in groups)):
                best, longest = id_, length
        return best


@lru_cache(maxsize=8)
def machine(rules: Rules) -> Machine:
    return Machine(rules)


def keyword_item(normalized: Column, items: Sequence[dict]) -> Column:
    """``text.keyword_class`` of a normalised text, by the automaton."""
    rules = Rules.of(items)

    @F.arrow_udf("string")
    def classify(texts: pa.Array) -> pa.Array:
        item = machine(rules).item
        return pa.array([None if t is None else item(t) for t in texts.to_pylist()], pa.string())

    # Told otherwise, the optimizer moves it, and filters on it, to before the rows are made distinct, and works it out twice.
    return classify.asNondeterministic()(normalized)
