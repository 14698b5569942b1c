"""Licence notices in texts, found by a positional index of the notices' rare words.

A template is a notice's words, a label and its mandatory key phrases.  The
index lists, for every word of the templates, where it stands in which; how rare
a word is, is counted over all texts.  A text is looked at by template:

1. the text's ANCHORS rarest words of the template are looked up; every place of
   such a word in the text and its postings in the template give a start, the
   place where the notice would begin;
2. starts are intersected by relative position: at least NEED of these words
   must stand where the template has them;
3. each mandatory phrase must stand, word by word, within SLACK words of its
   place.

A phrase template is its own key phrase: all its words are needed in place, so
all places are found, whatever the rarity of its words.

Everything is a projection of built-in functions over the words of one row: a
text is neither shuffled nor joined, and no group of rows exists that could be
hot.  Before it, one pass counts the texts that hold each template word; the
result has at most as many rows as the templates have words.

Defined cases: a null or empty text has no words, no labels and score 0; texts
without letters or digits likewise; repeated rows are texts of their own; null
ids stay; an empty table gives an empty result.  A text's words are held in
memory with the row, as its text is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rarest words of a template that a text is searched for, how many must be in place, words that a key phrase may be off.
ANCHORS, NEED, SLACK = 6, 2, 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: ASCII but for digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: str
    phrases: tuple[str, ...]
    base: bool = False


# The phrases that are always reported, and the wording of usual licence notices with their key phrases.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright", "related or neighboring rights")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
TEMPLATES = (*(Template(label, p, (p,), True) for p, label in PHRASES.items()), *(Template(*n) for n in NOTICES))


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def _vocabulary(templates: Sequence[Template]) -> Column:
    return F.array(*map(F.lit, sorted({w for t in templates for w in t.words.split()})))


def document_counts(docs: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """How many texts hold each word of the templates; bounded by their words."""
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), _vocabulary(templates))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


_PLACED = "array<struct<k: int, word: string>>"
_INDEX = f"array<struct<label: string, base: boolean, needed: int, n: int, words: {_PLACED}, keys: array<string>, ranked: array<struct<word: string, at: array<int>>>, phrases: array<struct<place: int, slack: int, words: {_PLACED}>>>>"


def _placed(words: Sequence[str]) -> list[dict]:
    return [{"k": k, "word": w} for k, w in enumerate(words)]


def index(templates: Sequence[Template], counts: dict[str, int]) -> Column:
    """The templates as one constant: words by place, and each word's places (postings), the rarest (highest IDF) first."""
    made = []
    for t in templates:
        words, at = t.words.split(), {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        ranked = sorted(at.items(), key=lambda x: (counts.get(x[0], 0), x[0]))
        phrases = [p.split() for p in t.phrases]
        places = [next(i for i in range(len(words)) if words[i : i + len(p)] == p) for p in phrases]
        made.append({
            "label": t.label, "base": t.base, "needed": len(at) if t.base else NEED, "n": len(words), "words": _placed(words),
            "keys": sorted({w for p in phrases for w in p}), "ranked": [{"word": w, "at": p} for w, p in ranked],
            "phrases": [{"place": i, "slack": 0 if t.base else SLACK, "words": _placed(p)} for i, p in zip(places, phrases, strict=True)],
        })
    return F.from_json(F.lit(json.dumps(made)), _INDEX)


#: Templates whose key words a text has, each with the rarest of its words that the text has.
_CANDIDATES = f"""
transform(
  filter(templates, t -> size(found) >= size(t.keys) and size(array_intersect(t.keys, found)) = size(t.keys)),
  t -> named_struct('t', t, 'own', slice(filter(t.ranked, r -> array_contains(found, r.word)), 1, {ANCHORS})))
"""
_ANCHORS = "array_distinct(flatten(candidates.own).word)"
#: Places of these words in the text.  (Columns used twice stay columns of their own and aren't worked out anew for every word.)
_HITS = """
case when size(anchors) > 0 then filter(transform(words, (w, i) -> named_struct('word', w, 'i', i)), h -> array_contains(anchors, h.word)) end
"""
#: Starts from every word's places and postings; those where enough words meet; those with all key phrases near their places.
_PLACES = """
case when size(hits) > 0 then flatten(transform(candidates, c -> transform(
  filter(
    filter(
      array_distinct(flatten(transform(c.own, a -> flatten(transform(filter(hits, h -> h.word = a.word), h -> transform(a.at, p -> h.i - p)))))),
      s -> size(filter(c.own, a -> exists(a.at, p -> get(words, s + p) <=> a.word))) >= c.t.needed),
    s -> forall(c.t.phrases, m -> exists(sequence(m.place - m.slack, m.place + m.slack), d -> forall(m.words, x -> get(words, s + d + x.k) <=> x.word)))),
  s -> named_struct('label', c.t.label, 'base', c.t.base, 'start', s, 'share', size(filter(c.t.words, x -> get(words, s + x.k) <=> x.word)) / c.t.n)))) end
"""


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Adds to every row of ``docs`` the ``words`` of its text and the verified ``places``: array of (label, base, start, share).

    ``share`` is the part of the template's words that stand in place.  Columns
    of these names, and of the steps between, are replaced.
    """
    counts = document_counts(docs, templates)
    made = ("words", "found", "templates", "candidates", "anchors", "hits", "places")
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made), words_of(F.col("text")).alias("words"))
    rows = rows.select("*", F.array_intersect("words", _vocabulary(templates)).alias("found"), index(templates, counts).alias("templates"))
    for name, expression in (("candidates", _CANDIDATES), ("anchors", _ANCHORS), ("hits", _HITS), ("places", _PLACES)):
        rows = rows.select("*", F.expr(expression).alias(name))
    none = F.array().cast("array<struct<label: string, base: boolean, start: int, share: double>>")
    return rows.drop(*made[1:-1]).withColumn("places", F.coalesce("places", none))


def licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of the base phrases, from the first one's start
    to the last one's.  ``score`` is the largest share of a found template's
    words that stand in place, so 1 for a base phrase, and 0 without any.
    """
    rows = scan(docs, templates).select("doc_id", "words", "places", F.expr("filter(places, m -> m.base)").alias("base"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(f"{c}.label"))), ",")
    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        labels("base").alias("base_labels"), labels("places").alias("labels"), F.coalesce(F.array_max("places.share"), F.lit(0.0)).alias("score"),
    )
