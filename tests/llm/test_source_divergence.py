"""Differences of sources against a plain sum over every kept term."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest

from tallyloom.llm import source_divergence
from tallyloom.llm.source_divergence import divergence, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, term string, n long, p double, value string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, min_docs, top=50):
    docs, times, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(terms(text)))
        times[lang, source].update(terms(text))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(times[lang, s])

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + (10**9 * (count[t] + 5)) // total for t in kept}

        p, q = {s: shares(times[lang, s]) for s in sources}, shares(whole)
        found = defaultdict(list)
        for a, b in permutations(sources, 2):
            found[a, "pair"].append((-sum(abs(p[a][t] - p[b][t]) for t in kept), b.encode(), b))
        for s in sources:
            found[s, "term"] += [(q[t] - p[s][t], t.encode(), t) for t in kept if times[lang, s][t] and p[s][t] > q[t]]
        for (s, part), items in found.items():
            for rank, (value, _, item) in enumerate(sorted(items), 1):
                if part == "pair" or rank <= top:
                    out.add((lang, s, part, item, -value, rank))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, 0.5, "v") for i, r in enumerate(rows)], DOCS)


def compared(spark, rows, min_docs, **more):
    got = [tuple(r) for r in divergence(spark, table(spark, rows), min_docs, **more).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, min_docs, **more)
    return got


def made(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "é", "日本", "Zz", "𝄞x"]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice([text, text.upper(), text + "_7-x"]), rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot"] * 5 + ["a", "b", "c", None, ""])))
    return rows


def test_values_and_ranks_match_a_plain_sum(spark):
    got = compared(spark, made(1), 4)
    assert {r[2] for r in got} == {"pair", "term"}


def test_small_bounds_of_memory_give_the_same(spark, monkeypatch):
    rows = made(2)
    for name, value in (("HELD", 10), ("PIECE", 7), ("BLOCK", 2), ("PAIRS", 3)):
        monkeypatch.setattr(source_divergence, name, value)
    batches = [pa.RecordBatch.from_pydict({"lang": [r[1] for r in part], "source": [r[2] for r in part], "text": [r[0] for r in part]}, pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())])) for part in (rows[:100], rows[100:])]
    times, docs = Counter(), Counter()
    for b in source_divergence._count(iter(batches)):
        for r in b.to_pylist():
            times[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    expected = Counter((lang or "", source or "", t) for text, lang, source in rows for t in terms(text))
    assert times == expected
    assert docs == Counter((lang or "", source or "", t) for text, lang, source in rows for t in set(terms(text)))


def test_mends_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(3)
    rows = sorted((lang, f"t{k:02}", f"s{s}") for lang in ("a", "b") for k in range(20) for s in range(9) if rng.random() < 0.7)
    given = [(*r, rng.randint(1, 10**9), rng.randint(1, 10**9)) for r in rows]
    batch = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "p", "z"), r, strict=True)) for r in part]) for part in (given[:31], given[31:])]
    plain = Counter()
    by_term = defaultdict(list)
    for lang, term, source, p, z in given:
        by_term[lang, term].append((source, p, z))
    for (lang, _), held in by_term.items():
        for i, (a, p, z) in enumerate(held):
            for b, p2, z2 in held[i + 1 :]:
                plain[lang, *sorted((a, b))] += abs(p - p2) - abs(p - z2) - abs(z - p2) + abs(z - z2)
    for block, pairs in ((256, 1 << 20), (2, 3), (3, 10)):
        monkeypatch.setattr(source_divergence, "BLOCK", block)
        monkeypatch.setattr(source_divergence, "PAIRS", pairs)
        got = Counter()
        for b in source_divergence._mend(iter(batch)):
            for r in b.to_pylist():
                got[r["lang"], *sorted((r["a"], r["b"]))] += r["value"]
        assert got == plain


def test_groups_without_terms_and_languages_without_any(spark):
    rows = [("one two", "en", "a"), ("one", "en", "b"), (None, "en", "c"), ("", "en", "c"), ("12 3", "fr", "a"), (None, "fr", "b"), (None, None, None), ("solo", "de", "x")]
    got = compared(spark, rows, 1)
    assert {r[:5] for r in got if r[0] == "fr"} == {("fr", "a", "pair", "b", 0), ("fr", "b", "pair", "a", 0)}
    assert not [r for r in got if r[0] == "" or (r[0] == "de" and r[2] == "pair")]


def test_repeated_rows_ties_and_ranks(spark):
    rows = [("zz aa mm", "en", s) for s in "abc"] * 3 + [("bb aa", "en", "a")] * 3
    compared(spark, rows, 3)
    compared(spark, rows, 3, top=1)


def test_long_text_passes_in_pieces(monkeypatch):
    monkeypatch.setattr(source_divergence, "PIECE", 10)
    text = ("Ab1é" + "x" * 25 + " - y ") * 40
    assert [t.decode() for part in terms_of(text.encode()) for t in part] == terms(text)


def test_empty_table(spark):
    got = divergence(spark, table(spark, []))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got.count() == 0


@pytest.mark.parametrize("n,total,kept", [(10**12, 10**13, 7), (0, 0, 1), (5 * 10**17, 10**18, 10**6)])
def test_shares_are_exact(spark, n, total, kept):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(n, total, kept)], "n long, t long, k long").select(source_divergence.share(F.col("n"), F.col("t"), F.col("k")).alias("p")).first()
    assert row["p"] == 1 + (10**9 * (n + 5)) // (total + 5 * kept)
