"""Licence scans against a plain search of every start, on made texts."""

import random
import re
from collections import Counter

from tallyloom.llm.license_scan import ANCHORS, NEED, NOTICES, PHRASES, SLACK, TEMPLATES, licenses, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, words string, found long, hits boolean, places string, score string, `a.b` string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stands(have, phrase, at):
    return at >= 0 and have[at : at + len(phrase)] == phrase


def brute(rows):
    texts = [words(t) for _, t in rows]
    counts = Counter(w for t in texts for w in set(t))
    out = Counter()
    for (doc, _), have in zip(rows, texts, strict=True):
        found = {}
        for i, t in enumerate(TEMPLATES):
            want = t.words.split()
            own = sorted(set(want) & set(have), key=lambda w: (counts[w], w))[:ANCHORS]
            needed = len(set(want)) if t.base else NEED
            for s in range(-len(want), len(have)):
                in_place = {w for p, w in enumerate(want) if 0 <= s + p < len(have) and have[s + p] == w}
                if len(in_place & set(own)) < needed:
                    continue
                slack = 0 if t.base else SLACK
                offsets = [(p.split(), next(k for k in range(len(want)) if stands(want, p.split(), k))) for p in t.phrases]
                if all(any(stands(have, p, s + k + d) for d in range(-slack, slack + 1)) for p, k in offsets):
                    found.setdefault(i, []).append((s, sum(0 <= s + p < len(have) and have[s + p] == w for p, w in enumerate(want)) / len(want)))
        base = [s for i, places in found.items() if TEMPLATES[i].base for s, _ in places]
        label = lambda only, found=found: ",".join(sorted({TEMPLATES[i].label for i in found if TEMPLATES[i].base or not only}))
        out[doc, len(have), len(base), min(base, default=None), max(base, default=None), label(True), label(False), max((x for p in found.values() for _, x in p), default=0.0)] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, True, "p", "s", "d") for r in rows], DOCS)


def found(spark, rows):
    return Counter(tuple(r) for r in licenses(table(spark, rows)).collect())


def made(seed, n=150):
    rng = random.Random(seed)
    pool = [w for t in TEMPLATES for w in t.words.split()] + ["ka", "lo", "é", "7"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.4:
                part = rng.choice(TEMPLATES).words.split()
                for _ in range(rng.randint(0, 3)):  # words added, lost and changed
                    k = rng.randrange(len(part))
                    part[k : k + rng.randint(0, 1)] = rng.choice([[], ["zz"], [rng.choice(pool)]])
                    part = part or ["x"]
            else:
                part = [rng.choice(pool) for _ in range(rng.randint(1, 25))]
            parts += part
        glue = rng.choice([" ", "\n", " - ", "(", "_"])
        text = glue.join(rng.choice([w, w, w.upper(), w.capitalize()]) for w in parts)
        rows.append((i if rng.random() < 0.9 else None, rng.choice([text, f"  {text}.", f"{text} {text}"])))
    return rows


def test_matches_a_search_of_every_start(spark):
    rows = made(1)
    expected = brute(rows)
    assert len({k[6] for k in expected}) > 10
    assert found(spark, rows) == expected


def test_notices_are_found_whole_and_edited(spark):
    rows = [(i, f"Ka lo. {text.capitalize()}; mi tu.") for i, (_, text, _) in enumerate(NOTICES)]
    for i, (_, text, phrases) in enumerate(NOTICES):  # a word added where it breaks no key phrase, or before all
        edited = (f"{text[:k]} zz{text[k:]}" for k, c in enumerate(text) if c == " ")
        rows.append((100 + i, f"ka {next((e for e in edited if all(p in e for p in phrases)), text)} lo"))
    got = {r["doc_id"]: r for r in licenses(table(spark, rows)).collect()}
    for i, (label, _, _) in enumerate(NOTICES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1
        assert label in got[100 + i]["labels"].split(",") and 0 < got[100 + i]["score"] <= 1


def test_base_phrases_at_all_places(spark):
    rows = [
        (1, "cc by cc-by CC, BY ccby c c by"), (2, "All rights\nreserved. all rights reserved"), (3, "General Public License"), (4, "general public licenses"),
        (5, "all Rights ® reserved"), (6, "cc 7 by"), (7, "x" * 50_000 + " cc by"), (8, "cc by " * 2000), (9, "cc by"), (9, "cc by"), (10, "cK by K"), (11, "cc_by"), (12, "ccéby"),
    ]
    expected = brute(rows)
    got = found(spark, rows)
    assert got == expected
    by = {k[0]: k for k in got}
    assert by[1][2:7] == (3, 0, 4, "cc-by", "cc-by")
    assert by[8][2:5] == (2000, 0, 3998)
    assert set(PHRASES.values()) <= {label for k in got for label in k[5].split(",")}


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "..."), (4, "☃ é"), (5, "by all"), (5, "by all"), (6, "license " * 5000 + "mit license")]
    got = found(spark, rows)
    assert got == brute(rows)
    assert sum(got.values()) == len(rows)


def test_places_keep_the_row_and_its_columns(spark):
    rows = scan(table(spark, [(1, "x released under the mit license")])).collect()
    assert rows[0]["a.b"] == "d" and rows[0]["score"] == "s" and rows[0]["words"][0] == "x"
    assert [tuple(m) for m in rows[0]["places"]] == [("mit", False, 1, 1.0)]


def test_plan_holds_no_python_and_no_exchange(spark):
    plan = licenses(table(spark, [(1, "cc by")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    got = licenses(table(spark, []))
    assert got.count() == 0
    assert got.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
