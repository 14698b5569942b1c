"""The pipeline's stages against brute force, and the registered queries against their SQL."""

import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import exact_dedup, hyperminhash, language_hdc, quality_gam
from tallyloom.llm.queries import ORACLES, QUERIES
from tallyloom.llm.tables import read

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = c.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pick = [want.columns.index(k) for k in columns]
    show = lambda rows: sorted(tuple("" if v is None else str(int(v)) if isinstance(v, bool | int) else str(v) for v in r) for r in rows)
    assert show([r[k] for k in columns] for r in got.collect()) == show([r[i] for i in pick] for r in want.fetchall())


def test_every_query_covers_its_table(spark):
    sizes = {"op1": "documents", "op4": "documents", "op7": "documents", "op10": "documents"}
    for name, query in QUERIES.items():
        if (table := sizes.get(name.split("_")[0])) is not None:
            assert query(spark, SF).count() == read(spark, SF, table).count()


def languages(spark, docs):
    """Ids whose text the language stage keeps, decided text by text from the operator's predictions."""
    size = {r["doc_id"]: int(language_hdc.runs_of(r["text"])[1].sum()) for r in docs.collect()}
    found = language_hdc.identify(spark, docs).where("lang_pred <> 'und'").collect()
    return {r["doc_id"] for r in found if size[r["doc_id"]] < language_hdc.JUDGED_RUNS or r["score"] >= language_hdc.LEAST_COSINE}


def odd_documents(spark, folder):
    """Documents with nulls, blank, very long and repeated texts, ties, near copies and clashing columns; labels beside them."""
    rng = random.Random(5)
    say = lambda n, seed: " ".join("".join(random.Random(f"{seed}/{i}").choice("ka lo mi tu ra ne so vi".split()) for _ in range(2 + i % 2)) for i in range(n)) + "."
    rows = [(i, say(60 + i % 7, i % 40), "aa") for i in range(120)]
    rows += [(200 + i, " ".join(w if rng.random() > 0.01 else "kakaka" for w in rows[i][1].split()), None) for i in range(20)]
    rows += [(300 + i, t, "aa") for i, t in enumerate([None, "", " \n\t", "12 34", "%%% ||| $$$ " * 30, "é" * 4000, say(30_000, "long"), "漢字" * 300])]
    rows += [(None, say(70, "nobody"), None), (1, rows[1][1], "aa"), (1, say(66, "another"), "aa"), (400, rows[2][1].replace(" ", "  "), "aa")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, row long, key string, digest string, number long, `x.y` string, `b``c` int"
    docs = spark.createDataFrame([(i, t, x, "s", 0 if t is None else len(t), 1.0, True, 7, "k", "d", 3, "dotted", i) for i, t, x in rows], kinds)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 5 > 0)) for i in range(120)] + [(304, 0), (305, 0), (None, 1), (7, None), (9999, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def plain_near_copies(rows):
    """One row of each component, by comparing every two texts."""
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if sets[i] else -1 - i, []).append(r)
    return [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))["doc_id"] for g in groups.values()]


def plain_equal_texts(rows):
    groups = {}
    for r in rows:
        groups.setdefault("".join(c for c in (r["text"] or "") if c not in " \t\n\v\f\r"), []).append(r)
    return [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"] for g in groups.values()]


def test_every_stage_on_odd_documents(spark, tmp_path):
    folder = str(tmp_path)
    docs = odd_documents(spark, folder)
    show = lambda ids: sorted((-1 if i is None else i) for i in ids)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names, name
        kept, rows = [r["doc_id"] for r in out.collect()], docs.collect()
        if name == "language ID":
            assert {300, 301, 302, 303} & set(kept) == set() and 306 in kept and None in kept
            judge = language_hdc.Judge(language_hdc.learn_profiles(docs.where(~language_hdc.held_out(docs.doc_id))))
            found = [(r["doc_id"], judge(r["text"])) for r in rows]
            assert show(kept) == show(i for i, (x, score, n) in found if x != "und" and (n < language_hdc.JUDGED_RUNS or score >= language_hdc.LEAST_COSINE))
        elif name == "quality classifier":
            model = quality_gam.fit(spark, docs, read(spark, folder, "labels"))
            scores = model.score(np.array([quality_gam.describe(r["text"] or "") for r in rows]))
            assert show(kept) == show(r["doc_id"] for r, x in zip(rows, scores, strict=True) if x >= quality_gam.THRESHOLD)
        elif name == "exact dedup":
            assert show(kept) == show(plain_equal_texts(rows))
        else:
            assert show(kept) == show(plain_near_copies(rows))
        nothing = stage(spark, docs.limit(0), folder)
        assert nothing.count() == 0 and nothing.schema.names == docs.schema.names, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    ids = {}
    for r in packed.collect():
        ids.setdefault(r["doc_id"], []).append((r["piece"], np.frombuffer(r["ids"], "<u4").tolist()))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.where("doc_id >= 200").collect():
        whole = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert [x for _, part in sorted(ids[r["doc_id"]]) for x in part] == whole
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_stages_do_what_their_operators_decide(spark, tmp_path):
    docs = read(spark, SF, "documents")
    columns, decided = docs.columns, []
    decide = [
        lambda d: languages(spark, d),
        lambda d: {r["doc_id"] for r in quality_gam.score_documents(spark, d, read(spark, SF, "labels")).where("predicted = 1").collect()},
        lambda d: {r["doc_id"] for r in exact_dedup.exact_dedup(spark, d).where("kept").collect()},
        lambda d: {r["doc_id"] for r in hyperminhash.near_duplicates(spark, d).where("kept").collect()},
    ]
    for k, ((name, stage), ids) in enumerate(zip(corpus_pipeline.STAGES[:-1], decide, strict=True)):
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        out.write.parquet(path := str(tmp_path / str(k)))
        after = spark.read.parquet(path)
        assert {r["doc_id"] for r in after.collect()} == ids(docs), name
        docs = after
        decided.append(after.count())
    assert decided == sorted(decided, reverse=True) and decided[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_run_gives_what_the_stages_give(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"] and rows.count() > 0
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
