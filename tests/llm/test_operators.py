"""The ten operators against brute force, round trips and held-out accuracy, on small fixtures.

Every fixture holds nulls, empty and long texts, ties and repeated rows, and
columns whose names clash with the operators' own.
"""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import bpe_transducer, chat_format, embedding_lsh, exact_dedup, gru, hyperminhash, language_hdc, language_model, packing, quality_gam, warc
from tallyloom.llm.components import components
from tallyloom.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, score double, kept boolean, row long, key string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, rows):
    """Rows of (doc_id, text[, lang]) with clashing extra columns."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 1.0, True, 7, "k") for r in rows], DOCS)


def prose(seed, n=60, syllables="ka lo mi tu ra ne so vi"):
    rng = random.Random(seed)
    s = syllables.split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n))


ODD = ["", None, "   \n\t", "a", "é" * 5000, "x " * 30_000, "end.\x00\x1f", "☃ 𝄞 ﬁ"]


# Exact deduplication.


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in (t or "") if c not in " \t\n\v\f\r"), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = Counter()
    for i, t in rows:
        key = "".join(c for c in (t or "") if c not in " \t\n\v\f\r")
        keep = min(groups[key])[3]
        out[i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()] += 1
    return out


EXACT = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\u00a0b"), (5, None), (6, ""), (7, " "), (8, "a  b"), (9, "long " * 20_000), (9, "long " * 20_000), (None, "zz"), (10, "z z"), (11, "z z")]


def test_exact_dedup_matches_brute_force(spark):
    got = exact_dedup.exact_dedup(spark, documents(spark, EXACT)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == brute_exact(EXACT)


def test_exact_dedup_stage_keeps_one_row_of_each_group(spark):
    docs = documents(spark, EXACT)
    kept = exact_dedup.keep_one(spark, docs)
    assert kept.columns == docs.columns
    expected = sorted({k[1] for k in brute_exact(EXACT)}, key=lambda x: (x is None, x or 0))
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0)) == expected


def test_exact_dedup_at_the_ends_of_the_ids(spark):
    rows = [(-(2**63), "a"), (2**63 - 1, " a"), (2**63 - 1, "b"), (-(2**63), "b"), (None, "c"), (-(2**63), "c"), (0, "b")]
    got = exact_dedup.exact_dedup(spark, documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == brute_exact(rows)
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(spark, documents(spark, rows)).collect()) == [-(2**63), -(2**63), 2**63 - 1]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark, documents(spark, [])).count() == 0
    assert exact_dedup.keep_one(spark, documents(spark, [])).count() == 0


@pytest.mark.parametrize("kind,labels", [("string", ["a", "b", None]), ("double", [0.0, -0.0, 0.5, 0.25, None]), ("boolean", [True, False, None]), ("decimal(4,2)", ["0.25", "0.50", None])])
def test_labels_of_any_type_stay_apart(spark, kind, labels):
    rows = [(i, [1.0, 0.001 * i], labels[i % len(labels)] if not kind.startswith("dec") or labels[i % len(labels)] is None else Decimal(labels[i % len(labels)])) for i in range(20)]
    got = {r["vec_id"]: r["component_id"] for r in embedding_lsh.near_duplicates(spark, spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    for i, _, label in rows:
        assert got[i] == (i if label is None else min(j for j, _, other in rows if other == label))


def test_bloom_table_holds_repeated_hashes_and_few_others(spark):
    import pyarrow as pa

    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000)]
    rows = digests + digests[:50]
    bits = exact_dedup.bloom_bits(len(rows))
    table = exact_dedup.repeated_positions(spark.createDataFrame([(d,) for d in rows], "text_sha256 string").repartition(5), bits)
    hit = exact_dedup._is_marked(table, pa.array(digests), bits)
    assert hit[:50].all() and hit[50:].mean() < 0.01


def test_bloom_size_is_bounded():
    assert exact_dedup.bloom_bits(0) == exact_dedup.LEAST_BITS and exact_dedup.bloom_bits(10**12) == exact_dedup.MAX_BITS


# Near-duplicates of texts.


def brute_sets(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_rows():
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for base in range(6):
        words = prose(base, 80).split()
        for copy in range(12):
            w = list(words)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
            rows.append((len(rows) + 10, " ".join(w)))
    rows += [(200, rows[-1][1]), (201, rows[-1][1].upper()), (202, "one two three"), (203, "One  two\nthree"), (204, "one two three four")]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rows = near_rows()
    sets = {i: brute_sets(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    got = {r["doc_id"]: r for r in hyperminhash.near_duplicates(spark, documents(spark, rows), k).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (want[i] == i) for i, s in sets.items())
    kept = hyperminhash.keep_one(spark, documents(spark, rows), k)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} and "score" in kept.columns


def test_near_duplicates_keep_one_row_of_each_component(spark):
    a, b, c, d, e, f = (prose(s, 60) for s in range(50, 56))
    rows = [(3, b + " end"), (5, a), (5, b), (7, c), (7, c + " end"), (8, d), (8, d), (None, e), (9, e), (None, f), (None, f), (5, None), (None, None), (11, "")]
    kept = hyperminhash.keep_one(spark, documents(spark, rows))
    texts = Counter((r["doc_id"], r["text"].removesuffix(" end") if r["text"] else r["text"]) for r in kept.collect())
    assert kept.columns == documents(spark, rows).columns
    assert texts == Counter([(3, b), (5, a), (7, c), (8, d), (9, e), (None, f), (5, None), (None, None), (11, "")])


def test_near_duplicates_find_links_that_miss_the_leader(spark):
    # A chain of texts, each near the next only: most pairs of a band's group don't link.
    words = prose(9, 100).split()
    rows = []
    for i in range(30):
        words = [*words[4:], *prose(100 + i, 4).split()]
        rows.append((i, " ".join(words)))
    sets = {i: brute_sets(t, 2) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(spark, documents(spark, rows), 2).collect()}
    assert len(links) > 20 and got == brute_components(sets, links)


@pytest.mark.parametrize("shuffled", [False, True])
def test_near_duplicates_in_hot_groups_and_small_blocks(spark, monkeypatch, shuffled):
    """Every band's group of more than three is hot, and blocks hold a few rows or sets only."""
    monkeypatch.setattr(hyperminhash, "HOT", 3)
    monkeypatch.setattr(hyperminhash, "BLOCK", 2)
    monkeypatch.setattr(hyperminhash, "SET_BYTES", 900)
    monkeypatch.setattr(hyperminhash, "HELD_BYTES", 1)
    rng = random.Random(12)
    rows = []
    for base in range(3):
        words = prose(40 + base, 120).split()
        for _ in range(14):
            w = list(words)
            for _ in range(rng.randint(0, 16)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(w)))
    if shuffled:
        rows = [(len(rows) - i, t) for i, t in rows]
    sets = {i: brute_sets(t, 2) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(spark, documents(spark, rows), 2).collect()}
    assert len(links) > 20 and got == brute_components(sets, links)


def test_near_duplicates_of_hot_groups_need_no_finer_band(spark, monkeypatch):
    """members of a hot group that share no finer band are compared all the same."""
    monkeypatch.setattr(hyperminhash, "HOT", 3)
    monkeypatch.setattr(hyperminhash, "HOT_BLOCK", 3)

    def apart(level):
        def finer(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("node")], ["node", "band"])

        return finer

    monkeypatch.setattr(hyperminhash, "_finer_rows", apart)
    monkeypatch.setattr(hyperminhash, "band_keys", lambda regs: np.zeros((len(regs), hyperminhash.BANDS), np.int64))
    rows = [(10 * base + k, f"{prose(60 + base, 100)} w{k}") for base in range(4) for k in range(4)]
    sets = {i: brute_sets(t, 2) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(spark, documents(spark, rows), 2).collect()}
    assert len(set(got.values())) == 4 and got == brute_components(sets, links)


def test_register_estimate_is_close():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        n = 4000
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        fresh = int(n * (1 - share) / (1 + share))
        b[:fresh] = rng.integers(0, 1 << 63, fresh, dtype=np.uint64)
        x, y = hyperminhash.registers([np.unique(a * np.uint64(2)), np.unique(b * np.uint64(2))])
        assert abs((x == y).mean() - share) < 0.13


def test_near_duplicates_of_nothing(spark):
    assert hyperminhash.near_duplicates(spark, documents(spark, [])).count() == 0
    assert [r["component_id"] for r in hyperminhash.near_duplicates(spark, documents(spark, [(3, None)])).collect()] == [3]


# Components.


@pytest.mark.parametrize("last", [-1, 20, 1000])
@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(9, 9), (5, 3), (3, 5), (7, 8), (8, 5)]])
def test_components(spark, edges, last, monkeypatch):
    monkeypatch.setattr("tallyloom.llm.components.LAST_EDGES", last)
    with Scratch(spark, "test") as scratch:
        found = {r["id"]: r["root"] for r in components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert found == {i: r for i, r in want.items() if i != r}


# Vectors.


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(8):
        centre = rng.normal(size=16)
        for _ in range(6):
            v = centre + rng.normal(size=16) * rng.choice([0.01, 0.1, 0.2]) * np.linalg.norm(centre) / 4
            rows.append((len(rows), [float(x) for x in v], c % 3))
    rows += [(100, rows[0][1], 0), (101, [2 * x for x in rows[0][1]], 0), (102, rows[0][1], 1), (103, None, 0), (104, [], 0), (105, [0.0] * 16, 0), (106, [float("nan")] * 16, 0), (107, [None] + [1.0] * 15, 0), (108, rows[0][1], None), (109, rows[0][1][:8], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, node long")
    ok = {i: (np.array(v, float), label) for i, v, label in rows if label is not None and v and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and cos(ok[a][0], ok[b][0]) >= 0.98]
    degree = Counter(x for e in links for x in e)
    want = brute_components([r[0] for r in rows], links)
    got = {r["vec_id"]: r for r in embedding_lsh.near_duplicates(spark, df).collect()}
    assert len(links) > 20 and {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (degree[i], want[i], want[i] == i) for i in want}


def test_vectors_in_a_large_group_split_into_blocks(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in centre + rng.normal(size=8) * 0.004], 1) for i in range(1300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    degree = ((x @ x.T) >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in embedding_lsh.near_duplicates(spark, df).collect()}
    assert [got[i]["n_links"] for i in range(1300)] == degree.tolist() and {r["component_id"] for r in got.values()} == {0}


def test_tables_follow_the_number_of_vectors():
    assert embedding_lsh.shape_for(0)[1] == 6 and embedding_lsh.shape_for(50_000)[1] == 12 and embedding_lsh.shape_for(10**9)[1] > 20
    for n in (1, 10**4, 10**9):
        tables, directions = embedding_lsh.shape_for(n)
        assert (1 - embedding_lsh.NEAR**directions) ** tables <= embedding_lsh.MISS


def test_vectors_travel_exactly():
    for x in (np.array([1.5, -2.0]), np.array([0.1, 1e300]), np.array([0.1, 3.0])):
        assert (embedding_lsh._loaded(embedding_lsh._stored(x)) == x).all()
    assert len(embedding_lsh._stored(np.array([0.5]))) == 5


def test_vectors_of_nothing(spark):
    assert embedding_lsh.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# Packing.


def test_packing_places_every_id(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20 + i, prose(i, 40 + 300 * i)) for i in range(12)] + [(40, "a b"), (40, "a b")]
    tokenizer = Tokenizer.from_file(WORDS)
    got = packing.pack(spark, documents(spark, rows), WORDS).collect()
    expected = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(spark, documents(spark, []), WORDS).count() == 0


def test_word_encoder_matches_the_tokenizer(monkeypatch):
    encoder, tokenizer, rng = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS), random.Random(2)
    assert encoder._parts_marks
    ends = ["", ".", ",", "...", "%%%", "$$$", "'s", "'s.", ").", "»", "-", "–", "_x", "é.", "İ.", "9;", "'", "\"'", "´.", "#@!", "&&&", "?!)"]
    letters = [*"abcXYZ019'.-_é", "ß", "İ", "I\u0307", "ﬁ", "漢", "½", "e\u0301", "K", "𝄞", "\u200d", "'re", "'LL"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 5))) + rng.choice(ends) for _ in range(6000)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, 6000, 30)] + [None, "", "A" * 40 + "." * 40]
    monkeypatch.setattr(packing, "CACHED_WORDS", 500)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_fullest_combination_matches_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        chosen = packing.fullest(dict(Counter(lengths)), room)
        best = max((s for m in range(1 << len(lengths)) if (s := sum(x for i, x in enumerate(lengths) if m >> i & 1)) <= room), default=0)
        assert sum(k * n for k, n in chosen.items()) == best and all(n <= lengths.count(k) for k, n in chosen.items())


def test_plan_uses_every_piece_once():
    histogram = {4096: 3, 4000: 5, 96: 9, 1000: 40, 7: 100}
    used = Counter()
    for bin_, times in packing.plan_bins(histogram):
        assert sum(k * n for k, n in bin_.items()) <= 4096
        used.update({k: n * times for k, n in bin_.items()})
    assert used == histogram


# Byte-level BPE.


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_transducer.load_ranks(RANKS), special_tokens={})


def test_bpe_rows(spark, reference):
    rows = [(i, t) for i, t in enumerate([*ODD, "don't  stop\n\n 12,345 <|endoftext|> naïve", prose(1, 300)])]
    got = {r["doc_id"]: r for r in bpe_transducer.encode_documents(documents(spark, rows), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_transducer_on_any_bytes(reference, monkeypatch):
    ranks = bpe_transducer.load_ranks(RANKS)
    transducer, rng, tokens = bpe_transducer.Transducer(ranks), random.Random(8), list(ranks)
    monkeypatch.setattr(bpe_transducer, "MAX_STATES", 300)
    for n in range(1500):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(1, 12))) if n % 3 else b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4)))
        assert transducer.encode(data) == reference._encode_single_piece(data)


def test_memory_is_bounded_inside_one_piece(reference, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "MAX_STATES", 500)
    monkeypatch.setattr(bpe_transducer, "MAX_DECODER_ARCS", 100)
    encoder, rng = bpe_transducer.Encoder(bpe_transducer.load_ranks(RANKS), public_tokenizers.PATTERN), random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(20_000))
    ids = np.frombuffer(encoder.encode(letters), "<u4").tolist()
    assert ids == reference.encode_ordinary(letters)
    assert len(encoder.transducer._configs) <= 501 and len(encoder.transducer._arcs) <= 256 * 501 and not encoder._known
    decoder = bpe_transducer.StreamDecoder(encoder.transducer.rules.tokens)
    assert decoder.feed(ids) + decoder.finish() == letters and len(decoder._arcs) <= 100


def test_bpe_of_repeated_rows_and_of_nothing(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "same text")]
    got = bpe_transducer.encode_documents(documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1] and len({tuple(r)[1:] for r in got}) == 1
    assert bpe_transducer.encode_documents(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_tokens_that_do_not_merge_to_themselves():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abcd": 257}
    own = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=258)
    transducer = bpe_transducer.Transducer(ranks)
    for data in (b"abcd", b"abcdab", b"xabcd", b"cdab"):
        assert transducer.encode(data) == own._encode_single_piece(data)


def test_stream_decoder_waits_for_whole_code_points():
    decoder = bpe_transducer.StreamDecoder({i: bytes([i]) for i in range(256)})
    data = "aé☃𝄞z".encode()
    out = [decoder.feed([b]) for b in data]
    assert "".join(out) == "aé☃𝄞z" and out[1] == "" and decoder.finish() == ""
    for broken in (b"\xe2\x98", b"a\xffb", b"\xf0\x28\x8c\xbc", b"\xc3\xc3\xa9", b"\xed\xa0\x80"):
        assert decoder.feed(broken) + decoder.finish() == broken.decode("utf-8", "replace")


# Chat formatting.


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "system", "be ### kind"), (1, 1, "user", None), (1, 2, "assistant", "\\### Assistant: </turn> ok"), (1, 3, "assistant", "\n</turn>\n### x:\n\\"),
        (2, 0, "user", "only"), (3, 1, "we:ird\nrole\\", "☃"), (3, None, "assistant", "first"), (3, 1, "we:ird\nrole\\", "☃"), (None, 0, "assistant", ""), (4, 0, None, "x" * 100_000), (4, 1, "user", "é### " * 200_000),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.digest(spark, df).collect()}
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=key)
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        sizes = [len(chat_format.format_turn(t[2] or "", t[3] or "")[0]) for t in own]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(own), len(loss), sum(sizes))
        assert r["context_chars"] == sum(sum(sizes[:i]) for i, t in enumerate(own) if t[2] == "assistant")
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    stream = chat_format.format_conversations(df)
    assert stream.where("example is not null").count() == 4
    assert all(r["contexts_match"] for r in got.values()) and got[1]["n_examples"] == 2
    written = {(r["conv_id"], r["example"]): r for r in chat_format.expand(stream).collect()}
    assert len(written) == 4
    for (conv, k), r in written.items():
        own = sorted((t for t in turns if t[0] == conv), key=key)
        at = [i for i, t in enumerate(own) if t[2] == "assistant"][k]
        whole = "".join(chat_format.format_turn(t[2] or "", t[3] or "")[0] for t in own[: at + 1])
        assert r["text"] == whole and chat_format.unescape(whole[r["loss_start"] : r["loss_end"]]) == (own[at][3] or "")
    text, begin, end = chat_format.render(stream, 1, 1)
    assert chat_format.unescape(text[begin:end]) == turns[3][3] and text.startswith("### system:\nbe \\### kind\n</turn>\n")
    assert chat_format.digest(spark, df.limit(0)).count() == 0


def test_chat_digest_reads_the_written_examples(spark, monkeypatch):
    expand, wrong = chat_format.expand, lambda text: F.regexp_replace(text, "kind", "mean")
    df = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "assistant", "yes"), (1, 2, "assistant", "no"), (1, 3, "user", "bye"), (2, 0, "user", "kind")], "conv_id long, turn long, role string, text string")
    assert all(r["contexts_match"] for r in chat_format.digest(spark, df).collect())
    monkeypatch.setattr(chat_format, "expand", lambda stream, **kw: (e := expand(stream, **kw)).withColumn("text", F.when(e.example == 1, wrong(e.text)).otherwise(e.text)))
    assert {r["conv_id"]: r["contexts_match"] for r in chat_format.digest(spark, df).collect()} == {1: False, 2: True}


@pytest.mark.parametrize("piece, held, part", [(40, 150, 300), (1, 60, 60), (100, 1 << 20, 200), (1 << 20, 90, 1 << 20)])
def test_chat_examples_in_parts_and_pieces(spark, monkeypatch, piece, held, part):
    for name, size in (("PIECE_CHARS", piece), ("HELD_CHARS", held), ("PART_CHARS", part)):
        monkeypatch.setattr(chat_format, name, size)
    rng = random.Random(piece)
    turns = {c: [(rng.choice(["user", "assistant"]), "é#" * rng.randint(0, 12)) for _ in range(rng.randint(1, 25))] for c in range(12)}
    turns |= {None: [("assistant", "a")] * 20, 12: [("user", "u" * 30)] * 20, 13: [("assistant", "x" * 200), ("user", "y" * 200), ("assistant", "z")], 14: [("assistant", "x")] + [("user", "y" * 30)] * 20}
    df = spark.createDataFrame([(c, i, *t) for c, own in turns.items() for i, t in enumerate(own)], "conv_id long, turn long, role string, text string")
    cloudpickle.register_pickle_by_value(chat_format)  # else workers import it with its own limits
    try:
        rows = chat_format.expand(chat_format.format_conversations(df), rest=True).collect()
        got = {r["conv_id"]: r for r in chat_format.digest(spark, df).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(chat_format)
    texts = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        before = texts.setdefault((r["conv_id"], r["example"]), [])
        assert r["piece"] == len(before) and len(r["text"]) < piece + 250
        before.append(r)
    want = {}
    for c, own in turns.items():
        stream = ["".join(chat_format.format_turn(*t)[0] for t in own[:i]) for i in range(len(own) + 1)]
        at = [i for i, t in enumerate(own) if t[0] == "assistant"]
        want |= {(c, k): stream[i + 1] for k, i in enumerate(at)}
        done = at[-1] + 1 if at else 0
        if done < len(own):
            want[c, None] = stream[-1][len(stream[done]) :]
        for k, i in enumerate(at):
            *_, last = texts[c, k]
            assert chat_format.unescape(want[c, k][last["loss_start"] : last["loss_end"]]) == own[i][1]
        said, loss = "".join(f"{r}\n{t}\n" for r, t in own), "".join(own[i][1] for i in at)
        r = got[c]
        assert r["contexts_match"] and (r["n_turns"], r["loss_chars"], r["formatted_chars"], r["n_examples"]) == (len(own), len(loss), len(stream[-1]), len(at))
        assert r["context_chars"] == sum(len(stream[i]) for i in at)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert {k: "".join(r["text"] for r in v) for k, v in texts.items()} == want


@pytest.mark.parametrize("text", ["", "###", "####", "######", "\\", "\\\\###", "</turn>", "\\</turn>\\", "\n</turn>\n", "#\\##"])
def test_chat_escapes_are_reversible(text):
    formatted, begin, end = chat_format.format_turn("user", text)
    assert chat_format.unescape(formatted[begin:end]) == text and chat_format.parse_turn(formatted) == ("user", text)
    assert formatted.index("\n</turn>\n", begin - 1) == end


# WARC.


def brute_pages(rows):
    out = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == data]
        revisit = len(data) >= 1000 and same and page != max(same) and len([1 for _, _, h in rows if h == html]) > 1
        out[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None] += 1
    return out


def test_warc_round_trip(spark):
    big = "é☃\r\n\r\nWARC/1.1\r\n" * 4000
    rows = [(1, "http://a/ü?q=1\r\nX: y", None), (2, None, ""), (3, "u", "short"), (4, "u", "short"), (5, "u", big), (6, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000), (10, "u", "y" * 1000), (11, "u", "0\r\n\r\n" * 3000), (12, "u", "𝄞" * 60_000), (None, "u", "y" * 1000), (None, "u", "only" * 500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, row string")
    got = warc.round_trip(spark, df).collect()
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == brute_pages(rows)
    assert all(r["complete"] for r in got)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_records_parse_in_small_reads(monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "READ_BYTES", 7)
    records = list(warc.response_records(5, "u", ("aé" * 3000).encode(), 1, 2048)) + [warc.revisit_record(4, "u", "00" * 20, 9, 5, 2)]
    data = b"".join(r + b"\r\n\r\n" for r in records)
    for content, name in ((data, "a.warc"), (gzip.compress(data), "a.gz"), (gzip.compress(data[:100]) + gzip.compress(data[100:]), "b.gz")):
        parsed = list(warc.parse_records(content, name))
        assert len(parsed) == len(records) and parsed[0][0]["warc-segment-number"] == "1"
        whole = warc.Dechunker()
        for fields, block in parsed[:-1]:
            for i in range(0, len(block), 5):
                whole.feed(block[i : i + 5])
        assert whole.complete and whole.size == 9000 and int(parsed[-2][0]["warc-segment-total-length"]) == whole.length


def test_warc_of_one_member_a_record():
    import gzip

    records = [b"".join(warc.response_records(i, "u", f"<p>{i}</p>".encode() * (i % 50), i)) for i in range(400)]
    content = b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)
    assert [int(f["x-page-id"]) for f, _ in warc.parse_records(content, "a.gz")] == list(range(400))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"".join(records)[:-9] + b"", "a.warc"))


def test_missing_segments_show(spark):
    rows = [("o", 1, None, 9, b"HTTP/1.1 200 OK\r\n\r\n3\r\nabc\r\n"), ("o", 3, 99, 9, b"0\r\n\r\n")]
    df = spark.createDataFrame(rows, "origin string, segment long, total long, page_id long, block binary").coalesce(1)
    (got,) = df.mapInArrow(warc._reassemble, warc._PAGES).collect()
    assert got["page_id"] == 9 and not got["complete"]


# Language ID.

LANGS = {"aa": "ka lo mi tu ra ne so vi", "bb": "ßü öst ung ein sch ich der", "cc": "ñá ción que los est ara"}


def language_rows():
    rows = [(i, prose(i, 30, LANGS[lang]), lang) for i, lang in enumerate(list(LANGS) * 40)]
    return rows + [(900 + i, t, "aa") for i, t in enumerate(ODD)] + [(None, prose(1), None), (990, "123 !!", "bb"), (991, prose(3, 20_000, LANGS["bb"]), None)]


def test_language_of_held_out_texts(spark):
    rows = language_rows()
    got = {r["doc_id"]: r for r in language_hdc.identify(spark, documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    test = [i for i, _, _ in rows[:120] if got[i]["held_out"]]
    assert len(test) > 10 and all(got[i]["lang_pred"] == rows[i][2] for i in test)
    assert {got[i]["lang_pred"] for i in (900, 901, 902, 990)} == {"und"} and got[991]["lang_pred"] == "bb"
    kept = language_hdc.keep_known(documents(spark, rows))
    assert "score" in kept.columns and {r["doc_id"] for r in kept.collect()} <= {i for i, r in got.items() if r["lang_pred"] != "und"}


def test_language_of_texts_without_letters_beyond_the_basic_alphabets(spark):
    blank = ["😀😀 🎉", "。！", "\ufffd\ufffd", "０１２", "\ue000\uf8ff", "𝟘𝟙 \U000f0000"]
    rows = language_rows() + [(2000 + i, t, None) for i, t in enumerate(blank)] + [(2100, "漢字かな", None)]
    got = {r["doc_id"]: r for r in language_hdc.identify(spark, documents(spark, rows)).collect()}
    assert all((got[2000 + i]["lang_pred"], got[2000 + i]["score"]) == ("und", 0.0) for i in range(len(blank)))
    assert got[2100]["lang_pred"] != "und"
    assert {r["doc_id"] for r in language_hdc.keep_known(documents(spark, rows)).where("doc_id >= 2000").collect()} == {2100}
    # Nor do such characters enter the runs of a text.
    assert all((x == y).all() for x, y in zip(language_hdc.runs_of("añb😀。cd\ufffd"), language_hdc.runs_of("añb cd "), strict=True))


def test_language_bundle_matches_brute_force():
    runs = language_hdc.Runs()
    codes, counts = language_hdc.runs_of("Añb ab")
    text = " añb ab "
    want = np.zeros(language_hdc.DIMENSIONS)
    for i in range(len(text) - 2):
        a, b, c = (runs._letter(ord(x)) for x in text[i : i + 3])
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert (runs.bundle(codes, counts) == want).all()


def test_language_stage_follows_the_prediction(spark):
    noise = random.Random(1)
    junk = ["".join(chr(noise.randrange(0x4E00, 0x9000)) for _ in range(400)), " ".join("".join(noise.choice("qxzjwvkg") for _ in range(9)) for _ in range(90))]
    rows = language_rows() + [(3000, junk[0], "aa"), (3001, junk[1], None), (3002, junk[0][:5], None), (3003, prose(77, 60, LANGS["cc"]), None), (3004, prose(78, 60, LANGS["bb"]), "")]
    found = {r["doc_id"]: r for r in language_hdc.identify(spark, documents(spark, rows)).collect()}
    runs = {i: int(language_hdc.runs_of(t)[1].sum()) for i, t, *_ in rows}
    kept = {r["doc_id"]: r["lang"] for r in language_hdc.keep_known(documents(spark, rows)).collect()}
    want = {i for i, r in found.items() if r["lang_pred"] != "und" and (runs[i] < language_hdc.JUDGED_RUNS or r["score"] >= language_hdc.LEAST_COSINE)}
    assert set(kept) == want and not {3000, 3001} & want and {3002, 3003, 991} <= want
    assert kept[3003] == "cc" and kept[3004] == "bb" and all(kept[i] == lang for i, _, lang in rows[:120])
    some = language_hdc.keep_known(documents(spark, rows), ["cc"])
    assert {r["doc_id"] for r in some.collect()} == {i for i in want if found[i]["lang_pred"] == "cc"}


def test_predictions_match_brute_force(spark):
    rows = language_rows()
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_hdc.identify(spark, documents(spark, rows)).collect()}
    runs, sums = language_hdc.Runs(), {}

    def vector(text, share):
        points = [c if c.isalpha() else " " for c in (text or "").lower()]
        words = "".join(points).split()
        if not words:
            return None
        line = f" {' '.join(words)} "
        parts = Counter(line[i : i + 3] for i in range(len(line) - 2))
        scale = max(sum(parts.values()), language_hdc.LEAST_RUNS)
        out = np.zeros(language_hdc.DIMENSIONS)
        for part, n in parts.items():
            a, b, c = (runs._letter(ord(x)) for x in part)
            out += ((n << language_hdc.SHARE_BITS) // scale if share else n) * np.roll(a, 2) * np.roll(b, 1) * c
        return out

    for i, text, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and lang and (v := vector(text, True)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    want = set()
    for i, text, _ in rows:
        v = vector(text, False)
        cosines = {lang: float(s @ v / np.linalg.norm(s) / np.linalg.norm(v)) for lang, s in sorted(sums.items())} if v is not None else {"und": 0.0}
        best = max(cosines, key=cosines.get)
        want.add((i, best, round(max(cosines[best], 0.0), 9)))
    assert got == want


def test_language_without_teachers(spark):
    rows = [(1, "some text", None), (2, None, "en")]
    assert {r["lang_pred"] for r in language_hdc.identify(spark, documents(spark, rows)).collect()} == {"und"}
    assert language_hdc.identify(spark, documents(spark, [])).count() == 0


def test_language_stage_without_teachers_keeps_texts_with_letters(spark):
    rows = [(1, "some text", None), (2, None, None), (3, "漢字", None), (4, "12 !!", None), (5, "", None), (None, "é", None)]
    assert {r["doc_id"] for r in language_hdc.keep_known(documents(spark, rows)).collect()} == {1, 3, None}


# Quality.


def test_quality_on_held_out_texts(spark):
    rows, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        rows.append((i, prose(i, 60) + "." if good else " | ".join(prose(i, 20).split()) + " %%%$$$" * 9))
        labels.append((i, int(good)))
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(None, "x")]
    frame = spark.createDataFrame([*labels, (5, 1), (7777, 1), (None, 1), (901, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_gam.score_documents(spark, documents(spark, rows), frame).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    test = [(i, y) for i, y in labels if got[i]["held_out"]]
    assert len(test) > 20 and np.mean([got[i]["predicted"] == y for i, y in test]) > 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels)
    kept = quality_gam.keep_good(spark, documents(spark, rows), frame)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_scores_are_sums_of_table_entries(spark):
    rows = [(i, prose(i, 30 + i) + (" %$!" * i if i % 2 else ".")) for i in range(60)] + [(7, "again"), (900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 1), (9, 0)], "doc_id long, quality int")
    docs = documents(spark, rows)
    model = quality_gam.fit(spark, docs, labels)
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in quality_gam.score_documents(spark, docs, labels).collect())

    def plain(text):
        total, x = model.base, quality_gam.describe(text or "")
        for j, value in enumerate(x):
            total += model.tables[j][sum(e <= value for e in model.edges[j])]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(e <= x[a] for e in model.pair_edges[a])][sum(e <= x[b] for e in model.pair_edges[b])]
        return 1 / (1 + np.exp(-total))

    assert got == Counter((i, round(plain(t), 9)) for i, t in rows)
    assert quality_gam.score_documents(spark, documents(spark, []), labels).count() == 0


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality_gam.score_documents(spark, documents(spark, [(1, None)]), none).collect()] == [0.5]


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(0)
    x = np.zeros((3000, len(quality_gam.FEATURES)))
    x[:, :2] = rng.uniform(-1, 1, (3000, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_gam.learn(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9


# Language model.


def test_base_scores_match_brute_force(spark, monkeypatch):
    rows = [(i, prose(i % 30, 50)) for i in range(80)] + [(900 + i, t) for i, t in enumerate(ODD)] + [(3, prose(3)), (None, "unseen words here")]
    monkeypatch.setattr(language_model, "DICTIONARY", 40)
    docs = documents(spark, rows)
    got = language_model.score_documents(spark, docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: float(sum(np.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in tokens(t)))
    want = sorted((i is None, i or 0, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), base(t)) for i, t in rows)
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"]) for r in got)
    assert [x[:4] for x in found] == [x[:4] for x in want] and [x[4] for x in found] == pytest.approx([x[4] for x in want])
    assert {r["train_tokens"] for r in got} == {total} and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    test = [r for r in got if r["held_out"]]
    assert test and sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_words_of_many_texts_are_those_of_each(monkeypatch):
    monkeypatch.setattr(language_model, "SPLIT_BYTES", 30)
    texts = [*ODD, " a", "b ", "\x00 x\x1cy\x1d\x1e\x1f z\x85    Q", "A É ß\tİ\n\v\f\rk", "ÀB c\u2003d", *(prose(i, 3) for i in range(20))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got, counts = [], Counter()
    for part in language_model._slices([batch, batch.slice(0, 0)]):
        assert part.num_rows == 1 or sum(len((t or "").encode()) for t in part.column("text").to_pylist()) <= 30
        words, at = language_model.words_by_text(part.column("text"))
        own = [[] for _ in range(part.num_rows)]
        for w, i in zip(words.to_pylist(), at.tolist(), strict=True):
            own[i].append(w)
        got += [[*w, b""] for w in own]
    assert got == [language_model.words_of(t) for t in texts]
    for part in language_model._count_rows([batch]):
        for w, c in zip(*(x.to_pylist() for x in part.columns), strict=True):
            counts[w] += c
    assert counts == Counter(w for t in texts for w in language_model.words_of(t))


def test_training_is_sure_of_its_margin_only(monkeypatch):
    rng = np.random.default_rng(5)
    trainer, asked = gru.Trainer(gru.fresh(rng.integers(1, 50, gru.HEAD + gru.TAIL))), []
    margin = gru._margin
    monkeypatch.setattr(gru, "_margin", lambda p, kind: asked.append(kind) or margin(p, kind))
    safe = trainer._safe
    monkeypatch.setattr(trainer, "_safe", lambda kind: (s := safe(kind)) and margin(trainer.p, kind) > 0 or not s or pytest.fail("not safe"))
    trainer.train([np.append(rng.integers(1, gru.HEAD, 400), 0).astype(np.int16) for _ in range(8)], 0, 2)
    assert 2 <= len(asked) < 2 * 8 * 401 / 2 / gru.WINDOW


def test_language_model_of_nothing(spark):
    assert language_model.score_documents(spark, documents(spark, [])).count() == 0
    (only,) = language_model.score_documents(spark, documents(spark, [(None, None)])).collect()
    assert only["n_tokens"] == 1 and only["train_tokens"] == 0 and not only["held_out"]


def learned(spark, docs):
    """The vocabulary and the weights that the operator's own steps give for these training documents."""
    with Scratch(spark, "taught") as scratch:
        v = language_model.vocabulary(language_model.count_words(scratch, docs))
        shared = spark.sparkContext.broadcast(v)
        rows = docs.select(docs.doc_id.alias("row"), "doc_id", "text").mapInArrow(language_model._prepare_rows(shared), language_model._PREPARED)
        return v, language_model.learn(spark, rows, shared, v.total)


def test_language_model_learns_from_every_training_document(spark, monkeypatch):
    monkeypatch.setattr(language_model, "WARM_TOKENS", 1)
    docs = documents(spark, [(i, f"word{i} word{i} word{i}") for i in range(60)]).select("doc_id", "text")
    v, flat = learned(spark, docs)
    # The vector of a word moves only where a text with that word has trained the network.
    moved = gru.unpack(flat)["inputs"] != gru.unpack(gru.fresh(v.symbol_counts()))["inputs"]
    assert v.heads == 61 and moved[:, : v.heads].any(axis=0).all()


def test_weights_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(language_model, "GROUP_TOKENS", 600)
    docs = documents(spark, [(i % 50, prose(i, 40)) for i in range(60)]).select("doc_id", "text")
    one, many = (learned(spark, docs.repartition(n))[1] for n in (1, 7))
    assert (one == many).all() and (one != gru.fresh(np.ones(gru.HEAD + gru.TAIL))).any()


def plain_states(p, symbols, end):
    """The states of one text, one step at a time, gate by gate."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, out, n = np.zeros(gru.HIDDEN), [], gru.HIDDEN
    for before in [end, *symbols[:-1]]:
        x = p["inputs"][:, before].astype(float)
        recur, bias = p["recur"].astype(float), p["recur_bias"][:, 0].astype(float)
        z = sigmoid(x[:n] + recur[:n] @ h + bias[:n])
        r = sigmoid(x[n : 2 * n] + recur[n : 2 * n] @ h + bias[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * (recur[2 * n :] @ h + bias[2 * n :]))
        h = (1 - z) * new + z * h
        out.append(h)
    return out


def plain_log(p, h, symbol):
    """Natural log of a symbol's probability by two whole softmaxes."""
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    out = log_softmax(p["class_out"].astype(float) @ h + p["class_bias"][:, 0])
    if symbol >= gru.HEAD:
        return out[gru.HEAD // gru.CLASS + symbol - gru.HEAD]
    own = slice(symbol // gru.CLASS * gru.CLASS, (symbol // gru.CLASS + 1) * gru.CLASS)
    return out[symbol // gru.CLASS] + log_softmax(p["word_out"][own].astype(float) @ h + p["word_bias"][own, 0])[symbol % gru.CLASS]


def test_scores_match_a_plain_run_of_the_same_weights(spark, monkeypatch):
    monkeypatch.setattr(language_model, "DICTIONARY", 40)
    monkeypatch.setattr(gru, "EVALUATED", 64)
    monkeypatch.setattr(gru, "_is_safe", lambda p, kind: kind == "word")
    rows = [(i, prose(i % 20, 5 + i)) for i in range(70)] + [(900, None), (901, ""), (902, "never seen " * 40), (903, prose(5, 900)), (30, prose(10, 40))]
    docs = documents(spark, rows)
    taught = docs.where(language_model.remainder(docs.doc_id) != 0).select("doc_id", "text")
    v, flat = learned(spark, taught)
    p, symbol_of, want = gru.unpack(flat), {}, []
    counts = Counter(w for r in taught.collect() for w in language_model.words_of(r["text"]))
    for w in counts:
        symbol_of[w] = v._index[w] if v._index.get(w, 1 << 30) < v.heads else gru.HEAD + v.suffixes.get(w[-2:], 0)
    inside = {}  # counts and number of the words of a tail class
    for w, s in symbol_of.items():
        if s >= gru.HEAD:
            m = inside.setdefault(s, [0, 0])
            m[0] += counts[w]
            m[1] += 1
    for i, text in rows:
        words = language_model.words_of(text)
        symbols = [symbol_of.get(w, gru.HEAD + v.suffixes.get(w[-2:], 0)) for w in words]
        total = 0.0
        for w, s, h in zip(words, symbols, plain_states(p, symbols, v.end), strict=True):
            total += plain_log(p, h, s) / np.log(10)
            if s >= gru.HEAD and s in inside:
                mass, types = inside[s]
                total += np.log10((counts[w] - language_model.DISCOUNT if w in counts else language_model.DISCOUNT * types) / mass)
        want.append((i, total))
    got = sorted((r["doc_id"], r["score"]) for r in language_model.score_documents(spark, docs).collect())
    assert [g[0] for g in got] == [w[0] for w in sorted(want)] and [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)], rel=2e-5)


def test_network_gradients_match_differences(monkeypatch):
    """With a large past, Adagrad moves the weights in proportion to the gradient, which differences of the loss confirm."""
    rng = np.random.default_rng(3)
    flat = gru.fresh(rng.integers(1, 50, gru.HEAD + gru.TAIL))
    gru.unpack(flat)["class_out"][:] = rng.normal(0, 0.5, (gru.CLASSES, gru.HIDDEN))
    gru.unpack(flat)["word_out"][:] = rng.normal(0, 0.5, (gru.HEAD, gru.HIDDEN))
    texts = [np.append(rng.integers(1, 90, n), 0).astype(np.int16) for n in (7, 3, 4)] + [np.array([gru.HEAD + 2, 70, 0], np.int16)]
    trainer = gru.Trainer(flat, np.full(gru.SIZE, 1e8, np.float32), rate=100.0)
    monkeypatch.setattr(gru, "WINDOW", 64)
    trainer.train(texts, 0, 2)
    gradient = (flat.astype(float) - trainer.flat) * 100
    loss = lambda w: -gru.score(w, texts, 0).sum() / sum(map(len, texts))
    wide, at = flat.astype(np.float64), 0
    for name, shape in gru._shapes().items():
        n = int(np.prod(shape))
        part = slice(at, at + n)
        at += n
        direction = np.zeros(gru.SIZE)
        direction[part] = gradient[part]
        norm = np.linalg.norm(direction)
        slope = (loss(wide + 1e-4 * direction / norm) - loss(wide - 1e-4 * direction / norm)) / 2e-4
        assert norm > 0 and slope == pytest.approx(norm, rel=0.05), name


def test_network_state_and_learning():
    rng = np.random.default_rng(1)
    flat = gru.fresh(np.ones(gru.HEAD + gru.TAIL)).astype(np.float64)
    texts = [np.append(rng.integers(1, 300, 9), 0), np.append(rng.integers(1, gru.HEAD + gru.TAIL, 9), 0)]
    before = gru.score(flat, texts, 0)
    # Scores don't depend on what else is in the batch, nor on where windows end.
    assert gru.score(flat, texts[:1], 0)[0] == pytest.approx(before[0])
    trainer = gru.Trainer(flat.astype(np.float32), rate=1e-3)
    for _ in range(30):
        trainer.train(texts, 0, 2)
    assert gru.score(trainer.flat, texts, 0).sum() > before.sum() + 1


def test_training_carries_the_state_through_a_text(monkeypatch):
    """A word far back decides the next one: only a state carried over windows and blocks can learn it."""
    seen = []
    monkeypatch.setattr(gru.Trainer, "window", lambda self, h, inputs, targets, live, end: (seen.append((h.copy(), inputs.copy())), h + 1)[1])
    text = np.append(np.arange(1, 1200) % 60 + 1, 0).astype(np.int16)
    gru.Trainer(gru.fresh(np.ones(gru.HEAD + gru.TAIL))).train([text, text[-3:]], 0, 2)
    assert np.concatenate([x[:, 0] for _, x in seen])[: len(text)].tolist() == [0, *text[:-1].tolist()]
    assert [h[0, 0] for h, _ in seen] == list(range(len(seen)))


def test_network_trains_on_windows_without_frequent_words():
    trainer = gru.Trainer(gru.fresh(np.ones(gru.HEAD + gru.TAIL)))
    trainer.train([np.full(40, gru.HEAD + 3)], 0, 2)
    assert trainer.seen == 40 and np.isfinite(trainer.flat).all()


def test_windows_write_into_kept_arrays():
    """Once the arrays are there, a window takes little new memory: it is neither asked for again nor copied between layouts."""
    rng = np.random.default_rng(2)
    trainer, h = gru.Trainer(gru.fresh(rng.integers(1, 50, gru.HEAD + gru.TAIL))), np.zeros((gru.HIDDEN, gru.LANES), np.float32)
    symbols = rng.integers(0, gru.HEAD + gru.TAIL, (gru.WINDOW + 1, gru.LANES)).astype(np.int16)
    inputs, targets = symbols[:-1], symbols[1:]
    h = trainer.window(h, inputs, targets, None, 0)
    tracemalloc.start()
    trainer.window(h, inputs, targets, None, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < inputs.size * 3 * gru.HIDDEN * 4 * 2


@pytest.mark.parametrize("ends", (False, True))
def test_window_moves_weights_as_a_plain_run_says(ends):
    """Gradients match differences of the loss weight by weight, also where lanes have ended and most classes have no word."""
    rng = np.random.default_rng(4)
    flat = gru.fresh(rng.integers(1, 50, gru.HEAD + gru.TAIL))
    symbols = rng.integers(1, 70, (6, 5)).astype(np.int16)
    symbols[3, 2], symbols[2, 4] = gru.HEAD + 5, 0
    live = np.ones((5, 5), bool)
    if ends:
        live[2:, 3] = live[4:, 1] = False
    start = rng.uniform(-0.5, 0.5, (gru.HIDDEN, 5)).astype(np.float32)
    trainer = gru.Trainer(flat, np.full(gru.SIZE, 1e8, np.float32), rate=100.0)
    last = trainer.window(start, symbols[:-1], symbols[1:], live if ends else None, 0)
    gradient = 100 * (flat.astype(np.float64) - trainer.flat)

    def loss(weights, states=None):
        p, h, total = gru.unpack(weights), [start[:, k].astype(float) for k in range(5)], 0.0
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        n = gru.HIDDEN
        for t in range(5):
            for k in range(5):
                before = h[k] * (symbols[t, k] != 0)
                a, x = p["recur"] @ before + p["recur_bias"][:, 0], p["inputs"][:, symbols[t, k]]
                z, r = sigmoid(x[:n] + a[:n]), sigmoid(x[n : 2 * n] + a[n : 2 * n])
                h[k] = (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :]) + z * before
                if live[t, k]:
                    total -= plain_log(p, h[k], symbols[t + 1, k])
        if states is not None:
            states += h
        return total / live.sum()

    states = []
    wide = flat.astype(np.float64)
    loss(wide, states)
    assert np.array(states).T == pytest.approx(last, abs=1e-5) and trainer.seen == live.sum()
    tried = rng.choice(np.flatnonzero(gradient), 40, replace=False)
    for i in tried:
        step = np.zeros(gru.SIZE)
        step[i] = 1e-4
        assert (loss(wide + step) - loss(wide - step)) / 2e-4 == pytest.approx(gradient[i], rel=0.01, abs=2e-5), i


def test_network_probabilities_sum_to_one():
    p = gru.unpack(gru.fresh(np.arange(gru.HEAD + gru.TAIL)))
    state = np.full((gru.HIDDEN, 1), 0.3, np.float32)
    every = np.arange(gru.HEAD + gru.TAIL)
    assert np.exp(gru.log_probabilities(p, np.repeat(state, len(every), 1), every)).sum() == pytest.approx(1, abs=1e-4)


def test_scratch_follows_the_named_folder(spark):
    from tallyloom.llm.scratch import checkpoint_root

    jvm = spark.sparkContext._jvm
    with Scratch(spark, "t") as scratch:
        table = scratch.table(spark.range(3), "x")
        base = scratch.base
        assert base.startswith(checkpoint_root(spark)) and table.count() == 3 and base.split(":")[-1] in table.inputFiles()[0]
    path = jvm.org.apache.hadoop.fs.Path(base)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_scratch_refuses_a_local_folder_on_a_cluster():
    from types import SimpleNamespace as Some

    from tallyloom.llm.scratch import checkpoint_root

    unset = Some(getCheckpointDir=lambda: Some(isDefined=lambda: False))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = Some(getConf=lambda: Some(get=lambda _: None), _jsc=Some(sc=lambda: unset), master=master)
        with pytest.raises(ValueError, match="share"):
            checkpoint_root(Some(sparkContext=context, conf=Some(get=lambda *_: None)))
