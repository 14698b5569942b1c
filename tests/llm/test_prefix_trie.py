"""The trie of conversations against one built turn by turn in a dictionary, and running sums against plain ones."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyloom.llm.prefix_trie import prefixes, rebuilt_trie, trie, verified
from tallyloom.llm.running import powers, running
from tallyloom.llm.scratch import Scratch

TURNS = "conv_id long, turn long, role string, text string, key long, depth string, part int, f long, salt string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, 3, "s") for r in rows], TURNS)


def ordered(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(x[2], x[3]) for x in sorted(t, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, t in found.items()}


def rebuilt(conversations):
    out = {}
    for c, own in conversations.items():
        base = c - int(c - 100 * int(c / 100))
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conversations.get(base, [])[:h] + own[h:]
    return out


def brute(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode() if path in ends else b"").hexdigest()
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved, digest))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, convs=60, words=("a", "b", "é😀"), most=8):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((rng.choice([c, c, c, 100 + c % 7, 0]), t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_a_dictionary(spark, seed):
    rows = made(seed)
    assert rows_of(trie(spark, table(spark, rows))) == brute(ordered(rows))


def test_rebuilt_trie_matches_a_dictionary(spark):
    rows = made(3, 40, most=3) + [(c, t, "user", f"x{t % 3}") for c in (-205, -200, -7, 300, 301, 302, 417, 2**63 - 1, -(2**63)) for t in range(7)]
    rows += [(100 * k + 1, 0, "user", "solo") for k in range(6, 16)]  # families without a first conversation: some become turnless
    plain = rebuilt(ordered(rows))
    assert any(not t for t in plain.values())
    assert rows_of(rebuilt_trie(spark, table(spark, rows))) == brute(plain)


def test_narrow_fingerprints_collide_and_are_split(spark):
    rows = made(4, 50, words=("a", "b", "c", "d", "e"))
    with Scratch(spark, "test") as scratch:
        t = table(spark, rows)
        found = prefixes(scratch, t, t.select("conv_id").distinct(), bits=2)
        assert found.select("depth", "f").distinct().count() < len(brute(ordered(rows)))
        _, nodes = verified(scratch, found)
        assert nodes.count() == len(brute(ordered(rows)))
    assert rows_of(trie(spark, table(spark, rows), bits=2)) == brute(ordered(rows))


def test_hot_conversation_and_hot_node(spark):
    rows = [(5, t, "user", f"w{t % 11}") for t in range(3000)] + [(c, 0, "user", "w0") for c in range(6, 900)]
    got = {r["depth"]: r for r in trie(spark, table(spark, rows)).where("conv_id = 5").collect()}
    assert set(got) == set(range(3001))
    assert got[0]["n_convs"] == got[1]["n_convs"] == 895
    assert got[0]["n_leaves"] == 1 and got[3000]["n_children"] == 0
    assert got[1]["saved_tokens"] == 894 * 2
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(6, 900))).encode()).hexdigest()


def test_nulls_repeats_and_long_texts(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", "x" * 200_000), (2, None, "", ""), (2, 5, "", None), (2, 5, "user", "x" * 200_000), (None, 0, "user", "lost"), (3, 1, "b", "a"), (3, 1, "a", "b"), (4, 1, "a", "b"), (4, 2, "b", "a")]
    assert rows_of(trie(spark, table(spark, rows))) == brute(ordered(rows))


def test_roles_and_texts_do_not_run_into_each_other(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, "ab", "c")]
    assert rows_of(trie(spark, table(spark, rows))) == brute(ordered(rows))


def test_empty_table(spark):
    assert trie(spark, table(spark, [])).count() == 0
    assert rebuilt_trie(spark, table(spark, [(None, 1, "user", "x")])).count() == 0


@pytest.mark.parametrize("keys", [1, 3, 400])
def test_running_sums_match_plain_ones(spark, keys):
    rng = random.Random(keys)
    rows = [(rng.randrange(keys), i, rng.randrange(1 << 40), rng.randrange(1 << 40)) for i in range(5000)]
    sums = {"v": (7_654_321, 1_000_003), "w": (1, None)}
    with Scratch(spark, "test") as scratch:
        df = spark.createDataFrame(rows, "k long, i long, v long, w long")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "170")
        try:
            got = {(r["k"], r["i"]): r for r in running(scratch, df, "k", ["i"], ["i"], sums, "sums").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at, v, w = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, i, x, y in sorted(rows):
        r = got[k, i]
        assert (r["at"], r["v_before"], r["w_before"]) == (at[k], v[k], w[k])
        v[k] = (v[k] + x * pow(7_654_321, at[k], 1_000_003)) % 1_000_003
        w[k] += y
        at[k] += 1
        assert (r["v"], r["w"]) == (v[k], w[k])


def test_powers():
    assert powers(12345, 1_000_003, 1000).tolist() == [pow(12345, i, 1_000_003) for i in range(1000)]
