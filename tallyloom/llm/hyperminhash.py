"""Near-duplicate texts by HyperMinHash registers, banding and full verification.

A text is the set of its word shingles, hashed to 64 bits.  The top bits of a
hash name one of REGISTERS buckets; of the smallest remainder in a bucket the
register keeps the number of leading zeros and the next MANTISSA bits, 16 bits
in all.  Empty buckets borrow from the first non-empty one along a fixed random
sequence.  BANDS bands of ROWS registers name candidate groups: at a Jaccard
similarity of 0.8 two texts share no band with probability 3e-6.

Links are found in two rounds, so that large groups never become all pairs:

1. every member of a band's group is compared with the group's smallest node;
2. of groups that then still hold more than one component, members of different
   components are compared by their registers; those that may link form families,
   and within a family all pairs of different components are compared on full
   sets.  Both happen in blocks of bounded size, and what leaves a task
   are trees over the pairs found, never the pairs.  Members of a group's largest
   component are never compared with each other, so they are copied only as often
   as the others fill blocks.

A band's group of more than HOT members is dealt once more by FINER bands, each of
ROWS further registers, and so are groups that are hot still, up to LEVELS times.
That joins most of a hot group's components cheaply; then the second round goes
over the hot groups themselves, so that no pair is left to the finer bands alone.

A pair is ruled out by its sizes or by the collision-corrected estimate of its
registers, five standard errors below the threshold; every other pair is decided
on the full sets of both texts.

Equal sets are represented once.  Words, shingles and comparisons cover whole
texts; nothing is capped.

Defined cases: null and blank texts have an empty set and link with nothing;
with fewer words than a shingle needs, all words are the one shingle; repeated
rows share their set and so their component; a null id is never the smallest
unless all ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.components import components, local_roots
from tallyloom.llm.scratch import Scratch, shuffle_partitions
from tallyloom.llm.tables import columns

REGISTERS, BUCKET_BITS, MANTISSA = 256, 8, 10
BANDS, ROWS = 42, 6
#: A group of more members is dealt by finer bands, so many a band, so many times.
HOT, FINER, LEVELS = 4096, 8, 3
#: Rows of one side of a block when registers are compared, and bytes of sets when full sets are.
BLOCK, SET_BYTES = 256, 1_000_000
#: The same rows in hot groups, where smaller blocks would be copied too often.
HOT_BLOCK = 2048
#: Bytes of rows that a task holds at a time, besides those of one pair of blocks.
HELD_BYTES = 16_000_000
SEED = 77
#: Bytes of text hashed at a time, and texts whose registers are made at a time.
TEXT_BYTES, TEXTS = 4_000_000, 512
#: A set of ids up to this number of rows is broadcast, a larger one is joined by shuffling.
BROADCAST_IDS = 200_000

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Probability that registers of unlike sets agree: equal leading zeros (1/3) and mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA)

_probes = np.random.default_rng(SEED).integers(0, REGISTERS, (512, REGISTERS))
_powers = np.ones(1, _U), np.ones(1, _U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, _U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = made[0], made[1]
    return _powers[0], _powers[1]


def _blocks(data: bytes) -> Iterator[bytes]:
    """Parts of about TEXT_BYTES bytes that end between words."""
    at = 0
    while at < len(data):
        end = at + TEXT_BYTES
        while end < len(data) and not _WHITE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, in order: a polynomial over its bytes, mixed."""
    out = []
    for block in _blocks(text.encode().lower()):  # bytes.lower changes A to Z only
        b = np.frombuffer(block, np.uint8)
        white = np.concatenate(([True], _WHITE[b], [True]))
        change = np.flatnonzero(white[1:] != white[:-1])
        starts, ends = change[::2], change[1::2]
        if not len(starts):
            continue
        power, inverse = _powers_to(len(b) + 1)
        sums = np.concatenate((np.zeros(1, _U), np.cumsum((b.astype(_U) + _U(1)) * power[: len(b)], dtype=_U)))
        out.append(_mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U)))
    return np.concatenate(out) if out else np.empty(0, _U)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``words`` words."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    size = min(words, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, _U)
    for j in range(size):
        h = _mix(h * _U(0xD1342543DE82EF95) + w[j : j + n])
    return np.unique(h)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers per set; rows of empty sets mean nothing."""
    shift = _U(64 - BUCKET_BITS)
    bounds = np.arange(REGISTERS, dtype=_U) << shift
    rest = np.zeros((len(sets), REGISTERS), _U)
    filled = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        if not len(s):
            filled[i] = True
            continue
        at = np.searchsorted(s, bounds)
        least = s[np.minimum(at, len(s) - 1)]
        filled[i] = (at < len(s)) & (least >> shift == np.arange(REGISTERS, dtype=_U))
        rest[i] = least & ((_U(1) << shift) - _U(1))
    bits = np.frexp(rest.astype(np.float64))[1].astype(_U)  # the remainder's length in bits
    mantissa = (rest << (_U(65) - np.maximum(bits, _U(2)))) >> _U(64 - MANTISSA)
    made = (((_U(64 - BUCKET_BITS) - bits) << _U(MANTISSA)) | mantissa).astype(np.uint16)
    row, col = np.nonzero(~filled)
    for attempt in range(len(_probes) + REGISTERS):
        if not len(row):
            break
        source = _probes[attempt, col] if attempt < len(_probes) else (col + attempt) % REGISTERS
        hit = filled[row, source]
        made[row[hit], col[hit]] = made[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return made


def band_keys(regs: np.ndarray) -> np.ndarray:
    r = regs[:, : BANDS * ROWS].astype(_U).reshape(len(regs), BANDS, ROWS)
    h = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=_U)), r.shape[:2])
    for j in range(ROWS):
        h = _mix(h * _U(0xD1342543DE82EF95) + r[:, :, j])
    return h.astype(np.int64)


def _finer_rows(level: int):
    """Members of hot groups by finer bands: the group's name and ROWS more registers, FINER times."""

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([SEED, level])
        chosen = np.stack([rng.permutation(REGISTERS)[:ROWS] for _ in range(FINER)])
        salt = _mix(np.arange(1, FINER + 1, dtype=_U) + _U(1000 * level))
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            h = _mix(batch.column("band").to_numpy().astype(_U))[:, None] + salt
            for j in range(ROWS):
                h = _mix(h * _U(0xD1342543DE82EF95) + regs[:, chosen[:, j]].astype(_U))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), FINER)), pa.array(h.ravel().astype(np.int64))], ["node", "band"])

    return finer


def _sketch_rows(words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                regs = registers(sets)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band_keys(regs).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()), pa.array([r.tobytes() for r in regs], pa.binary()), bands],
                    ["doc_id", "n_shingles", "key", "regs", "bands"],
                )

    return sketch


def may_reach(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and registers leave a similarity of ``percent`` possible."""
    goal = percent / 100
    agree = (regs_a == regs_b).mean(axis=-1)
    estimate = (agree - COLLISION) / (1 - COLLISION)
    least = goal - 5 * (goal * (1 - goal) / REGISTERS) ** 0.5
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (estimate >= least)


def _estimated(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b")]
            sizes = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            yield batch.select(["a", "b"]).filter(pa.array(may_reach(*regs, *sizes, percent)))

    return keep


def _set_rows(words: int):
    """The full set of each text whose set is the one asked for."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                found = [s.tobytes() for s in (shingles(t, words) for t in part.column("text").to_pylist())]
                same = [hashlib.blake2b(s, digest_size=16).hexdigest() == k for s, k in zip(found, part.column("key").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], ["node", "members"]).filter(pa.array(same, pa.bool_()))

    return sets


def _confirmed(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                x, y = (np.frombuffer(m.as_buffer(), _U) for m in (a, b))
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return keep


def _shared(sets: list[np.ndarray], k: int, others: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of set k with the others."""
    flat = np.concatenate([sets[o] for o in others])
    at = np.minimum(np.searchsorted(sets[k], flat), len(sets[k]) - 1)
    starts = np.cumsum([0, *(len(sets[o]) for o in others[:-1])])
    return np.add.reduceat((sets[k][at] == flat).astype(np.int64), starts)


def _across(key: str, percent: int, exact: bool):
    """Rows sorted by a key and pair of blocks: trees over the pairs of different roots that may link, or do.

    Only a pair's ends leave a task, as (node, smallest node it reaches here),
    so a group sends no more rows than it has members.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def of(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            name, low, high, node, root, block, size = (rows.column(c).to_numpy() for c in (key, "low", "high", "node", "root", "block", "n_shingles"))
            change = np.flatnonzero((name[1:] != name[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            bounds = [0, *change.tolist(), rows.num_rows]
            if not last:
                bounds.pop()
            regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            ends_a, ends_b = [], []
            for i, j in zip(bounds, bounds[1:], strict=False):
                one = low[i] == high[i]
                if (root[i:j] == root[i]).all():
                    continue
                sets = [np.frombuffer(m, _U) for m in rows.column("members")[i:j].to_pylist()] if exact else []
                left, right = [], []
                for k in range(j - i):  # one row against the rest of its group
                    others = np.flatnonzero((root[i + k + 1 : j] != root[i + k]) & ((block[i + k + 1 : j] != block[i + k]) | one)) + k + 1
                    if len(others):  # sizes first: they are cheaper than registers
                        others = others[100 * np.minimum(size[i + k], size[i + others]) >= percent * np.maximum(size[i + k], size[i + others])]
                        others = others[may_reach(regs[i + k], regs[i + others], size[i + k], size[i + others], percent)]
                    if exact and len(others):
                        shared = _shared(sets, k, others)
                        others = others[100 * shared >= percent * (size[i + k] + size[i + others] - shared)]
                    left.append(np.full(len(others), k))
                    right.append(others)
                a, b = np.concatenate(left), np.concatenate(right)
                if len(a):
                    reach = local_roots(j - i, a, b)
                    moved = np.flatnonzero(reach != np.arange(j - i))
                    ends_a.append(node[i + moved])
                    ends_b.append(node[i + reach[moved]])
            columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (ends_a, ends_b)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b"]), rows.slice(bounds[-1])

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= HELD_BYTES:
                found, rest = of(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                yield found
        if held:
            yield of(pa.Table.from_batches(held), True)[0]

    return compare


_SKETCH = "doc_id long, n_shingles long, key string, regs binary, bands array<long>"


class _Search:
    """The steps of one search for links, over stored tables."""

    def __init__(self, scratch: Scratch, docs: DataFrame, words: int, percent: int):
        self.scratch, self.docs, self.words, self.percent = scratch, docs, words, percent
        self.n = shuffle_partitions(scratch.spark)
        self.rows = scratch.table(docs.select("doc_id", "text").mapInArrow(_sketch_rows(words), _SKETCH), "rows")
        reps = self.rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
        self.reps = scratch.table(reps.withColumn("node", F.monotonically_increasing_id()), "reps")

    def candidates(self) -> DataFrame:
        """Members of bands' groups of two or more: band, node, the group's smallest node, and whether pairs are sought inside it at once, or later (``hot``)."""
        spread, found = self.reps.select("node", F.explode("bands").alias("band")), None
        for level in range(LEVELS + 1):
            groups = spread.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
            groups = self.scratch.table(groups, "groups")
            inside = (F.col("n") <= HOT) | F.lit(level == LEVELS)
            members = self.scratch.table(spread.join(groups, "band").select("band", "node", "leader", inside.alias("inside"), (~inside & F.lit(level == 0)).alias("hot")), "members")
            found = members if found is None else found.unionByName(members)
            if level == LEVELS or groups.where(F.col("n") > HOT).isEmpty():
                return found
            hot = members.where("not inside").join(self.reps.select("node", "regs"), "node").select("node", "band", "regs")
            spread = self.scratch.table(hot.mapInArrow(_finer_rows(level), "node long, band long"), "finer")
        raise AssertionError("unreachable")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs that pass the estimate."""
        for side in ("a", "b"):
            about = self.reps.select(F.col("node").alias(side), F.col("regs").alias(f"regs_{side}"), F.col("n_shingles").alias(f"n_{side}"))
            pairs = pairs.join(about, side)
        return self.scratch.table(pairs.mapInArrow(_estimated(self.percent), "a long, b long"), "likely")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """The full set of each node."""
        wanted = self.scratch.table(self.reps.select("node", "doc_id", "key").join(nodes, "node", "left_semi"), "wanted")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        texts = self.docs.select(F.col("doc_id").alias("id"), "text").join(side, F.col("id").eqNullSafe(F.col("doc_id"))).select("node", "key", "text")
        return self.scratch.table(texts.mapInArrow(_set_rows(self.words), "node long, members binary"), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs confirmed on the full sets of both texts."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        for side in ("b", "a"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("members").alias(f"members_{side}")), side)
        found = self.scratch.table(pairs.mapInArrow(_confirmed(self.percent), "a long, b long"), "links")
        self.scratch.drop(sets)
        return found

    def _blocks(self, members: DataFrame, key: str, size: int) -> DataFrame:
        """Members of groups of several roots dealt to pairs of blocks: columns key, node, root, block, low, high.

        ``members`` has key, node, root and weight; a block weighs about ``size``.
        Blocks below 0 hold the heaviest root of a group, which meets the other
        blocks only; those from 0 hold the rest, and meet all.
        """
        roots = self.scratch.table(members.groupBy(key, "root").agg(F.sum("weight").alias("weight")), "weights")
        groups = roots.groupBy(key).agg(F.max(F.struct("weight", "root")).alias("m"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        count = lambda weight: F.ceil(weight / size).cast("int")
        groups = groups.select(key, F.col("m.root").alias("major"), count(F.col("m.weight")).alias("majors"), count(F.col("all") - F.col("m.weight")).alias("minors"))
        dealt = members.join(self.scratch.table(groups, "mixed"), key)
        is_major = F.col("root") == F.col("major")
        block = F.when(is_major, F.pmod(F.hash("node"), F.col("majors")) - F.col("majors")).otherwise(F.pmod(F.hash("node"), F.col("minors")))
        others = F.sequence(F.when(is_major, 0).otherwise(-F.col("majors")), F.col("minors") - 1)
        dealt = dealt.withColumn("block", block).withColumn("other", F.explode(others))
        return dealt.select(key, "node", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def _compared(self, dealt: DataFrame, key: str, exact: bool) -> DataFrame:
        dealt = dealt.repartition(self.n, key, "low", "high").sortWithinPartitions(key, "low", "high", "node")
        return self.scratch.table(dealt.mapInArrow(_across(key, self.percent, exact), "a long, b long"), "across")

    def across(self, members: DataFrame, roots: DataFrame, block: int) -> DataFrame:
        """Links between components of the members' groups, confirmed on full sets."""
        about = self.reps.select("node", "n_shingles", "regs")
        roots = roots.select(F.col("id").alias("node"), "root")
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = self.scratch.table(placed.select("band", "node", "root", F.lit(1).alias("weight")), "placed")
        likely = self._compared(self._blocks(placed, "band", block).join(about, "node"), "band", False)
        family = components(self.scratch, likely)
        family = family.select(F.col("id").alias("node"), F.col("root").alias("family")).union(family.select("root", "root").distinct())
        family = self.scratch.table(family, "families")
        grouped = family.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        grouped = grouped.join(about.select("node", (8 * F.col("n_shingles")).alias("weight")), "node")
        grouped = self.scratch.table(grouped.select("family", "node", "root", "weight"), "grouped")
        sets = self.sets(family.select("node"))
        found = self._compared(self._blocks(grouped, "family", SET_BYTES).join(about, "node").join(sets, "node"), "family", True)
        self.scratch.drop(sets)
        return found


def _linked(scratch: Scratch, docs: DataFrame, words: int, percent: int) -> tuple[_Search, DataFrame]:
    """The search, and a stored row per set: key, node, doc_id (the smallest), root of its component."""
    search = _Search(scratch, docs, words, percent)
    members = search.candidates()
    first = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = search.links(search.likely(first))
    roots = components(scratch, links)
    for part, block in (("inside", BLOCK), ("hot", HOT_BLOCK)):  # finer groups lie within hot ones, which then have fewer components
        groups = members.where(part)
        if part == "hot" and groups.isEmpty():
            break
        more = search.across(groups, roots, block)
        if not more.isEmpty():
            roots = components(scratch, roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    nodes = search.reps.select("key", "node", "doc_id").join(roots.select(F.col("id").alias("node"), "root"), "node", "left")
    return search, scratch.table(nodes.withColumn("root", F.coalesce("root", "node")), "nodes")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 times the intersection of their sets is at least
    ``percent`` times the union.
    """
    with Scratch(spark, "hyperminhash") as scratch:
        search, nodes = _linked(scratch, docs, words, percent)
        smallest = scratch.table(nodes.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
        known = scratch.table(nodes.join(smallest, "root").select("key", "component_id"), "known")
        rows = search.rows.select("doc_id", "n_shingles", "key")
        linked = rows.where("key is not null").join(known, "key").select("doc_id", "n_shingles", "component_id")
        alone = rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        out = linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return scratch.keep(out)


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows and columns, exactly one row of each component, and all rows with an empty set.

    The row of the smallest id stays, one without id only if no row has one.
    Rows whose id is null or repeated are numbered and stored, and decided by number.
    """
    number = "number"
    while number in docs.columns:
        number += "_"
    with Scratch(spark, "hyperminhash") as scratch:
        search, nodes = _linked(scratch, docs, words, percent)
        repeated = search.rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
        repeated = scratch.table(repeated, "repeated")
        unsure = docs.where("doc_id is null").unionByName(docs.join(repeated, "doc_id", "left_semi").select(*columns(docs)))
        unsure = scratch.keep(unsure.withColumn(number, F.monotonically_increasing_id()), "unsure")
        again = unsure.select(F.col(number).alias("doc_id"), "text").mapInArrow(_sketch_rows(words), _SKETCH).select(F.col("doc_id").alias("number"), "key")
        again = again.where("key is not null").join(unsure.select(F.col(number).alias("number"), "doc_id"), "number")
        once = search.rows.where("doc_id is not null and key is not null").join(repeated, "doc_id", "left_anti")
        rows = once.select("doc_id", F.lit(-1).cast("long").alias("number"), "key").unionByName(again)
        rows = scratch.table(rows.join(nodes.select("key", "root"), "key").select("root", "doc_id", "number"), "placed-rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")).alias("first")
        stay = scratch.table(rows.groupBy("root").agg(first).select("first.doc_id", "first.number"), "stay")
        gone = rows.where("number < 0").select("doc_id").join(stay.where("number < 0"), "doc_id", "left_anti")
        gone = scratch.keep(gone.unionByName(repeated), "gone")
        gone_numbers = scratch.keep(rows.where("number >= 0").select("number").join(stay, "number", "left_anti").withColumnRenamed("number", number), "gone-numbers")
    sure = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    return sure.select(*columns(docs)).unionByName(unsure.join(gone_numbers, number, "left_anti").select(*columns(docs)))
