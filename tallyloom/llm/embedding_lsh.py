"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Vectors are normalised; in each of a number of tables, WIDTH-wide steps along
random directions name a bucket.  Each direction keeps two vectors at cosine 0.98
together with probability NEAR, and two unrelated ones with probability FAR.  The
number of directions follows the number of vectors, so that a vector's chance
company in a bucket stays the same however many there are, and the number of
tables follows the directions, so that a pair at cosine 0.98 misses all of them
in about MISS cases.  The tables so grow as the vectors to the power 0.12.

Within a bucket every pair's cosine is computed exactly, in blocks of
at most about BLOCK rows a side that go to tasks of their own; a pair counts in
the first table where it meets.  No pair leaves its task: what leaves it is each
vector's number of links and the root of its local component.  Vectors travel in
single precision where that is exact, with the buckets of earlier tables only.

Equal vectors are represented once, with their number.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
number, and vectors without a label, link with nothing; vectors of different
length never link; a null id counts as a link but is never the smallest; of
repeated rows each counts as a vector, and ``kept`` holds for all that carry the
component's id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from tallyloom.llm.components import components, local_roots
from tallyloom.llm.scratch import Scratch, shuffle_partitions

THRESHOLD = 0.98
WIDTH, NEAR, FAR, MISS = 1.5, 0.8936, 0.387, 7e-6
#: So many directions for so many vectors, one more for each 1 / FAR times as many.
DIRECTIONS, VECTORS = 12, 50_000
BLOCK = 512
#: Bytes of rows that a task holds at a time, besides those of one group.
HELD_BYTES = 8_000_000
SEED = 41


def _vector(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def shape_for(n: int) -> tuple[int, int]:
    """Numbers of tables and of directions a table for n different vectors."""
    directions = max(6, math.ceil(DIRECTIONS + math.log(max(n, 1) / VECTORS) / -math.log(FAR)))
    return math.ceil(math.log(MISS) / math.log1p(-(NEAR**directions))), directions


def _stored(x: np.ndarray) -> bytes:
    """A vector in single precision where that is exact; the first byte says which."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return b"s" + single.tobytes() if (single == x).all() else b"d" + x.astype("<f8").tobytes()


def _loaded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[:1] == b"s" else "<f8", offset=1).astype(np.float64)


def _valid_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the key of its vector, null where it can't link."""
    for batch in batches:
        keys, vectors = [], []
        for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            x = None if label is None else _vector(values)
            keys.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest())
            vectors.append(None if x is None else _stored(x))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.string()), pa.array(vectors, pa.binary())], ["vec_id", "label", "key", "vector"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _normalised(vectors: list[bytes]) -> np.ndarray:
    x = np.array([_loaded(v) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Random directions and shifts by length of vector."""

    def __init__(self, tables: int, directions: int):
        self.tables, self.directions = tables, directions
        self._made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def buckets(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """A 64-bit bucket per row and table; label and length are part of it."""
        n, d = x.shape
        if d not in self._made:
            rng = np.random.default_rng([SEED, d])
            size = self.tables * self.directions
            self._made[d] = rng.standard_normal((d, size)), rng.uniform(0, WIDTH, size)
        directions, shifts = self._made[d]
        steps = np.floor((x @ directions + shifts) / WIDTH).astype(np.int64).astype(np.uint64).reshape(n, self.tables, self.directions)
        h = _mix(labels.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))[:, None] + _mix(np.arange(1, self.tables + 1, dtype=np.uint64))
        for j in range(self.directions):
            h = _mix(h * np.uint64(0xD1342543DE82EF95) + steps[:, :, j])
        return h.astype(np.int64)


def _bucket_rows(shape: tuple[int, int]):
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(*shape)
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            out: list = [None] * len(vectors)
            for size in sorted({(v[:1], len(v)) for v in vectors}):
                rows = [i for i, v in enumerate(vectors) if (v[:1], len(v)) == size]
                for i, b in zip(rows, tables.buckets(_normalised([vectors[i] for i in rows]), labels[rows]), strict=True):
                    out[i] = b
            flat = np.concatenate(out) if out else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * shape[0], pa.int32()), pa.array(flat, pa.int64()))
            yield batch.append_column("buckets", lists)

    return bucket


def _links_of_group(table: int, nodes: np.ndarray, sides: np.ndarray, two: bool, mult: np.ndarray, x: np.ndarray, earlier: np.ndarray):
    """Nodes with links in this group, their numbers of links, and local roots; ``earlier`` has the buckets of the tables before."""
    cosines = x @ x.T
    a, b = np.nonzero(np.triu(cosines >= THRESHOLD, 1))
    if two:
        across = sides[a] != sides[b]
        a, b = a[across], b[across]
    if table and len(a):
        new = np.ones(len(a), bool)
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            new[part] = ~(earlier[a[part]] == earlier[b[part]]).any(axis=1)
        a, b = a[new], b[new]
    if not len(a):
        return None
    n = len(nodes)
    links = np.bincount(a, mult[b], n) + np.bincount(b, mult[a], n)
    own = np.flatnonzero(links)
    return nodes[own], links[own].astype(np.int64), nodes[local_roots(n, a, b)[own]]


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and pair of blocks; one group at a time."""
    held: list[pa.RecordBatch] = []

    def groups(rows: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
        keys = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        bounds = [0, *change.tolist(), rows.num_rows]
        if not last:
            bounds.pop()
        nodes, mult, table, side = (rows.column(c).to_numpy() for c in ("node", "mult", "table", "block"))
        vectors, lists = rows.column("vector"), rows.column("earlier").combine_chunks()
        flat = lists.flatten().to_numpy()
        starts = np.concatenate(([0], np.cumsum(table)))
        found = []
        for i, j in zip(bounds, bounds[1:], strict=False):
            if j - i < 2:
                continue
            x = _normalised(vectors[i:j].to_pylist())
            earlier = flat[starts[i] : starts[j]].reshape(j - i, int(table[i]))
            if (got := _links_of_group(int(table[i]), nodes[i:j], side[i:j], bool(keys[1][i] != keys[2][i]), mult[i:j], x, earlier)) is not None:
                found.append(got)
        return found, None if last else rows.slice(bounds[-1])

    def batch_of(found: list) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= HELD_BYTES:
            found, rest = groups(pa.Table.from_batches(held), False)
            held = rest.to_batches()
            yield batch_of(found)
    if held:
        yield batch_of(groups(pa.Table.from_batches(held), True)[0])


def label_code(vectors: DataFrame) -> Column:
    """A whole number per label: itself if it is one, else 64 bits of its hash; labels of any type stay apart."""
    kind, label = vectors.schema["label"].dataType, F.col("label")
    if isinstance(kind, IntegralType):
        return label.cast("long")
    if isinstance(kind, FractionalType):
        label = label + F.lit(0)  # one zero, not two
    return F.when(label.isNotNull(), F.xxhash64(label))


def near_duplicates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    with Scratch(spark, "embedding_lsh") as scratch:
        n = shuffle_partitions(spark)
        rows = vectors.select("vec_id", label_code(vectors).alias("label"), "embedding")
        rows = scratch.table(rows.mapInArrow(_valid_rows, "vec_id long, label long, key string, vector binary"), "rows")
        able = rows.where("key is not null")
        reps = able.groupBy("label", "key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("mult"), F.first("vector").alias("vector"))
        reps = reps.withColumn("node", F.monotonically_increasing_id())
        reps = scratch.table(reps, "different")
        shape = shape_for(reps.count())
        reps = scratch.table(reps.mapInArrow(_bucket_rows(shape), "label long, key string, vec_id long, mult long, vector binary, node long, buckets array<long>"), "reps")
        spread = reps.select("node", F.posexplode("buckets").alias("table", "bucket"))
        shared = scratch.table(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
        members = scratch.table(spread.join(shared, "bucket"), "members")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = members.withColumn("block", F.pmod(F.hash("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("bucket", "table", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        full = dealt.join(reps.select("node", "mult", "vector", "buckets"), "node")
        full = full.withColumn("earlier", F.slice("buckets", 1, F.col("table"))).drop("buckets")
        full = full.repartition(n, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
        found = scratch.table(full.mapInArrow(_compare_blocks, "node long, links long, root long"), "found")
        roots = components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        nodes = reps.select("node", "label", "key", "vec_id", "mult").join(links, "node", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
        nodes = scratch.table(nodes.withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("mult") - 1), "nodes")
        smallest = scratch.table(nodes.groupBy("root").agg(F.min("vec_id").alias("component_id")), "smallest")
        known = scratch.table(nodes.join(smallest, "root").select("label", "key", "links", "component_id"), "known")
        linked = able.join(known, ["label", "key"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
        alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
        return scratch.keep(out)
