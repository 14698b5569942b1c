"""Exact deduplication behind a two-pass Bloom filter.

Pass one hashes every normalised text and marks HASHES positions of a bit table;
tasks send positions, four bytes each, and the blocks of the table are merged
apart, keeping those positions that more than one row takes.  Pass two looks
every hash up: one with a position that no other row takes cannot repeat, so its
row passes straight through; only the rest shuffle, and an exact grouping of full
SHA-256 digests decides about them.  A false positive therefore costs a shuffled
row and never a wrong result.  Up to some 30 million rows the table has 16 bits a
row and about one unrepeated row in 400 shuffles; as the table ends at MAX_BITS,
that share rises beyond, and past some 500 million rows most rows shuffle.

Defined cases: a null text counts as empty; texts without any other character
than white space are equal to the empty text; ties on length go to the smallest
``doc_id`` (a null id after all others); repeated rows are rows of their own
and one of them stays only if it carries the winning id; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.tables import columns, map_rows

WHITE = b" \t\n\x0b\x0c\r"
#: Positions of a hash in the table.
HASHES = 4
#: A Bloom table never exceeds this many bits (64 MB), whatever the input.
MAX_BITS = 1 << 29
LEAST_BITS, BITS_PER_ROW = 1 << 16, 16
#: Most bits of one block of the table, the unit in which positions are gathered and merged.
BLOCK_BITS = 1 << 22

_HASHED = "doc_id long, n_chars long, text_sha256 string"


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), _digests(batch)],
            ["doc_id", "n_chars", "text_sha256"],
        )


def bloom_bits(n_rows: int) -> int:
    """Table size: a power of two near 16 bits a row, at most MAX_BITS."""
    bits = LEAST_BITS
    while bits < BITS_PER_ROW * n_rows and bits < MAX_BITS:
        bits *= 2
    return bits


def block_bits(bits: int) -> int:
    return min(bits // 16, BLOCK_BITS)


def _positions(digests: pa.Array, bits: int) -> np.ndarray:
    """A row of HASHES positions per digest, each from eight bytes of its own."""
    joined = "".join(x[: 16 * HASHES] for x in digests.to_pylist())
    return np.frombuffer(bytes.fromhex(joined), ">u8").astype(np.int64).reshape(-1, HASHES) & (bits - 1)


def _marks(bits: int):
    """Positions that rows take, by block of the table: all of them, and those that are taken twice here."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = block_bits(bits)
        for batch in batches:
            pos, taken = np.unique(_positions(batch.column("text_sha256"), bits), return_counts=True)
            if not len(pos):
                continue
            cuts = np.flatnonzero(np.diff(pos // size)) + 1
            once = np.split((pos % size).astype("<u4"), cuts)
            twice = [p[t > 1] for p, t in zip(once, np.split(taken, cuts), strict=True)]
            blocks = pos[np.concatenate(([0], cuts))] // size
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array([p.tobytes() for p in once], pa.binary()), pa.array([p.tobytes() for p in twice], pa.binary())],
                ["block", "once", "again"],
            )

    return mark


def _merge_blocks(bits: int):
    """Of one block, the bit table of positions that more than one row takes."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = (np.zeros(block_bits(bits), bool) for _ in range(2))
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("again"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4")
                again[a[once[a]]] = True
                again[b] = True
                once[a] = True
        if again.any():
            table = np.packbits(again, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([table], pa.binary())], ["block", "again"])

    return merge


def _is_marked(table: np.ndarray, digests: pa.Array, bits: int) -> np.ndarray:
    """Whether all positions of a digest are taken more than once."""
    pos = _positions(digests, bits)
    return ((table[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).all(axis=1)


_MARKS = "block long, once binary, again binary"


def repeated_positions(hashed: DataFrame, bits: int) -> np.ndarray:
    """The bit table of positions that more than one row takes (at most MAX_BITS bits)."""
    return _collected(hashed.select("text_sha256").mapInArrow(_marks(bits), _MARKS), bits)


def _collected(marks: DataFrame, bits: int) -> np.ndarray:
    merged = marks.groupBy("block").applyInArrow(_merge_blocks(bits), "block long, again binary")
    table = np.zeros(bits // 8, np.uint8)
    width = block_bits(bits) // 8
    for row in merged.toLocalIterator():  # one row a block of the fixed-size table
        table[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(bytes(row["again"]), np.uint8)
    return table


def _mark(shared, bits: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            yield batch.append_column("maybe", pa.array(_is_marked(table, batch.column("text_sha256"), bits)))

    return mark


def _fresh_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores in front until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def _digests(batch: pa.RecordBatch) -> pa.Array:
    texts = batch.column("text").to_pylist()
    return pa.array([hashlib.sha256((t or "").encode().translate(None, WHITE)).hexdigest() for t in texts], pa.string())


def _marks_of_texts(bits: int):
    mark = _marks(bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return mark(pa.RecordBatch.from_arrays([_digests(b)], ["text_sha256"]) for b in batches)

    return of


def _branch(shared, bits: int, repeated: bool, names: list[str]):
    """Rows whose hash may repeat, with digest and length; or those whose hash can't."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            digests = _digests(batch)
            hit = _is_marked(table, digests, bits)
            if repeated:
                n = pa.array([len(t or "") for t in batch.column("text").to_pylist()], pa.int64())
                batch = pa.RecordBatch.from_arrays([*batch.columns, digests, n], [*batch.schema.names, *names])
            yield batch.filter(pa.array(hit == repeated))

    return pick


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The input's rows and columns, one of each group of equal texts.

    Rows that can't repeat never shuffle; of the others each task keeps its best
    per digest before the shuffle, so a group of any size sends a row a task.
    """
    bits = bloom_bits(docs.count())
    shared = spark.sparkContext.broadcast(_collected(docs.select("text").mapInArrow(_marks_of_texts(bits), _MARKS), bits))
    digest, length = _fresh_names(docs.columns, "digest", "length")
    through = map_rows(docs, _branch(shared, bits, False, []))
    maybe = map_rows(docs, _branch(shared, bits, True, [digest, length]), [StructField(digest, StringType()), StructField(length, LongType())])
    order = F.struct(F.col(length), F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"))  # falls as the id grows, without overflow
    best = maybe.groupBy(digest).agg(F.max_by(F.struct(*columns(docs)), order).alias("row")).select("row.*")
    return through.unionByName(best)


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` is true for the row whose doc_id is ``keep_id``; of rows that agree
    in text, length and doc_id all carry the same values.
    """
    with Scratch(spark, "exact_dedup") as scratch:
        hashed = scratch.table(docs.select("doc_id", "text").mapInArrow(_hash_rows, _HASHED), "hashed")
        bits = bloom_bits(hashed.count())
        shared = spark.sparkContext.broadcast(repeated_positions(hashed, bits))
        marked = scratch.table(hashed.mapInArrow(_mark(shared, bits), _HASHED + ", maybe boolean"), "marked")
        single = marked.where(~F.col("maybe"))
        maybe = marked.where("maybe")
        # Longest first, then smallest id: partial maxima are combined before the shuffle.
        best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("falling")))
        groups = maybe.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        groups = scratch.table(groups.select("text_sha256", F.bitwise_not("best.falling").alias("keep_id"), "group_size").where("group_size > 1"), "groups")
        joined = maybe.join(groups, "text_sha256", "left")
        decided = joined.select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            "text_sha256",
        )
        through = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
        out = through.unionByName(decided).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        return scratch.keep(out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
