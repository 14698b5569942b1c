"""The trie of conversations' prefixes.

A node is a distinct sequence of first turns (role and text); the conversations
that begin with it are its members, and its smallest member stands for it.

* Every turn's prefix gets a fingerprint, a polynomial in the turns' hashes
  modulo two primes: running sums that numpy scans over sorted turns
  (``running``).  Depth and fingerprint name a group of prefixes.
* Each group is verified turn by turn: members must have the turn, and the
  fingerprint before it, of the representative.  Equal turns meet in the tasks
  that read them, so a group of any size sends one row a task.  By induction
  over the depth, groups that pass are exact nodes.  Members that differ are
  split off with all their longer prefixes, and everything is verified again
  until no group differs.
* The roll-up to parents needs no join a level.  A conversation stands for the
  nodes of one end of its own path, its chain.  Within a chain sums run from the
  end; a chain's total goes to all earlier nodes of that path, one sum by node
  over the members that pass through it.

Work and memory grow with the turns: a conversation of any length is spread over
tasks, a node of any number of members is added up before it shuffles, and the
ids that end at a node are hashed as a stream of joined blocks.

Defined cases: null role or text counts as empty; turns sort by number (null
first), then role and text, and repeated rows are turns of their own; rows
without a conversation id belong to no conversation and are left out; a
conversation without turns is a member of the root; an empty table gives an
empty result.  Turns of one conversation with one and the same number are sorted
by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.running import running
from tallyloom.llm.scratch import Scratch, shuffle_partitions

#: Moduli (the largest primes of 31 bits) and bases of the fingerprint.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_003)
#: Characters of a block of joined ids.
BLOCK = 1 << 16


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of nodes to comma-joined blocks, with each block's first id."""
    now, first, ids, size = None, None, [], 0
    out: list[tuple] = []

    def block() -> None:
        if ids:
            out.append((*now, first, ",".join(ids)))

    for batch in batches:
        for depth, f, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "f", "conv_id")), strict=True):
            if (depth, f) != now or size > BLOCK:
                block()
                now, first, ids, size = (depth, f), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield _rows(out, ("depth", "f", "first", "ids"))
            out.clear()
    block()
    if out:
        yield _rows(out, ("depth", "f", "first", "ids"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for depth, f, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "f", "ids")), strict=True):
            if (depth, f) == now:
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = (depth, f), hashlib.sha256(ids.encode())
        if out:
            yield _rows(out, ("depth", "f", "ends"))
            out.clear()
    if now is not None:
        yield _rows([(*now, state.hexdigest())], ("depth", "f", "ends"))


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows, strict=True)], list(names))


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's ids (``depth, f, conv_id``), ascending and joined by commas."""
    n = shuffle_partitions(ends.sparkSession)
    joined = ends.repartitionByRange(n, "depth", "f", "conv_id").sortWithinPartitions("depth", "f", "conv_id").mapInArrow(_blocks, "depth long, f long, first long, ids string")
    return joined.repartition(n, "depth", "f").sortWithinPartitions("depth", "f", "first").mapInArrow(_digests, "depth long, f long, ends string")


def prefixes(scratch: Scratch, turns: DataFrame, conversations: DataFrame, bits: int = 62) -> DataFrame:
    """Every prefix of every conversation: conv_id, depth, its last turn, and fingerprints with (``f``) and without (``before``) it.

    The textless prefix of depth 0 is one of them.  ``bits`` narrows the
    fingerprints, for tests.
    """
    last = turns.where("conv_id is not null").select("conv_id", F.lit(1).alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    rows = last.unionByName(conversations.where("conv_id is not null").select("conv_id", F.lit(0).alias("kind"), *none))
    digest = F.when(F.col("kind") == 1, F.xxhash64("role", "text")).otherwise(0)
    rows = rows.withColumns({f"h{k}": F.pmod(digest, F.lit(p)) for k, p in enumerate(PRIMES)})
    sums = {f"h{k}": (b, p) for k, (b, p) in enumerate(zip(BASES, PRIMES, strict=True))}
    found = running(scratch, rows, "conv_id", ["kind", "turn", "role", "text"], ["kind", "turn"], sums, "prefixes")
    whole = lambda end: (F.col(f"h0{end}") * (1 << 31) + F.col(f"h1{end}")).bitwiseAND((1 << bits) - 1)
    return found.select("conv_id", F.col("at").alias("depth"), whole("").alias("f"), whole("_before").alias("before"), "role", "text")


def verified(scratch: Scratch, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes whose groups (depth, f) are exact nodes, and the nodes: depth, f, before, conv_id, n_convs, n_chars of the last text."""
    turn = ["role", "text"]
    for step in count():
        kinds = found.groupBy("depth", "f", "before", *turn).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        kinds = scratch.table(kinds, "kinds")
        mixed = scratch.table(kinds.groupBy("depth", "f").agg(F.min("conv_id").alias("stands"), F.count(F.lit(1)).alias("n")).where("n > 1"), "mixed")
        if mixed.isEmpty():
            return found, kinds.select("depth", "f", "before", "conv_id", "n_convs", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
        # Members unlike their group's representative, with a number that their true prefix decides.
        unlike = kinds.join(mixed, ["depth", "f"]).where("conv_id <> stands").withColumn("salt", F.xxhash64(F.lit(step), "depth", "f", "before", *turn))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("depth", "f", "before", *turn)]
        marks = found.alias("a").join(unlike.alias("b"), same).groupBy("a.conv_id").agg(F.collect_list(F.struct(F.col("a.depth").alias("from"), "b.salt")).alias("marks"))
        salted = found.join(marks, "conv_id", "left")

        def split(c: str, depth, marked=salted):
            own = F.filter("marks", lambda m: m["from"] <= depth)
            return F.coalesce(F.aggregate(own, F.col(c), lambda x, m: x.bitwiseXOR(m["salt"])), F.col(c))

        salted = salted.select("conv_id", "depth", split("f", F.col("depth")).alias("f"), split("before", F.col("depth") - 1).alias("before"), *turn)
        found = scratch.table(salted, "split")


def trie(spark: SparkSession, turns: DataFrame, conversations: DataFrame | None = None, bits: int = 62) -> DataFrame:
    """The trie of ``turns`` (conv_id, turn, role, text), one row a node.

    ``conversations`` lists all ids once where some may have no turns.  Columns:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, what storing each node once saves
    in characters), ends_sha256 (the members that end there).
    """
    with Scratch(spark, "prefix_trie") as scratch:
        ids = turns.select("conv_id").distinct() if conversations is None else conversations
        found, nodes = verified(scratch, prefixes(scratch, turns, ids, bits))
        children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("f")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = nodes.join(children, ["depth", "f"], "left").na.fill(0, ["n_children"])
        nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_chars"), "up": -F.col("depth")})
        nodes = scratch.table(nodes, "nodes")
        # Chains: sums from the end, and each chain's total for the nodes before it.
        plain = (1, None)
        chained = running(scratch, nodes, "conv_id", ["up"], ["up"], {"leaves": plain, "saved": plain}, "chains")
        totals = nodes.groupBy("conv_id").agg(F.min("depth").alias("start"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        passing = found.select("conv_id", "depth", "f").join(totals, "conv_id").where("depth < start").groupBy("depth", "f").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        last = found.groupBy("conv_id").agg(F.max(F.struct("depth", "f")).alias("last")).select("conv_id", "last.*")
        ends = ends_digests(last)
        node = ["before", "conv_id", "n_convs", "n_children"]
        parts = chained.select("depth", "f", *node, "leaves", "saved").unionByName(passing, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
        sums = parts.groupBy("depth", "f").agg(*(F.max(c).alias(c) for c in (*node, "ends")), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("before"), F.col("conv_id").alias("parent_conv_id"))
        made = sums.join(parents, ["depth", "before"], "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
        )
        return scratch.keep(made)


def rebuilt_trie(spark: SparkSession, turns: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """The trie after every conversation takes over its family's first turns.

    The first h turns of conversation c come from the first of its family
    (c - c % family), with h = crc32 of c in decimal, modulo ``heads``; its own
    follow from turn h on.
    """
    with Scratch(spark, "prefix_trie-rebuilt") as scratch:
        turn = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
        own = turns.where("conv_id is not null").select("conv_id", "turn", *turn)
        placed = running(scratch, own, "conv_id", ["turn", "role", "text"], ["turn"], {}, "turns")
        base = F.col("conv_id") - F.col("conv_id") % family
        placed = placed.withColumns({"turn": F.col("at"), "base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads})
        ids = placed.where("at = 0")
        firsts = placed.where((F.col("conv_id") == F.col("base")) & (F.col("at") < heads - 1)).select("base", "turn", "role", "text")
        taken = ids.where("conv_id <> base").select("conv_id", "base", "h").join(firsts, "base").where("turn < h")
        columns = ["conv_id", "turn", "role", "text"]
        rows = placed.where("at >= h or conv_id = base").select(*columns).unionByName(taken.select(*columns))
        return trie(spark, rows, ids.select("conv_id"))
