"""Connected components of an undirected graph, as tables from start to end.

Alternating large-star and small-star steps: every step hangs the larger
neighbours of a node on its smallest neighbour, then the smaller ones, until
each component is a star around its smallest node.  Minima are combined before
they shuffle, and the joins read stored tables on both sides, so that adaptive
execution can split the partition of a node with very many neighbours.

The steps shrink the graph; as soon as at most LAST_EDGES edges are left (some
megabytes, and counted), one task finishes them, which saves the last rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch

LAST_EDGES = 500_000


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable over the pairs, by row."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        # A root that hangs on a smaller one takes all of its own along.
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if ends:
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
        hangs = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[hangs]), pa.array(nodes[root[hangs]])], ["id", "root"])


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and none that hangs holds others."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    roles = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return roles.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Rows of (id, root) for every node that has an edge and isn't its component's smallest.

    ``edges`` has long columns a and b, in any order and repeated or not.
    """
    oriented = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = scratch.table(oriented, "edges")
    while now.count() > LAST_EDGES:
        if _is_stars(now):
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        # Large star: the larger neighbours of u go to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        up = now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        large = up.join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = scratch.table(large.distinct(), "large")
        # Small star: u and its smaller neighbours go to the smallest of these.
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = scratch.table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return scratch.table(now.repartition(1).mapInArrow(_finish, "id long, root long"), "roots")  # at most LAST_EDGES rows
