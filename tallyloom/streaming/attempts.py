"""The state of every day of an import, kept over a stream of attempts.

An attempt says how importing a revision of a day ended.  A day is ``to do``
until a revision was tried, ``failed`` while all that were tried were rejected,
``imported`` once one was taken in, and ``revised`` when another followed.  Of
several attempts at a revision the one that finished last counts (an import
before a rejection, if they finished together), so that repeated, late and
reordered attempts lead to the same state.

``states`` answers for a table of attempts; ``state_updates`` keeps one state
machine a day over a stream and tells a day's new state whenever it changes;
``compacted`` is the manifest, one row a day, from such updates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyloom.session import ship_code

ATTEMPT = "d date, revision long, outcome string, error string, finished_at long"
STATE = "d date, status string, revision long, rejected array<long>, attempts long"
LISTED, IMPORTED, REJECTED = "listed", "imported", "rejected"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def states(attempts: DataFrame) -> DataFrame:
    """The state of each day by all attempts: d, status, revision (the import that stands), rejected, attempts (revisions tried).

    A row of outcome LISTED only makes a day known.  A null day or revision is no attempt.
    """
    known = attempts.where("d is not null")
    rank = F.struct("finished_at", (F.col("outcome") == IMPORTED).alias("taken"))
    tried = known.where(F.col("revision").isNotNull() & F.col("outcome").isin(IMPORTED, REJECTED)).groupBy("d", "revision").agg(F.max_by(F.struct("outcome", "finished_at"), rank).alias("last"))
    taken = F.col("last.outcome") == IMPORTED
    days = tried.groupBy("d").agg(
        F.count_if(taken).alias("taken"), F.max(F.when(taken, F.struct("last.finished_at", "revision"))).alias("stands"),
        F.array_sort(F.collect_list(F.when(~taken, F.col("revision")))).alias("rejected"), F.count(F.lit(1)).alias("attempts"),
    )
    rows = known.select("d").distinct().join(days, "d", "left")
    status = F.when(F.col("taken") > 1, "revised").when(F.col("taken") == 1, "imported").when(F.col("attempts") > 0, "failed").otherwise("to do")
    return rows.select("d", status.alias("status"), F.col("stands.revision").alias("revision"), F.coalesce("rejected", F.array().cast("array<long>")).alias("rejected"), F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"))


class Day(StatefulProcessor):
    """A day's machine: the last attempt at each revision."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getMapState("last", "revision long", "taken boolean, finished_at long")
        self._told = handle.getValueState("told", "version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[int, bool]] = {}  # messages to the state are for what the rows come to, not for rows
        for batch in rows:
            batch = batch[batch.outcome.isin([IMPORTED, REJECTED]) & batch.revision.notna()]
            ranks = 2 * batch.finished_at.fillna(-1).astype("int64") + (batch.outcome == IMPORTED)
            for revision, rank in ranks.groupby(batch.revision.astype("int64")).max().items():
                found = (int(rank) // 2, bool(rank % 2))
                best[int(revision)] = max(found, best.get(int(revision), found))
        version = self._told.get()
        changed = version is None
        last = {k[0]: (v[1], v[0]) for k, v in self._last.iterator()}
        for revision, found in best.items():
            if revision not in last or found > last[revision]:
                last[revision] = found
                self._last.updateValue((revision,), (found[1], found[0]))
                changed = True
        if not changed:
            return
        version = (version[0] if version else 0) + 1
        self._told.update((version,))
        taken = sorted((finished, r) for r, (finished, ok) in last.items() if ok)
        status = "revised" if len(taken) > 1 else "imported" if taken else "failed" if last else "to do"
        rejected = sorted(r for r, (_, ok) in last.items() if not ok)
        yield pd.DataFrame({"d": [key[0]], "status": [status], "revision": pd.array([taken[-1][1] if taken else None], "Int64"), "rejected": [rejected], "attempts": [len(last)], "version": [version]})

    def close(self) -> None:
        pass


def state_updates(attempts: DataFrame) -> DataFrame:
    """A day's state, with a rising ``version``, whenever attempts of a stream change it (update mode)."""
    spark = attempts.sparkSession
    ship_code(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = attempts.where("d is not null")
    return known.groupBy("d").transformWithStateInPandas(Day(), f"{STATE}, version long", "Update", "None")


def keep_manifest(updates: DataFrame, path: str, checkpoint: str):
    """A query that appends the updates of every batch below ``path``; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def compacted(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: each day's newest state."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    state = [c.split()[0] for c in STATE.split(", ")][1:]
    return rows.groupBy("d").agg(F.max_by(F.struct(*state), "version").alias("s")).select("d", "s.*")
