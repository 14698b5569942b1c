"""Running sums over the rows of a key in order, however many rows a key has.

Rows are sorted by range over all tasks, so one key's rows may lie in several;
each task sums its own run in numpy, batch by batch.  What the runs before a
task's first one come to is worked out from one row a task, and added.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch, shuffle_partitions

#: A sum's base and modulus; (1, None) adds plainly.
Sums = Mapping[str, tuple[int, int | None]]


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo a prime below 2^31."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * (int(out[-1]) * base % prime) % prime))
    return out[:n]


class _Sum:
    """One polynomial sum of v_i * base^i over the rows i of a run; carried from batch to batch."""

    def __init__(self, base: int, prime: int | None):
        self.base, self.prime = base, prime
        self.total, self.power = 0, 1

    def scan(self, values: np.ndarray, starts: np.ndarray, goes_on: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to and with each row, and before it; ``starts`` are the rows where runs begin, row 0 included."""
        n = len(values)
        run = np.zeros(n, np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        within = np.arange(n) - starts[run]
        terms = values
        if self.prime:
            pw = powers(self.base, self.prime, int(within.max()) + 1)
            terms = values % self.prime * pw[within] % self.prime
            if goes_on:
                terms[run == 0] = terms[run == 0] * self.power % self.prime
        sums = np.cumsum(terms)
        before = np.concatenate((np.zeros(1, np.int64), sums))[starts]
        sums = sums - before[run]
        if goes_on:
            sums[run == 0] += self.total
        exclusive = sums - terms
        if self.prime:
            sums, exclusive = sums % self.prime, exclusive % self.prime
            last = int(within[-1]) + 1
            self.power = (self.power if goes_on and run[-1] == 0 else 1) * pow(self.base, last, self.prime) % self.prime
        self.total = int(sums[-1])
        return sums, exclusive


def _scan(batches: Iterator[pa.RecordBatch], sums: Sums) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    states = {name: _Sum(*how) for name, how in sums.items()}
    key, first, seen, count = None, None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column("key").to_numpy()
        first = keys[0] if first is None else first
        goes_on = bool(seen) and keys[0] == key
        starts = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        if goes_on:
            at[: starts[1] if len(starts) > 1 else n] += count
        columns = {name: batch.column(name) for name in batch.schema.names if name not in sums}
        columns |= {"part": pa.array(np.full(n, part, np.int32)), "seq": pa.array(np.arange(seen, seen + n)), "at": pa.array(at), "in_first": pa.array(keys == first)}
        for name, state in states.items():
            columns[name], columns[f"{name}_before"] = map(pa.array, state.scan(batch.column(name).to_numpy(), starts, goes_on))
        key, seen, count = keys[-1], seen + n, int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _carries(edges: Sequence, sums: Sums) -> list[tuple]:
    """(part, rows, then sum and power of each sum) before the first run of a part, where its key began in a part before."""
    out: list[tuple] = []
    last_key, rows, held = None, 0, {}
    for e in edges:
        goes_on = e["first_key"] == last_key
        carry_rows, carry = (rows, held) if goes_on else (0, dict.fromkeys(sums, 0))
        if goes_on:
            out.append((e["part"], carry_rows, *(x for name, (base, prime) in sums.items() for x in (carry[name], pow(base, carry_rows, prime) if prime else 1))))
        whole = e["last"]["key"] == e["first_key"]
        n = e["last"]["at"] + 1
        now = {}
        for name, (base, prime) in sums.items():
            value = e["last"][name]
            if whole and prime:
                value = (carry[name] + pow(base, carry_rows, prime) * value) % prime
            elif whole:
                value += carry[name]
            now[name] = value
        last_key, rows, held = e["last"]["key"], n + (carry_rows if whole else 0), now
    return out


def running(scratch: Scratch, rows: DataFrame, key: str, order: Sequence, by_range: Sequence, sums: Sums, name: str) -> DataFrame:
    """``rows`` with ``at``, the row's place among those of its key, and every sum up to its row.

    ``key`` is a long column without nulls; ``order`` sorts its rows and
    ``by_range`` (a beginning of that order, of small values) deals them out.
    Column x of ``sums`` becomes its running sum, and ``x_before`` the sum
    without the row itself.  What reaches the driver is one row a task.
    """
    n = shuffle_partitions(scratch.spark)
    keyed = rows.withColumn("key", F.col(key))
    spread = keyed.repartitionByRange(n, "key", *by_range).sortWithinPartitions("key", *order)
    kept = [f for f in spread.schema.fields if f.name not in sums]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "part int, seq long, at long, in_first boolean", *(f"`{s}` long, `{s}_before` long" for s in sums)])
    found = scratch.table(spread.mapInArrow(lambda batches: _scan(batches, sums), schema), name)
    edges = found.groupBy("part").agg(F.min_by("key", "seq").alias("first_key"), F.max_by(F.struct("key", "at", *sums), "seq").alias("last"))
    carried = _carries(edges.orderBy("part").collect(), sums)  # one row a task
    if carried:
        fields = ", ".join(["part int, carry_rows long", *(f"`{s}_carry` long, `{s}_power` long" for s in sums)])
        late = F.broadcast(scratch.spark.createDataFrame(carried, fields).withColumn("in_first", F.lit(True)))
        found = found.join(late, ["part", "in_first"], "left").withColumn("at", F.col("at") + F.coalesce("carry_rows", F.lit(0)))
        for s, (_, prime) in sums.items():
            total, power = F.coalesce(f"{s}_carry", F.lit(0)), F.coalesce(f"{s}_power", F.lit(1))
            for c in (s, f"{s}_before"):
                value = total + power * F.col(c)
                found = found.withColumn(c, value % prime if prime else value)
    return found.select(*rows.columns, "at", *(f"{s}_before" for s in sums))
