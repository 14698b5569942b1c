"""The streamed panel against the batch panel: rows in order, late rows, gaps and repeated days."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyloom.operators import panel
from tallyloom.streaming import daily_panel
from tallyloom.streaming.daily_panel import panel_stream

CELLS = "series long, ts timestamp, p double"


def cells(seed, days=40):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(s, start + timedelta(days=d, hours=rng.randint(0, 23), minutes=k), rng.uniform(1, 9)) for s in range(6) for d in range(days) if rng.random() < (0.9 - 0.12 * s) for k in range(rng.randint(1, 2))]


def stream(spark, folder, parts):
    """Cells in the given parts, a batch each, and a last row that closes all days."""
    parts = [*parts, [(-1, datetime(2024, 6, 1), 1.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, CELLS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(CELLS).parquet(f"{folder}/in")
        query = panel_stream(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None, k
    return spark.read.parquet(f"{folder}/out").where("series >= 0")


def batch(spark, rows):
    low = spark.createDataFrame(rows, CELLS).groupBy("series", F.to_date("ts").alias("d")).agg(F.min("p").alias("p"))
    return panel.build(low).where("pf is not null")


def shown(df, last):
    return sorted(map(tuple, df.where(F.col("d") <= last).select("series", "d", "p", "pf", "observed", "n").collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_late_and_ordered_rows_gives_the_batch_panel(spark, tmp_path, seed):
    rows = sorted(cells(seed), key=lambda r: r[1])
    last = rows[-1][1].date()
    rng = random.Random(seed)
    edges = [datetime(2024, 1, 12), datetime(2024, 1, 25)]
    parts = [[], [], []]
    for r in rows:
        own = sum(r[1] >= e for e in edges)
        late = own < 2 and edges[own] - r[1] < timedelta(days=2) and rng.random() < 0.5  # comes with the next part
        parts[own + late].append(r)
    for part in parts:
        rng.shuffle(part)
    got = stream(spark, str(tmp_path), parts)
    want = shown(batch(spark, rows), last)
    assert shown(got, last) == want and len({r[5] for r in want}) > 5 and not all(r[4] for r in want)
    # Beyond the last day every series is carried over two days at most; a segment begins where its first row is.
    assert got.where("datediff(d, segment) <> n - 1").count() == 0


def test_rows_after_the_watermark_are_left_out(spark, tmp_path):
    day = lambda n: datetime(2024, 1, n, 5)
    got = stream(spark, str(tmp_path), [[(1, day(1), 5.0), (1, day(20), 6.0)], [(1, day(2), 1.0), (1, day(19), 3.0)]])
    assert [(r["d"].day, r["p"], r["n"]) for r in got.where("d <= date'2024-01-20'").orderBy("d").collect()] == [(1, 5.0, 1), (2, None, 2), (3, None, 3), (19, 3.0, 1), (20, 6.0, 2)]


class Counted:
    """A processor's handle whose states count the messages sent to them."""

    def __init__(self):
        self.messages, self.held, self.timers = 0, {}, []

    def getMapState(self, name, *schemas):
        return self._state(self.held.setdefault(name, {}))

    def getValueState(self, name, schema):
        return self._state(self.held.setdefault(name, {}))

    def registerTimer(self, at):
        self.messages += 1
        self.timers.append(at)

    def _state(self, held):
        def message(f):
            def counted(*args):
                self.messages += 1
                return f(*args)

            return counted

        calls = {
            "get": lambda: held.get(()), "exists": lambda: () in held, "update": lambda v: held.update({(): v}), "iterator": lambda: iter(list(held.items())),
            "getValue": held.get, "containsKey": lambda k: k in held, "updateValue": lambda k, v: held.update({k: v}), "removeKey": held.pop,
        }
        return SimpleNamespace(**{n: message(f) for n, f in calls.items()})


def test_messages_to_the_state_do_not_grow_with_the_days():
    """thirty days of a series cost a few messages a batch, and one timer at a time."""
    handle, series = Counted(), daily_panel.SeriesDays()
    series.init(handle)
    told = list(series.handleInputRows((1,), iter([Row(day=19_700 + i % 30, p=float(i)) for i in range(300)]), None))
    assert not told and handle.messages <= 3 and handle.timers == [19_701 * daily_panel.DAY_MS]
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 19_740 * daily_panel.DAY_MS)
    rows = list(series.handleExpiredTimer((1,), clock, None))
    assert [(r.pf, r.observed, r.n) for r in rows] == [*((float(i), True, i + 1) for i in range(30)), (29.0, False, 31), (29.0, False, 32)]
    assert handle.messages <= 6 and len(handle.timers) == 1
