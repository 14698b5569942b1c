"""The machines of days over a stream against the batch answer: replayed, reordered and repeated attempts."""

import random
from datetime import date, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest

from tallyloom.streaming import attempts as at


def made(seed, n=120):
    rng = random.Random(seed)
    rows = [(date(2024, 1, 1) + timedelta(days=rng.randrange(12)), rng.choice([1, 2, 3]), rng.choice(["imported", "rejected", "rejected", "listed"]), rng.choice([None, "bad day"]), rng.randrange(40)) for _ in range(n)]
    return rows + [(date(2024, 2, 1), None, "listed", None, None), (date(2024, 2, 2), None, "imported", None, 1), (None, 1, "imported", None, 1), (date(2024, 2, 3), 4, "rejected", "x", 3), (date(2024, 2, 3), 4, "imported", None, 3)]


def shown(df):
    return sorted(tuple(r[c] for c in ("d", "status", "revision", "rejected", "attempts")) for r in df.collect())


def test_states_of_a_table(spark):
    day = lambda n: date(2024, 1, n)
    rows = [
        (day(1), None, "listed", None, None), (day(2), 1, "rejected", "x", 5), (day(3), 1, "rejected", "x", 5), (day(3), 2, "imported", None, 6), (day(4), 1, "imported", None, 5), (day(4), 2, "imported", None, 9),
        (day(5), 1, "imported", None, 5), (day(5), 1, "rejected", "late", 7), (day(6), 1, "rejected", None, 5), (day(6), 1, "imported", None, 5), (day(7), 3, "imported", None, 2), (day(7), 4, "imported", None, 2),
    ]
    got = shown(at.states(spark.createDataFrame(rows, at.ATTEMPT)))
    assert got == [(day(1), "to do", None, [], 0), (day(2), "failed", None, [1], 1), (day(3), "imported", 2, [1], 2), (day(4), "revised", 2, [], 2), (day(5), "failed", None, [1], 1), (day(6), "imported", 1, [], 1), (day(7), "revised", 4, [], 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_attempts_gives_the_batch_answer(spark, tmp_path, seed):
    rows = made(seed)
    want = shown(at.states(spark.createDataFrame(rows, at.ATTEMPT)))
    rng = random.Random(seed)
    rng.shuffle(rows)
    parts = [rows[:40], rows[20:90], rows[60:], rng.sample(rows, 30)]  # overlapping, so attempts come twice
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, at.ATTEMPT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(at.ATTEMPT).parquet(source)
        query = at.keep_manifest(at.state_updates(stream), out, marks).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None, k
    manifest = at.compacted(spark, out)
    assert shown(manifest) == want and manifest.count() == len({r[0] for r in rows if r[0] is not None})


def test_no_attempts(spark):
    assert at.states(spark.createDataFrame([], at.ATTEMPT)).count() == 0


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


def test_messages_to_the_state_do_not_grow_with_the_rows():
    """F8: a day's thousand attempts at two revisions meet before the state hears of them."""
    handle, day = Counted(), at.Day()
    day.init(handle)
    rows = pd.DataFrame({"revision": [1.0, 2.0, None, 1.0] * 250, "outcome": [at.IMPORTED, at.REJECTED, at.IMPORTED, at.REJECTED] * 250, "finished_at": [*range(999), None]})
    told = pd.concat(day.handleInputRows(("d",), iter([rows[:500], rows[500:]]), None))
    assert told[["status", "revision", "attempts", "version"]].values.tolist() == [["imported", 1, 2, 1]] and told.rejected.tolist() == [[2]]
    assert handle.messages < 10
    assert list(day.handleInputRows(("d",), iter([rows[:500]]), None)) == []  # nothing new
