"""The daily panel from a stream: days are told once they are over, filled for at most two more, and then the segment closes.

One state machine a series keeps the lowest value of each open day.  A timer at
a day's end (by event time, so the watermark decides how long late rows are
waited for) makes the day final: an observed day leaves with its value, and
starts or continues a segment; without a value, the last one is carried over for
FILL_DAYS days; after that nothing is told until the series is seen again.  The
state of a series is its open days and its last value, whatever its history.

The rows equal those of ``panel.build`` that have a filled value, up to the last
day that is over.  Rows later than the watermark are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyloom.operators.panel import FILL_DAYS
from tallyloom.session import ship_code
from tallyloom.streaming.attempts import ROCKSDB

EPOCH, DAY_MS = date(1970, 1, 1), 86_400_000
STATE = "days array<long>, lows array<double>, day long, seen long, p double, start long, n long, due long"
ROWS = "series long, d date, p double, pf double, observed boolean, n long, segment date"


class SeriesDays(StatefulProcessor):
    """A series: its open days, and the last final day of its segment with the value carried, its start and its length.

    Every call to the state is a message to the JVM, so all of it is one value,
    and one timer stands for all days: the earliest day whose end would tell
    something.  When it goes off, all days that the watermark has passed are told.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", STATE)

    def _held(self) -> tuple[dict[int, float], tuple | None, int | None]:
        """Lowest values by open day, the last final day (day, seen, p, start, n), and the timer's day."""
        held = self._state.get()
        if held is None:
            return {}, None, None
        days, lows, *last, due = held
        return dict(zip(days, lows, strict=True)), None if last[0] is None else tuple(last), due

    def _keep(self, lowest: dict[int, float], last: tuple | None, due: int | None) -> None:
        self._state.update((list(lowest), list(lowest.values()), *(last or [None] * 5), due))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        lowest, last, due = self._held()
        changed = False
        for row in rows:
            day, p = row.day, row.p
            if (last is None or day > last[0]) and p < lowest.get(day, math.inf):  # other days are final
                lowest[day] = p
                changed = True
        if changed:
            first = min(lowest)
            if due is None or first < due:
                self._handle.registerTimer((first + 1) * DAY_MS)
                due = first
            self._keep(lowest, last, due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        lowest, last, due = self._held()
        over = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1
        if due is None or due > over:
            return  # an earlier timer's call has told these days
        out: list[tuple] = []

        def carry(until: int) -> None:
            nonlocal last
            while last is not None and last[0] < min(until, last[1] + FILL_DAYS):
                last = (last[0] + 1, last[1], last[2], last[3], last[4] + 1)
                out.append((last[0], None, last[2], False, last[4], last[3]))

        for day in sorted(d for d in lowest if d <= over):
            p = lowest.pop(day)
            carry(day - 1)
            joins = last is not None and last[0] == day - 1
            last = (day, day, p, last[3] if joins else day, last[4] + 1 if joins else 1)
            out.append((day, p, p, True, last[4], last[3]))
        carry(over)
        nexts = [*lowest, *([last[0] + 1] if last is not None and last[0] < last[1] + FILL_DAYS else [])]
        due = min(nexts, default=None)
        if due is not None:
            self._handle.registerTimer((due + 1) * DAY_MS)
        self._keep(lowest, last, due)
        as_date = lambda n: EPOCH + timedelta(days=n)
        yield from (Row(series=key[0], d=as_date(d), p=p, pf=pf, observed=seen, n=n, segment=as_date(start)) for d, p, pf, seen, n, start in out)

    def close(self) -> None:
        pass


def panel_stream(cells: DataFrame, late: str = "3 days") -> DataFrame:
    """Final days of a stream of cells (series long, ts timestamp, p double), in append mode."""
    ship_code(cells.sparkSession)
    cells.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    day = F.floor(F.unix_millis("ts") / DAY_MS).cast("long")
    rows = cells.where("series is not null and p is not null and ts is not null").withWatermark("ts", late).select("series", "ts", day.alias("day"), "p")
    return rows.groupBy("series").transformWithState(SeriesDays(), ROWS, "Append", "EventTime")
