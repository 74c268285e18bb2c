"""A drain watched as a stream: when a polled count has settled, held, or run out of time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "first double, last double, n bigint, run int, held double, over boolean"
RESULT = "scope string, at double, n bigint, status string"


@dataclass(frozen=True)
class Rule:
    """Seconds and polls: after `least` seconds, `stable` polls in a row that equal the one before, then the same count `hold` seconds on.

    positive: only counts above 0 make a row, but it may begin before `least`.
    """

    stable: int = 6
    least: float = 120
    hold: float = 120
    timeout: float = 3600
    positive: bool = False


START = (-1.0, -1.0, -1, 0, -1.0, False)
#: Where the time of polls begins in event time, so that a poll at 0 seconds is not late before any other.
ORIGIN = 86_400


def step(state: tuple, at: float, n: int, rule: Rule) -> tuple[tuple, str | None]:
    """One poll: the new state, whose third field is the count, and how the watch ended if it did.

    A negative count is a failed poll and breaks the row. Polls not later than the last one, polls within the hold and all
    that follows an end change nothing. At the timeout the count before it stands.
    """
    first, last, before, run, held, over = state
    if over or at <= last:
        return state, None
    first = at if first < 0 else first
    if held >= 0:
        if at - held < rule.hold:
            return (first, at, before, run, held, False), None
        if n == before:
            return (first, at, n, run, held, True), "settled"
        run, held, before = 0, -1.0, n
    elif at - first < rule.timeout:
        late = at - first >= rule.least
        same = n == before and (n > 0 if rule.positive else n >= 0 and late)
        run, before = run + 1 if same else 0, n
        held = at if run >= rule.stable and late else -1.0
        if held >= 0 and rule.hold <= 0:
            return (first, at, n, run, held, True), "settled"
    ended = held < 0 and at - first >= rule.timeout
    return (first, at, before, run, held, ended), "timeout" if ended else None


class Watch(StatefulProcessor):
    """One scope's watch: its state, and a timer at the end of its time."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("watch", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = not self.state.exists()
        now = START if new else tuple(self.state.get())
        for at, n in sorted((float(r["at"]), int(r["n"])) for r in rows):
            now, status = step(now, at, n, self.rule)
            if status:
                yield Row(scope=key[0], at=at, n=now[2], status=status)
        if new:
            self.handle.registerTimer(int((now[0] + self.rule.timeout + ORIGIN) * 1000))
        self.state.update(now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The scope's time is up: if its watch has not ended, the last count stands. Nothing of the scope is kept."""
        first, _, n, _, _, over = tuple(self.state.get())
        if not over:
            yield Row(scope=key[0], at=first + self.rule.timeout, n=n, status="timeout")
        self.state.clear()

    def close(self) -> None:
        pass


def watch(polls: DataFrame, rule: Rule = Rule(), late: str = "60 seconds") -> DataFrame:
    """polls (scope string, at double in seconds since any start from 0, n bigint), a stream: one row for each scope that settled or timed out.

    A scope's state is six numbers and a timer. Time is that of the polls: once the polls of all scopes are `late` beyond the end
    of a scope's time, the scope ends as "timeout" although nothing more is heard of it, and its state is gone; a later poll would
    begin a new watch. Polls later than that are left out. Null scopes are a scope; null times or counts are left out. The session
    needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = polls.where("at is not null and n is not null").withColumn("polled_at", F.timestamp_micros(((F.col("at") + ORIGIN) * 1_000_000).cast("bigint")))
    return timed.withWatermark("polled_at", late).groupBy("scope").transformWithState(Watch(rule), RESULT, "append", "EventTime")
