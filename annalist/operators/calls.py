"""A stage that calls a model for each row: lanes of rows in order, bounded retries, a breaker, and a row for every outcome.

A lane is what one client works through in order: its rows meet in one task, sorted, and the client lives as long as the
lane. A reply that is blank, or a row whose tries are used up, is no answer; `breaker` of these in a row open the lane's
breaker. The rows that opened it are "broken" and the rest of the lane is "skipped" without a call, so a failing endpoint
costs a bounded number of calls, poisons no finished row and fails no job. What is not "ok", "empty" or "failed" runs again
from the log of outcomes (`remaining`).

Only a breaker's length of rows is held back. A task that is lost runs its lane again, calls included.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME = "lane int, status string, reply string, attempts int, waited double, error string"
#: Outcomes that stand; all others are to run again.
FINAL = ["ok", "empty", "failed"]


@dataclass(frozen=True)
class Guard:
    """attempts: tries of a row whose client raises. The wait before try k doubles from `wait` up to `cap` seconds, twice at most
    (`doublings`). breaker: rows without an answer, one after the other, that open it; 0 for never. sleep: None to wait in name only."""

    attempts: int = 8
    wait: float = 5.0
    doublings: int = 2
    cap: float = 60.0
    breaker: int = 8
    sleep: Callable[[float], None] | None = time.sleep

    def pause(self, failures: int) -> float:
        """Seconds to wait after so many failures of a row."""
        return min(self.cap, self.wait * 2 ** min(failures - 1, self.doublings))


class Lane:
    """One client's state: the row of answers that did not come, and whether the breaker is open."""

    def __init__(self, number: int, client: Callable[[str], str], guard: Guard) -> None:
        self.number, self.client, self.guard = number, client, guard
        self.held: list[tuple] = []
        self.open = False

    def call(self, prompt: str) -> tuple:
        """status, reply, attempts, waited, error of one row."""
        waited, error = 0.0, None
        for attempt in range(1, self.guard.attempts + 1):
            try:
                reply = (self.client(prompt) or "").strip()
                return "ok" if reply else "empty", reply, attempt, waited, None
            except Exception as raised:  # whatever the client raises is an outcome of the row
                error = f"{type(raised).__name__}: {raised}"
                if attempt < self.guard.attempts:
                    pause = self.guard.pause(attempt)
                    waited += pause
                    if self.guard.sleep:
                        self.guard.sleep(pause)
        return "failed", "", self.guard.attempts, waited, error

    def add(self, key: tuple, prompt: str | None) -> list[tuple]:
        """Rows whose outcome is known now."""
        if self.open:
            return [(*key, self.number, "skipped", "", 0, 0.0, None)]
        self.held.append((*key, self.number, *self.call(prompt or "")))
        if self.held[-1][len(key) + 1] == "ok" or not self.guard.breaker:
            return self.close()
        if len(self.held) < self.guard.breaker:
            return []
        self.open = True
        at = len(key) + 1
        return [(*row[:at], "broken", *row[at + 1 :]) for row in self.close()]

    def close(self) -> list[tuple]:
        out, self.held = self.held, []
        return out


def called(rows: DataFrame, key: list[str], order: list, prompt: Column, make: Callable[[], Callable[[str], str]], guard: Guard = Guard(), lanes: int = 8, lane: Column | None = None) -> DataFrame:
    """key, lane, status, reply, attempts, waited (seconds), error: the outcome of one call for each row.

    make is called once a lane, in its task, and gives the client. lane: 0 to lanes - 1, by default a hash of the key.
    A null prompt is an empty one. Rows of equal order are called in any order.
    """
    number = F.pmod(F.xxhash64(*key), F.lit(lanes)).cast("int") if lane is None else lane.cast("int")
    dealt = rows.select(*key, number.alias("_lane"), prompt.alias("_prompt"), F.struct(*order).alias("_order")).repartition(lanes, "_lane").sortWithinPartitions("_lane", "_order").drop("_order")
    schema = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key] + [OUTCOME])
    names = [*key, *[c.split()[0] for c in OUTCOME.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Lane | None = None
        for batch in batches:
            out: list[tuple] = []
            for *own, at, asked in batch.itertuples(index=False):
                if now is None or at != now.number:
                    out += now.close() if now else []
                    now = Lane(at, make(), guard)
                out += now.add(tuple(own), asked)
            yield pd.DataFrame(out, columns=names)
        if now and now.held:
            yield pd.DataFrame(now.close(), columns=names)

    return dealt.mapInPandas(run, schema)


def dry() -> Callable[[str], str]:
    """The client of a dry run: a verdict of no points for every prompt."""
    return lambda prompt: '{"score": 0.0, "failure_mode": "dry_run"}'


def remaining(units: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Units whose outcomes do not stand yet."""
    return units.join(log.where(F.col("status").isin(FINAL)).select(*key).distinct(), key, "left_anti")


def verdicts(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """key, score, failure_mode: verdicts out of replies that are JSON. No answer scores 0: its mode is the outcome, that of an unreadable reply "unreadable"."""
    read = F.from_json(F.when(F.col("status") == "ok", F.col("reply")), "score double, failure_mode string")
    known = read["score"].isNotNull()
    mode = F.when(F.col("status") != "ok", F.col("status")).when(~known, "unreadable").otherwise(F.coalesce(read["failure_mode"], F.lit("none")))
    return outcomes.select(*key, F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), read["score"]))).otherwise(0.0).alias("score"), mode.alias("failure_mode"))


def settings(stage, override, defaults: dict[str, int], fallback: int) -> Column:
    """A setting of a call: the override, else its stage's default, else the fallback."""
    of = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else None
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.coalesce(c(override), of[c(stage)] if of is not None else F.lit(None).cast("int"), F.lit(fallback))
