"""The job-log fold with state that ends: a job that is done, or silent, leaves the state after a while.

State is one value by job in the store, with the greatest seq that was counted, so lines that are read again change nothing. Each
line sets the job's timer: `keep` after the job's latest line if it is done, `silent` after it if it isn't. When event time
passes the timer, the job's last row goes out with retired = true and its state is deleted. So the
state holds the jobs of the last while, not all jobs that ever were.

Defined results: lines of a trigger may come in any order; one whose seq was passed in an earlier trigger is a
repeat; a line that comes later than the watermark is dropped by Spark, so it can't wake a retired job; a line of a
retired job that is not late begins a new state; lines without a job or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import DONE_MARK, phase_of, progress_of, slug_of

#: The store that keeps timers; set for the session before a query with timers starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "job string, phase string, progress double, slug string, done boolean, lines long, retired boolean"
STATE = "phase string, progress double, slug string, done boolean, lines long, seq long, timer long"
FIELDS = [c.split()[0] for c in STATE.split(", ")]


class JobFold(StatefulProcessor):
    """State and timer of one job at a time."""

    def __init__(self, keep_ms: int, silent_ms: int):
        self.keep_ms, self.silent_ms = keep_ms, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _held(self) -> dict:
        if not self.state.exists():
            return {"phase": None, "progress": 0.0, "slug": None, "done": False, "lines": 0, "seq": -1, "timer": -1}
        return dict(zip(FIELDS, self.state.get(), strict=True))

    def _row(self, key, held: dict, retired: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *(held[k] for k in ("phase", "progress", "slug", "done", "lines")), retired]], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        new = pd.concat(rows).drop_duplicates("seq").sort_values("seq")
        new = new[new["seq"] > held["seq"]]
        if not len(new):
            return
        phases, slugs = new["phase"].dropna(), new["slug"].dropna()
        held["phase"] = phases.iloc[-1] if len(phases) else held["phase"]
        held["slug"] = slugs.iloc[0] if held["slug"] is None and len(slugs) else held["slug"]
        held["progress"] = float(max([held["progress"], *new["progress"].dropna()]))
        held["done"] = bool(held["done"] or new["done"].any())
        held["lines"], held["seq"] = held["lines"] + len(new), int(new["seq"].iloc[-1])
        if held["timer"] >= 0:
            self.handle.deleteTimer(held["timer"])
        latest = int(new["ms"].max())
        held["timer"] = max(latest + (self.keep_ms if held["done"] else self.silent_ms), timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(held["timer"])
        self.state.update(tuple(held[k] for k in FIELDS))
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if self.state.exists() and held["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._row(key, held, True)

    def close(self) -> None:
        pass


def fold_retiring(log: DataFrame, keep_seconds: int = 600, silent_seconds: int = 86_400, late: str = "1 minute") -> DataFrame:
    """job, phase, progress, slug, done, lines, retired of the jobs that a trigger changes or retires. log: job, seq, ts, line (a stream)."""
    log.sparkSession.conf.set(*STORE)
    line = F.col("line")
    timed = log.where("job IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    marks = [phase_of(line).alias("phase"), progress_of(line).alias("progress"), slug_of(line).alias("slug"), F.contains(line, F.lit(DONE_MARK)).alias("done")]
    marked = timed.select(F.col("job").cast("string").alias("job"), "seq", "ts", F.unix_millis("ts").alias("ms"), *marks)
    return marked.groupBy("job").transformWithStateInPandas(JobFold(1000 * keep_seconds, 1000 * silent_seconds), OUT, "Update", "EventTime")
