"""STR-5 with the status rule: changes of each job in order of their time, whatever batch they come in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The jobs of a bucket as a JSON list of [job_id, status, stage, applied_at, at, id, stale_at, waiting], waiting a list of [at, id, status].
_STATE = "jobs string"
_NEW = ("NEW", None, None, None, None, None)
_NO_TIME = -(2**63)
OUT = "job_id bigint, id bigint, kind string, changed_at timestamp, old_status string, new_status string, old_stage string, new_stage string, applied_at timestamp"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store; set it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Transitions(StatefulProcessor):
    """The jobs of one bucket: the status of each, and the changes that wait for the watermark.

    A change waits until no earlier one can come, then the rule is applied: APPLIED sets applied_at
    and a stage unless there is one, any other status clears both. A change known by its time and id is applied
    once. One that comes after a later one was applied is reported as late and changes nothing. A batch reads and writes the state of
    the buckets that it touches once, whatever the number of their jobs.
    """

    def __init__(self, stale_days: int | None) -> None:
        self.stale = stale_days * 86_400_000 if stale_days else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", _STATE)

    def _read(self) -> dict:
        """By job: its state and what waits, by time and id."""
        held = self.now.get()
        return {x[0]: (tuple(x[1:7]), {(at, n): status for at, n, status in x[7]}) for x in json.loads(held[0])} if held is not None else {}

    def _write(self, jobs: dict) -> None:
        self.now.update((json.dumps([[job, *state, [[*k, v] for k, v in sorted(waiting.items())]] for job, (state, waiting) in jobs.items()]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs, late = self._read(), set()
        for batch in rows:
            given = [[None if pd.isna(x) else int(x) for x in batch["job_id"].tolist()], batch["at"].tolist(), batch["id"].tolist(), batch["new_status"].tolist()]
            for job, at, number, status in zip(*given, strict=True):
                if job not in jobs:
                    jobs[job] = _NEW, {}
                state, waiting = jobs[job]
                applied = (state[3], state[4]) if state[3] is not None else (-(2**63), 0)
                if (at, number) < applied:
                    late.add((job, at, number, status))
                elif (at, number) != applied:
                    waiting.setdefault((at, number), status)
        yield self._settle(jobs, timerValues.getCurrentWatermarkInMs(), sorted(late, key=lambda x: x[1:]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(self._read(), timerValues.getCurrentWatermarkInMs(), [])

    def _settle(self, jobs: dict, mark: int, late: list) -> pd.DataFrame:
        """Applies what the watermark has passed, in order; one timer waits for what comes next."""
        out, following = [(job, number, "late", at, None, status, None, None, None) for job, at, number, status in late], []
        for job, (state, waiting) in jobs.items():
            status, stage, applied_at, last, number, stale_at = state
            for at, n in sorted(k for k in waiting if k[0] <= mark):
                old, before, status = status, stage, waiting.pop((at, n))
                put = status == "APPLIED"
                stage, applied_at, last, number = (stage or "APPLIED") if put else None, at if put else None, at, n
                stale_at = at + self.stale if self.stale else None
                out.append((job, n, "change", at, old, status, before, stage, applied_at))
            if stale_at is not None and stale_at <= mark:
                out.append((job, None, "stale", stale_at, status, status, stage, stage, applied_at))
                stale_at = None
            jobs[job] = (status, stage, applied_at, last, number, stale_at), waiting
            following += [min(waiting)[0]] if waiting else []
            following += [stale_at] if stale_at is not None else []
        self._write(jobs)
        if following:
            self.handle.registerTimer(min(following))
        return self._frame(out)

    def _frame(self, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_NAMES)
        for c, at in (("changed_at", 3), ("applied_at", 8)):
            whole = np.array([_NO_TIME if x[at] is None else x[at] for x in rows], np.int64)  # no floats, which pandas can't always turn into times
            out[c] = pd.Series(whole.view("datetime64[ms]")).dt.tz_localize("UTC")
        return out.astype({"job_id": "Int64", "id": "Int64"})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        jobs = self._read()
        for job, status, stage, at in zip(*[initialState[c].tolist() for c in ("job_id", "status", "stage", "applied_ms")], strict=True):
            jobs[int(job)] = (status, stage if isinstance(stage, str) else None, None if pd.isna(at) else int(at), *_NEW[3:]), {}
        self._write(jobs)

    def close(self) -> None:
        pass


def stream_transitions(events: DataFrame, delay: str = "1 day", stale_days: int | None = None, jobs: DataFrame | None = None, buckets: int = 2048) -> DataFrame:
    """STR-5: a row for each change of a job (job_id, id, new_status, changed_at), in append mode; session: ``use_rocksdb``.

    ``kind``: change (applied in order of changed_at and id once the watermark has passed it), late
    (a later one was applied before; nothing changes), stale (no change for ``stale_days`` after the last, once the watermark has passed that time). Rows
    carry the old and new status and stage and the time of application: rows of changes with different values are the histories, the last one is the
    current state. ``jobs`` (id, status, stage, applied_at) are where the stream's jobs start; others start as NEW. Times count in milliseconds.
    Jobs share the state of their bucket, so that a batch calls Python once a bucket and not once a job; ``buckets`` is part of the checkpoint, and
    about one for a few hundred to a few thousand jobs is right.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    timed = events.select("job_id", "id", "new_status", "changed_at", ms("changed_at").alias("at")).withWatermark("changed_at", delay)
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket")
    keyed = timed.select(bucket, "job_id", "id", "new_status", "at").groupBy("bucket")  # without it Spark drops no late rows, so they can be told
    start = None
    if jobs is not None:
        start = jobs.select(F.col("id").alias("job_id"), "status", "stage", ms("applied_at").alias("applied_ms")).select(bucket, "*").groupBy("bucket")
    return keyed.transformWithStateInPandas(Transitions(stale_days), OUT, "Append", "EventTime", start)
