"""Live views with state of their own: job progress by stage, workers that fall silent. Each has a batch twin in
operators.ops, to which a stream that has read the same events is equal."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from ..operators.ops import CLOSING, SILENT_SEC

#: A stream with these processors needs this state store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_PROGRESS = "job_id long, attempt long, stage string, status string, progress long, stages map<string,string>, events long, last_id long"
_WORKERS = "worker string, state string, at_ms long"


def job_progress_stream(events: DataFrame, stages: list[str]) -> DataFrame:
    """The state of each job that got events in a batch: attempt, current stage and its progress, the last status of every
    stage (`pending` if none came), the number of events and the last id of the attempt.

    events (job_id long, id long, event_type, stage, progress long): ids rise with time, a job's events come in the order
    of ids from batch to batch; an id seen before is a repeat and does nothing. A requeue clears the stages and
    begins the next attempt; after a closing event nothing counts until the next requeue."""
    known, closing = list(stages), dict(CLOSING)
    kept = StructType.fromDDL("attempt long, stage string, status string, progress long, events long, last_id long, seen long")

    class Progress(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.job = handle.getValueState("job", kept)
            self.stages = handle.getMapState("stages", StructType().add("stage", StringType()), StructType().add("status", StringType()))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            attempt, stage, status, progress, n, last, seen = self.job.get() if self.job.exists() else (1, None, "queued", None, 0, None, None)
            for row in sorted(rows, key=lambda r: r["id"]):
                if seen is not None and row["id"] <= seen:
                    continue
                seen, kind = row["id"], row["event_type"]
                if kind == "job_requeued":
                    attempt, stage, status, progress, n, last = attempt + 1, None, "queued", None, 0, None
                    self.stages.clear()
                elif status not in closing.values():
                    n, last = n + 1, seen
                    if kind in closing:
                        status = closing[kind]
                    else:
                        status, stage = "running", row["stage"]
                        progress = 100 if kind == "stage_completed" else row["progress"]
                        self.stages.updateValue((stage,), (kind.removeprefix("stage_"),))
            self.job.update((attempt, stage, status, progress, n, last, seen))
            found = {k[0]: v[0] for k, v in self.stages.iterator()}
            yield Row(job_id=key[0], attempt=attempt, stage=stage, status=status, progress=progress, stages={s: "pending" for s in known} | found, events=n, last_id=last)

        def close(self) -> None:
            pass

    return events.groupBy("job_id").transformWithState(Progress(), StructType.fromDDL(_PROGRESS), "Update", "None")


def worker_state_stream(beats: DataFrame, silent_sec: int = SILENT_SEC, delay: str = "10 seconds") -> DataFrame:
    """(worker, state, at_ms): a row whenever the state of a worker changes. A beat makes it busy or idle, and
    `not_responding` follows by an event-time timer once the watermark passes the last beat by over silent_sec, without
    any further row of that worker.

    beats (worker, ts, running_job): in any order within `delay`; a beat before the last one does nothing."""
    silent_ms = silent_sec * 1000

    class Workers(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", StructType().add("ts_ms", LongType()).add("state", StringType()))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            before, state = self.last.get() if self.last.exists() else (None, None)
            # A worker's beats of one batch; of two at one time the one with a job counts, as in the batch twin.
            newest = max(((int(r["ms"]), r["running_job"] is not None) for r in rows), default=None)
            if newest is None or (before is not None and newest[0] < before):
                return
            at, now = newest[0], "busy" if newest[1] else "idle"
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(at + silent_ms + 1)
            self.last.update((at, now))
            if now != state:
                yield Row(worker=key[0], state=now, at_ms=at)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            at, _ = self.last.get()
            self.last.update((at, "not_responding"))
            yield Row(worker=key[0], state="not_responding", at_ms=expiredTimerInfo.getExpiryTimeInMs())

        def close(self) -> None:
            pass

    timed = beats.where("ts is not null").withWatermark("ts", delay).selectExpr("worker", "ts", "running_job", "unix_millis(ts) as ms")
    return timed.groupBy("worker").transformWithState(Workers(), StructType.fromDDL(_WORKERS), "Update", "EventTime")
