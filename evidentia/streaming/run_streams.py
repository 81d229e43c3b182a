"""Streams of run events (run_id, at, seq, state): audit, status, overdue runs, deduplication, counts.

State that outlives a batch is typed and stands in the operator-state interface on a RocksDB store: `started()` gives a query that
store, whatever the session's own is. State ends: the audit's by a time to live, that of overdue runs by event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evidentia.operators import runs
from evidentia.streaming.snapshot import Snapshot

STORE = "spark.sql.streaming.stateStore.providerClass"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


class Audit(StatefulProcessor):
    """The last state of a run, kept for some time after its last event."""

    def __init__(self, allowed: set, start: str, keep_ms: int):
        self.allowed, self.start, self.keep_ms = allowed, start, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_us", "seq"])
        last, out = (self.last.get()[0] if self.last.exists() else None), []
        for seq, now in zip(events["seq"], events["state"], strict=True):
            out.append((key[0], seq, last, now, now == self.start if last is None else (last, now) in self.allowed))
            last = now
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["run_id", "seq", "previous", "state", "allowed"])

    def close(self) -> None:
        pass


def stream_run_audit(
    events: DataFrame,
    transitions: dict = runs.TRANSITIONS,
    start: str = "draft",
    noted: tuple = runs.NOTED,
    keep_days: float = 30,
) -> DataFrame:
    """Every event with its run's state before it and whether the step is allowed; the last state of each run is kept
    between batches, and dropped keep_days (of real time) after the batch that held its last event. Within a batch, events are taken in
    order of at and seq."""
    processor = Audit(set(runs.legal_steps(transitions, noted)), start, int(keep_days * 86_400_000))
    return events.withColumn("at_us", F.unix_micros("at")).groupBy("run_id").transformWithStateInPandas(
        processor,
        "run_id long, seq long, previous string, state string, allowed boolean",
        "append",
        "processingTime",
    )


def status_of(events: DataFrame) -> DataFrame:
    """The newest event of each run and its number of events, as rows of the status snapshot."""
    return runs.latest_run_state(events)


def newer_status(rows: DataFrame) -> DataFrame:
    """One row per run from several: the newest event, all events counted."""
    out = rows.groupBy("run_id").agg(F.max(F.struct("at", "seq", "state")).alias("e"), F.sum("events").alias("events"))
    return out.select("run_id", F.col("e.at").alias("at"), F.col("e.seq").alias("seq"), F.col("e.state").alias("state"), "events")


def stream_run_status(events: DataFrame, snapshot: Snapshot, checkpoint: str) -> StreamingQuery:
    """Merges each batch into the snapshot, which holds one row per run and is the only state; a batch that is played again changes
    nothing. The query runs over all that is there."""

    def merge(batch: DataFrame, n: int) -> None:
        snapshot.merge(status_of(batch), n, newer_status)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


SESSIONS = "started array<long>, last array<long>, ended array<long>, told array<boolean>, timer long"


class Sessions(StatefulProcessor):
    """The open sessions of a run, each until the watermark is `gap` past its last event. They are one value, and a run has one timer, for
    what comes next of all its sessions: a batch costs a run a few calls to its state, however many sessions it has. A timer that
    comes too early finds nothing to do and sets the next one."""

    def __init__(self, terminal: list, limit_us: int, gap_us: int):
        self.terminal, self.limit_us, self.gap_us = set(terminal), limit_us, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sessions = handle, handle.getValueState("sessions", SESSIONS)

    def held(self) -> tuple[list[list], int | None]:
        """The sessions, and the timer that was set last."""
        found = self.sessions.get()
        return ([list(s) for s in zip(*found[:4], strict=True)], found[4]) if found is not None else ([], None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_sessions, timer = self.held()
        for batch in rows:
            for at, state in zip(batch["at_us"].tolist(), batch["state"].tolist(), strict=True):
                open_sessions.append([at, at, at if state in self.terminal else None, False])
        merged: list[list] = []
        for s in sorted(open_sessions, key=lambda s: s[0]):
            if merged and s[0] - merged[-1][1] <= self.gap_us:
                m = merged[-1]
                m[1] = max(m[1], s[1])
                m[2] = s[2] if m[2] is None else m[2] if s[2] is None else min(m[2], s[2])
                m[3] = m[3] or s[3]
            else:
                merged.append(s)
        yield from self.looked_at(key, merged, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.looked_at(key, *self.held(), timerValues.getCurrentWatermarkInMs())

    def looked_at(self, key, sessions: list[list], timer: int | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Tells the sessions whose limit has passed, drops those that are over, and sets a timer for what comes next."""
        out, left, wanted = [], [], []
        for s in sessions:
            limit = s[0] + self.limit_us
            due = limit // 1000 + 1
            if due <= watermark_ms:
                if not s[3] and (s[2] is None or s[2] > limit):
                    s[3] = True
                    out.append(s[0])
            else:
                wanted.append(due)
            over = max((s[1] + self.gap_us) // 1000 + 1, due)
            if over > watermark_ms:
                left.append(s)
                wanted.append(over)
        if left:
            soonest = min(wanted)
            if timer is None or timer <= watermark_ms or soonest < timer:
                self.handle.registerTimer(soonest)
                timer = soonest
            self.sessions.update((*map(list, zip(*left, strict=True)), timer))
        elif sessions:
            self.sessions.clear()
        if out:
            yield pd.DataFrame({"run_id": key[0], "started_us": out})

    def close(self) -> None:
        pass


def stream_overdue_runs(events: DataFrame, terminal: list[str], minutes: int = 30, gap_minutes: int = 30, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of runs (events at most gap_minutes apart) that have no terminal event within `minutes` of their first one, once the
    watermark has passed that time. A session's state is removed when the watermark is past its last event by the gap and past its limit;
    a run that goes on later starts a new session, as in overdue_sessions()."""
    if gap_minutes < minutes:
        raise ValueError("a session must not close before its limit")
    processor = Sessions(terminal, minutes * 60_000_000, gap_minutes * 60_000_000)
    marked = events.withColumn("at_us", F.unix_micros("at")).withWatermark("at", lateness)
    rows = marked.select("run_id", "at", "at_us", "state")
    return rows.groupBy("run_id").transformWithStateInPandas(processor, "run_id long, started_us long", "append", "eventTime")


def stream_dedupe(events: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """Events without their repeats that come within the lateness."""
    return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(keys)


def stream_state_counts(events: DataFrame, window: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Events per window and state, when the window is over; append mode."""
    return runs.state_counts(events.withWatermark("at", lateness), window, slide)


def started(stream: DataFrame, folder: str, idle_batches: bool = True) -> StreamingQuery:
    """Starts a stream over all that is there, into Parquet in folder/out; its state stands in a RocksDB store. idle_batches: whether
    batches without rows run, which event-time timers and windows need at the end; a time to live asks for them without end. The
    session's own settings are as before when this returns."""
    conf = stream.sparkSession.conf
    own = {STORE: ROCKS, IDLE: str(idle_batches).lower()}
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        return writer.format("parquet").outputMode("append").start(f"{folder}/out")
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def drained(stream: DataFrame, folder: str, idle_batches: bool = True) -> str:
    """Runs a stream over all that is there; the folder of its results. Run again with the same folder, it goes on where it was."""
    started(stream, folder, idle_batches).awaitTermination()
    return f"{folder}/out"
