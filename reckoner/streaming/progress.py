"""What a reader who watches an upload is told: its job's phase, lost, or not found.

A stateful operator keeps for each upload whether it is there, its job's newest phase, and
whether somebody waits. One who asks for an upload that isn't there is told not_found. One
who asks before the job has a phase is told initializing, and a processing-time timer
runs: without a phase after ``ticks`` of ``tick_seconds`` the answer is lost. Every phase is
told to those who wait, and the waiting ends with done or error.

Rows: upload_id, event ("upload", "watch" or "job"), phase, ts. Defined results: rows of a
batch are taken by time, uploads before jobs before readers at equal ones; a phase that is
older than the newest one changes nothing; other events, null phases and phases without a time are passed over; state
goes after ``days`` without a change. The session needs the RocksDB state store (``STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
TICKS, TICK_SECONDS, DAYS = 20, 0.5, 7
TERMINAL = ("done", "error")
_ORDER = {"upload": 0, "job": 1, "watch": 2}
_STATE = T.StructType([T.StructField("there", T.BooleanType()), T.StructField("phase", T.StringType()), T.StructField("at", T.LongType()), T.StructField("waiting", T.BooleanType())])


class Progress(StatefulProcessor):
    def __init__(self, grace_ms: int, ttl_ms: int):
        self.grace_ms, self.ttl_ms = grace_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("upload", _STATE, self.ttl_ms)

    def _stop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        there, phase, at, waiting = (self.state.get() or (False, None, None, False)) if self.state.exists() else (False, None, None, False)
        for r in sorted((r for r in rows if r["event"] in _ORDER), key=lambda r: (r["ts"] or 0, _ORDER[r["event"]])):
            if r["event"] == "upload":
                there = True
            elif r["event"] == "job":
                if r["phase"] is None or r["ts"] is None or at is not None and r["ts"] < at:
                    continue
                phase, at = r["phase"], r["ts"]
                if waiting:
                    self._stop_timers()
                    waiting = phase not in TERMINAL
                    yield Row(upload_id=key[0], state=phase)
            elif phase is not None:
                waiting = phase not in TERMINAL
                yield Row(upload_id=key[0], state=phase)
            elif not there:
                yield Row(upload_id=key[0], state="not_found")
            else:
                if not waiting:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace_ms)
                waiting = True
                yield Row(upload_id=key[0], state="initializing")
        self.state.update((there, phase, at, waiting))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.state.exists():
            return
        there, phase, at, waiting = self.state.get()
        if waiting and phase is None:
            self.state.update((there, phase, at, False))
            yield Row(upload_id=key[0], state="lost")

    def close(self) -> None:
        pass


def told(events: DataFrame, ticks: int = TICKS, tick_seconds: float = TICK_SECONDS, days: int = DAYS) -> DataFrame:
    """(upload_id, state) of a stream of events, as they are told."""
    out = T.StructType([events.schema["upload_id"], T.StructField("state", T.StringType())])
    processor = Progress(round(ticks * tick_seconds * 1000), days * 86_400_000)
    return events.select("upload_id", "event", "phase", F.unix_micros("ts").alias("ts")).groupBy("upload_id").transformWithState(processor, out, "Append", "ProcessingTime")
