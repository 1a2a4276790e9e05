"""Stateful operators of streams on Spark's typed state: value, list and map state, timers and time to live in the RocksDB store.

OrderedDetector puts a shuffled stream in order: rows wait in list state until the watermark has passed them, leave in the order of their
times by an event-time timer, and run through the detector, whose memory is value state. EventTracker turns the steps along a stream
into one row for each event, closed by a timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.scalar import label_of, stream_kind
from tidewatch.streaming.detector import STATE, STEP, Detector, in_buckets, known_detector, recalled, saved, step_series

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
def use_rocksdb(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store: an error says so where the session has another."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as an Arrow stream."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


class OrderedDetector(StatefulProcessor):
    """The detector over the rows of a bucket of series in the order of their times, however they arrive, up to a delay.

    The bound is the watermark plus `ahead_ms`. A row waits until the bound has passed its time, and one timer for each bucket fires when the
    first of those that wait may leave. What waits is kept as one Arrow stream for each micro-batch.
    Rows that arrive behind the bound aren't in order any more: they are returned at once with the note `late` and change nothing, as are
    `invalid` ones.
    """

    def __init__(self, text: str, ahead_ms: int):
        self.text, self.ahead_ms = text, ahead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", STATE)
        self.timer = handle.getValueState("timer", "ms long")
        self.waiting = handle.getListState("waiting", "rows binary")

    def _bound(self, timerValues) -> int:
        return (timerValues.getCurrentWatermarkInMs() + self.ahead_ms) * 1000

    def _wait_for(self, t_us: int) -> None:
        """A timer for when the bound is past t_us, if there is none that is earlier."""
        ms = max(1, t_us // 1000 + 1 - self.ahead_ms)
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is None or ms < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f for f in rows if len(f)], ignore_index=True).drop(columns=["_time", "_bucket"], errors="ignore")
        channels = [c for c in frame.columns if c[0] == "c" and c[1:].isdigit()]
        known = np.isfinite(frame[channels].to_numpy(float)).all(axis=1)
        held = known & (frame["t_us"].to_numpy() >= self._bound(timerValues))
        if held.any():
            self.waiting.appendValue(_packed(frame[held]))
            self._wait_for(int(frame["t_us"][held].min()))
        if not held.all():
            yield self._marked(frame[~held], known[~held])

    def _memories(self) -> dict:
        return recalled(self.memory.get()[0] if self.memory.exists() else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bound = self._bound(timerValues)
        self.timer.clear()
        parts = [pa.ipc.open_stream(bytes(r[0])).read_all().to_pandas() for r in self.waiting.get()]
        self.waiting.clear()
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        ready = rows["t_us"].to_numpy() < bound
        if not ready.all():
            self.waiting.appendValue(_packed(rows[~ready]))
            self._wait_for(int(rows["t_us"][~ready].min()))
        if ready.any():
            memories = self._memories()
            yield step_series(rows[ready], known_detector(self.text), memories)
            self.memory.update((saved(memories),))

    def _marked(self, rows: pd.DataFrame, known: np.ndarray) -> pd.DataFrame:
        n, memories = len(rows), self._memories()
        blank = {c: [None] * n for c in ("gap_sec", "short_score", "long_score")} | {"sample_score": [0.0] * n, "segment_reset": [False] * n}
        blank |= {c: [False] * n for c in ("sample_alarm", "short_alarm", "long_alarm", "or_3", "final_alarm")}
        segments = [memories[key].segment if key in memories else 0 for key in zip(rows["source"], rows["series"], strict=True)]
        blank |= {"segment_id": segments, "persistence_count": [0] * n, "active_detectors": [[] for _ in range(n)], "note": np.where(known, "late", "invalid").tolist()}
        same = {c: rows[c].tolist() for c in ("source", "series", "t_us", "seq", "kind")}
        return pd.DataFrame({**same, "ground_truth": pd.to_numeric(rows["truth"]).astype("Int32").array, **blank}, columns=[c.split()[0] for c in STEP.split(", ")])

    def close(self) -> None:
        pass


def milliseconds(span: str) -> int:
    return round(pd.Timedelta(span).total_seconds() * 1000)


def ordered_detection(stream: DataFrame, detector: Detector, delay: str, keep: str = "30 days") -> DataFrame:
    """detector.STEP columns of a stream of samples that may come up to `delay` (such as "10 minutes") late, as if it came in order.

    delay is behind the latest time of all rows of the micro-batches before. Rows that are later are returned with the note `late`, those
    later than `keep` are dropped and counted by Spark. Append mode. The last rows stay in state until later ones come.
    """
    use_rocksdb(stream.sparkSession)
    ahead = milliseconds(keep) - milliseconds(delay)
    if ahead < 0:
        raise ValueError("keep must not be shorter than delay")
    given = set(stream.columns)
    optional = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in given else F.lit(default)
    truth = label_of(F.col("state")) if "state" in given else F.lit(None).cast("int")
    source = optional("source", "external")
    channels = detector.settings.channels
    narrow = stream.select(
        source.alias("source"),
        F.col("series").cast("string").alias("series"),
        F.timestamp_micros("t_us").alias("_time"),
        "t_us",
        F.col("seq").cast("long").alias("seq"),
        stream_kind(source, optional("state", 0), optional("idle", 0)).alias("kind"),
        truth.alias("truth"),
        *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(channels)),
    )
    rows = in_buckets(narrow.withWatermark("_time", keep), "source", "series")
    return rows.transformWithStateInPandas(OrderedDetector(detector.to_json(), ahead), STEP, "append", "eventtime")


EVENT = "series string, event_id long, fault_start_us long, fault_end_us long, fault_rows long, detected boolean, first_alarm_us long, delay_sec double, delay_samples long, alarm_rows long"


class EventTracker(StatefulProcessor):
    """Runs of fault rows along each series of a bucket, in order: opened by the first, given its first alarm, closed by the next row of another kind or, if
    none comes, by a timer. Each event is written once."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # of each series the number of closed events and the open one, if any: start, last, rows, alarms, first alarm and its place
        self.series = handle.getValueState("series", "known string")
        self.timer = handle.getValueState("timer", "ms long")

    @staticmethod
    def _close(name, kept: list, out: list) -> None:
        start, last, rows, alarms, first, place = kept[1]
        found = first is not None
        kept[:] = [kept[0] + 1, None]
        out.append((name, kept[0], start, last, rows, found, first, (first - start) / 1e6 if found else None, place, alarms))

    def _known(self) -> dict:
        return {name: kept for name, *kept in json.loads(self.series.get()[0])} if self.series.exists() else {}

    def _keep(self, known: dict) -> None:
        """Saves the series; one timer for the first of their open events that may be over."""
        self.series.update((json.dumps([[name, *kept] for name, kept in known.items()]),))
        due = min((kept[1][1] // 1000 + self.quiet_ms for kept in known.values() if kept[1]), default=None)
        old = self.timer.get()[0] if self.timer.exists() else None
        if due == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if due is not None:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    @staticmethod
    def _rows(out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])
        return frame.astype({"first_alarm_us": "Int64", "delay_samples": "Int64", "delay_sec": "float64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        known = self._known()
        ordered = pd.concat([f for f in rows if len(f)]).sort_values(["t_us", "seq"], kind="stable")
        for name, t, kind, alarm in zip(*(ordered[c].tolist() for c in ("series", "t_us", "kind", "final_alarm")), strict=True):
            kept = known.setdefault(name, [0, None])
            if kind != "fault":
                if kept[1]:
                    self._close(name, kept, out)
                continue
            event = kept[1] = kept[1] or [t, t, 0, 0, None, None]
            if alarm and event[4] is None:
                event[4:] = [t, event[2]]
            event[1], event[2], event[3] = t, event[2] + 1, event[3] + bool(alarm)
        self._keep(known)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        out: list[tuple] = []
        known = self._known()
        for name, kept in known.items():
            # an event that has gone on since the timer was set waits for its own last row
            if kept[1] and kept[1][1] // 1000 + self.quiet_ms <= timerValues.getCurrentWatermarkInMs():
                self._close(name, kept, out)
        self._keep(known)
        if out:
            yield self._rows(out)

    def close(self) -> None:
        pass


def track_events(steps: DataFrame, quiet: str, delay: str) -> DataFrame:
    """Events of a stream of steps (series, t_us, seq, kind, final_alarm), each once: those of metrics.realtime_events, in order.

    quiet: after so long without rows an open event is closed. Append mode.
    """
    use_rocksdb(steps.sparkSession)
    rows = steps.select(F.col("series").cast("string").alias("series"), F.timestamp_micros("t_us").alias("_time"), "t_us", F.col("seq").cast("long").alias("seq"), "kind", "final_alarm")
    return in_buckets(rows.withWatermark("_time", delay), "series").transformWithStateInPandas(EventTracker(milliseconds(quiet)), EVENT, "append", "eventtime")
