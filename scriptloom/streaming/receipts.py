"""Receipts as a stream: commit accepted segments as they arrive, once each, and follow their states.

Keyed state is kept by ``transformWithState``, in RocksDB. Starting one of these queries sets the
session's state store provider to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.verify import classify_receipts, committable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = "segment_id string, state string, rounds int, reason string"
#: States that nothing leaves.
ENDED = ("done", "failed")


def read_receipts(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Receipt files under a path as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def dedupe_stream(receipts: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first receipt of each (fingerprint, segment) within ``delay`` of event time, whatever its outcome.

    For counting what was sent. To commit, use ``commit_segments``: it dedupes what was accepted,
    so a refused receipt never hides the good one after it.
    """
    return receipts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint", "segment_id"])


def _with_rocksdb(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


class FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through, of one batch the earliest by (ts, event_id); counts all others.

    The state of a key is the event that was let through and how many came after it. With ``ttl_ms`` it
    goes so long after the key's last row, and the key may come again.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "event_id bigint, repeats bigint", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best, n = None, 0
        for row in rows:
            n += 1
            if best is None or _at(row) < _at(best):
                best = row
        if self.first.exists():
            event_id, repeats = self.first.get()
            self.first.update((event_id, repeats + n))
        else:
            self.first.update((best["event_id"], n - 1))
            yield best

    def close(self) -> None:
        pass


def _at(row: Row) -> tuple:
    """Order of a key's rows in time, nulls first."""
    return tuple(y for x in (row["ts"], row["event_id"]) for y in ((False,) if x is None else (True, x)))


def first_committable(receipts: DataFrame, expected: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Of each (fingerprint, segment) the first receipt that may be committed (see ``committable``).

    Receipts are judged before they are deduped: a refused one leaves no trace in the state, so a
    good retry after it is committed, and a second good one isn't, also after a restart.
    """
    good = _with_rocksdb(committable(receipts, expected))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return good.groupBy("segment_id", "fingerprint").transformWithState(FirstOfKey(ttl_ms), good.schema, "append", mode)


def commit_segments(receipts: DataFrame, path: str, checkpoint: str, expected: DataFrame, ttl_ms: int | None = None):
    """Start a query that writes each segment's first committable receipt under ``path``, a folder per batch.

    A batch that is run again after a failure overwrites its own folder, and the state of batches
    before it knows which segments are there, so each (fingerprint, segment) is written once. Ends when
    all that is there has been read.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    rows = first_committable(receipts, expected, ttl_ms)
    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scene_counts(receipts: DataFrame) -> DataFrame:
    """Running counts and tokens per scene (segment) and outcome, for update mode."""
    return classify_receipts(receipts).groupBy("segment_id", "outcome").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"))


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Start a query that writes what each batch changes under ``path``; ends when all that is there has been read."""

    def update(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return counts.writeStream.foreachBatch(update).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of each scene and outcome as of the last batch that changed them."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct("n", "prompt_tokens"), "batch").alias("last")
    return rows.groupBy("segment_id", "outcome").agg(last).select("segment_id", "outcome", "last.n", "last.prompt_tokens")


class SegmentStates(StatefulProcessor):
    """pending, extracted, audited, then done or failed.

    An extraction makes a segment extracted. An audit that finds nothing missing ends it as done; one
    that does makes it audited, and failed if it was the last of ``most`` rounds. Where nothing
    happens for ``stall_ms`` of event time it fails as stalled. What has ended stays as it is.
    """

    def __init__(self, most: int = 2, stall_ms: int | None = None):
        self.most = most
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, rounds int, due bigint")

    def _move(self, key: Any, state: str, rounds: int, due: int, reason: str | None) -> Row:
        self.state.update((state, rounds, due))
        return Row(segment_id=key[0], state=state, rounds=rounds, reason=reason)

    def _set_timer(self, old: int, new: int) -> None:
        if old:
            self.handle.deleteTimer(old)
        if new:
            self.handle.registerTimer(new)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.state.update((initialState["state"], initialState["rounds"] or 0, 0))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state, rounds, due = self.state.get() if self.state.exists() else ("pending", 0, 0)
        audits: list[tuple] = []  # the earliest that can still count, the last of them on top
        last, extracted = None, False
        for n, row in enumerate(rows):
            if row["at"] is not None:
                last = row["at"] if last is None else max(last, row["at"])
            if row["kind"] == "extracted":
                extracted = True
            elif row["kind"] == "audit":
                heapq.heappush(audits, _Latest((*_at(row), n), row["missing"]))
                if len(audits) > self.most:
                    heapq.heappop(audits)
        if state in ENDED:
            return
        if extracted and state == "pending":
            state = "extracted"
        for audit in sorted(audits, reverse=True):
            if state in ENDED:
                break
            rounds += 1
            state = "done" if audit.missing == 0 else "failed" if rounds >= self.most else "audited"
        new = 0
        if state not in ENDED and self.stall_ms is not None and last is not None:
            new = max(due, last // 1000 + self.stall_ms)
        if new != due:
            self._set_timer(due, new)
        yield self._move(key, state, rounds, new, "missing" if state == "failed" else None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state, rounds, due = self.state.get()
        if state not in ENDED and due == expiredTimerInfo.getExpiryTimeInMs():
            yield self._move(key, "failed", rounds, 0, "stalled")

    def close(self) -> None:
        pass


class _Latest:
    """An audit in the order of time, backwards, for a heap that keeps the earliest."""

    __slots__ = ("missing", "order")

    def __init__(self, order: tuple, missing: int | None):
        self.order, self.missing = order, missing

    def __lt__(self, other: _Latest) -> bool:
        return self.order > other.order


def segment_states(events: DataFrame, most: int = 2, stall: timedelta | None = None, delay: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """``(segment_id, state, rounds, reason)`` in update mode, a row for each change of a segment.

    events: segment_id, ts, event_id, kind (extracted or audit) and how many units an audit found
    ``missing`` (null counts as some). Events of one batch are taken in the order of (ts, event_id), batches as they come.
    With ``stall`` segments without an event for so long of event time, by a
    watermark ``delay`` behind, fail. initial: ``(segment_id, state, rounds)`` of earlier runs.
    The batch twin over whole tables is ``audit_rounds``.
    """
    ts = F.col("ts").cast("timestamp")
    rows = _with_rocksdb(events.select("segment_id", ts.alias("ts"), "event_id", "kind", "missing", F.unix_micros(ts).alias("at")))
    if stall is not None:
        rows = rows.withWatermark("ts", delay)
    stall_ms = None if stall is None else int(stall.total_seconds() * 1000)
    first = None if initial is None else initial.select("segment_id", "state", "rounds").groupBy("segment_id")
    processor = SegmentStates(most, stall_ms)
    return rows.groupBy("segment_id").transformWithState(processor, T._parse_datatype_string(STATES), "update", "None" if stall is None else "EventTime", first)


def write_states(states: DataFrame, path: str, checkpoint: str):
    """Start a query that writes what each batch changes under ``path``; ends when all that is there has been read."""

    def update(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return states.writeStream.foreachBatch(update).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """``(segment_id, state, rounds, reason)`` as of the last batch that changed each segment.

    Within a batch a segment may change twice, by rows and by a timer; ended states come last.
    """
    rows = spark.read.schema(f"{STATES}, batch bigint").parquet(path)
    last = F.max_by(F.struct("state", "rounds", "reason"), F.struct("batch", F.col("state").isin(*ENDED))).alias("last")
    return rows.groupBy("segment_id").agg(last).select("segment_id", "last.*")
