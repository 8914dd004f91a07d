"""Incremental intake with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.snapshots import HASHES
from ..sources.ledger import Ledger
from ..sources.scratch import new_path


def intake(spark: SparkSession, path: str, schema: str, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append") -> None:
    """Drain what has landed and stop; the checkpoint makes the next call go on after the last finished batch."""
    out = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = out.foreachBatch(write).start() if write else out.format("parquet").start(path)
    try:
        query.awaitTermination()
    finally:
        query.stop()


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All rows an append stream gives for what has landed so far, as a table in the shared folder."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    run(stream, f"{path}-checkpoint", path=path)
    return spark.read.schema(stream.schema).parquet(path)


def admit(batch: DataFrame, checkpoints: DataFrame, force: bool = False) -> DataFrame:
    """T2 on a micro-batch: rows strictly older than their source's mark are late; undated rows always pass."""
    from ..operators.snapshots import admit as rule
    return rule(batch, checkpoints, force)


def dedupe(items: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """T4: each key once within the watermark's delay."""
    return items.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


#: Keys of the state of snapshot changes.
BUCKETS = 8192


class _Hashes(StatefulProcessor):
    """The last hash of each kind of the sources of one bucket; the state is written only where one differs."""

    def __init__(self, kinds: list[str]):
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        hashes = ", ".join(f"{k}: string" for k in self.kinds)
        self.last = handle.getValueState("last", f"sources array<struct<source_id: bigint, {hashes}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self.last.get()
        last, differs = {source: hashes for source, *hashes in found[0]} if found else {}, False
        for source, version, *hashes, _ in sorted(rows, key=lambda r: (r[1] is None, r[1])):
            old = last.get(source)
            merged = [h if h is not None else o for h, o in zip(hashes, old or [None] * len(hashes))]
            if merged != (old or [None] * len(hashes)):
                yield Row(source_id=source, version=version, change="CHANGED" if old else "CREATED")
                last[source], differs = merged, True
        if differs:
            self.last.update(([(source, *hashes) for source, hashes in last.items()],))


def snapshot_changes(items: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Items (source_id, version, and any of page_hash, text_hash, metadata_hash) that differ from what is known of their source.

    The state is the last hash of each kind; a null hash says nothing and keeps the old one. Within a micro-batch
    versions are taken in order. A source has a row or two, so a call and a state of its own would cost far more than its
    work: sources are dealt by a hash into ``buckets`` that have their state together. A batch reads and writes the buckets
    it touches; the number belongs to the checkpoint. It needs the RocksDB state store (see ``with_rocksdb``).
    """
    kinds = [h for h in HASHES if h in items.columns]
    dealt = items.select(F.col("source_id").cast("long").alias("source_id"), "version", *kinds, F.pmod(F.xxhash64("source_id"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").transformWithState(_Hashes(kinds), "source_id long, version int, change string", "append", "none")


def windows(events: DataFrame, size: str = "1 hour", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """T8, first half: counts per window and type, tumbling or (with ``slide``) sliding, final once the watermark has passed."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "event_type", "n"))


def alerts(counts: DataFrame, factor: float = 2.0, back: int = 24) -> DataFrame:
    """T8, second half: windows with more than factor times the mean of the windows before them."""
    w = Window.partitionBy("event_type").orderBy("window_start").rowsBetween(-back, -1)
    return counts.withColumn("trailing_mean", F.round(F.avg("n").over(w), 6)).withColumn(
        "alert", F.coalesce(F.col("n") > F.col("trailing_mean") * factor, F.lit(False)))


class _Trailing(StatefulProcessor):
    """Counts of a key's open windows, and of the last closed ones; a timer at the end of the next window closes it."""

    def __init__(self, size_ms: int, back: int, factor: float):
        self.size, self.back, self.factor = size_ms, back, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "n long")
        self.closed = handle.getValueState("closed", "next long, counts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = self.closed.get() if self.closed.exists() else None
        for frame in rows:
            starts = frame["ms"] // self.size * self.size
            for start, n in starts.value_counts().items():
                if closed is None or start >= closed[0]:  # its window is not closed yet
                    had = self.open.getValue((int(start),)) if self.open.containsKey((int(start),)) else (0,)
                    self.open.updateValue((int(start),), (int(had[0]) + int(n),))
        waiting = [k[0] for k in self.open.keys()]
        if closed is None and waiting:
            self.closed.update((min(waiting), []))
            self._wait(min(waiting) + self.size)
        elif closed is not None and closed[1] == [] and waiting and min(waiting) < closed[0]:
            self.closed.update((min(waiting), []))
            self._wait(min(waiting) + self.size)
        yield from ()

    def _wait(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, counts = self.closed.get()
        counts, out = [int(c) for c in counts], []
        while at + self.size <= timerValues.getCurrentWatermarkInMs():
            n = int(self.open.getValue((at,))[0]) if self.open.containsKey((at,)) else 0
            self.open.removeKey((at,))
            mean = round(sum(counts) / len(counts), 6) if counts else None
            out.append((pd.Timestamp(at, unit="ms"), key[0], n, mean, mean is not None and n > mean * self.factor))
            counts, at = [*counts, n][-self.back:], at + self.size
        self.closed.update((at, counts))
        self._wait(at + self.size)
        if out:
            yield pd.DataFrame(out, columns=["window_start", "event_type", "n", "trailing_mean", "alert"]).astype({"trailing_mean": "float64"})


def stream_alerts(events: DataFrame, size: str = "1 hour", delay: str = "1 hour", factor: float = 2.0, back: int = 24) -> DataFrame:
    """T8 in the stream: every closed window of a type from its first on, empty ones too, with the mean of up to ``back`` windows before it.

    events (event_type, ts). State is the counts of open windows and of the last ``back`` closed ones. It needs the
    RocksDB state store (see ``with_rocksdb``).
    """
    ms = int(pd.Timedelta(size).total_seconds() * 1000)
    rows = events.withWatermark("ts", delay).select("event_type", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("event_type").transformWithStateInPandas(
        _Trailing(ms, back, factor), "window_start timestamp, event_type string, n long, trailing_mean double, alert boolean", "append", "eventTime")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and typed state need, for the queries that start inside; the session is left as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def latest_updates(events: DataFrame, docs: DataFrame) -> DataFrame:
    """A stream of events with the documents they are about."""
    return events.join(docs.select("document_id", "document_number", "title"), "document_id")


def due(queue: DataFrame, now: str) -> DataFrame:
    """Entries to try now: due, not leased, attempts left."""
    t = F.lit(now).cast("timestamp_ntz")
    return queue.where((F.col("next_retry_at") <= t) & (F.col("lease_until").isNull() | (F.col("lease_until") < t)) & (F.col("attempts") < 3))


class _Queue(StatefulProcessor):
    """One entry of the retry queue: attempts, when it is due, who holds it until when; a timer ends the lease."""

    def __init__(self, lease_ms: int, most: int):
        self.lease, self.most = lease_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "state string, attempts int, due long, lease long")

    def _tried(self, attempts: int, at: int) -> tuple:
        attempts += 1
        if attempts >= self.most:
            return "failed", attempts, at, None
        return "waiting", attempts, at + T.RETRY_HOURS[min(attempts, len(T.RETRY_HOURS)) - 1] * 3_600_000, None

    def _keep(self, key, rows: list, entry: tuple, at: int, change: str) -> tuple:
        self.entry.update(entry)
        rows.append((key[0], pd.Timestamp(at, unit="ms"), change, entry[0], entry[1], pd.Timestamp(entry[2], unit="ms"), None if entry[3] is None else pd.Timestamp(entry[3], unit="ms")))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if entry[3] is not None:
            self.handle.registerTimer(entry[3])
        return entry

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["item_id", "at", "change", "state", "attempts", "next_retry_at", "lease_until"]).astype({"lease_until": "datetime64[ns]"})

    def handleInputRows(self, key, frames, timerValues) -> Iterator[pd.DataFrame]:
        out: list = []
        given = pd.concat(list(frames)).sort_values(["ms", "kind"], kind="stable")
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        for at, kind in zip(given["ms"].tolist(), given["kind"].tolist()):
            if entry is None:
                entry = self._keep(key, out, ("waiting", 0, at, None), at, "queued")
            state, attempts, due_at, lease = entry
            if lease is not None and lease < at:
                entry = self._keep(key, out, self._tried(attempts, lease), lease, "lease expired")
                state, attempts, due_at, lease = entry
            if kind == "claim" and state == "waiting" and due_at <= at and lease is None:
                entry = self._keep(key, out, (state, attempts, due_at, at + self.lease), at, "claimed")
            elif kind == "failure" and lease is not None:
                entry = self._keep(key, out, self._tried(attempts, at), at, "failure")
            elif kind == "success" and lease is not None:
                entry = self._keep(key, out, ("done", attempts, due_at, None), at, "success")
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, attempts, _, lease = self.entry.get()
        out: list = []
        if lease is not None and lease <= timerValues.getCurrentWatermarkInMs():
            self._keep(key, out, self._tried(attempts, lease), lease, "lease expired")
            yield self._frame(out)
        else:
            yield from ()


def retry_queue(messages: DataFrame, lease: str = "1 hour", most: int = 3, delay: str = "1 hour") -> DataFrame:
    """T6 as a stream of messages (item_id, ts, kind: claim, success or failure): every change of every queue entry.

    An entry begins with its first message. A claim holds it if it is due and free; a failure, or a lease that ends
    without a result, is an attempt, after which it is due 6, 24 or 72 hours later (without jitter, so that claims are
    judged alike everywhere); after ``most`` attempts it has failed. Other messages change nothing. It needs the RocksDB
    state store (see ``with_rocksdb``).
    """
    rows = messages.withWatermark("ts", delay).select("item_id", "ts", "kind", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("item_id").transformWithStateInPandas(
        _Queue(int(pd.Timedelta(lease).total_seconds() * 1000), most), "item_id long, at timestamp, change string, state string, attempts int, next_retry_at timestamp, lease_until timestamp", "append", "eventTime")


def reschedule(queue: DataFrame, now: str) -> DataFrame:
    return queue.withColumn("attempts", F.col("attempts") + 1).withColumn(
        "next_retry_at", T.next_retry(F.col("attempts"), F.col("item_id"), F.lit(now)))


def tagged(batch: DataFrame, group: str) -> DataFrame:
    """batch with the circuit of each row's group. Rows without a group are one group."""
    from ..operators.audit import drift
    state = drift(batch, group).select(F.col(group).alias("_group"), "circuit")
    return batch.join(state, batch[group].eqNullSafe(F.col("_group"))).drop("_group")


def drift_gate(batch: DataFrame, group: str, write: Callable[[DataFrame], None], divert: Callable[[DataFrame], None]) -> None:
    """Groups of the real batch with a degraded circuit are diverted, the others written; two writes (``drift_stream`` makes them one)."""
    rows = tagged(batch, group)
    write(rows.where("circuit = 'HEALTHY'").drop("circuit"))
    divert(rows.where("circuit <> 'HEALTHY'").drop("circuit"))


def drift_stream(stream: DataFrame, group: str, ledger: Ledger, checkpoint: str) -> None:
    """T7 on a stream: both lanes of a micro-batch become visible together, once, in the ledger's tables written and diverted."""
    from ..operators.intake import drift_lanes
    run(stream, checkpoint, write=ledger.sink(lambda batch: drift_lanes(batch, group)))


def intake_run(stream: DataFrame, ledger: Ledger, checkpoint: str, force: bool = False, before_commit: Callable[[int], None] | None = None) -> None:
    """Drain a stream of items into the ledger's tables; marks move with the rows that move them."""
    from ..operators.intake import build
    run(stream, checkpoint, write=ledger.sink(lambda batch: build(ledger, batch, force), before_commit))


def backfill(items: DataFrame, start: str, end: str) -> DataFrame:
    """The batch form over a range of dates, both ends in."""
    return items.where(F.col("published").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def reconcile(listing: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Listed items that have not landed."""
    return listing.join(landed, keys, "left_anti")
