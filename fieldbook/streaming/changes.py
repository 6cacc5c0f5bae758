"""The queue of changes: a state machine in batch and as a stream."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

from fieldbook.functions.text import fnv1a, iso_text
from fieldbook.sources.commits import Lease, Snapshot, lease

EVENT = "change_id string, entry_id string, seq long, kind string, ts timestamp"
STATE = "change_id string, entry_id string, seq long, status string, attempts int, last_tried_ts timestamp, last_error string"
ERROR = "Mock API error (500)"
FORCED = "Mock API error (forced)"
OFFLINE = "Offline"


def enqueued(updates: DataFrame, now: Column) -> DataFrame:
    """New changes for updates (entry_id, blocks, pos), pending and not yet tried; collections.prepended puts them before a queue's.

    An id is chg-time-hash, where the hash follows from the update, so that a
    retried task makes the same one.
    """
    key = F.concat(F.lit("chg-"), iso_text(now), F.lit("-"), F.sha2(F.concat_ws("/", "entry_id", F.concat_ws(",", "blocks"), F.col("pos").cast("string")), 256).substr(1, 16))
    return updates.select(key.alias("id"), "pos", "entry_id", "blocks", F.lit("pending").alias("status"), now.alias("updated_ts"), F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("last_tried_ts"), F.lit(None).cast("string").alias("last_error"))


def fails_first(change_id: Column, attempts: Column) -> Column:
    """Whether the endpoint refuses: a first try of one id in five, by hash."""
    return (attempts == 0) & (F.pmod(fnv1a(change_id), F.lit(5)) == 0)


def would_try(entry: str | None = None, include_failed: bool = True) -> Column:
    """Whether a sync of one entry's changes, or of all, would try a change."""
    wanted = F.col("status").isin(["pending", "failed"] if include_failed else ["pending"])
    return wanted if entry is None else wanted & (F.col("entry_id") == entry)


def candidates(changes: DataFrame, entry: str | None = None, include_failed: bool = True) -> DataFrame:
    """The changes that a sync would try."""
    return changes.where(would_try(entry, include_failed))


def single_flight(spark: SparkSession, name: str, start: Callable[[], StreamingQuery], folder: str | None = None, seconds: float = 60.0) -> StreamingQuery | None:
    """start() a streaming query of this name, or None while one of this name runs: a second call is dropped.

    With a folder that several drivers share, only one of them runs it: a
    lease of so many seconds is renewed while the query runs and let go when
    it ends. A driver that dies lets others in when its lease expires; one
    that has lost its lease stops its query.
    """
    if any(q.name == name for q in spark.streams.active):
        return None
    held = lease(spark, folder, seconds) if folder else None
    if folder and held is None:
        return None
    try:
        query = start()
    except Exception:
        if held:
            held.release()
        raise
    if held:
        threading.Thread(target=_hold, args=(held, query, seconds), daemon=True).start()
    return query


def _hold(held: Lease, query: StreamingQuery, seconds: float) -> None:
    lost = False
    while query.isActive and not lost:
        deadline = time.monotonic() + seconds / 3
        while query.isActive and time.monotonic() < deadline:
            time.sleep(min(0.2, seconds / 10))
        lost = query.isActive and not held.renew(seconds)
    if lost:
        query.stop()
    else:
        held.release()


def synced(changes: DataFrame, now: Column, entry: str | None = None, include_failed: bool = True, online: bool = True, no_fail: bool = False, fail_next: bool = False) -> DataFrame:
    """changes after one sync: what it tried is synced or failed, with one more attempt.

    Offline everything fails, no_fail lets everything through, and fail_next
    refuses the first change of the queue that is tried: the one of the least
    seq, which is the newest, as new changes are put before the others.
    """
    hit, out = F.coalesce(would_try(entry, include_failed), F.lit(False)), changes
    if not online:
        error = F.lit(OFFLINE)
    elif no_fail:
        error = F.lit(None).cast("string")
    else:
        error = F.when(fails_first(F.col("id"), F.col("attempts")), ERROR)
        if fail_next:
            first = candidates(changes, entry, include_failed).agg(F.min(F.struct("seq", "id")).alias("_first"))  # one row
            out = changes.join(F.broadcast(first))
            error = F.when(F.struct("seq", "id") == F.col("_first"), FORCED).otherwise(error)
    out = out.withColumn("_error", error)
    return out.withColumns(
        {
            "status": F.when(hit, F.when(F.col("_error").isNull(), "synced").otherwise("failed")).otherwise(F.col("status")),
            "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "last_tried_ts": F.when(hit, now).otherwise(F.col("last_tried_ts")),
            "last_error": F.when(hit, F.col("_error")).otherwise(F.col("last_error")),
        }
    ).select(*changes.columns)


def cleared(changes: DataFrame) -> DataFrame:
    """The queue without what is synced, an extension."""
    return changes.where(F.col("status") != "synced")


def latest(events: DataFrame) -> DataFrame:
    """STATE of each change after all its events (EVENT): 'enqueue' makes it pending, each 'attempt' tries it.

    A pending or failed change is tried, a synced one is left alone; the first
    try fails for one id in five, so any second attempt succeeds.
    """
    by = events.groupBy("change_id").agg(F.max("entry_id").alias("entry_id"), F.max("seq").alias("seq"), F.count_if(F.col("kind") == "attempt").alias("asked"))
    # No more than the first two attempts of a change leave a partition.
    earliest = events.where("kind = 'attempt'").withColumn("n", F.row_number().over(Window.partitionBy("change_id").orderBy("seq", "ts"))).where("n <= 2")
    tries = earliest.groupBy("change_id").agg(*[F.max(F.when(F.col("n") == k, F.col("ts"))).alias(f"try_{k}") for k in (1, 2)])
    by = by.join(tries, "change_id", "left")
    bad = fails_first(F.col("change_id"), F.lit(0))
    attempts = F.least(F.col("asked"), F.when(bad, 2).otherwise(1)).cast("int")
    status = F.when(attempts == 0, "pending").when(bad & (attempts == 1), "failed").otherwise("synced")
    return by.select("change_id", "entry_id", "seq", status.alias("status"), attempts.alias("attempts"), F.when(attempts == 1, F.col("try_1")).when(attempts == 2, F.col("try_2")).alias("last_tried_ts"), F.when(status == "failed", ERROR).alias("last_error"))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, session, events, first, last): bursts of events with no longer pause than the gap, as a debounce sees them."""
    w = Window.partitionBy(key).orderBy(ts)
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    begins = F.when(pause.isNull() | (pause > gap_seconds * 1e6), 1).otherwise(0)
    numbered = events.withColumn("_new", begins).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


class _Queue(StatefulProcessor):
    """Keeps each change's state; an older event never overwrites a newer one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("change", "entry_id string, seq long, status string, attempts int, tried timestamp, error string, queued boolean", 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        entry, seq, status, attempts, tried, error, queued = tuple(old) if old is not None else (None, -1, "pending", 0, None, None, False)
        events = pd.concat(list(rows)).sort_values("seq")
        bad = _fnv(key[0]) % 5 == 0
        for e in events.itertuples():
            seq = max(seq, int(e.seq))
            entry = e.entry_id if entry is None else entry
            queued = queued or e.kind == "enqueue"
            if e.kind == "attempt" and status != "synced":
                failed = attempts == 0 and bad
                attempts, tried = attempts + 1, e.ts.to_pydatetime()
                status, error = ("failed", ERROR) if failed else ("synced", None)
        self.state.update((entry, seq, status, attempts, tried, error, queued))
        yield pd.DataFrame({"change_id": [key[0]], "entry_id": [entry], "seq": [seq], "status": [status], "attempts": [attempts], "last_tried_ts": [pd.Timestamp(tried) if tried else pd.NaT], "last_error": [error]})

    def close(self) -> None:
        pass


def _fnv(text: str) -> int:
    h = 2166136261
    data = text.encode("utf-16-le")
    for k in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[k : k + 2], "little")) * 16777619 & 0xFFFFFFFF
    return h


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of EVENT rows from JSON lines in a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def tracked(events: DataFrame) -> DataFrame:
    """STATE rows of a stream of events, one for each change that a batch touches; states are kept for a day.

    Needs the RocksDB state store provider.
    """
    return events.groupBy("change_id").transformWithStateInPandas(_Queue(), STATE, "Update", "ProcessingTime")


def newest(states: DataFrame) -> DataFrame:
    """One STATE row for each change, the one of the highest seq."""
    columns = [c for c in states.columns if c != "change_id"]
    return states.groupBy("change_id").agg(F.max_by(F.struct(*columns), "seq").alias("s")).select("change_id", "s.*")


def keep_latest(batch: DataFrame, path: str) -> DataFrame:
    """The newest rows of a folder of STATE rows and a new batch; a new folder beside it is written by the caller."""
    return newest(batch.sparkSession.read.schema(STATE).parquet(path).unionByName(batch))


def overwrite_latest(states: DataFrame, path: str, checkpoint: str, pause: str = "250 milliseconds"):
    """A streaming query writer that overwrites the whole table of states with each batch, at most once in a pause.

    Readers (commits.Snapshot) see the table before a batch or after it. A
    batch that is repeated after a crash takes effect once. The path belongs
    to this checkpoint: its versions are numbered as the batches are.
    """
    table = Snapshot(states.sparkSession, path)

    def put(batch: DataFrame, number: int) -> None:
        old = table.read()
        table.write(newest(batch if old is None else old.unionByName(batch)), number)

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=pause).foreachBatch(put)


BURST = "key string, events long, first timestamp, last timestamp"


class _Debounce(StatefulProcessor):
    """Bursts of a key's events that may still grow, each with a timer that fires a gap after its last event."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bursts = handle.getListState("bursts", "first long, last long, events long")

    def _keep(self, bursts: list[tuple[int, int, int]]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not bursts:
            self.bursts.clear()
            return
        self.bursts.put(bursts)
        for _, last, _ in bursts:
            self.handle.registerTimer(-(-last // 1000) + self.gap_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(t), 1) for batch in rows for t in batch["us"]]
        joined: list[tuple[int, int, int]] = []
        for first, last, n in sorted([*map(tuple, self.bursts.get()), *new]):
            if joined and first - joined[-1][1] <= self.gap_ms * 1000:
                joined[-1] = (joined[-1][0], max(last, joined[-1][1]), joined[-1][2] + n)
            else:
                joined.append((first, last, n))
        self._keep(joined)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        bursts = [tuple(b) for b in self.bursts.get()]
        over = [b for b in bursts if -(-b[1] // 1000) + self.gap_ms <= now]
        self._keep([b for b in bursts if b not in over])
        yield pd.DataFrame({"key": [key[0]] * len(over), "events": [b[2] for b in over], "first": pd.to_datetime([b[0] for b in over], unit="us"), "last": pd.to_datetime([b[1] for b in over], unit="us")})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, ts: str, gap_ms: int = 900, late: str = "10 seconds") -> DataFrame:
    """BURST rows of a stream: each key's bursts as `sessions` has them, one as soon as it has been quiet for the gap.

    Time is the events' own; those that come later than `late` after newer
    ones are dropped. What a burst starts, such as a sync of all that is
    pending, belongs to the sink. Needs the RocksDB state store provider.
    """
    timed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.withColumn("us", F.unix_micros("at")).groupBy("key").transformWithStateInPandas(_Debounce(gap_ms), BURST, "Append", "EventTime")


def write_latest(states: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends each batch's states under path/batch=N, so that a repeated batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n) of a stream or table of events (ts, event_type), an extension."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")

