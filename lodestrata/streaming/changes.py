"""Change streams: file events, throttle and debounce per key, incremental maintenance, event routing.

The throttle, both debounces and the maintenance have a batch form over a finished table of events and a streaming form with the same
results; the routing of runtime events and the single flight are batch only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

THROTTLE_MS, DEBOUNCE_MS, GENERATE_MS, REVERSE_MS, POLL_MS, BUFFER = 120, 300, 1500, 2000, 250, 50
# fixed values: extensions of watched files
WATCHED = ("dart", "kt", "java", "xml", "gradle", "kts", "ts", "tsx", "js", "jsx", "arb")


def file_changes(spark: SparkSession, path: str, schema: str = "path string, op string, ts timestamp") -> DataFrame:
    """A stream of change-log rows; a file source alone would not see deletions."""
    return spark.readStream.schema(schema).json(path)


def file_events(events: DataFrame, present: Column | None = None) -> DataFrame:
    """Events of watched files as Modified or Removed; a modification of a file that is gone is a removal."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    gone = F.col("op").isin("Removed", "remove", "delete")
    if present is not None:
        gone = gone | ~present
    return events.where(ext.isin(*WATCHED)).withColumn("op", F.when(gone, "Removed").otherwise("Modified"))


def throttled(events: DataFrame, keys: list[str], ms: int = THROTTLE_MS, ts: str = "ts") -> DataFrame:
    """(keys, at): accepted event times.  Whether one counts depends on the last that did, so a run's times are taken in order.

    Runs of events further apart than ``ms`` cannot influence each other: they are found first with a lag window and dealt out
    by key and run.  A run streams through its task sorted by Spark, which can spill; only the last accepted time is held.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("t")
    rows = events.select(*keys, F.unix_millis(F.col(ts).cast("timestamp")).alias("t")).where("t is not null")
    rows = rows.withColumn("begins", F.coalesce((F.col("t") - F.lag("t").over(w) >= ms).cast("int"), F.lit(1))).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.drop("begins").repartition(*keys, "run").sortWithinPartitions(*keys, "run", "t")

    def accept(batches):
        last_run, last = None, None
        for batch in batches:
            runs, keep = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "run")))), []
            for run, t in zip(runs, batch.column("t").to_pylist()):
                fits = run != last_run or t - last >= ms
                keep.append(fits)
                if fits:
                    last_run, last = run, t
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(accept, rows.schema).select(*keys, F.timestamp_millis("t").alias("at"))


class Throttle(StatefulProcessor):
    """Keeps the last accepted time of each key."""

    def __init__(self, ms: int = THROTTLE_MS):
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        times = sorted(t for batch in rows for t in batch["t"].tolist())
        out = []
        for t in times:
            if last is None or t - last >= self.ms:
                last = t
                out.append(t)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "t": out})

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame, key: str, ms: int = THROTTLE_MS, ts: str = "ts") -> DataFrame:
    """(key, t): streaming form; needs the RocksDB state store."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("t"))
    return rows.groupBy("key").transformWithStateInPandas(Throttle(ms), "key string, t long", "append", "none")


def debounced(events: DataFrame, keys: list[str], ms: int = DEBOUNCE_MS, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """(keys, began, fires, n): one run for each burst of events, ``ms`` after its last.  Batch and streaming.

    With keys empty the debounce is global.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark(ts, watermark)
    w = F.session_window(ts, f"{ms} milliseconds")
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("began"), F.col("w.end").alias("fires"), "n")


def debounced_changes(events: DataFrame, keys: list[str], ms: int = DEBOUNCE_MS, ts: str = "ts", op: str = "op", span_ms: int = 86_400_000) -> DataFrame:
    """(keys, at, op): runs for changed and removed paths, times in ms.

    A change runs ``ms`` later unless another event of the key comes before that; a removal cancels what is pending and runs at
    once.  The next event is looked up within spans of time, and beyond a span's end by the first event of the next, so that
    a key with very many events is not one group.
    """
    from pyspark.sql import Window

    rows = events.select(*keys, F.unix_millis(F.col(ts).cast("timestamp")).alias("t"), F.col(op).alias("op")).where("t is not null")
    rows = rows.withColumn("span", F.floor(F.col("t") / span_ms))
    first = rows.groupBy(*keys, "span").agg(F.min("t").alias("first"))
    after = first.withColumn("after", F.lead("first").over(Window.partitionBy(*keys).orderBy("span"))).drop("first")
    # of equal times the removal is last, so it cancels
    w = Window.partitionBy(*keys, "span").orderBy("t", F.col("op") == "Removed")
    rows = rows.withColumn("next", F.lead("t").over(w)).join(after, [*keys, "span"]).withColumn("next", F.coalesce("next", "after"))
    gone = F.col("op") == "Removed"
    quiet = F.col("next").isNull() | (F.col("next") - F.col("t") >= ms)
    return rows.where(gone | quiet).select(*keys, F.when(gone, F.col("t")).otherwise(F.col("t") + ms).alias("at"), "op")


class Debounce(StatefulProcessor):
    """Holds the events of each key until the watermark shows that nothing can come between them and the end of their quiet time.

    An event is decided when its timer fires, ``ms`` after it: everything up to then has arrived, so out-of-order events within the watermark's delay
    change nothing.  Only undecided events are held.
    """

    def __init__(self, ms: int = DEBOUNCE_MS):
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long, removed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for t, removed in zip(batch["t"].tolist(), batch["removed"].tolist()):
                self.held.appendValue((int(t), bool(removed)))
                self.handle.registerTimer(int(t) + self.ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = expiredTimerInfo.getExpiryTimeInMs()
        events = sorted(self.held.get()) if self.held.exists() else []  # of equal times the removal is last
        out, rest = [], []
        for k, (t, removed) in enumerate(events):
            if t + self.ms > over:
                rest.append((t, removed))
            elif removed:
                out.append((t, "Removed"))
            elif k + 1 == len(events) or events[k + 1][0] - t >= self.ms:
                out.append((t + self.ms, "Modified"))
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        return iter([pd.DataFrame({"key": [key[0]] * len(out), "at": [t for t, _ in out], "op": [op for _, op in out]})] if out else ())

    def close(self) -> None:
        pass


def debounced_changes_stream(events: DataFrame, key: str, delay: str, ms: int = DEBOUNCE_MS, ts: str = "ts", op: str = "op") -> DataFrame:
    """(key, at, op): the streaming form of ``debounced_changes``; events may come late by ``delay``.  Needs the RocksDB state store.

    Times of runs are in ms; a key's rows come when the watermark has passed them.  Any op but ``Removed`` is a change and is named ``Modified``.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    rows = rows.select(F.col(key).cast("string").alias("key"), ts, F.unix_millis(ts).alias("t"), (F.col(op) == "Removed").alias("removed"))
    return rows.groupBy("key").transformWithStateInPandas(Debounce(ms), "key string, at long, op string", "append", "eventTime")


def single_flight(requests: DataFrame, run_ms: int, ts: str = "ts") -> list[tuple[int, int]]:
    """Begin and end (epoch ms) of runs of a job that takes run_ms: requests during a run cause one more run after it.

    The requests are debounced ones, which the driver may hold: there is at most one for each quiet period.
    """
    runs: list[tuple[int, int]] = []
    for (t,) in requests.select(F.unix_millis(F.col(ts).cast("timestamp"))).orderBy(1).toLocalIterator():
        if not runs or t >= runs[-1][1]:
            runs.append((t, t + run_ms))
        elif t >= runs[-1][0]:
            runs.append((runs[-1][1], runs[-1][1] + run_ms))
    return runs


def incremental(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Work of a batch of changes (path, op, content, hash, ts): the last change of each path, with what to do about it.

    skip: the hash is what is stored; upsert: parse and replace; delete: remove the path's rows everywhere.
    """
    from lodestrata.sources.store import latest

    last = latest(changes, ["path"], ["ts"])
    j = last.join(stored.select("path", F.col("hash").alias("old")), "path", "left")
    action = F.when(F.col("op") == "Removed", "delete").when(F.col("old") == F.col("hash"), "skip").otherwise("upsert")
    return j.withColumn("action", action).drop("old")


def maintain(stream: DataFrame, read: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = f"{POLL_MS} milliseconds", once: bool = False):
    """Run incremental() on each micro-batch, every so often, and hand the work to ``apply(work, batch_id)``, which must be idempotent.

    once: take what there is and stop.
    """

    def batch(df: DataFrame, number: int) -> None:
        apply(incremental(read(), df).where("action != 'skip'"), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def runtime_errors(events: DataFrame, size: int = BUFFER) -> DataFrame:
    """The newest errors of each stream of runtime events (stream, ts, kind, message)."""
    from lodestrata.sources.store import ring_buffer

    return ring_buffer(events.where(F.lower("kind").rlike("error|exception")), ["stream"], ["ts", "message"], size)
