"""Growing logs: the batch operators' streaming forms. Late data is bounded by a watermark, duplicates are known by their id,
never by equal values."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..operators import logs as G
from ..session import checkpoint_dir

FIELDS = G.FIELDS
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_batches(out: str) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to its own folder by its number, so that one that is tried again replaces what it wrote."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return keep


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the data there is now, through a table in the shared folder. In update mode every micro-batch
    is kept with its number, and ``latest_of`` picks the last value of each key."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/table"

    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    query = writer.foreachBatch(keep_batches(out)).start() if mode == "update" else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    schema = StructType([*stream.schema, StructField("batch", IntegerType())]) if mode == "update" else stream.schema
    return spark.read.schema(schema).parquet(out)


def latest_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def ingest(lines: DataFrame) -> DataFrame:
    """New log lines (``session, ord, raw``) as events, each once."""
    return G.parse_events(lines)


def drop_replays(events: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events without replays of an id, with state for one watermark only; rows without an id pass."""
    known = events.filter("event_id IS NOT NULL").withWatermark(ts, delay).dropDuplicatesWithinWatermark(["session", "event_id"])
    return known.unionByName(events.filter("event_id IS NULL").withWatermark(ts, delay))


def usage_windows(usage: DataFrame, ts: str = "ts", delay: str = "1 hour", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Calls and tokens per session and time window."""
    rows = usage.withWatermark(ts, delay)
    return rows.groupBy(F.window(ts, size, slide or size), "session").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def activity_sessions(events: DataFrame, ts: str = "ts", delay: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    rows = events.withWatermark(ts, delay)
    return rows.groupBy(F.session_window(ts, gap), "session").agg(F.count("*").alias("events"))


class CounterDeltas(StatefulProcessor):
    """Cumulative totals to growth, per session. Rows wait in the state until the session's newest ``ord`` is ``delay`` beyond
    theirs (without a delay: until a row that ``closes`` them) and are taken in order, so that an old total sent again does not
    look like a reset. The state is the totals of the last row taken, how far rows were taken, the newest ord, and the waiting rows."""

    def __init__(self, delay: int | None) -> None:
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        def longs(*names: str) -> StructType:
            return StructType([StructField(n, LongType()) for n in names])
        self.last = handle.getValueState("last", longs(*FIELDS))
        self.reached = handle.getValueState("reached", longs("passed", "newest"))
        self.waiting = handle.getListState("waiting", longs("ord", *[f"total_{f}" for f in FIELDS], *[f"last_{f}" for f in FIELDS]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, n = pd.concat(list(rows)), len(FIELDS)
        passed, newest = self.reached.get() if self.reached.exists() else (None, None)
        ends = batch.loc[batch["closes"], "ord"]
        data = batch.loc[~batch["closes"], ["ord", *[f"total_{f}" for f in FIELDS], *[f"last_{f}" for f in FIELDS]]]
        new, made = [tuple(int(v) for v in r) for r in data.itertuples(index=False)], []
        made += [(str(key[0]), r[0], *r[1 + n:], 0, 1) for r in new if passed is not None and r[0] <= passed]
        new = [r for r in new if passed is None or r[0] > passed]
        newest = max([int(batch["ord"].max()), *([] if newest is None else [newest])])
        marks = [*([] if passed is None else [passed]), *([] if self.delay is None else [newest - self.delay]), *[int(v) for v in ends]]
        upto = max(marks, default=None)
        if upto == passed:
            if new:
                self.waiting.appendList(new)
        else:
            held = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *new])
            prev = self.last.get() if self.last.exists() else None
            for r in held:
                if r[0] > upto:
                    break
                total = r[1:1 + n]
                begins = prev is None or any(a < b for a, b in zip(total, prev))
                delta = r[1 + n:] if begins else tuple(a - b for a, b in zip(total, prev))
                same = not begins and total[0] == prev[0]
                prev = total
                if any(delta):
                    made.append((str(key[0]), r[0], *delta, int(same), 0))
            if prev is not None:
                self.last.update(tuple(prev))
            later = [tuple(r) for r in held if r[0] > upto]
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        self.reached.update((upto, newest))
        yield pd.DataFrame(made, columns=["session", "ord", *FIELDS, "same_call", "late"])

    def close(self) -> None:
        pass


def counter_deltas(events: DataFrame, delay: int | None = 0) -> DataFrame:
    """Growth of cumulative counters per session (a text key). Needs the RocksDB state store.

    Rows may come ``delay`` behind the newest ``ord`` of their session; without a delay all wait for a row whose ``closes`` is true, which
    has no growth of its own and lets rows up to its ``ord`` go. A row that comes after later ones were taken is given with ``late`` 1 and
    its own ``last_*``: between resets the next total already holds its growth, so late rows are not to be added up with the others."""
    schema = StructType([StructField("session", StringType()), *[StructField(c, LongType()) for c in ("ord", *G.FIELDS, "same_call", "late")]])
    rows = events if "closes" in events.columns else events.withColumn("closes", F.lit(False))
    return rows.groupBy("session").transformWithStateInPandas(CounterDeltas(delay), schema, "Append", "None")


def progress(events: DataFrame, step: Column) -> DataFrame:
    """The furthest step of each session and its latest gauge; steps only go forward."""
    return events.groupBy("session").agg(F.max(step).alias("step"), F.max_by("used", "ord").alias("used"))


class LiveProgress(StatefulProcessor):
    """The furthest step of a session and its latest gauge, till the session has been idle for ``idle_ms`` of event time: a timer then
    gives its last row and clears its state, so that the state holds the sessions that are alive, however many there were."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", StructType([StructField(n, LongType()) for n in ("step", "ord", "used", "until")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, last, used, until = self.at.get() if self.at.exists() else (None, None, None, None)
        ends = until
        for batch in rows:
            newest = batch.loc[batch["ord"].idxmax()]
            step = max(int(batch["step"].max()), step) if step is not None else int(batch["step"].max())
            if last is None or newest["ord"] > last:
                last, used = int(newest["ord"]), int(newest["used"])
            ends = max(int(batch["ms"].max()) + self.idle_ms, ends or 0)
        if ends != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(ends)
        self.at.update((step, last, used, ends))
        yield pd.DataFrame({"session": [str(key[0])], "step": [step], "used": [used], "ord": [last], "ended": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step, last, used, _ = self.at.get()
        self.at.clear()
        yield pd.DataFrame({"session": [str(key[0])], "step": [step], "used": [used], "ord": [last], "ended": [True]})

    def close(self) -> None:
        pass


def live_progress(events: DataFrame, step: Column, ts: str = "ts", delay: str = "1 hour", idle_seconds: int = 3600) -> DataFrame:
    """``progress`` with bounded state: (session, step, used, ord, ended), a row of each session that a micro-batch changes and one with ``ended``
    when no event came for ``idle_seconds``. A session that goes on after its end starts anew; over all rows of a session the greatest step and
    the ``used`` of the greatest ``ord`` are those of ``progress``. Events that come later than ``delay`` are dropped; ``ord`` and ``used`` are
    numbers and not null. Needs the RocksDB state store."""
    schema = StructType([StructField("session", StringType()), StructField("step", LongType()), StructField("used", LongType()), StructField("ord", LongType()), StructField("ended", BooleanType())])
    rows = events.withWatermark(ts, delay).select(F.col("session").cast("string").alias("session"), step.cast("long").alias("step"), F.col("used").cast("long").alias("used"),
                                                  F.col("ord").cast("long").alias("ord"), ts, F.unix_millis(ts).alias("ms"))
    return rows.groupBy("session").transformWithStateInPandas(LiveProgress(idle_seconds * 1000), schema, "Update", "EventTime")


def join_results(calls: DataFrame, results: DataFrame, delay: str = "2 hours", within: str = "1 hour", how: str = "inner") -> DataFrame:
    """Calls (``session, tool_id, call_ts``) with their results (``result_ts``) in time."""
    a = calls.withWatermark("call_ts", delay).alias("c")
    b = results.withWatermark("result_ts", delay).alias("r")
    near = F.expr(f"c.session = r.session AND c.tool_id = r.tool_id AND r.result_ts >= c.call_ts AND r.result_ts <= c.call_ts + INTERVAL {within}")
    return a.join(b, near, how).select("c.session", "c.tool_id", "c.call_id", "call_ts", "r.result_id", "result_ts")
