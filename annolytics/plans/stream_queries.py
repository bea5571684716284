"""The streaming forms over the events table as a growing log, run for what is there."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as G
from ..streaming import streams as S
from . import fixtures as fx
from .fixtures import COUNTERS_SQL
from .registry import Tables, query


def _stream(t: Tables):
    """The events table as a stream; its times are UTC."""
    schema = t.events.schema
    rows = t.spark.readStream.schema(schema).parquet(f"{t.folder}/events*.parquet")
    return rows.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))


def _view(t: Tables, rows, sql: str):
    rows.createOrReplaceTempView("annolytics_event_stream")
    return t.spark.sql(sql.replace("FROM events)", "FROM annolytics_event_stream)"))


STREAM_LOG = f"log AS ({fx.LOG_BODY})"


@query("s01_ingest", STREAM_LOG, "SELECT session, ord, coalesce(raw::JSON->>'$.type', '') AS type FROM log WHERE starts_with(trim(raw), '{') AND json_valid(raw)")
def ingest(t: Tables):
    lines = _view(t, _stream(t), fx.LOG_BODY)
    rows = S.ingest(lines).select("session", "ord", F.coalesce(G.get("type"), F.lit("")).alias("type"))
    return S.run_available(rows)


@query("s02_replays", "SELECT user_id AS session, event_id, event_type FROM events")
def replays(t: Tables):
    rows = _stream(t).select(F.col("user_id").alias("session"), "event_id", "event_type", "ts")
    again = _stream(t).filter("event_id % 10 = 3").select(F.col("user_id").alias("session"), "event_id", "event_type", "ts")
    return S.run_available(S.drop_replays(rows.unionByName(again))).select("session", "event_id", "event_type")


@query("s03_usage_windows", """ended AS (SELECT user_id AS session, time_bucket(INTERVAL '5 minutes', ts) AS w, CAST(round(value * 100) AS BIGINT) AS tokens FROM events)""", """
SELECT epoch(w)::BIGINT AS start, session, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM ended
WHERE w + INTERVAL '5 minutes' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY w, session""")
def usage_windows(t: Tables):
    rows = _stream(t).select(F.col("user_id").alias("session"), "ts", F.round(F.col("value") * 100).cast("long").alias("tokens"))
    return S.run_available(S.usage_windows(rows)).select(F.unix_seconds("window.start").alias("start"), "session", "calls", "tokens")


@query("s04_activity", """gaps AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS g FROM events),
runs AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts) AS r FROM gaps)""", """
SELECT user_id AS session, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS events FROM runs GROUP BY user_id, r HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""")
def activity(t: Tables):
    rows = _stream(t).select(F.col("user_id").alias("session"), "ts")
    out = S.run_available(S.activity_sessions(rows, gap="6 hours"))
    return out.select("session", F.floor(F.unix_micros("session_window.start") / 1000000).cast("long").alias("start"), "events")


@query("s05_counter_deltas", COUNTERS_SQL, """SELECT session, CAST(sum(last_input) AS BIGINT) AS input, CAST(sum(last_cached) AS BIGINT) AS cached, CAST(sum(last_output) AS BIGINT) AS output FROM first_counters GROUP BY session""")
def counter_deltas(t: Tables):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    import uuid

    from ..session import checkpoint_dir
    path = f"{checkpoint_dir(t.spark)}/counters-{uuid.uuid4().hex}"
    G.first_records(fx.counters(t)).withColumns({"session": F.col("session").cast("string"), "closes": F.lit(False)}).write.parquet(path)
    # files come in any order: rows wait for the row that closes their session, in files written after all others
    known = t.spark.read.parquet(path)
    ends = known.groupBy("session").agg(F.max("ord").alias("ord")).withColumn("closes", F.lit(True))
    ends.select(*[F.col(c) if c in ends.columns else F.lit(0).cast(known.schema[c].dataType).alias(c) for c in known.columns]).write.mode("append").parquet(path)
    rows = t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1000).parquet(path)
    out = S.run_available(S.counter_deltas(rows, delay=None)).filter("late = 0")
    return out.groupBy(F.col("session").cast("long").alias("session")).agg(*[F.sum(f).alias(f) for f in G.FIELDS])


STEPS = """CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END"""


@query("s06_progress", f"SELECT user_id AS session, max({STEPS}) AS step, arg_max(CAST(round(value) AS BIGINT), event_id) AS used FROM events GROUP BY user_id")
def progress(t: Tables):
    rows = _stream(t).select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.expr(STEPS).alias("at"), F.round("value").cast("long").alias("used"))
    return S.latest_of(S.run_available(S.progress(rows, F.col("at")), "update"), ["session"])


@query("s06_live_progress", f"SELECT user_id AS session, max({STEPS}) AS step, arg_max(CAST(round(value) AS BIGINT), event_id) AS used FROM events GROUP BY user_id")
def live_progress(t: Tables):
    """Progress whose state forgets sessions idle for two days: the rows of all runs of a session together."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    rows = _stream(t).select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.expr(STEPS).alias("at"), F.round("value").alias("used"), "ts")
    out = S.run_available(S.live_progress(rows, F.col("at"), delay="30 days", idle_seconds=2 * 86400), "update")
    return out.groupBy(F.col("session").cast("long").alias("session")).agg(F.max("step").cast("int").alias("step"), F.max_by("used", "ord").alias("used"))


@query("s07_call_results", """calls AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), results AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view')""", """
SELECT c.user_id AS session, c.event_id AS call_id, r.event_id AS result_id FROM calls c JOIN results r ON c.user_id = r.user_id AND c.event_id % 3 = r.event_id % 3 AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL '12 hours'""")
def call_results(t: Tables):
    def side(kind, name):
        return _stream(t).filter(F.col("event_type") == kind).select(F.col("user_id").alias("session"), (F.col("event_id") % 3).alias("tool_id"),
                                                                     F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))
    joined = S.join_results(side("click", "call"), side("view", "result"), delay="13 hours", within="12 hours")
    return S.run_available(joined).select("session", "call_id", "result_id")
