"""Counter rows: made once, and spread over as many tasks as shuffles have."""
from annolytics.operators import logs as G
from annolytics.plans import fixtures as fx

COUNTS = ", ".join(f"{p}_{f} long" for p in ("last", "total") for f in ("input", "cached", "output"))


class Events:
    def __init__(self, spark, events):
        self.spark, self.events = spark, events


def test_counter_rows_are_made_once(spark):
    rows = spark.range(60).selectExpr("id event_id", "id % 3 user_id", "timestamp_seconds(id) ts", "cast(id as double) value", "'click' event_type")
    out = fx.counters(Events(spark, rows))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1
    got = sorted((r.event_id, r.ord) for r in out.collect())
    first = {i: 2 * (i // 3 + 1) for i in range(60)}
    assert got == sorted([*first.items(), *((i, o + 31) for i, o in first.items() if i % 10 == 3)])


def test_chunks_of_counters_keep_their_partitions(spark):
    events = spark.createDataFrame([(1, i, i, 1, 0, 1, i + 1, 0, i + 1) for i in range(20)], f"session long, event_id long, ord long, {COUNTS}")
    calls = G.counter_calls(events, width=4)
    assert "REPARTITION_BY_NUM" in calls._jdf.queryExecution().executedPlan().toString()
    assert calls.agg({"input": "sum"}).first()[0] == 20 and calls.rdd.getNumPartitions() > 1


def test_tasks_of_counter_rows_stay_small(spark):
    rows = spark.range(3_000_000).selectExpr("id event_id", "id % 3000 user_id", "timestamp_seconds(id) ts", "cast(id as double) value", "'click' event_type")
    assert fx.counters(Events(spark, rows)).rdd.getNumPartitions() >= 22
