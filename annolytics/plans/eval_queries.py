"""Scores of runs against a baseline; orders stand for runs, customers for papers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evals as E
from ..operators import logs as G
from ..operators import profile as P
from . import fixtures as fx
from .log_queries import BLOCKS, COSTS, TO_RECORDS, _blocks, _events
from .registry import Tables, query

RUNS = """runs AS (SELECT o_orderkey AS run, o_custkey AS paper, o_orderstatus AS status, o_totalprice AS cost_usd, CAST(o_orderkey % 20 AS DOUBLE) AS turns,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS missed FROM orders)"""
METRICS = ["cost_usd", "turns", "missed"]


def _runs(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("run"), F.col("o_custkey").alias("paper"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost_usd"),
                           (k % 20).cast("double").alias("turns"), F.when(k % 7 != 0, (k % 100).cast("double")).alias("missed"))


BASE = """base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY run) AS r FROM runs WHERE status = 'F') b WHERE r = 1)"""


@query("c15_baseline_join", RUNS, BASE, "SELECT n.run, n.paper, b.run AS baseline_run FROM runs n LEFT JOIN base b USING (paper) WHERE n.status = 'O'")
def baseline_join(t: Tables):
    rows = _runs(t)
    return E.compare(rows.filter("status = 'O'"), rows.filter("status = 'F'"), "paper", "run", ["turns"]).select("run", "paper", "baseline_run")


@query("h25_scorecard", *TO_RECORDS, COSTS, BLOCKS, """SELECT run, cost_usd, turns, result_error, tool_calls, errors, text_entries FROM
 (SELECT file AS run, round_even(sum(cost), 4) AS cost_usd, CAST(sum(num_turns) AS BIGINT) AS turns, bool_or(is_error) AS result_error FROM costs GROUP BY file) a
 FULL JOIN (SELECT session AS run, count(*) AS tool_calls FROM kinds GROUP BY 1) b USING (run) FULL JOIN (SELECT session AS run, count(*) FILTER (is_error) AS errors FROM errs GROUP BY 1) c USING (run)
 FULL JOIN (SELECT session AS run, count(*) FILTER (c->>'$.type' = 'text') AS text_entries FROM blocks GROUP BY 1) d USING (run)""")
def scorecard(t: Tables):
    events, blocks = _events(t), _blocks(t)
    usage = G.usage_totals(G.run_costs(G.result_events(events))).select(F.col("file").alias("run"), "cost_usd", "turns", "result_error")
    calls = G.tool_calls(blocks).groupBy(F.col("session").alias("run")).agg(F.count("*").alias("tool_calls"))
    errors = (blocks.filter("block = 'tool_result'").groupBy(F.col("session").alias("run"), "tool_use_id").agg(F.max("is_error").alias("e"))
              .groupBy("run").agg(F.count_if("e").alias("errors")))
    texts = blocks.groupBy(F.col("session").alias("run")).agg(F.count_if(F.col("block") == "text").alias("text_entries"))
    return E.scorecard([usage, calls, errors, texts])


@query("h26_score_rows", RUNS, """unpivoted AS (SELECT run, metric, value FROM (SELECT run, unnest(['cost_usd', 'turns', 'missed']) AS metric, unnest([cost_usd, turns, missed]) AS value FROM runs) u)""", """
SELECT run, metric, value FROM unpivoted
UNION ALL SELECT NULL, metric, round_even(sum(value), 4) FROM unpivoted WHERE metric <> 'missed' GROUP BY metric""")
def score_rows(t: Tables):
    return E.score_rows(_runs(t), "run", METRICS)


@query("h26_score_table", RUNS, """picked AS (SELECT run, unnest(['cost_usd', 'turns', 'missed']) AS metric, unnest([cost_usd, turns, missed]) AS value FROM runs WHERE run < 4)""", """
SELECT metric, max(value) FILTER (run = 0) AS "0", max(value) FILTER (run = 1) AS "1", max(value) FILTER (run = 2) AS "2", max(value) FILTER (run = 3) AS "3" FROM picked GROUP BY metric""")
def score_table(t: Tables):
    return E.score_table(_runs(t), "run", METRICS, [0, 1, 2, 3])


@query("h27_baseline_deltas", RUNS, BASE, """cells AS (SELECT n.run, n.paper, b.run AS baseline_run, unnest(['cost_usd', 'turns', 'missed']) AS metric, unnest([b.cost_usd, b.turns, b.missed]) AS before,
  unnest([n.cost_usd, n.turns, n.missed]) AS after FROM runs n LEFT JOIN base b USING (paper) WHERE n.status = 'O')""", """
SELECT *, round_even(after - before, 4) AS delta, CASE WHEN before <> 0 THEN round_even((after - before) / before * 100, 0) END AS percent, after = before AS equal FROM cells""")
def baseline_deltas(t: Tables):
    rows = _runs(t)
    return E.compare(rows.filter("status = 'O'"), rows.filter("status = 'F'"), "paper", "run", METRICS)


@query("e17_copied_comments")
def copied_comments(t: Tables):
    rows = fx.annotations(t).withColumn("comment", F.when(F.col("ord") % 3 == 0, F.concat("text", F.lit("。"))).when(F.col("ord") % 3 == 1, F.concat(F.lit("说明。"), "comment")).otherwise(F.col("comment")))
    rows = rows.withColumn("comment", F.when(F.col("ord") % 3 == 0, F.concat("comment", F.lit("注"))).otherwise(F.col("comment")))
    return E.copied_comments(rows).select("key", "comment", "text")


@query("g18_usage_total", *TO_RECORDS, COSTS, """SELECT file, CAST(sum(num_turns) AS BIGINT) AS turns, CAST(sum(output) AS BIGINT) AS output_tokens FROM costs GROUP BY ROLLUP (file)""")
def usage_total(t: Tables):
    return P.with_grand_total(G.usage_totals(G.run_costs(G.result_events(_events(t)))), "file", ["turns", "output_tokens"])
