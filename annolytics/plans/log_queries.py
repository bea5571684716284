"""Accounting of model calls, tools, cost, context and turns over event logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as G
from . import fixtures as fx
from .fixtures import CONV_SQL, COUNTERS_SQL, LOG_SQL
from .registry import Tables, query

VALID = """good AS (SELECT session, ord, raw::JSON AS j FROM log WHERE starts_with(trim(raw), '{') AND json_valid(raw)),
firsts AS (SELECT session, j->>'$.uuid' AS u, min(ord) AS ord FROM good WHERE j->>'$.uuid' IS NOT NULL GROUP BY 1, 2),
records AS (SELECT g.* FROM good g LEFT JOIN firsts f ON f.session = g.session AND f.u = g.j->>'$.uuid' WHERE f.u IS NULL OR f.ord = g.ord)"""
TO_RECORDS = [LOG_SQL, VALID]
USAGE = """usage_rows AS (SELECT session, ord, j->>'$.message.id' AS message_id, CAST(j->>'$.message.usage.input_tokens' AS BIGINT) AS input,
  CAST(j->>'$.message.usage.cache_read_input_tokens' AS BIGINT) AS cache_read, CAST(j->>'$.message.usage.output_tokens' AS BIGINT) AS output FROM records WHERE j->>'$.type' = 'assistant'),
usage AS (SELECT session, message_id, min(ord) AS ord, arg_max(input, ord) FILTER (input IS NOT NULL) AS input, arg_max(cache_read, ord) FILTER (cache_read IS NOT NULL) AS cache_read,
  arg_max(output, ord) FILTER (output IS NOT NULL) AS output FROM usage_rows GROUP BY session, message_id),
known AS (SELECT *, coalesce(input, 0) + coalesce(cache_read, 0) AS context FROM usage WHERE coalesce(input, cache_read, output) IS NOT NULL)"""
BLOCKS = """blocks AS (SELECT session, ord, j->>'$.type' AS type, j->>'$.message.id' AS message_id, j->'$.message.content[0]' AS c FROM records WHERE j->>'$.type' IN ('assistant', 'user')),
calls AS (SELECT session, c->>'$.id' AS call_key, min(ord) AS ord, arg_min(message_id, ord) AS message_id, arg_min(c->>'$.name', ord) AS name, arg_min(c->>'$.input.command', ord) AS cmd
  FROM blocks WHERE type = 'assistant' AND c->>'$.type' = 'tool_use' GROUP BY 1, 2),
kinds AS (SELECT *, CASE lower(name) WHEN 'read' THEN 'read file' WHEN 'edit' THEN 'write file' ELSE CASE WHEN contains(cmd, 'tool') THEN CASE WHEN contains(cmd, '--apply') THEN 'tool apply'
   WHEN contains(cmd, ' extract') THEN 'tool extract' ELSE 'tool other' END WHEN contains(cmd, 'localhost') THEN 'library API' WHEN starts_with(cmd, 'cat ') THEN 'read file' ELSE 'other' END END AS kind FROM calls),
outs AS (SELECT DISTINCT session, c->>'$.tool_use_id' AS id, c->>'$.content' AS content FROM blocks WHERE type = 'user'),
errs AS (SELECT session, c->>'$.tool_use_id' AS id, bool_or(CAST(c->>'$.is_error' AS BOOLEAN)) AS is_error FROM blocks WHERE type = 'user' GROUP BY 1, 2)"""
RESULTED = """resulted AS (SELECT k.*, chars, e.is_error FROM kinds k LEFT JOIN (SELECT session, id, sum(length(content)) AS chars FROM outs GROUP BY 1, 2) o ON o.session = k.session AND o.id = k.call_key
  LEFT JOIN errs e ON e.session = k.session AND e.id = k.call_key)"""


def _events(t: Tables):
    return G.parse_events(fx.log_lines(t))


def _blocks(t: Tables):
    return G.content_blocks(G.unique_records(_events(t)))


def _resulted(t: Tables):
    b = _blocks(t)
    return G.call_results(G.tool_calls(b), G.tool_outputs(b))


@query("a01_tolerant_scan", *TO_RECORDS, "SELECT session, ord, coalesce(j->>'$.type', '') AS type FROM good")
def tolerant_scan(t: Tables):
    return _events(t).select("session", "ord", F.coalesce(G.get("type"), F.lit("")).alias("type"))


@query("a02_dialects", LOG_SQL, """heads AS (SELECT session, string_agg(raw, chr(10) ORDER BY ord) AS file FROM log GROUP BY session)""",
       """SELECT session, CASE WHEN contains(file, '"payload"') OR contains(file, '"session_meta"') THEN 'counters' ELSE 'messages' END AS dialect FROM heads""")
def dialects(t: Tables):
    return G.sniff_dialect(fx.log_lines(t))


@query("a11_new_lines", LOG_SQL, """ends AS (SELECT session, max(ord) AS last, CASE WHEN session % 3 = 0 THEN NULL WHEN session % 3 = 1 THEN 9000 ELSE 1000000000 END AS since FROM log GROUP BY session)""",
       "SELECT session, ord FROM log JOIN ends USING (session) WHERE since IS NULL OR last < since OR ord > since")
def new_lines(t: Tables):
    lines = fx.log_lines(t)
    offsets = lines.select("session").distinct().filter("session % 3 <> 0").withColumn("offset", F.when(F.col("session") % 3 == 1, 9000).otherwise(1000000000))
    return G.new_lines(lines, offsets).select("session", "ord")


@query("h01_tool_kinds", """SELECT event_id, CASE WHEN contains(cmd, 'tool') THEN CASE WHEN contains(cmd, '--apply') THEN 'tool apply' WHEN contains(cmd, '--list') THEN 'tool --list'
  WHEN contains(cmd, ' extract') THEN 'tool extract' WHEN contains(cmd, '--config') THEN 'tool dry-run' ELSE 'tool other' END WHEN contains(cmd, 'localhost') OR contains(cmd, 'curl ') THEN 'library API'
  WHEN contains(cmd, 'out-file') THEN 'write file' WHEN contains(cmd, 'sed -n') OR starts_with(cmd, 'cat ') THEN 'read file' ELSE 'other' END AS kind FROM (SELECT event_id, lower(CASE event_id % 10
  WHEN 0 THEN 'tool --config a --apply' WHEN 1 THEN 'tool --config a' WHEN 2 THEN 'Tool --list' WHEN 3 THEN 'tool extract x' WHEN 4 THEN 'tool' WHEN 5 THEN 'curl http://x' WHEN 6 THEN 'ls | Out-File y'
  WHEN 7 THEN 'sed -n 1p z' WHEN 8 THEN 'cat a' ELSE 'echo cat ' END) AS cmd FROM events) e""")
def tool_kinds(t: Tables):
    cmds = ["tool --config a --apply", "tool --config a", "Tool --list", "tool extract x", "tool", "curl http://x", "ls | Out-File y", "sed -n 1p z", "cat a", "echo cat "]
    cmd = F.element_at(F.array(*[F.lit(c) for c in cmds]), (F.col("event_id") % 10 + 1).cast("int"))
    return t.events.select("event_id", G.classify_command(cmd).alias("kind"))


@query("h02_message_usage", *TO_RECORDS, USAGE, "SELECT session, message_id, input, cache_read, output, context FROM known")
def message_usage(t: Tables):
    return G.message_usage(_events(t)).select("session", "message_id", "input", "cache_read", "output", "context")


COUNTED = """counted AS (SELECT *, lag(total_input) OVER w AS prev_input, lag(total_output) OVER w AS prev_output FROM first_counters WINDOW w AS (PARTITION BY session ORDER BY ord))"""


@query("h03_counter_totals", COUNTERS_SQL, COUNTED, """SELECT session, CAST(sum(last_input) AS BIGINT) AS input, CAST(sum(last_cached) AS BIGINT) AS cached, CAST(sum(last_output) AS BIGINT) AS output,
  count(*) FILTER (NOT (prev_input IS NOT NULL AND total_input = prev_input AND total_output > prev_output)) AS calls,
  CAST(max(last_input) AS BIGINT) AS peak FROM counted GROUP BY session""")
def counter_totals(t: Tables):
    return G.counter_totals(G.counter_calls(fx.counters(t)))


@query("h03_counters_with_gaps", COUNTERS_SQL, COUNTED, """SELECT session, CAST(sum(last_input) AS BIGINT) AS input, CAST(sum(last_cached) AS BIGINT) AS cached, CAST(sum(last_output) AS BIGINT) AS output,
  count(*) FILTER (NOT (prev_input IS NOT NULL AND total_input = prev_input AND total_output > prev_output)) AS calls,
  CAST(max(last_input) AS BIGINT) AS peak FROM counted GROUP BY session""")
def counters_with_gaps(t: Tables):
    """Every seventh row that is a call inside a segment lost its cached total, which its last value bridges. (A row that
    repeats a call would have to repeat the call's last value, which the fixture's do not.)"""
    gap = (F.col("event_id") % 7 == 2) & (F.col("last_input") > 0) & (F.col("total_input") > F.col("last_input"))
    rows = fx.counters(t).withColumn("total_cached", F.when(~gap, F.col("total_cached")))
    return G.counter_totals(G.counter_calls_with_gaps(rows, width=64))


@query("h04_tool_calls", *TO_RECORDS, BLOCKS, "SELECT session, kind, count(*) AS n FROM kinds GROUP BY session, kind")
def tool_calls(t: Tables):
    return G.tool_counts(G.tool_calls(_blocks(t)))


@query("h04_output_sizes", *TO_RECORDS, BLOCKS, "SELECT session, CAST(sum(length(content)) AS BIGINT) AS chars FROM outs GROUP BY session")
def output_sizes(t: Tables):
    return G.tool_outputs(_blocks(t)).groupBy("session").agg(F.sum("chars").alias("chars"))


@query("h05_session_totals", *TO_RECORDS, USAGE, """SELECT session, count(*) AS calls, CAST(sum(context) AS BIGINT) AS input, CAST(sum(coalesce(cache_read, 0)) AS BIGINT) AS cached, CAST(sum(coalesce(output, 0)) AS BIGINT) AS output,
  max(context) AS peak, CASE WHEN sum(context) <> 0 THEN round_even(sum(coalesce(cache_read, 0)) / sum(context), 4) END AS cached_share FROM known GROUP BY session""")
def session_totals(t: Tables):
    return G.session_totals(G.message_usage(_events(t)))


COSTS = """results AS (SELECT session AS file, ord, j->>'$.session_id' AS sid, CAST(j->>'$.total_cost_usd' AS DOUBLE) AS total, CASE WHEN (j->'$.model_usage_since_last_result') IS NOT NULL THEN 0.75::DOUBLE END AS since,
  CAST(j->>'$.num_turns' AS BIGINT) AS num_turns, CAST(j->>'$.duration_ms' AS BIGINT) AS duration_ms, CAST(j->>'$.is_error' AS BOOLEAN) AS is_error, CAST(j->>'$.usage.input_tokens' AS BIGINT) AS input,
  CAST(j->>'$.usage.output_tokens' AS BIGINT) AS output FROM good WHERE j->>'$.type' = 'result'),
costs AS (SELECT *, coalesce(since, CASE WHEN sid IS NULL OR prev IS NULL OR total < prev THEN total ELSE total - prev END) AS cost FROM (SELECT *, lag(total) OVER (PARTITION BY sid ORDER BY ord) AS prev FROM results) r)"""


@query("h06_run_costs", *TO_RECORDS, COSTS, "SELECT file, ord, cost FROM costs")
def run_costs(t: Tables):
    return G.run_costs(G.result_events(_events(t))).select("file", "ord", "cost")


@query("h07_cost_since_offset", *TO_RECORDS, COSTS, "SELECT file, round_even(sum(cost), 4) AS cost_usd FROM costs WHERE file % 2 = 0 OR ord >= 9000 GROUP BY file")
def cost_since_offset(t: Tables):
    costs = G.run_costs(G.result_events(_events(t)))
    offsets = costs.select(F.col("file").alias("session")).distinct().filter("session % 2 = 1").withColumn("offset", F.lit(9000))
    return G.session_cost(costs, offsets)


@query("h08_usage_totals", *TO_RECORDS, COSTS, """SELECT file, round_even(sum(cost), 4) AS cost_usd, CAST(sum(num_turns) AS BIGINT) AS turns, count(*) AS runs, CAST(round_even(sum(duration_ms) / 1000, 0) AS BIGINT) AS duration_s,
  CAST(sum(input) AS BIGINT) AS input_tokens, 0::BIGINT AS cache_read, 0::BIGINT AS cache_write, CAST(sum(output) AS BIGINT) AS output_tokens, bool_or(is_error) AS result_error FROM costs GROUP BY file""")
def usage_totals(t: Tables):
    return G.usage_totals(G.run_costs(G.result_events(_events(t))))


@query("c14_call_results", *TO_RECORDS, BLOCKS, RESULTED, "SELECT session, call_key, kind, CAST(chars AS BIGINT) AS chars, is_error FROM resulted")
def call_results(t: Tables):
    return _resulted(t).select("session", "call_key", "kind", "chars", "is_error")


@query("h09_reports", """SELECT event_id, event_id % 50 AS missed FROM events WHERE event_id % 4 <> 3""")
def reports(t: Tables):
    """The first JSON object inside a result text, behind words with braces of their own."""
    k = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 4 == 3, "no {report here").otherwise(
        F.concat(F.lit("checked {x} {\n ok\n"), F.lit('{"missed": '), (F.col("event_id") % 50).cast("string"), F.lit(', "of": {"a": "}"}} and {"missed": -'), k, F.lit("}")))
    rows = t.events.select("event_id", G.first_json(text).alias("report")).filter("report IS NOT NULL")
    return rows.select("event_id", F.get_json_object("report", "$.missed").cast("long").alias("missed"))


@query("h09_read_ranges", """SELECT user_id AS session, event_id AS ord, CASE WHEN event_id % 3 = 0 THEN '1' ELSE CAST(CAST(props->>'$.k' AS BIGINT) * 10 + 1 AS VARCHAR) END
  || '+' || CASE WHEN event_id % 4 = 0 THEN 'all' ELSE props->>'$.k' END AS range FROM events WHERE event_type = 'view'""")
def read_ranges(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    cmd = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, k * 10 + 1).alias("offset"), F.when(F.col("event_id") % 4 != 0, k).alias("limit")))
    blocks = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.lit("assistant").alias("type"), F.lit("tool_use").alias("block"),
                             F.when(F.col("event_type") == "view", "Read").otherwise("Bash").alias("name"), cmd.alias("cmd"))
    return G.read_ranges(blocks)


GROWTH = """growth AS (SELECT *, lead(context) OVER w - context - coalesce(output, 0) AS grown, count(*) OVER (PARTITION BY session) - row_number() OVER w AS reread FROM known WINDOW w AS (PARTITION BY session ORDER BY ord)),
shared AS (SELECT r.session, r.call_key, r.kind, r.ord, g.reread, CAST(round_even(CASE WHEN grown < 0 THEN 0 ELSE grown END * CASE WHEN s.c > 0 THEN coalesce(r.chars, 0) / s.c ELSE 1 / s.n END, 0) AS BIGINT) AS added
  FROM resulted r JOIN growth g USING (session, message_id) JOIN (SELECT session, message_id, sum(coalesce(chars, 0)) AS c, count(*) AS n FROM resulted GROUP BY 1, 2) s USING (session, message_id))"""


def _attributed(t: Tables):
    return G.attribute_context(_resulted(t), G.context_growth(G.message_usage(_events(t))))


@query("h10_context_attribution", *TO_RECORDS, USAGE, BLOCKS, RESULTED, GROWTH, "SELECT session, call_key, added, reread FROM shared")
def context_attribution(t: Tables):
    return _attributed(t).select("session", "call_key", "added", "reread")


@query("h11_heaviest_results", *TO_RECORDS, USAGE, BLOCKS, RESULTED, GROWTH, """SELECT session, call_key, weight, CAST(r AS INT) AS rank FROM (SELECT *, coalesce(added, 0) * reread AS weight,
  row_number() OVER (PARTITION BY session ORDER BY coalesce(added, 0) * reread DESC, ord, call_key) AS r FROM shared) x WHERE r <= 6""")
def heaviest_results(t: Tables):
    return G.heaviest_results(_attributed(t)).select("session", "call_key", "weight", "rank")


TURNS = """flags AS (SELECT *, kind NOT IN ('run', 'steer', 'end', 'time', 'counts', 'rewind', 'gone', 'compact') AS foreign_line, CASE WHEN kind = 'run' THEN words IS NOT NULL
  WHEN kind IN ('prompt', 'message', 'result') THEN false END AS sets FROM conv_log),
opened AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER w, false) AS was_open, count(*) FILTER (foreign_line OR (kind = 'run' AND words IS NOT NULL)) OVER w AS any_before
  FROM flags WINDOW w AS (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
started AS (SELECT *, (kind = 'run' AND words IS NOT NULL) OR (kind = 'prompt' AND NOT was_open) OR (foreign_line AND kind <> 'prompt' AND any_before = 0) AS starts FROM opened),
turned AS (SELECT *, CAST(count(*) FILTER (starts) OVER w - 1 AS INT) AS turn, count(*) FILTER (kind = 'run' OR (kind = 'prompt' AND starts)) OVER w AS stretch,
  coalesce(last_value(CASE WHEN kind = 'run' THEN compact END IGNORE NULLS) OVER w, false) AS compacting FROM started WINDOW w AS (PARTITION BY conv_id ORDER BY ord)),
turn_rows AS (SELECT conv_id, turn, string_agg(CASE WHEN kind IN ('run', 'prompt') AND starts THEN words WHEN kind = 'steer' THEN text END, chr(10) || chr(10) ORDER BY ord) AS said,
  arg_max(text, ord) FILTER (kind = 'result' AND NOT is_error AND NOT compacting) AS reply,
  arg_max(CASE WHEN kind = 'gone' THEN '' ELSE text END, ord) FILTER ((kind = 'gone' AND resent) OR (NOT compacting AND (kind = 'end' OR (kind = 'result' AND is_error)))) AS ended,
  bool_or(kind = 'message' OR (kind = 'result' AND NOT is_error)) AS reached,
  coalesce(arg_max(agent, ord) FILTER (NOT compacting AND (kind = 'message' OR (kind = 'result' AND NOT is_error))), arg_min(agent, ord)) AS agent FROM turned WHERE turn >= 0 GROUP BY conv_id, turn)"""
TO_TURNS = [CONV_SQL, TURNS]


def _turns(t: Tables):
    return G.turns(fx.conv_log(t))


@query("h12_turns", *TO_TURNS, "SELECT conv_id, turn, coalesce(said, '') AS said, reply, ended, reached, agent FROM turn_rows")
def turns(t: Tables):
    return G.turn_table(_turns(t)).withColumnRenamed("user", "said")


ENTRIES = """entry_rows AS (SELECT session, ord, CASE WHEN j->>'$.type' = 'annolytics' THEN 'run' WHEN j->>'$.type' = 'result' THEN 'final' WHEN j->>'$.type' = 'user' THEN 'result'
    WHEN j->>'$.method' IS NOT NULL THEN 'text' WHEN j->>'$.message.content[0].type' = 'text' THEN 'text' ELSE 'tool' END AS kind,
  CASE WHEN j->>'$.type' = 'annolytics' THEN j->>'$.user' WHEN j->>'$.type' = 'result' THEN j->>'$.result' WHEN j->>'$.type' = 'user' THEN j->>'$.message.content[0].content'
    WHEN j->>'$.method' IS NOT NULL THEN j->>'$.params.item.text' WHEN j->>'$.message.content[0].type' = 'text' THEN trim(j->>'$.message.content[0].text')
    ELSE (j->>'$.message.content[0].name') || '(' || (j->>'$.message.content[0].input.command') || ')' END AS text,
  CASE WHEN j->>'$.type' = 'result' THEN true WHEN j->>'$.type' = 'user' THEN CAST(j->>'$.message.content[0].is_error' AS BOOLEAN) ELSE false END AS is_error
  FROM good WHERE NOT (j->>'$.type' = 'result' AND NOT CAST(j->>'$.is_error' AS BOOLEAN)) OR j->>'$.type' IS NULL)"""


@query("h20_entries", *TO_RECORDS, ENTRIES, "SELECT session, ord, kind, text, is_error FROM entry_rows")
def entries(t: Tables):
    return G.entries(_events(t)).select("session", "ord", "kind", "text", "is_error")


@query("h13_run_segments", *TO_RECORDS, ENTRIES, """runs AS (SELECT *, count(*) FILTER (kind = 'run') OVER (PARTITION BY session ORDER BY ord) AS run FROM entry_rows),
parts AS (SELECT *, max(ord) FILTER (kind IN ('tool', 'result')) OVER (PARTITION BY session, run) AS last_tool, min(ord) FILTER (kind IN ('tool', 'result', 'text')) OVER (PARTITION BY session, run) AS first_shown FROM runs)""", """
SELECT session, ord, run, CASE WHEN kind = 'run' THEN 'run' WHEN kind IN ('tool', 'result') THEN 'step' WHEN kind = 'text' THEN CASE WHEN ord < last_tool THEN 'step' ELSE 'answer' END
  WHEN first_shown < ord THEN 'other' ELSE 'lead' END AS part FROM parts""")
def run_segments(t: Tables):
    from ..session import cut_lineage
    return G.run_segments(cut_lineage(G.entries(_events(t)).select("session", "ord", "kind"))).select("session", "ord", "run", "part")


REACH = """reach AS (SELECT conv_id, agent, ord, turn FROM turned WHERE turn >= 0 AND kind IN ('message', 'result') AND NOT is_error AND NOT compacting
  QUALIFY row_number() OVER (PARTITION BY conv_id, stretch ORDER BY ord) = 1),
seen AS (SELECT conv_id, agent, max(ord) AS last_ord, arg_max(turn, ord) AS through FROM (SELECT conv_id, agent, ord, turn FROM reach
  UNION ALL SELECT conv_id, agent, ord, -1 FROM turned WHERE kind = 'gone' OR (kind = 'rewind' AND text IS NULL)) r GROUP BY 1, 2)"""


@query("h14_agent_states", *TO_TURNS, REACH, """SELECT s.conv_id, s.agent, through, (SELECT min(r.turn) FROM reach r WHERE r.conv_id = s.conv_id AND r.agent <> s.agent AND r.ord > s.last_ord AND r.turn <= s.through) AS stale FROM seen s""")
def agent_states(t: Tables):
    return G.agent_states(_turns(t))


@query("h15_context_gauge", """gauge AS (SELECT user_id AS session, event_id AS ord, CASE WHEN event_type = 'click' THEN CAST(value * 100 AS BIGINT) END AS used, CASE WHEN event_type = 'purchase' THEN event_id % 3 * 500 END AS post,
  CASE WHEN event_type = 'view' THEN event_id % 4 * 4000 END AS "window" FROM events),
filled AS (SELECT *, last_value(coalesce(CASE WHEN post > 0 THEN post END, used) IGNORE NULLS) OVER w AS now_used, last_value(CASE WHEN "window" > 0 THEN "window" END IGNORE NULLS) OVER w AS now_window
  FROM gauge WINDOW w AS (PARTITION BY session ORDER BY ord))""", "SELECT session, ord, now_used, now_window, coalesce(now_used >= 0.8 * now_window, false) AS warn FROM filled")
def context_gauge(t: Tables):
    e = F.col("event_type")
    rows = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.when(e == "click", F.bround(F.col("value") * 100).cast("long")).alias("used"),
                           F.when(e == "purchase", F.col("event_id") % 3 * 500).alias("post"), F.when(e == "view", F.col("event_id") % 4 * 4000).alias("window"))
    return G.context_gauge(rows, width=512).select("session", "ord", "now_used", "now_window", "warn")


@query("h16_spent_on_latest", CONV_SQL, """starts AS (SELECT conv_id, max(ord) AS from_ord FROM conv_log WHERE kind = 'run' AND words IS NOT NULL GROUP BY conv_id),
compacting AS (SELECT l.*, coalesce(last_value(CASE WHEN kind = 'run' THEN compact END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY ord), false) AS c FROM conv_log l)""",
       "SELECT conv_id, CAST(sum(num_turns) AS BIGINT) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens FROM compacting JOIN starts USING (conv_id) WHERE ord >= from_ord AND kind = 'result' AND NOT c GROUP BY conv_id")
def spent_on_latest(t: Tables):
    return G.spent_on_latest(fx.conv_log(t))


BUDGET = 4000 - G.HISTORY_RESERVE


def _whole_cost(u: str, a: str) -> str:
    return f"""greatest(length('[Turn ' || (turn + 1) || ']' || chr(10) || 'User: ' || {u} || chr(10) || 'Answer (' || agent || '): ' || {a}) + 2,
  length('[{{"type":"message","role":"user","content":[{{"type":"input_text","text":' || to_json(CASE WHEN {u} = '' THEN '[Empty message]' ELSE {u} END) || '}}]}},{{"type":"message","role":"assistant","content":[{{"type":"output_text","text":' || to_json({a}) || '}}]}}]') + 1)"""


def _ends(s: str, n: str) -> str:
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE substr({s}, 1, ({n} + 1) // 2 - 1) || '…' || right({s}, {n} - ({n} + 1) // 2) END"


HISTORY = f"""told AS (SELECT conv_id, turn, coalesce(said, '') AS u, agent, CASE WHEN coalesce(reply, '') <> '' THEN reply WHEN reply IS NOT NULL THEN '(no text)'
    ELSE '(not finished' || CASE WHEN coalesce(ended, '') <> '' THEN ': ' || CASE WHEN length(ended) <= 300 THEN ended ELSE substr(ended, 1, 299) || '…' END ELSE '' END || ')' END AS a,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM turn_rows),
limited AS (SELECT *, CASE WHEN rank = 1 AND {_whole_cost('u', 'a')} > {BUDGET} THEN list_filter({G.shortening_limits(BUDGET)}, lambda l: {_whole_cost(f"({_ends('u', 'l')})", f"({_ends('a', 'l')})")} <= {BUDGET})[1] END AS lim FROM told),
clipped AS (SELECT * REPLACE (CASE WHEN lim IS NULL THEN u ELSE {_ends('u', 'lim')} END AS u, CASE WHEN lim IS NULL THEN a ELSE {_ends('a', 'lim')} END AS a) FROM limited),
excerpts AS (SELECT *, CASE WHEN length(u) <= 250 THEN u ELSE substr(u, 1, 249) || '…' END AS eu, CASE WHEN length(a) <= 400 THEN a ELSE substr(a, 1, 399) || '…' END AS ea FROM clipped),
priced AS (SELECT *, {_whole_cost('u', 'a')} AS whole_cost, length(to_json('User: ' || eu || chr(10) || 'Answer (' || agent || '): ' || ea)) + 4 AS excerpt_cost FROM excerpts),
wholes AS (SELECT *, rank <= CASE WHEN n > 10 THEN 5 ELSE n END AND upto <= {BUDGET} AS whole FROM (SELECT *, sum(whole_cost) OVER (PARTITION BY conv_id ORDER BY rank) AS upto FROM priced) p),
spent AS (SELECT *, coalesce(max(CASE WHEN whole THEN upto END) OVER (PARTITION BY conv_id), 0) + sum(CASE WHEN whole THEN 0 ELSE excerpt_cost END) OVER (PARTITION BY conv_id ORDER BY rank) AS total FROM wholes),
history AS (SELECT *, n - count(*) OVER (PARTITION BY conv_id) AS omitted FROM spent WHERE whole OR total <= {BUDGET})"""
KEPT = """SELECT conv_id, turn, CASE WHEN whole THEN 'whole' ELSE 'excerpt' END AS form, lim IS NOT NULL AS shortened,
  CAST(CASE WHEN whole THEN whole_cost ELSE excerpt_cost END AS BIGINT) AS cost"""


@query("h17_bounded_history", *TO_TURNS, HISTORY, f"{KEPT} FROM history")
def bounded_history(t: Tables):
    return G.bounded_history(G.turn_table(_turns(t)), chars=4000).select("conv_id", "turn", "form", "shortened", "cost")


@query("h17_history_texts", *TO_TURNS, HISTORY, f"""{KEPT}, CASE WHEN whole THEN u ELSE eu END AS "user", CASE WHEN whole THEN a ELSE ea END AS answer, agent, CAST(omitted AS BIGINT) AS omitted FROM history""")
def history_texts(t: Tables):
    return G.bounded_history(G.turn_table(_turns(t)), chars=4000)


@query("h17_handoffs", *TO_TURNS, HISTORY, """parts AS (SELECT conv_id, max(omitted) AS omitted, bool_or(lim IS NOT NULL) AS shortened, count(*) FILTER (NOT whole) AS n_excerpts, string_agg(CASE WHEN whole
  THEN '[Turn ' || (turn + 1) || ']' || chr(10) || 'User: ' || u || chr(10) || 'Answer (' || agent || '): ' || a ELSE 'User: ' || eu || chr(10) || 'Answer (' || agent || '): ' || ea END, chr(10) || chr(10) ORDER BY whole, turn) AS said
  FROM history GROUP BY conv_id)""", """SELECT conv_id, CAST(omitted AS BIGINT) AS omitted, concat_ws(chr(10) || chr(10), CASE WHEN omitted > 0 OR shortened THEN concat_ws(' ', 'The history is cut to a limit.',
  CASE WHEN omitted > 0 THEN 'Earlier turns left out: ' || omitted || '.' END, CASE WHEN shortened THEN 'The latest turn is shortened.' END) END,
  CASE WHEN n_excerpts > 0 THEN 'Earlier turns in excerpts: ' || n_excerpts || '.' END, said) AS handoff FROM parts""")
def handoffs(t: Tables):
    return G.history_handoffs(G.bounded_history(G.turn_table(_turns(t)), chars=4000))


@query("h18_unseen_turns", *TO_TURNS, REACH, "SELECT t.conv_id, s.agent AS for_agent, t.turn FROM turn_rows t JOIN seen s ON s.conv_id = t.conv_id AND t.turn > s.through")
def unseen_turns(t: Tables):
    rows = _turns(t)
    return G.unseen_turns(rows.filter("turn >= 0").select("conv_id", "turn").distinct(), G.agent_states(rows))


@query("h19_conversation_list", *TO_TURNS, """SELECT conv_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN 'week' WHEN d < 30 THEN 'month' ELSE 'older' END AS day_group,
  CASE WHEN conv_id % 4 = 0 THEN 'Own ' || conv_id ELSE CASE WHEN length(line) <= 64 THEN line ELSE substr(line, 1, 63) || '…' END END AS title FROM (
  SELECT c.conv_id, CAST(c.conv_id % 45 AS INT) AS d, CASE WHEN coalesce(string_split(said, chr(10))[1], '') = '' THEN 'Annotate this' ELSE string_split(said, chr(10))[1] END AS line
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, arg_min(coalesce(said, ''), turn) AS said FROM turn_rows GROUP BY conv_id) f USING (conv_id)) x""")
def conversation_list(t: Tables):
    today = F.lit("2026-03-01").cast("date")
    meta = t.conversations.select("conv_id").distinct().select("conv_id", F.date_sub(today, (F.col("conv_id") % 45).cast("int")).alias("at"),
                                                               F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("Own "), F.col("conv_id").cast("string"))).alias("title"))
    return G.conversation_list(G.turn_table(_turns(t)), meta, today).drop("at")


@query("h21_repeated_finals", *TO_RECORDS, ENTRIES, """told AS (SELECT *, lag(kind) OVER w AS k, lag(text) OVER w AS x FROM entry_rows WINDOW w AS (PARTITION BY session ORDER BY ord))""",
       "SELECT session, ord, kind FROM told WHERE NOT coalesce(kind = 'final' AND k = 'text' AND x = text, false)")
def repeated_finals(t: Tables):
    return G.drop_repeats(G.entries(_events(t)).select("session", "ord", "kind", "text")).select("session", "ord", "kind")


CLOSINGS = {0: ("All done. Remaining warnings: none.", ""), 1: ("Ok\nRemaining warnings: 2 (a long comment in Fig. 3).", "a long comment in Fig. 3"), 2: ("剩余警告 1 条（译文提示）", "译文提示"),
            3: ("3 remaining warnings", "3"), 4: ("No remaining warnings.", ""), 5: ("Everything is written.", None), 6: ("剩余警告：无", ""), 7: ("Remaining warnings: 2 translation notes.", "2 translation notes"),
            8: ("remaining warnings: numbers in s. 3!", "numbers in s. 3"), 9: ("剩餘警告 0 條", "")}


@query("h23_closing_lines", "SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, (_, v) in CLOSINGS.items()) + " END AS warnings FROM events")
def closing_lines(t: Tables):
    text = F.element_at(F.array(*[F.lit(CLOSINGS[i][0]) for i in range(10)]), (F.col("event_id") % 10 + 1).cast("int"))
    return t.events.select("event_id", G.closing_warnings(text).alias("warnings"))


# a reply in French per event: its own number and kind stand in the remainder, which is kept unless it says none
REMAINDERS = """CASE event_id % 6 WHEN 0 THEN 'aucun' WHEN 1 THEN 'Aucun avertissement' WHEN 2 THEN 'aucun, tout corrigé (' || event_type || ')' WHEN 3 THEN 'aucun texte pour la p. ' || event_id
  WHEN 4 THEN event_type || ' en p. ' || event_id ELSE '' END"""


@query("h23_labelled_closings", f"""SELECT event_id, CASE WHEN event_id % 6 <= 2 THEN '' WHEN event_id % 6 <= 4 THEN {REMAINDERS} END AS warnings FROM events""")
def labelled_closings(t: Tables):
    said = F.concat(F.lit("Terminé.\nAvertissements restants : "), F.expr(REMAINDERS), F.lit("."))
    return t.events.select("event_id", G.closing_warnings(said, "Avertissements restants", "aucun").alias("warnings"))


@query("h24_wall_time", """kinds AS (SELECT user_id AS session, event_id AS ord, CASE event_type WHEN 'signup' THEN 'run' WHEN 'purchase' THEN 'counts' ELSE 'other' END AS kind, epoch_us(ts) // 1000 AS ms, 100 + user_id AS probe FROM events)""",
       """SELECT session, CASE WHEN c >= b THEN round_even((c - b) / 1000, 1) ELSE CAST(p AS DOUBLE) END AS wall_s FROM (SELECT session, arg_min(ms, ord) FILTER (kind = 'run') AS b, arg_max(ms, ord) FILTER (kind = 'counts') AS c, max(probe) AS p FROM kinds GROUP BY session) x""")
def wall_time(t: Tables):
    e = F.col("event_type")
    rows = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.when(e == "signup", "run").when(e == "purchase", "counts").otherwise("other").alias("kind"),
                           F.unix_millis(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), "ts").cast("timestamp")).alias("at"), (100 + F.col("user_id")).alias("probe"))
    return G.wall_time(rows)


@query("h29_refused_runs", CONV_SQL, """run_rows AS (SELECT *, CASE WHEN kind IN ('result', 'end') AND is_error THEN 'final' ELSE kind END AS k, count(*) FILTER (kind = 'run') OVER (PARTITION BY conv_id ORDER BY ord) AS run FROM conv_log),
taken AS (SELECT *, max(ord) FILTER (kind = 'gone' AND resent) OVER (PARTITION BY conv_id, run) AS gone_at FROM run_rows)""",
       "SELECT conv_id AS session, ord, k AS kind FROM taken WHERE NOT coalesce(k = 'final' AND ord < gone_at, false)")
def refused_runs(t: Tables):
    rows = fx.conv_log(t).withColumnRenamed("conv_id", "session").withColumn("kind", F.when(F.col("kind").isin("result", "end") & F.col("is_error"), "final").otherwise(F.col("kind")))
    return G.drop_refused(rows).select("session", "ord", "kind")
