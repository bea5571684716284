"""Logs of assistants: events, model calls, tokens, cost, turns and context.

Events are rows ``session, ord, raw``: ``ord`` orders the lines of a session, ``raw`` is a JSON object. Two dialects are read:
messages that carry their usage, and cumulative counters.
"""
from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from .ordered import by_chunks, first_rows, group_total, last_known, once, ordered_scan, previous, running_count, running_max, running_sum

OWN = "annolytics"                     # the type of the lines the tool itself writes
FIELDS = ("input", "cached", "output")
EVENT_CHUNK = 1 << 14
SUB_AGENT = ("spawn_agent", "wait_agent", "list_agents")


def chunk(order: str = "ord", width: int = EVENT_CHUNK) -> Column:
    return F.floor(F.col(order) / width).cast("long")


# --- reading ---------------------------------------------------------------------------------------------------------------
def parse_events(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, as a variant ``v``; blank and broken lines are skipped, the order stays."""
    rows = lines.filter(F.trim("raw").startswith("{")).withColumn("v", F.try_parse_json("raw"))
    return rows.filter(F.col("v").isNotNull()).drop("raw")


def get(path: str, kind: str = "string", v: str | Column = "v") -> Column:
    return F.try_variant_get(T.col(v), f"$.{path}", kind)


def sniff_dialect(lines: DataFrame) -> DataFrame:
    """The dialect of each file (``session``) from any of its lines: one flag per line, combined before the shuffle."""
    found = F.max(F.col("raw").contains('"payload"') | F.col("raw").contains('"session_meta"'))
    return lines.groupBy("session").agg(F.when(found, "counters").otherwise("messages").alias("dialect"))


def new_lines(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lines written since a session's offset; a session that is now shorter is read anew."""
    ends = lines.groupBy("session").agg(F.max("ord").alias("last"))
    since = ends.join(offsets, "session", "left").select(
        "session", F.when(F.col("last") < F.col("offset"), None).otherwise(F.col("offset")).alias("offset"))
    return lines.join(since, "session").filter(F.col("offset").isNull() | (F.col("ord") > F.col("offset"))).drop("offset")


# --- tool calls ------------------------------------------------------------------------------------------------------------
def classify_command(cmd: str | Column, tool: str = "tool") -> Column:
    """A command by what it does: the tool's own steps, the library's API, reading and writing files."""
    c = F.lower(F.coalesce(T.col(cmd), F.lit("")))

    def has(*words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(c, F.lit(w))
        return out

    own = (F.when(has("--apply"), f"{tool} apply").when(has("--list"), f"{tool} --list").when(has(" extract"), f"{tool} extract")
           .when(has("--config"), f"{tool} dry-run").otherwise(f"{tool} other"))
    return (F.when(has(tool), own).when(has("localhost", "curl ", "invoke-restmethod", "invoke-webrequest"), "library API")
            .when(has("set-content", "out-file", "apply_patch", "*** begin patch", "add-content"), "write file")
            .when(has("get-content", "sed -n") | c.startswith("cat ") | c.startswith("type ") | c.startswith("head "), "read file").otherwise("other"))


def tool_kind(name: str | Column, cmd: str | Column, tool: str = "tool") -> Column:
    n = F.lower(F.coalesce(T.col(name), F.lit("")))
    return (F.when(n == "read", "read file").when(n.isin("write", "edit", "multiedit"), "write file").when(n == "agent", "sub-agent control")
            .when(n == "bash", classify_command(cmd, tool)).otherwise(n))


def unique_records(events: DataFrame) -> DataFrame:
    """Events without replays: of records with an id (``record_id``) the first, all of those without."""
    rec = F.coalesce(get("uuid"), get("id"))
    rows = events.withColumn("record_id", rec)
    first = rows.filter("record_id IS NOT NULL").groupBy("session", "record_id").agg(F.min("ord").alias("ord"))
    keep = rows.join(first.withColumn("first", F.lit(True)), ["session", "record_id", "ord"], "left")
    return keep.filter(F.col("record_id").isNull() | F.col("first")).drop("record_id", "first")


def content_blocks(events: DataFrame) -> DataFrame:
    """One row per content block of assistant and user messages."""
    kind = get("type")
    rows = events.filter(kind.isin("assistant", "user")).select(
        "session", "ord", kind.alias("type"), get("message.id").alias("message_id"),
        F.posexplode(F.try_variant_get("v", "$.message.content", "array<variant>")).alias("pos", "c"))
    return rows.select("session", "ord", "pos", "type", "message_id", get("type", v="c").alias("block"), get("id", v="c").alias("tool_id"),
                       get("name", v="c").alias("name"), F.coalesce(get("input.command", v="c"), F.lit("")).alias("cmd"),
                       get("tool_use_id", v="c").alias("tool_use_id"), get("text", v="c").alias("text"),
                       F.coalesce(get("content", v="c"), F.lit("")).alias("content"),
                       F.coalesce(get("is_error", "boolean", v="c"), F.lit(False)).alias("is_error"))


def tool_calls(blocks: DataFrame, tool: str = "tool") -> DataFrame:
    """Tool calls without repeats of an id; a call without an id always counts."""
    calls = blocks.filter("type = 'assistant' AND block = 'tool_use'").withColumn(
        "call_key", F.coalesce("tool_id", F.concat_ws("#", F.col("ord").cast("string"), F.col("pos").cast("string"))))
    first = calls.groupBy("session", "call_key").agg(F.min_by(F.struct("ord", "message_id", "tool_id", "name", "cmd"), F.struct("ord", "pos")).alias("f"))
    return first.select("session", "call_key", "f.*").withColumn("kind", tool_kind("name", "cmd", tool))


def tool_outputs(blocks: DataFrame) -> DataFrame:
    """Tool results without repeats of the same text for the same call."""
    rows = blocks.filter("type = 'user' AND block = 'tool_result'").withColumn(
        "key", F.when(F.col("tool_use_id").isNull(), F.concat_ws("#", F.col("ord").cast("string"), F.col("pos").cast("string")))
        .otherwise(F.concat(F.col("tool_use_id"), F.lit("\u0001"), F.sha1("content"))))
    return rows.groupBy("session", "key").agg(F.first("tool_use_id").alias("tool_use_id"), F.max(F.length("content")).alias("chars"),
                                              F.max("is_error").alias("is_error"), F.min("ord").alias("ord"))


def call_results(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Calls with the characters of their results and whether one failed."""
    per = outputs.filter("tool_use_id IS NOT NULL").groupBy("session", F.col("tool_use_id").alias("tool_id")).agg(
        F.sum("chars").alias("chars"), F.max("is_error").alias("is_error"))
    return calls.join(per, ["session", "tool_id"], "left")


# --- usage -----------------------------------------------------------------------------------------------------------------
USAGE = {"input_tokens": "input", "cache_read_input_tokens": "cache_read", "cache_creation_input_tokens": "cache_write", "output_tokens": "output"}


def message_usage(events: DataFrame) -> DataFrame:
    """Usage per message: its blocks repeat it, the last known value of each field counts. A message without an id counts
    alone, an absent field never overwrites a known one."""
    rows = unique_records(events).filter(get("type") == "assistant").select(
        "session", "ord", F.coalesce(get("message.id"), F.concat(F.lit("#"), F.col("ord").cast("string"))).alias("message_id"),
        *[get(f"message.usage.{k}", "long").alias(n) for k, n in USAGE.items()])
    per = rows.groupBy("session", "message_id").agg(
        F.min("ord").alias("ord"), *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("ord"))).alias(n) for n in USAGE.values()])
    known = F.coalesce(*USAGE.values()).isNotNull()
    return per.filter(known).withColumn("context", sum((F.coalesce(n, F.lit(0)) for n in ("input", "cache_read", "cache_write")), F.lit(0)))


def session_totals(usage: DataFrame) -> DataFrame:
    """Calls, input (what each call took in), cached part, output and the largest context per session."""
    total = usage.groupBy("session").agg(
        F.count("*").alias("calls"), F.sum("context").alias("input"), F.sum(F.coalesce("cache_read", F.lit(0))).alias("cached"),
        F.sum(F.coalesce("output", F.lit(0))).alias("output"), F.max("context").alias("peak"))
    return total.withColumn("cached_share", F.when(F.col("input") != 0, F.bround(F.col("cached") / F.col("input"), 4)))


def first_records(events: DataFrame) -> DataFrame:
    """Counter rows without replays: of rows with an ``event_id`` the first."""
    rest = [c for c in events.columns if c not in ("session", "event_id")]
    first = events.filter("event_id IS NOT NULL").groupBy("session", "event_id").agg(F.min_by(F.struct(*rest), F.col("ord")).alias("r"))
    return first.select("session", "event_id", "r.*").unionByName(events.filter("event_id IS NULL"))


def _struct(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}_{f}").alias(f) for f in FIELDS])


def counter_calls(events: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """Calls from cumulative counters (``total_*`` and ``last_*`` per field, none missing): the growth since the row before. A
    smaller total starts a segment, whose first row counts its ``last_*``; an unchanged input total is the same call."""
    rows = by_chunks(first_records(events).withColumn("__at", chunk(width=width)), "session", "__at")
    rows = ordered_scan(rows, ["session"], ["ord"], "__at", before=previous(_struct("total"))).drop("__at")
    b = F.col("before")
    reset = F.lit(False)
    for f in FIELDS:
        reset = reset | (F.col(f"total_{f}") < b[f])
    begins = b.isNull() | reset
    delta = {f: F.when(begins, F.col(f"last_{f}")).otherwise(F.col(f"total_{f}") - b[f]) for f in FIELDS}
    some = F.lit(False)
    for f in FIELDS:
        some = some | (F.col(f) != 0)
    rows = rows.withColumns({**delta, "same_call": ~begins & (F.col("total_input") == b["input"])}).drop("before")
    return rows.filter(some)


def counter_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session").agg(F.count_if(~F.col("same_call")).alias("calls"), *[F.sum(f).alias(f) for f in FIELDS],
                                        F.max(F.when(~F.col("same_call"), F.col("input"))).alias("peak"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Counter rows of one piece of a session in order, with fields that may be missing."""
    out, prev, cur = [], {}, {}
    for r in rows.sort_values("ord").to_dict("records"):
        def val(prefix, f, r=r):
            v = r[f"{prefix}_{f}"]
            return None if pd.isna(v) else int(v)
        if r["anchor"] and not out and not prev:
            prev = {f: val("prev", f) for f in FIELDS if val("prev", f) is not None}
            cur = dict.fromkeys(FIELDS, 0) if prev else {}
        total = {f: val("total", f) for f in FIELDS if val("total", f) is not None}
        last = {f: val("last", f) for f in FIELDS}
        if any(total[f] < prev[f] for f in total.keys() & prev.keys()):
            prev, cur = {}, {}
        same = bool(cur) and "input" in total and total["input"] == prev.get("input")
        delta = {}
        for f in FIELDS:
            if f in total and f in prev:
                delta[f] = total[f] - prev[f]
            else:
                known = last[f] if last[f] is not None else total.get(f)
                delta[f] = (known - cur[f] if known is not None else 0) if same else (known or 0)
            if f in total:
                prev[f] = total[f]
            elif f in prev:
                prev[f] += delta[f]
        if any(delta.values()):
            cur = {f: cur[f] + delta[f] for f in FIELDS} if same else delta
            out.append((r["session"], r["ord"], *delta.values(), same, cur["input"]))
    return pd.DataFrame(out, columns=["session", "ord", *FIELDS, "same_call", "call_input"])


def counter_calls_with_gaps(events: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """As ``counter_calls`` where fields may be missing. What came before no longer matters at a row whose totals, like those of
    the row before it, are whole and whose input grew: there a session is cut, so that no task walks more than about a
    chunk of a long one."""
    rows = first_records(events)
    whole = F.lit(True)
    for f in FIELDS:
        whole = whole & F.col(f"total_{f}").isNotNull()
    rows = by_chunks(rows.withColumns({"whole": whole, "at": chunk(width=width)}), "session", "at")
    rows = ordered_scan(rows, ["session"], ["ord"], "at", before=previous(F.struct("whole", _struct("total").alias("t"))))
    grew = F.col("whole") & F.col("before.whole")
    for f in FIELDS:
        grew = grew & (F.col(f"total_{f}") >= F.col(f"before.t.{f}"))
    anchor = F.coalesce(grew & (F.col("total_input") > F.col("before.t.input")), F.lit(False))
    rows = rows.withColumns({"anchor": anchor, **{f"prev_{f}": F.col(f"before.t.{f}") for f in FIELDS}}).drop("before", "whole")
    first = rows.filter("anchor").groupBy("session", "at").agg(F.min("ord").alias("ord")).withColumn("cut", F.lit(True))
    rows = rows.join(first, ["session", "at", "ord"], "left")
    # a piece runs from the first anchor of a chunk to the next piece
    rows = ordered_scan(rows, ["session"], ["ord"], "at", piece=last_known(F.when(F.col("cut"), F.col("ord"))))
    rows = rows.withColumn("anchor", F.coalesce("cut", F.lit(False))).withColumn("piece", F.coalesce("piece", F.lit(-1)))
    schema = "session long, ord long, input long, cached long, output long, same_call boolean, call_input long"
    return rows.groupBy("session", "piece").applyInPandas(_walk, schema)


# --- cost ------------------------------------------------------------------------------------------------------------------
def result_events(events: DataFrame) -> DataFrame:
    """Result lines with their session, the session's total cost so far and the cost since the last result where given."""
    since = F.try_variant_get("v", "$.model_usage_since_last_result", "map<string,variant>")
    cost = F.aggregate(F.map_values(since), F.lit(0.0), lambda a, m: a + F.coalesce(F.try_variant_get(m, "$.costUSD", "double"), F.lit(0.0)))
    return events.filter(get("type") == "result").select(
        F.col("session").alias("file"), "ord", get("session_id").alias("session_id"), F.coalesce(get("total_cost_usd", "double"), F.lit(0.0)).alias("total"),
        F.when(F.size(since) > 0, cost).alias("since"), F.coalesce(get("num_turns", "long"), F.lit(0)).alias("num_turns"),
        F.coalesce(get("duration_ms", "long"), F.lit(0)).alias("duration_ms"), F.coalesce(get("is_error", "boolean"), F.lit(False)).alias("is_error"),
        *[F.coalesce(get(f"usage.{k}", "long"), F.lit(0)).alias(n) for k, n in USAGE.items()], get("result").alias("result"))


def run_costs(results: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """What each run cost: the cost since the last result, else what its session's total grew by; a total that got smaller,
    and one without a session, counts whole."""
    named = ordered_scan(results.filter("session_id IS NOT NULL"), ["session_id"], ["ord"], chunk(width=width), before=previous(F.col("total")))
    rows = named.unionByName(results.filter("session_id IS NULL").withColumn("before", F.lit(None).cast("double")))
    prev = F.coalesce("before", F.lit(0.0))
    return rows.withColumn("cost", F.coalesce("since", F.when(F.col("total") >= prev, F.col("total") - prev).otherwise(F.col("total")))).drop("before")


def session_cost(costs: DataFrame, offsets: DataFrame) -> DataFrame:
    """The cost of each file's runs since its offset; the lines before it were the base of the growing totals."""
    return (costs.join(offsets.withColumnRenamed("session", "file"), "file", "left").filter(F.col("offset").isNull() | (F.col("ord") >= F.col("offset")))
            .groupBy("file").agg(F.bround(F.sum("cost"), 4).alias("cost_usd")))


def usage_totals(costs: DataFrame) -> DataFrame:
    return costs.groupBy("file").agg(
        F.bround(F.sum("cost"), 4).alias("cost_usd"), F.sum("num_turns").alias("turns"), F.count("*").alias("runs"),
        F.bround(F.sum("duration_ms") / 1000).cast("long").alias("duration_s"), F.sum("input").alias("input_tokens"), F.sum("cache_read").alias("cache_read"),
        F.sum("cache_write").alias("cache_write"), F.sum("output").alias("output_tokens"), F.max("is_error").alias("result_error"))


# --- tool facts ------------------------------------------------------------------------------------------------------------
def _first_object(text: str) -> str | None:
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            return json.dumps(found, ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The first JSON object inside a text."""
    return texts.map(lambda t: _first_object(t) if t else None)


def tool_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session", "kind").agg(F.count("*").alias("n"))


def read_ranges(blocks: DataFrame) -> DataFrame:
    """What was read of a listing as ``offset+limit``; the input of a read is in its command as JSON."""
    reads = blocks.filter("type = 'assistant' AND block = 'tool_use' AND name = 'Read'")
    return reads.select("session", "ord", F.concat(F.coalesce(F.get_json_object("cmd", "$.offset"), F.lit("1")), F.lit("+"),
                                                   F.coalesce(F.get_json_object("cmd", "$.limit"), F.lit("all"))).alias("range"))


# --- context ---------------------------------------------------------------------------------------------------------------
def context_growth(usage: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """Messages with the tokens each added to the next one's context and how many later messages read it again."""
    rows = ordered_scan(usage, ["session"], ["ord"], chunk(width=width), reverse=True, following=previous(F.col("context")), reread=running_count(before=True))
    grown = F.col("following") - F.col("context") - F.coalesce("output", F.lit(0))
    return rows.withColumn("added", F.when(F.col("following").isNotNull(), F.greatest(grown, F.lit(0)))).drop("following")


def attribute_context(calls: DataFrame, growth: DataFrame) -> DataFrame:
    """Each tool call's share of what its message added, by the size of its result; equal shares when all are empty."""
    sizes = calls.groupBy("session", "message_id").agg(F.sum(F.coalesce("chars", F.lit(0))).alias("all_chars"), F.count("*").alias("all_calls"))
    rows = calls.join(growth.select("session", "message_id", "added", "reread").join(sizes, ["session", "message_id"]), ["session", "message_id"])
    part = F.when(F.col("all_chars") > 0, F.coalesce("chars", F.lit(0)) / F.col("all_chars")).otherwise(F.lit(1) / F.col("all_calls"))
    return rows.withColumn("added", F.bround(F.col("added") * part).cast("long")).drop("all_chars", "all_calls")


def heaviest_results(attributed: DataFrame, top: int = 6) -> DataFrame:
    """The calls whose results weigh most: tokens added times the messages that read them again."""
    weight = F.coalesce("added", F.lit(0)) * F.col("reread")
    return first_rows(attributed.withColumn("weight", weight).select("session", "call_key", "kind", "added", "reread", "weight", "ord"),
                      ["session"], [F.desc("weight"), F.col("ord"), F.col("call_key")], top)


def context_gauge(events: DataFrame, width: int = EVENT_CHUNK, warn: float = 0.8) -> DataFrame:
    """The context in use and the window after each event: the last request's size or what a compaction left, and the largest
    window of the last result. ``used, post, window`` are null where an event says nothing."""
    said = F.coalesce(F.when(F.col("post") > 0, F.col("post")), F.col("used"))
    rows = ordered_scan(events.withColumn("said", said), ["session"], ["ord"], chunk(width=width), now_used=last_known(F.col("said")),
                        now_window=last_known(F.when(F.col("window") > 0, F.col("window"))))
    return rows.drop("said").withColumn("warn", F.coalesce(F.col("now_used") >= warn * F.col("now_window"), F.lit(False)))


# --- turns -----------------------------------------------------------------------------------------------------------------
def turns(log: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """Log rows (``conv_id, ord, kind, agent, words, text, is_error, resent, compact``) with their ``turn`` from 0, whether they open
    it (``starts``), whether their run is a compaction (``compacting``) and the number of runs and opening prompts up to them
    (``stretch``). A run with the user's words opens a turn; so does a prompt no run opened, and the first line of an agent when
    there is none. ``kind``: run, prompt, steer, result, end, message, or another line of the tool."""
    own = F.col("kind").isin("run", "steer", "end", "time", "counts", "rewind", "gone", "compact")
    opened = F.when(F.col("kind") == "run", F.col("words").isNotNull()).when(F.col("kind") == "prompt", False).when(~own, False)
    rows = ordered_scan(log, ["conv_id"], ["ord"], chunk(width=width), was_open=last_known(opened, before=True),
                        worded=running_count((F.col("kind") == "run") & F.col("words").isNotNull() | (F.col("kind") == "prompt"), before=True),
                        spoken=running_count(~own & (F.col("kind") != "prompt"), before=True))
    starts = (((F.col("kind") == "run") & F.col("words").isNotNull())
              | ((F.col("kind") == "prompt") & ~F.coalesce("was_open", F.lit(False)))
              | (~own & (F.col("kind") != "prompt") & (F.col("worded") == 0) & (F.col("spoken") == 0)))
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(False))).drop("was_open", "worded", "spoken")
    rows = ordered_scan(rows, ["conv_id"], ["ord"], chunk(width=width), turn=running_count(F.col("starts")),
                        compacting=last_known(F.when(F.col("kind") == "run", F.coalesce("compact", F.lit(False)))),
                        stretch=running_count((F.col("kind") == "run") | (F.col("kind") == "prompt") & F.col("starts")))
    return rows.withColumns({"turn": (F.col("turn") - 1).cast("int"), "compacting": F.coalesce("compacting", F.lit(False))})


def turn_table(rows: DataFrame) -> DataFrame:
    """One row per turn: the user's words with what was steered in, the last reply, how it ended, who answered. A prompt adds no words
    to a turn its run opened. A compaction neither replies nor ends a turn; a session that takes the words over (``gone`` with
    ``resent``) empties how it ended."""
    kind, works = F.col("kind"), ~F.col("compacting")
    said = F.when(F.col("starts") & kind.isin("run", "prompt"), F.col("words")).when(kind == "steer", F.col("text"))
    # the words of a turn are one text in the end
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("ord", said.alias("s"))))), lambda x: x["s"]), "\n\n")
    answered = (kind == "result") & ~F.col("is_error")
    bad = ((kind == "end") | (kind == "result") & F.col("is_error")) & works
    taken = (kind == "gone") & F.coalesce("resent", F.lit(False))
    reached = (kind == "message") | answered
    ended = F.max_by(F.when(taken, F.lit("")).otherwise(F.col("text")), F.when(bad | taken, F.col("ord")))
    return rows.filter("turn >= 0").groupBy("conv_id", "turn").agg(
        words.alias("user"), F.max_by("text", F.when(answered & works, F.col("ord"))).alias("reply"), ended.alias("ended"),
        F.coalesce(F.max(reached), F.lit(False)).alias("reached"),
        F.coalesce(F.max_by("agent", F.when(reached & works, F.col("ord"))), F.min_by("agent", "ord")).alias("agent"))


def agent_states(rows: DataFrame) -> DataFrame:
    """Per conversation and agent the last turn it saw (``through``, -1 for none or after it lost its session) and the first turn
    it saw that another agent answered again since (``stale``).

    A run counts once, where its first answer reached the turn, and a compaction not at all. A lost session and a rewind
    without a point to go back to (``kind`` rewind, ``text`` null) start anew; a rewind to a point keeps what was seen."""
    reach = (rows.filter(F.col("kind").isin("message", "result") & ~F.coalesce("is_error", F.lit(False)) & (F.col("turn") >= 0) & ~F.col("compacting"))
             .groupBy("conv_id", "stretch").agg(F.min_by("agent", "ord").alias("agent"), F.min_by("turn", "ord").alias("turn"), F.min("ord").alias("ord")))
    anew = rows.filter("kind = 'gone' OR (kind = 'rewind' AND text IS NULL)")
    own = (reach.select("conv_id", "agent", "ord", "turn").unionByName(anew.select("conv_id", "agent", "ord", F.lit(-1).alias("turn")))
           .groupBy("conv_id", "agent").agg(F.max("ord").alias("last_ord"), F.max_by("turn", "ord").alias("through")))
    # the few agents of a conversation meet the others' answers, reduced to the last of each turn first
    others = reach.groupBy("conv_id", F.col("agent").alias("other"), "turn").agg(F.max("ord").alias("at"))
    stale = (others.join(own, "conv_id").filter((F.col("other") != F.col("agent")) & (F.col("at") > F.col("last_ord")) & (F.col("turn") <= F.col("through")))
             .groupBy("conv_id", "agent").agg(F.min("turn").alias("stale")))
    return own.join(stale, ["conv_id", "agent"], "left").drop("last_ord")


def run_segments(entries: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """Entries (``session, ord, kind``) with their run and the part of it each belongs to: lead, step, answer or other. Text before a
    later tool becomes a step; the answer is the text after the last one."""
    rows = ordered_scan(entries, ["session"], ["ord"], chunk(width=width), run=running_count(F.col("kind") == "run"))
    rows = ordered_scan(rows, ["session", "run"], ["ord"], chunk(width=width), reverse=True, tools_after=running_count(F.col("kind").isin("tool", "result")))
    rows = ordered_scan(rows, ["session", "run"], ["ord"], chunk(width=width), shown=running_count(F.col("kind").isin("tool", "result", "text"), before=True))
    part = (F.when(F.col("kind").isin("run", "prompt"), F.col("kind")).when(F.col("kind").isin("tool", "result"), "step")
            .when(F.col("kind") == "text", F.when(F.col("tools_after") > 0, "step").otherwise("answer"))
            .when(F.col("shown") > 0, "other").otherwise("lead"))
    return rows.withColumn("part", part).drop("tools_after", "shown")


def drop_repeats(entries: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """Entries without a final line that repeats the text before it."""
    rows = ordered_scan(entries, ["session"], ["ord"], chunk(width=width), before=previous(F.struct("kind", "text")))
    same = (F.col("kind") == "final") & (F.col("before.kind") == "text") & F.col("before.text").eqNullSafe(F.col("text"))
    return rows.filter(~F.coalesce(same, F.lit(False))).drop("before")


def drop_refused(entries: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """Entries without the error lines of a run that a new session took over (a ``gone`` entry with ``resent`` in the run)."""
    rows = ordered_scan(entries, ["session"], ["ord"], chunk(width=width), run=running_count(F.col("kind") == "run"))
    taken = rows.filter("kind = 'gone' AND resent").groupBy("session", "run").agg(F.max("ord").alias("taken_at"))
    marked = rows.join(taken, ["session", "run"], "left")
    refused = (F.col("kind") == "final") & F.col("is_error") & (F.col("ord") < F.col("taken_at"))
    return marked.filter(~F.coalesce(refused, F.lit(False))).drop("run", "taken_at")


def spent_on_latest(log: DataFrame, width: int = EVENT_CHUNK) -> DataFrame:
    """Turns and tokens of the latest turn of each conversation, over all of its runs but compactions (``kind`` run and result,
    ``compact`` on run lines)."""
    last = log.filter("kind = 'run' AND words IS NOT NULL").groupBy("conv_id").agg(F.max("ord").alias("from_ord"))
    rows = ordered_scan(log, ["conv_id"], ["ord"], chunk(width=width), compacting=last_known(F.when(F.col("kind") == "run", F.coalesce("compact", F.lit(False)))))
    rows = rows.join(last, "conv_id").filter((F.col("ord") >= F.col("from_ord")) & (F.col("kind") == "result") & ~F.coalesce("compacting", F.lit(False)))
    return rows.groupBy("conv_id").agg(F.sum("num_turns").alias("turns"), F.sum("tokens").alias("tokens"))


# --- history ---------------------------------------------------------------------------------------------------------------
HISTORY_FROM, HISTORY_WHOLE, HISTORY_CHARS, HISTORY_RESERVE = 10, 5, 40000, 1024
EXCERPT_USER, EXCERPT_ANSWER = 250, 400


def cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def _message(role: str, kind: str, text: Column) -> Column:
    return F.struct(F.lit("message").alias("type"), F.lit(role).alias("role"), F.array(F.struct(
        F.lit(kind).alias("type"), F.when(text == "", "[Empty message]").otherwise(text).alias("text"))).alias("content"))


def cut_middle(text: Column, n: Column) -> Column:
    """A text of at most ``n`` characters that keeps both ends: half of them, an ellipsis, the rest from the end."""
    head = F.ceil(n / 2).cast("int")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, F.lit(1), head - 1), F.lit("…"), F.right(text, n - head)))


def shortening_limits(budget: int) -> list[int]:
    """The characters that each side of an oversized turn may keep, tried in turn: half of the budget, then four fifths each time."""
    limits = [budget // 2]
    while limits[-1] > 1:
        limits.append(int(limits[-1] * 0.8))
    return [n for n in limits if n]


def _turn_lines(user: Column, answer: Column) -> Column:
    return F.concat(F.lit("[Turn "), (F.col("turn") + 1).cast("string"), F.lit("]\nUser: "), user, F.lit("\nAnswer ("), "agent", F.lit("): "), answer)


def _excerpt(user: Column, answer: Column) -> Column:
    return F.concat(F.lit("User: "), user, F.lit("\nAnswer ("), "agent", F.lit("): "), answer)


def bounded_history(turn_rows: DataFrame, chars: int = HISTORY_CHARS) -> DataFrame:
    """The turns handed to a new session, newest first, with what is said of each: beyond ten turns the latest five whole, the earlier
    ones as excerpts (``user`` and ``answer`` cut), up to the first that does not fit. A newest turn over the budget by itself is
    ``shortened``: both sides keep their ends, as long as the budget lets them. ``omitted`` counts the turns of the conversation that are not there.

    An excerpt costs at least its fixed words, so only so many of the newest turns can fit: the others leave before any
    window.
    """
    budget, fixed = chars - HISTORY_RESERVE, len("User: \nAnswer (): ") + 6
    ended = F.concat(F.lit("(not finished"), F.when(F.coalesce("ended", F.lit("")) != "", F.concat(F.lit(": "), cut(F.col("ended"), 300))).otherwise(""), F.lit(")"))
    answer = F.when(F.coalesce("reply", F.lit("")) != "", F.col("reply")).when(F.col("reply").isNotNull(), "(no text)").otherwise(ended)
    n = turn_rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    few = first_rows(turn_rows.select("conv_id", "turn", F.coalesce("user", F.lit("")).alias("user"), answer.alias("answer"), F.coalesce("agent", F.lit("")).alias("agent")),
                     ["conv_id"], [F.desc("turn")], budget // fixed + HISTORY_FROM + 1).join(n, "conv_id")

    def cost(user: Column, answer: Column) -> Column:
        pair = F.to_json(F.array(_message("user", "input_text", user), _message("assistant", "output_text", answer)))
        return F.greatest(F.length(_turn_lines(user, answer)) + 2, F.length(pair) + 1).cast("long")

    u, a = F.col("user"), F.col("answer")
    limits = F.array(*[F.lit(n) for n in shortening_limits(budget)])
    fits = F.get(F.filter(limits, lambda n: cost(cut_middle(u, n), cut_middle(a, n)) <= budget), F.lit(0))
    rows = once(few, limit=F.when((F.col("rank") == 1) & (cost(u, a) > budget), fits))
    rows = rows.withColumns({c: F.when(F.col("limit").isNull(), F.col(c)).otherwise(cut_middle(F.col(c), F.col("limit"))) for c in ("user", "answer")})
    cuts = {"cut_user": cut(u, EXCERPT_USER), "cut_answer": cut(a, EXCERPT_ANSWER)}
    rows = once(rows, whole_cost=cost(u, a), **cuts)
    excerpt = F.to_json(F.struct(_excerpt(F.col("cut_user"), F.col("cut_answer")).alias("e")))
    rows = rows.withColumn("excerpt_cost", (F.length(excerpt) - 6 + 4).cast("long"))
    newest = Window.partitionBy("conv_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    may_whole = F.col("rank") <= F.when(F.col("n_turns") > HISTORY_FROM, HISTORY_WHOLE).otherwise(F.col("n_turns"))
    rows = rows.withColumn("upto", F.sum("whole_cost").over(newest)).withColumn("whole", may_whole & (F.col("upto") <= budget))
    of_conversation = Window.partitionBy("conv_id")
    used = F.coalesce(F.max(F.when(F.col("whole"), F.col("upto"))).over(of_conversation), F.lit(0))
    later = F.sum(F.when(F.col("whole"), 0).otherwise(F.col("excerpt_cost"))).over(newest)
    rows = rows.withColumn("fits", F.col("whole") | (used + later <= budget)).filter("fits")
    w = F.col("whole")
    return rows.select("conv_id", "turn", F.when(w, "whole").otherwise("excerpt").alias("form"), F.col("limit").isNotNull().alias("shortened"),
                       F.when(w, F.col("whole_cost")).otherwise(F.col("excerpt_cost")).alias("cost"), F.when(w, u).otherwise(F.col("cut_user")).alias("user"),
                       F.when(w, a).otherwise(F.col("cut_answer")).alias("answer"), "agent", (F.col("n_turns") - F.count("*").over(of_conversation)).alias("omitted"))


def history_handoffs(history: DataFrame) -> DataFrame:
    """One text per conversation from the rows of ``bounded_history``, whose budget bounds it: what is left out, the excerpts, then the whole
    turns, each from the oldest on."""
    u, a = F.col("user"), F.col("answer")
    parts = history.groupBy("conv_id").agg(
        F.max("omitted").alias("omitted"), F.max("shortened").alias("shortened"), F.count_if(F.col("form") == "excerpt").alias("n_excerpts"),
        F.array_sort(F.collect_list(F.struct((F.col("form") == "whole").alias("w"), "turn", F.when(F.col("form") == "whole", _turn_lines(u, a)).otherwise(_excerpt(u, a)).alias("said")))).alias("said"))
    left_out = F.when((F.col("omitted") > 0) | F.col("shortened"), F.concat_ws(
        " ", F.lit("The history is cut to a limit."), F.when(F.col("omitted") > 0, F.concat(F.lit("Earlier turns left out: "), F.col("omitted").cast("string"), F.lit("."))),
        F.when(F.col("shortened"), "The latest turn is shortened.")))
    heading = F.when(F.col("n_excerpts") > 0, F.concat(F.lit("Earlier turns in excerpts: "), F.col("n_excerpts").cast("string"), F.lit(".")))
    return parts.select("conv_id", "omitted", F.concat_ws("\n\n", left_out, heading, F.transform("said", lambda t: t["said"])).alias("handoff"))


def unseen_turns(turn_rows: DataFrame, states: DataFrame) -> DataFrame:
    """The turns after the last one each agent saw."""
    return turn_rows.select("conv_id", "turn").join(states.select("conv_id", F.col("agent").alias("for_agent"), "through"), "conv_id").filter(
        F.col("turn") > F.col("through")).select("conv_id", "for_agent", "turn")


def conversation_list(turn_rows: DataFrame, meta: DataFrame, today: Column) -> DataFrame:
    """Conversations with their day group and title: their own, else the first line of the first message, cut to 64. ``meta`` has
    ``conv_id, at, title``."""
    first = turn_rows.groupBy("conv_id").agg(F.min_by("user", "turn").alias("first"))
    days = F.datediff(today, F.to_date("at"))
    group = F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, "week").when(days < 30, "month").otherwise("older")
    rows = meta.join(first, "conv_id", "left")
    line = F.regexp_extract(F.coalesce("first", F.lit("")), r"^([^\n]*)", 1)
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), cut(F.when(line != "", line).otherwise("Annotate this"), 64))
    return rows.select("conv_id", "at", group.alias("day_group"), title.alias("title")).orderBy(F.desc("at"), "conv_id")


# --- one entry table for both dialects ---------------------------------------------------------------------------------------
def entries(events: DataFrame) -> DataFrame:
    """Events of both dialects as one table: ``session, ord, pos, kind, text, name, is_error``."""
    def made(kind, text=None, name=None, error=None):
        return F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if text is None else text.cast("string")).alias("text"),
                        (F.lit(None).cast("string") if name is None else name.cast("string")).alias("name"),
                        (F.lit(False) if error is None else F.coalesce(error, F.lit(False))).alias("is_error"))

    kind, sub = get("type"), get("subtype")
    own = kind == OWN
    content = F.coalesce(F.try_variant_get("v", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))

    def block(c):
        b = F.try_variant_get(c, "$.type", "string")
        text = F.trim(F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit("")))
        name = F.try_variant_get(c, "$.name", "string")
        cmd = F.coalesce(F.try_variant_get(c, "$.input.command", "string"), F.lit(""))
        return (F.when((kind == "assistant") & (b == "text") & (text != ""), made("text", text))
                .when((kind == "assistant") & (b == "tool_use"), made("tool", F.concat(name, F.lit("("), cmd, F.lit(")")), name))
                .when((kind == "user") & (b == "tool_result"), made("result", F.try_variant_get(c, "$.content", "string"), None, F.try_variant_get(c, "$.is_error", "boolean"))))

    item, method = get("params.item.type"), get("method")
    failed = get("params.item.status").isin("failed", "declined")
    single = F.array_compact(F.array(
        F.when((kind == "system") & (sub == "init"), made("info", F.coalesce(get("model"), F.lit("?")))),
        F.when((kind == "system") & (sub == "compact_boundary"), made("compacted", get("compact_metadata.post_tokens"))),
        F.when((kind == "result") & (F.coalesce(get("is_error", "boolean"), F.lit(False)) | (F.coalesce(sub, F.lit("success")) != "success")),
               made("final", F.trim(F.coalesce(get("result"), sub, F.lit("failed"))), None, F.lit(True))),
        F.when(own & (sub == "run"), made("run", get("user"))), F.when(own & sub.isin("prompt", "steer"), made("prompt", get("text"))),
        F.when(own & (sub == "end"), made("final", F.coalesce(get("text"), get("outcome"), F.lit("failed")), None, F.lit(True))),
        F.when(own & (sub == "counts"), made("counts", get("highlights"))), F.when(own & (sub == "time"), made("time", get("at"))),
        F.when(own & (sub == "compacted"), made("compacted", get("post"))), F.when(own & (sub == "compact"), made("compacting")),
        F.when((method == "item/started") & (item == "commandExecution"), made("tool", F.concat(F.lit("Shell("), get("params.item.command"), F.lit(")")), F.lit("Shell"))),
        F.when((method == "item/completed") & (item == "agentMessage") & (F.trim(get("params.item.text")) != ""), made("text", F.trim(get("params.item.text")))),
        F.when((method == "item/completed") & (item == "commandExecution"), made(
            "result", get("params.item.aggregatedOutput"), None, failed | (F.coalesce(get("params.item.exitCode", "int"), F.lit(0)) != 0))),
        F.when((method == "item/completed") & (item == "webSearch"), made("tool", F.concat(F.lit("WebSearch("), get("params.item.query"), F.lit(")")), F.lit("WebSearch")))))
    blocks = F.array_compact(F.transform(content, block))
    return events.select("session", "ord", F.posexplode(F.concat(single, blocks)).alias("pos", "e")).select("session", "ord", "pos", "e.*")


def wall_time(log: DataFrame) -> DataFrame:
    """Seconds from the first run to the last counts of each session, else what the probe measured."""
    began, counted = F.min_by("at", F.when(F.col("kind") == "run", F.col("ord"))), F.max_by("at", F.when(F.col("kind") == "counts", F.col("ord")))
    rows = log.groupBy("session").agg(began.alias("began"), counted.alias("counted"), F.max("probe").alias("probe"))
    return rows.select("session", F.when(F.col("counted") >= F.col("began"), F.bround((F.col("counted") - F.col("began")) / 1000, 1))
                       .otherwise(F.col("probe").cast("double")).alias("wall_s"))


@dataclass(frozen=True)
class ClosingForm:
    """A form of a closing line: its pattern and the groups that hold the count, the unit, words on the count and words alone."""

    pattern: str
    count: int
    words: tuple[int, ...]
    unit: int | None = None
    tail: int | None = None
    glue: str = ""


# How a closing line says what warnings are left
CLOSING_FORMS = (
    ClosingForm(r"剩[余餘]警告\s*[:：]?\s*(\d+)\s*([条條])\s*(?:[（(](.*)[）)]|[:：]\s*([^\n]+)|([^\s。．.!！，,；;][^\n]*))?", count=1, unit=2, words=(3, 4), tail=5),
    ClosingForm(r"(?i)(\d+)\s+remaining warnings?\b\s*(?:\((.*)\)|[:：]\s*([^\n]+))?", count=1, words=(2, 3)),
    ClosingForm(r"(?i)remaining warnings?\s*[:：]\s*(\d+)(?:\s*\((.*)\)|\s+([A-Za-z][^\n]*))?\s*[.。]?\s*$", count=1, words=(2,), tail=3, glue=" "))
CLOSING_LABEL = r"(?i)(?:剩[余餘]警告\s*[:：]|remaining warnings\s*[:：])\s*([^\n]+)"
CLOSING_ZERO = r"^0(?:\s*[条條件个個])?$"
CLOSING_NONE = ("无", "無", "没有", "沒有", "none")
CLOSING_DENIAL = r"(?i)[无無]剩[余餘]警告|[没沒]有剩[余餘]警告|no (?:remaining )?warnings"
REMARK = r"\s*[(（][^)）]*[)）]\s*[.。]?$"
END_MARKS = r"[\s.。．!！]+$"


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() and c.isascii() else c for c in text)


def none_pattern(label: str, none: str) -> str:
    """What says that nothing is left: a word for none by itself, with an aside after a comma, or before a word that begins like one of
    the label's own words (of four letters or more)."""
    words = "|".join(_literal(w) for w in (*CLOSING_NONE, none.lower()) if w)
    begins = "|".join(sorted({_literal(w[:4]) for w in label.lower().split() if len(w) >= 4}))
    own = rf"|\s+(?:{begins})\p{{L}}*" if begins else ""
    return rf"{CLOSING_ZERO}|^(?:{words})(?:\s*[，,；;].*{own})?$"


def closing_warnings(reply: Column, label: str = "Remaining warnings", none: str = "none") -> Column:
    """What the last line of a reply says of the warnings left: an empty text for none, the words or the count, null when it
    does not say. A form with a count decides before a label with words, that before a plain denial, and that before ``label``, which
    with ``none`` is how the user's language says it."""
    line = F.regexp_extract(F.trim(reply), r"([^\n]*)$", 1)

    def bare(c: Column) -> Column:
        return F.regexp_replace(F.trim(c), END_MARKS, "")

    def counted(form: ClosingForm) -> Column:
        group = {i: F.regexp_extract(line, form.pattern, i) for i in (form.count, form.unit, form.tail, *form.words) if i}
        amount = F.concat_ws(" ", *[group[i] for i in (form.count, form.unit) if i])
        alone = bare(F.concat(*[group[i] for i in form.words]))
        said = F.when(alone != "", alone).otherwise(amount)
        if form.tail:
            said = F.when(group[form.tail] != "", bare(F.concat(amount, F.lit(form.glue), group[form.tail]))).otherwise(said)
        return F.when(group[form.count].rlike("^0+$"), "").otherwise(said)

    def labelled(pattern: str) -> Column:
        words = F.regexp_extract(line, pattern, 1)
        return F.when(bare(F.regexp_replace(F.lower(words), REMARK, "")).rlike(none_pattern(label, none)), "").otherwise(bare(words))

    ways = [*((form.pattern, counted(form)) for form in CLOSING_FORMS), (CLOSING_LABEL, labelled(CLOSING_LABEL)), (CLOSING_DENIAL, F.lit(""))]
    if label:
        own = rf"(?iu){_literal(label)}\s*[:：]\s*(.+)$"
        said = labelled(own)
        ways.append((own, F.when((said != "") | (bare(F.regexp_extract(line, own, 1)) != ""), said)))
    return F.coalesce(*[F.when(line.rlike(pattern), said) for pattern, said in ways])
