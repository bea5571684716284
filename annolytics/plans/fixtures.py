"""Tables of the engine's own shapes, derived from the given tables, in Spark and in SQL. Integer arithmetic throughout."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators import text as X
from ..operators.ordered import by_rows, once, spread
from .registry import Tables

# A page is eight rows, a block four; a header row, a page number row, and headings that open a bibliography, a checklist and
# an appendix.
LINES_SQL = r"""lines AS (
SELECT doc_id, CAST(pos AS INT) AS row_no, CAST(floor(pos / 8) AS INT) + 1 AS page, CAST(floor(pos / 4) AS INT) AS block,
  CASE WHEN pos % 8 = 0 THEN 'Running  Header' WHEN pos % 8 = 7 THEN CAST(CAST(floor(pos / 8) AS INT) + 1 AS VARCHAR)
       WHEN pos = 13 THEN '5 References' WHEN pos = 18 AND doc_id % 3 = 0 THEN 'A. Paper Checklist'
       WHEN pos = 22 AND doc_id % 2 = 0 THEN 'B Appendix' WHEN pos % 9 = 4 THEN line || '-' ELSE line END AS text,
  CASE WHEN pos = 18 OR pos = 22 THEN 14.0 WHEN pos % 23 = 10 THEN 14.0 WHEN pos % 11 = 3 THEN 8.0 ELSE 10.0 END AS size,
  pos % 29 = 5 AS bold, CASE WHEN pos % 37 = 9 THEN 0 ELSE 1 END AS dir_x, CASE WHEN pos % 37 = 9 THEN 1 ELSE 0 END AS dir_y
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) s)"""


def documents(t: Tables) -> DataFrame:
    """One row per document with its lines as an array."""
    def line(text, pos):
        page = F.floor(pos / 8).cast("int") + 1
        words = (F.when(pos % 8 == 0, "Running  Header").when(pos % 8 == 7, page.cast("string"))
                 .when(pos == 13, "5 References").when((pos == 18) & (F.col("doc_id") % 3 == 0), "A. Paper Checklist")
                 .when((pos == 22) & (F.col("doc_id") % 2 == 0), "B Appendix")
                 .when(pos % 9 == 4, F.concat(text, F.lit("-"))).otherwise(text))
        size = (F.when((pos == 18) | (pos == 22), 14.0).when(pos % 23 == 10, 14.0).when(pos % 11 == 3, 8.0).otherwise(10.0))
        turned = pos % 37 == 9
        return F.struct(pos.alias("row_no"), page.alias("page"), F.floor(pos / 4).cast("int").alias("block"), words.alias("text"),
                        size.alias("size"), (pos % 29 == 5).alias("bold"), F.when(turned, 0).otherwise(1).alias("dir_x"),
                        F.when(turned, 1).otherwise(0).alias("dir_y"))

    return once(spread(t.documents.select("doc_id", "text")), lines=F.transform(F.split("text", "\n"), line)).select("doc_id", "lines")


def lines(t: Tables) -> DataFrame:
    return documents(t).select("doc_id", F.inline("lines"))


def norm_sql(e: str) -> str:
    return (rf"regexp_replace(replace(replace(replace(replace(lower({e}), '’', ''''), '‘', ''''), '“', chr(34)), '”', chr(34)), "
            r"'[\s\-–—\x{00ad}]', '', 'g')")


# Words of the lines with boxes: the words of a page in reading order
WORDS_SQL = """words AS (
SELECT doc_id, page, block, row_no % 8 AS line, word, (wpos * 37) % 480 AS x0, (wpos * 37) % 480 + 6 * length(word) AS x1,
  14 * (row_no % 8) AS y0, 14 * (row_no % 8) + 10 AS y1,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY row_no, wpos) - 1 AS word_no
FROM (SELECT doc_id, page, block, row_no, unnest(string_split(text, ' ')) AS word,
             unnest(range(len(string_split(text, ' ')))) AS wpos FROM lines) s WHERE word <> '')"""
INDEXED_SQL = f"""indexed AS (
SELECT *, sum(n) OVER (PARTITION BY doc_id, page ORDER BY word_no) - n AS "offset" FROM (
  SELECT *, {norm_sql('word')} AS norm, length({norm_sql('word')}) AS n FROM words) w),
texts AS (SELECT doc_id, page, string_agg(norm, '' ORDER BY word_no) AS text, list(word ORDER BY word_no) AS ws FROM indexed GROUP BY doc_id, page)"""


def pages(t: Tables) -> DataFrame:
    """One row per page with its words as an array."""
    def by_page(rows):
        return X.runs(rows, X.positions(rows, lambda r, i: (i == 0) | (F.get(rows, i - 1)["page"] != r["page"])))

    docs = documents(t).select("doc_id", F.explode(let(F.col("lines"), by_page)).alias("rows"))

    def words(r):
        made = F.transform(F.split(r["text"], " "), lambda w, i: F.struct(
            w.alias("word"), r["block"].alias("block"), (r["row_no"] % 8).alias("line"), (i * 37 % 480).alias("x0"),
            (i * 37 % 480 + 6 * F.length(w)).alias("x1"), (r["row_no"] % 8 * 14).alias("y0"), (r["row_no"] % 8 * 14 + 10).alias("y1")))
        return F.filter(made, lambda w: w["word"] != "")

    docs = once(docs, own=F.flatten(F.transform("rows", words))).select("doc_id", F.col("rows")[0]["page"].alias("page"), "own")
    return once(docs, words=F.transform("own", lambda w, i: F.struct(i.alias("word_no"), *[w[c].alias(c) for c in (
        "word", "block", "line", "x0", "x1", "y0", "y1")]))).drop("own").filter(F.size("words") > 0)


# One phrase per page: one to three of its words from the third on; every other page asks for an occurrence
INTENTS_SQL = """intents AS (
SELECT doc_id, page, array_to_string(ws[3:3 + CAST(doc_id % 3 AS INT)], ' ') AS phrase,
  CASE WHEN page % 2 = 0 THEN 1 + CAST(doc_id % 2 AS INT) END AS occurrence FROM texts WHERE len(ws) >= 3)"""


def intents(t: Tables) -> DataFrame:
    words = F.slice(F.transform("words", lambda w: w["word"]), F.lit(3), (F.col("doc_id") % 3 + 1).cast("int"))
    return pages(t).filter(F.size("words") >= 3).select(
        "doc_id", "page", F.array_join(words, " ").alias("phrase"),
        F.when(F.col("page") % 2 == 0, (1 + F.col("doc_id") % 2).cast("int")).alias("occurrence"))


def sentences(t: Tables) -> DataFrame:
    """Sentences of the whole documents, ten to a page."""
    from ..functions import text as T
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(T.split_sentences("text")).alias("pos", "text"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("id"), (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), "text")


SENTENCES_SQL = """sentences AS (SELECT doc_id, id, CAST(floor((id - 1) / 10) AS INT) + 1 AS page, text FROM sents)"""

# Caption lines: a figure or table label opens some lines, and some only speak of one
CAPTIONS_SQL = """caption_lines AS (
SELECT doc_id, row_no, page, CASE WHEN row_no % 17 = 4 THEN 'Figure ' || (row_no % 7) || ': ' || text
  WHEN row_no % 17 = 9 THEN 'Figure ' || row_no || ' shows ' || text WHEN row_no % 17 = 12 THEN 'Tab. s' || (row_no % 5) || '. ' || text
  WHEN row_no % 17 = 15 THEN 'TABLE A.' || (row_no % 3) || ' | ' || text ELSE text END AS text FROM lines)"""


def caption_lines(t: Tables) -> DataFrame:
    n = F.col("row_no")
    text = (F.when(n % 17 == 4, F.concat(F.lit("Figure "), (n % 7).cast("string"), F.lit(": "), "text"))
            .when(n % 17 == 9, F.concat(F.lit("Figure "), n.cast("string"), F.lit(" shows "), "text"))
            .when(n % 17 == 12, F.concat(F.lit("Tab. s"), (n % 5).cast("string"), F.lit(". "), "text"))
            .when(n % 17 == 15, F.concat(F.lit("TABLE A."), (n % 3).cast("string"), F.lit(" | "), "text")).otherwise(F.col("text")))
    return lines(t).select("doc_id", "row_no", "page", text.alias("text"))


# Library items: customers are papers, orders their attachments and notes
ITEMS_SQL = """lib_items AS (
SELECT 'I' || c_custkey AS key, 'journalArticle' AS item_type, NULL AS content_type, NULL AS parent FROM customer
UNION ALL SELECT 'C' || o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'note' ELSE 'attachment' END,
  CASE o_orderstatus WHEN 'F' THEN 'application/pdf' WHEN 'P' THEN 'text/html' END, 'I' || o_custkey FROM orders)"""


def lib_items(t: Tables) -> DataFrame:
    papers = t.customer.select(F.concat(F.lit("I"), F.col("c_custkey").cast("string")).alias("key"), F.lit("journalArticle").alias("item_type"),
                               F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("parent"))
    s = F.col("o_orderstatus")
    kids = t.orders.select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("key"),
                           F.when(s == "O", "note").otherwise("attachment").alias("item_type"),
                           F.when(s == "F", "application/pdf").when(s == "P", "text/html").alias("content_type"),
                           F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("parent"))
    return papers.unionByName(kids)


# Annotations with boxes on a grid, from the order lines
ANNOTATIONS_SQL = """annotations AS (
SELECT concat('A', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS key, l_partkey AS parent,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS global_ord,
  l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey AS ord,
  CASE WHEN l_returnflag = 'R' THEN 'highlight' WHEN l_returnflag = 'A' THEN 'text' WHEN l_suppkey % 2 = 0 THEN 'note' ELSE 'underline' END AS type,
  CASE l_suppkey % 4 WHEN 0 THEN '#ff6666' WHEN 1 THEN '#FFD400' WHEN 2 THEN '#5fb236' ELSE '#2ea8e5' END AS color,
  CAST(l_quantity AS INT) AS page, CAST((l_orderkey % 40) * 12 AS INT) AS x0, CAST((l_suppkey % 50) * 14 AS INT) AS y0,
  CAST((l_orderkey % 40) * 12 + CASE WHEN l_suppkey % 5 = 0 THEN 300 ELSE 60 END AS INT) AS x1, CAST((l_suppkey % 50) * 14 + 10 AS INT) AS y1,
  concat('sentence  ', l_orderkey % 97) AS text,
  CASE l_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('key: note ', l_partkey % 13) WHEN 2 THEN concat('1. first', chr(10), '2. second ', l_partkey % 7)
    WHEN 3 THEN concat('see [', l_suppkey % 9, '] → next') ELSE concat('plain note ', l_partkey % 13, ' on x^2') END AS comment,
  l_linestatus = 'O' AS own, epoch(l_shipdate)::BIGINT AS added, epoch(l_shipdate)::BIGINT + (l_linenumber % 3) * 4 AS modified
FROM lineitem)"""


def annotations(t: Tables) -> DataFrame:
    o, p, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")

    def st(c):
        return c.cast("string")
    comment = (F.when(o % 6 == 0, "").when(o % 6 == 1, F.concat(F.lit("key: note "), st(p % 13)))
               .when(o % 6 == 2, F.concat(F.lit("1. first\n2. second "), st(p % 7)))
               .when(o % 6 == 3, F.concat(F.lit("see ["), st(s % 9), F.lit("] → next")))
               .otherwise(F.concat(F.lit("plain note "), st(p % 13), F.lit(" on x^2"))))
    added = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    return spread(t.lineitem).select(
        F.concat(F.lit("A"), F.concat_ws("-", st(o), st(n), st(p), st(s))).alias("key"), p.alias("parent"),
        (o * 1000000 + n * 100000 + s).alias("ord"),
        F.when(F.col("l_returnflag") == "R", "highlight").when(F.col("l_returnflag") == "A", "text")
        .when(s % 2 == 0, "note").otherwise("underline").alias("type"),
        F.when(s % 4 == 0, "#ff6666").when(s % 4 == 1, "#FFD400").when(s % 4 == 2, "#5fb236").otherwise("#2ea8e5").alias("color"),
        F.col("l_quantity").cast("int").alias("page"), (o % 40 * 12).cast("int").alias("x0"), (s % 50 * 14).cast("int").alias("y0"),
        (o % 40 * 12 + F.when(s % 5 == 0, 300).otherwise(60)).cast("int").alias("x1"), (s % 50 * 14 + 10).cast("int").alias("y1"),
        F.concat(F.lit("sentence  "), st(o % 97)).alias("text"), comment.alias("comment"), (F.col("l_linestatus") == "O").alias("own"),
        added.alias("added"), (added + n % 3 * 4).alias("modified"))


# --- logs: one text for both engines -------------------------------------------------------------------------------------------
LOG_BODY = r"""
SELECT session, ord, raw FROM (
  SELECT user_id AS session, k * 2 AS ord, k, event_type, CASE event_type
    WHEN 'click' THEN concat('{"type":"assistant","uuid":"r', k, '","message":{"id":"m', user_id, '-', b, '","usage":{"input_tokens":', k % 50, ',"cache_read_input_tokens":',
      CASE WHEN k % 7 = 0 THEN 'null' ELSE CAST(k % 1000 * 10 AS VARCHAR(20)) END, ',"output_tokens":', k % 97, '},"content":[{"type":"tool_use","id":"T', user_id, '-', b, '-', k % 3,
      '","name":"', CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Edit' ELSE 'Bash' END, '","input":{"command":"', CASE k % 5 WHEN 0 THEN 'tool --config a.json --apply'
      WHEN 1 THEN 'cat sentences.txt' WHEN 2 THEN 'tool extract --pdf x' WHEN 3 THEN 'curl http://localhost' ELSE 'make' END, '"}}]}}')
    WHEN 'view' THEN concat('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"T', user_id, '-', b, '-', k % 3, '","content":"', repeat('x', CAST(k % 40 AS INT)),
      '","is_error":', CASE WHEN k % 9 = 0 THEN 'true' ELSE 'false' END, '}]}}')
    WHEN 'purchase' THEN concat('{"type":"result","session_id":', CASE WHEN k % 11 = 0 THEN 'null' ELSE concat('"s', user_id, '"') END, ',"total_cost_usd":', k % 5000, '.25,"num_turns":', k % 6,
      ',"duration_ms":', k % 900 * 10, ',"is_error":', CASE WHEN k % 8 = 0 THEN 'true' ELSE 'false' END, ',"usage":{"input_tokens":', k % 30, ',"output_tokens":', k % 20, '}',
      CASE WHEN k % 13 = 0 THEN ',"model_usage_since_last_result":{"a":{"costUSD":0.5},"b":{"costUSD":0.25}}' ELSE '' END, ',"result":"Done ', k, '"}')
    WHEN 'signup' THEN concat('{"type":"annolytics","subtype":"run","agent":"a","user":', CASE WHEN k % 3 = 0 THEN 'null' ELSE concat('"words ', k, '"') END, '}')
    ELSE CASE k % 4 WHEN 0 THEN '{"type": ' WHEN 1 THEN '   '
      WHEN 2 THEN concat('{"type":"assistant","uuid":"r', k, '","message":{"id":"n', k, '","content":[{"type":"text","text":" Done ', k + 1, ' "}]}}')
      ELSE concat('{"method":"item/completed","payload":1,"params":{"item":{"type":"agentMessage","text":"said ', k, '"}}}') END END AS raw
  FROM (SELECT user_id, event_id AS k, event_type, CAST(floor(event_id / 700) AS BIGINT) AS b FROM events) e) r
"""
LOG_REPLAYS = "UNION ALL SELECT session, ord + 31, raw FROM ({body}) p WHERE raw LIKE '{{\"type\":\"assistant\",\"uuid\"%' AND ord % 20 = 6"


def _log_text() -> str:
    return LOG_BODY + LOG_REPLAYS.format(body=LOG_BODY)


LOG_SQL = "log AS (" + _log_text() + ")"


def both(t: Tables, sql: str, *tables: str) -> DataFrame:
    """A derivation whose text runs in both engines."""
    for name in tables:
        spread(getattr(t, name)).createOrReplaceTempView(f"annolytics_{name}")
        sql = sql.replace(f"FROM {name} ", f"FROM annolytics_{name} ").replace(f"FROM {name})", f"FROM annolytics_{name})")
    return t.spark.sql(sql)


def log_lines(t: Tables) -> DataFrame:
    return both(t, _log_text(), "events")


COUNTER_BODY = """SELECT user_id AS session, event_id, rn * 2 AS ord, tokens AS last_input, cached AS last_cached, output AS last_output,
  SUM(tokens) OVER w AS total_input, SUM(cached) OVER w AS total_cached, SUM(output) OVER w AS total_output
FROM (SELECT user_id, event_id, rn, tokens, CAST(floor(tokens / 2) AS BIGINT) AS cached, 1 + event_id % 5 AS output, CAST(floor((rn - 1) / 40) AS INT) AS seg FROM (
  SELECT user_id, event_id, CASE WHEN event_id % 17 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) + 1 END AS tokens,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events ) e) s
WINDOW w AS (PARTITION BY user_id, seg ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
COUNTERS_SQL = f"first_counters AS ({COUNTER_BODY}), counters AS (SELECT *, 0 AS replay FROM first_counters UNION ALL SELECT * REPLACE (ord + 31 AS ord), 1 FROM first_counters WHERE event_id % 10 = 3)"


def counters(t: Tables) -> DataFrame:
    """The rows move once, by user, and every tenth is given twice where it is made. The number of partitions is stated: by the bytes of this shuffle,
    which are few, adaptive execution would put a large table's rows into as few tasks as there are cores."""
    events = by_rows(t.events, "user_id")
    events.createOrReplaceTempView("annolytics_counter_events")
    rows = t.spark.sql(COUNTER_BODY.replace("FROM events )", "FROM annolytics_counter_events )"))
    sums = {c: F.col(c).cast("long") for c in ("ord", "last_input", "last_cached", "last_output", "total_input", "total_cached", "total_output")}
    rows = rows.withColumns(sums)
    times = F.when(F.col("event_id") % 10 == 3, F.array("ord", F.col("ord") + 31)).otherwise(F.array("ord"))
    return rows.withColumn("ord", times).select(*[F.explode(c).alias(c) if c == "ord" else c for c in rows.columns])


CONV_BODY = """SELECT conv_id, turn * 10 AS ord, 'run' AS kind, CASE WHEN (conv_id + CAST(floor(turn / 2) AS BIGINT)) % 2 = 0 THEN 'a' ELSE 'b' END AS agent,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL ELSE text END AS words, CAST(NULL AS VARCHAR(10)) AS text, false AS is_error, false AS resent, (conv_id + turn) % 13 = 0 AS compact, 0 AS num_turns, 0 AS tokens FROM conversations WHERE role <> 'assistant'
UNION ALL SELECT conv_id, turn * 10 + 1, 'prompt', CASE WHEN (conv_id + CAST(floor(turn / 2) AS BIGINT)) % 2 = 0 THEN 'a' ELSE 'b' END, concat('asked ', text), NULL, false, false, false, 0, 0 FROM conversations WHERE role = 'user' AND conv_id % 3 = 0
UNION ALL SELECT conv_id, turn * 10 + 2, 'steer', CASE WHEN (conv_id + CAST(floor(turn / 2) AS BIGINT)) % 2 = 0 THEN 'a' ELSE 'b' END, NULL, concat('steer ', turn), false, false, false, 0, 0 FROM conversations WHERE role = 'user' AND turn % 4 = 2
UNION ALL SELECT conv_id, turn * 10, 'message', CASE WHEN (conv_id + CAST(floor(turn / 2) AS BIGINT)) % 2 = 0 THEN 'a' ELSE 'b' END, NULL, text, false, false, false, 0, 0 FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn * 10 + 1, 'result', CASE WHEN (conv_id + CAST(floor(turn / 2) AS BIGINT)) % 2 = 0 THEN 'a' ELSE 'b' END, NULL, text, (conv_id * 7 + turn) % 11 = 0, false, false, 1 + turn, length(text) FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn * 10 + 2, 'gone', CASE WHEN (conv_id + CAST(floor(turn / 2) AS BIGINT)) % 2 = 0 THEN 'a' ELSE 'b' END, NULL, NULL, false, true, false, 0, 0 FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 6 = 1
UNION ALL SELECT conv_id, turn * 10 + 3, 'end', CASE WHEN (conv_id + CAST(floor(turn / 2) AS BIGINT)) % 2 = 0 THEN 'a' ELSE 'b' END, NULL, 'cancelled', true, false, false, 0, 0 FROM conversations WHERE role = 'assistant' AND turn % 5 = 3
UNION ALL SELECT conv_id, turn * 10 + 4, 'rewind', CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END, NULL, CASE WHEN conv_id % 3 = 0 THEN 'point' END, false, false, false, 0, 0 FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 7 = 2"""
CONV_SQL = f"conv_log AS ({CONV_BODY})"


def conv_log(t: Tables) -> DataFrame:
    return both(t, CONV_BODY, "conversations")
