"""Checks of comments, notes, configurations and translations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import rules as R
from ..functions import text as T
from ..operators import anchor as A
from ..operators import checks as C
from ..operators import fidelity as X
from ..operators.ordered import spread
from . import fixtures as fx
from .anchor_queries import TO_SENTENCES
from .diff_queries import NOTES_SQL, _notes
from .fixtures import ANNOTATIONS_SQL
from .registry import Tables, query

BANNED = ["plain note 7", "second 3"]
VARIED = r"""varied AS (SELECT * REPLACE (CASE ord % 9 WHEN 0 THEN comment || ' $a_1$' WHEN 1 THEN '<em>x</em> ' || comment WHEN 2 THEN comment || ' <b>open' WHEN 3 THEN '方法：' || comment
  WHEN 4 THEN 'H<sub>2 ' || comment ELSE comment END AS comment) FROM annotations)"""


def _varied(t: Tables):
    a, o, c = fx.annotations(t), F.col("ord"), F.col("comment")
    return a.withColumn("comment", F.when(o % 9 == 0, F.concat(c, F.lit(" $a_1$"))).when(o % 9 == 1, F.concat(F.lit("<em>x</em> "), c)).when(o % 9 == 2, F.concat(c, F.lit(" <b>open")))
                        .when(o % 9 == 3, F.concat(F.lit("方法："), c)).when(o % 9 == 4, F.concat(F.lit("H<sub>2 "), c)).otherwise(c))


def _only(t: Tables, *kinds: str):
    return C.style_findings(_varied(t), BANNED).filter(F.col("kind").isin(*kinds)).select("key", "kind", "reason")


@query("e10_display_defects", ANNOTATIONS_SQL, VARIED, r"""defects AS (SELECT key, unnest([
  CASE WHEN regexp_matches(comment, '\$\$[^$]*\$\$|\$[^$\n]+\$|\\\([^()]*\\\)|\\[a-zA-Z]+') THEN 'latex: raw LaTeX' END,
  CASE WHEN regexp_matches(CASE WHEN type = 'text' THEN replace(comment, '^', '') ELSE comment END, '\^|_\{|(?:\b10|\de)−\d') THEN 'math_format: exponent or subscript without markup' END,
  CASE WHEN contains(comment, '<em>') THEN 'tag: not rendered: em' END,
  CASE WHEN type = 'text' AND contains(comment, '<sub>') THEN 'tag: script without its closing tag' END,
  CASE WHEN type <> 'text' AND contains(comment, '<sub>') THEN 'tag: unclosed: sub' WHEN type <> 'text' AND contains(comment, '<b>') THEN 'tag: unclosed: b' END,
  CASE WHEN contains(comment, chr(10)) THEN 'line_break: hard line break' END]) AS f FROM varied)""", "SELECT key, split_part(f, ': ', 1) AS kind, substr(f, length(split_part(f, ': ', 1)) + 3) AS reason FROM defects WHERE f IS NOT NULL")
def display_defects(t: Tables):
    return _only(t, "latex", "math_format", "tag", "line_break")


@query("e11_style_rules", ANNOTATIONS_SQL, VARIED, r"""defects AS (SELECT key, unnest([
  CASE WHEN type IN ('text', 'note') AND regexp_matches(comment, '^[^：:，,。.]{1,12}[：:]\s*\S')
     AND length(regexp_replace(string_split_regex(comment, '[：:]')[1], '[^\x{3400}-\x{9fff}]', '', 'g')) + len(regexp_extract_all(regexp_replace(string_split_regex(comment, '[：:]')[1], '[\x{3400}-\x{9fff}]', ' ', 'g'), '[\p{L}\p{N}]+')) <= 6 THEN 'label' END,
  CASE WHEN type IN ('text', 'note') AND contains(comment, '→') THEN 'symbol' END,
  CASE WHEN contains(comment, 'plain note 7') OR contains(comment, 'second 3') THEN 'banned_phrase' END]) AS kind FROM varied)""", "SELECT key, kind FROM defects WHERE kind IS NOT NULL")
def style_rules(t: Tables):
    return _only(t, "label", "symbol", "banned_phrase").select("key", "kind")


@query("e12_earlier_text", ANNOTATIONS_SQL, r"""sides AS (SELECT *, type IN ('highlight', 'underline') AS mark, trim(regexp_replace(CASE WHEN type IN ('highlight', 'underline') THEN text ELSE comment END, '\s+', ' ', 'g')) AS body, parent % 50 AS paper FROM annotations)""", """
SELECT n.key, arg_min(o.key, (o.ord, o.key)) AS listed_key FROM sides n JOIN sides o ON o.own AND NOT n.own AND o.paper = n.paper AND o.page = n.page AND o.mark = n.mark AND n.body <> '' AND n.body = o.body GROUP BY n.key""")
def earlier_text(t: Tables):
    rows = fx.annotations(t).withColumns({"mark": R.is_mark(), "paper": F.col("parent") % 50,
                                          "body": T.collapse(F.when(R.is_mark(), F.col("text")).otherwise(F.col("comment")))}).filter("body <> ''")
    keys = ["paper", "page", "mark"]
    listed = rows.filter("own").select(*keys, T.brief("body").alias("listed"), F.col("key").alias("listed_key"), "ord")
    return A.listed_as(rows.filter("NOT own").select(*keys, "key", "body"), listed, keys).filter("listed_key IS NOT NULL").select("key", "listed_key")


@query("e13_core_count", ANNOTATIONS_SQL, """SELECT parent, n AS core FROM (SELECT parent, count(*) FILTER (lower(color) = '#ff6666' AND type IN ('highlight', 'underline')) AS n FROM annotations
  GROUP BY parent) c WHERE n < 3 OR n > 5""")
def core_count(t: Tables):
    return C.core_count(fx.annotations(t), 3, 5)


NOTE_CASES = r"""cases AS (SELECT key, CASE key % 6 WHEN 0 THEN html WHEN 1 THEN '<div data-schema-version="9">' || html || '</div>' WHEN 2 THEN '<p>no title</p>' || html WHEN 3 THEN '  <!-- c -->'
  WHEN 4 THEN html || '<span class="math">a\\b</span><pre class="math">x</pre><span class="math">$y$</span>' ELSE html || ' $z_1$ ' END AS html FROM notes)"""


@query("e14_note_rules", NOTES_SQL, NOTE_CASES, r"""rest AS (SELECT *, regexp_replace(html, '(?s)<(?:span|pre) class="math">(.*?)</(?:span|pre)>', ' ', 'g') AS plain FROM cases)""", r"""
SELECT key, 'note_title' AS kind, 'no title' AS reason FROM cases WHERE key % 6 = 2
UNION ALL SELECT key, 'note_title', 'empty' FROM cases WHERE key % 6 = 3
UNION ALL SELECT key, 'note_math', unnest(['double backslash in mathematics', 'mathematics without delimiters']) FROM cases WHERE key % 6 = 4
UNION ALL SELECT key, 'note_math', 'LaTeX outside mathematics' FROM rest WHERE regexp_matches(plain, '\$\$|\$[^$\n]+\$')""")
def note_rules(t: Tables):
    k, h = F.col("key"), F.col("html")
    notes = _notes(t)[0].select("key", F.when(k % 6 == 0, h).when(k % 6 == 1, F.concat(F.lit('<div data-schema-version="9">'), h, F.lit("</div>")))
                                .when(k % 6 == 2, F.concat(F.lit("<p>no title</p>"), h)).when(k % 6 == 3, "  <!-- c -->")
                                .when(k % 6 == 4, F.concat(h, F.lit('<span class="math">a\\\\b</span><pre class="math">x</pre><span class="math">$y$</span>')))
                                .otherwise(F.concat(h, F.lit(" $z_1$ "))).alias("html"))
    return C.note_findings(notes)


CONFIGS = {0: ('{"id": 4, "comment": "x", "color": "Red"}', []), 1: ('{"id": "4", "colour": "red"}', ["unknown key colour", "id must be a sentence number"]),
           2: ('{"ids": [5, 2], "level": "claim"}', ["ids must be two sentence numbers in order"]), 3: ('{"page": 0, "text": " "}', ["give id, ids, or a page", "give id, ids, or text"]),
           4: ('{"page": 3, "text": "a", "color": "pinkish", "level": "none"}', ["unknown colour", "unknown level"]),
           5: ('{"ids": [2, 4], "type": "circle", "occurrence": 0}', ["occurrence must be a number from 1", "type must be highlight or underline"]),
           6: ('{"id": 9, "tags": ["a", " "]}', ["tags must be non-empty texts"]), 7: ('{"id": 9, "tags": ["annolytics"], "occurrence": null}', ["tags must not include the tool''s"])}


@query("e15_configuration", "SELECT o_orderkey, unnest(CASE o_orderkey % 8 " + " ".join(
    f"WHEN {k} THEN [" + ", ".join(f"'{p}'" for p in ps) + "]" for k, (_, ps) in CONFIGS.items() if ps) + " END) AS problem FROM orders WHERE o_orderkey % 8 <> 0")
def configuration(t: Tables):
    raw = F.element_at(F.array(*[F.lit(CONFIGS[i][0]) for i in range(8)]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return C.intent_findings(t.orders.select("o_orderkey", raw.alias("raw")), levels=("claim",))


FINDINGS = """docs AS (SELECT DISTINCT l_partkey % 220 AS parent FROM lineitem),
found AS (SELECT l_partkey % 220 AS parent, l_orderkey AS key, CASE l_suppkey % 8 WHEN 0 THEN 'overlap' WHEN 1 THEN 'core_count' WHEN 2 THEN 'user_edit' WHEN 3 THEN 'label' ELSE 'core_count' END AS kind
  FROM lineitem WHERE l_partkey % 220 < 200),
accepted AS (SELECT DISTINCT parent, kind FROM found WHERE parent % 3 <> 0), confirmed AS (SELECT DISTINCT parent, kind, key FROM found WHERE kind = 'user_edit' AND (parent % 5 <> 1 OR key % 2 = 0)),
open AS (SELECT parent, string_agg(DISTINCT kind, ',' ORDER BY kind) AS blocking, count(*) AS n FROM found f WHERE kind <> 'core_count' AND NOT EXISTS (SELECT 1 FROM accepted a WHERE a.parent = f.parent AND a.kind = f.kind) GROUP BY parent),
unconf AS (SELECT parent, count(DISTINCT key) AS n FROM found f WHERE kind = 'user_edit' AND EXISTS (SELECT 1 FROM accepted a WHERE a.parent = f.parent AND a.kind = f.kind)
  AND NOT EXISTS (SELECT 1 FROM confirmed c WHERE c.parent = f.parent AND c.kind = f.kind AND c.key = f.key) GROUP BY parent)"""


@query("e16_gate", FINDINGS, """SELECT d.parent, coalesce(blocking, '') AS blocking, coalesce(o.n, 0) AS blocked_by, coalesce(u.n, 0) AS unconfirmed, o.n IS NULL AND u.n IS NULL AS passes
FROM docs d LEFT JOIN open o USING (parent) LEFT JOIN unconf u USING (parent)""")
def gate(t: Tables):
    s = F.col("l_suppkey") % 8
    parent = (F.col("l_partkey") % 220).alias("parent")
    found = t.lineitem.filter("l_partkey % 220 < 200").select(parent, F.col("l_orderkey").alias("key"), F.when(s == 0, "overlap").when(s == 2, "user_edit")
                                                         .when(s == 3, "label").otherwise("core_count").alias("kind"))
    accepted = found.filter("parent % 3 <> 0").select("parent", "kind").distinct()
    confirmed = found.filter("kind = 'user_edit' AND (parent % 5 <> 1 OR key % 2 = 0)").select("parent", "kind", "key").distinct()
    return C.gate(t.lineitem.select(parent), found, accepted, confirmed, ["parent"])


# --- translation fidelity -------------------------------------------------------------------------------------------------------
PAIRS = """pairs AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS key, hi, lo, q, l_orderkey % 7 = 0 AS wrong,
  concat('It costs ', hi, '.', lpad(CAST(lo AS VARCHAR), 2, '0'), ' for ', q, '% more.') AS text,
  concat('Es kostet ', CASE WHEN hi + w >= 1000 THEN concat((hi + w) // 1000, '.', lpad(CAST((hi + w) % 1000 AS VARCHAR), 3, '0')) ELSE CAST(hi + w AS VARCHAR) END, ',', lpad(CAST(lo AS VARCHAR), 2, '0'), ' bei ', q, ' % mehr.') AS comment
FROM (SELECT *, CAST(l_quantity AS INT) AS q, cents // 100 AS hi, cents % 100 AS lo, CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS w FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) c) d),
canon AS (SELECT *, rtrim(concat(hi, lpad(CAST(lo AS VARCHAR), 2, '0')), '0') AS kept, length(concat(hi, lpad(CAST(lo AS VARCHAR), 2, '0'))) AS n,
  rtrim(CAST(q AS VARCHAR), '0') AS q_kept, length(CAST(q AS VARCHAR)) AS q_n FROM pairs),
shown AS (SELECT *, concat(CASE WHEN kept = '' THEN '0' ELSE concat(ltrim(kept, '0'), CASE WHEN n - length(kept) - 2 <> 0 THEN concat('E', n - length(kept) - 2) ELSE '' END) END, '|',
  q_kept, CASE WHEN q_n - length(q_kept) <> 0 THEN concat('E', q_n - length(q_kept)) ELSE '' END, '%') AS numbers FROM canon)"""


def _pairs(t: Tables):
    def s(c):
        return c.cast("string")
    rows = spread(t.lineitem).withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    o, hi, lo, q = F.col("l_orderkey"), F.floor(F.col("cents") / 100), s(F.lpad(s(F.col("cents") % 100), 2, "0")), s(F.col("l_quantity").cast("int"))
    other = hi + F.when(o % 7 == 0, 1).otherwise(0)
    grouped = F.when(other >= 1000, F.concat(s(F.floor(other / 1000)), F.lit("."), F.lpad(s(other % 1000), 3, "0"))).otherwise(s(other))
    return rows.select(F.concat_ws("-", s(o), s(F.col("l_linenumber")), s(F.col("l_partkey")), s(F.col("l_suppkey"))).alias("key"), F.lit("highlight").alias("type"),
                       F.concat(F.lit("It costs "), s(hi), F.lit("."), lo, F.lit(" for "), q, F.lit("% more.")).alias("text"),
                       F.concat(F.lit("Es kostet "), grouped, F.lit(","), lo, F.lit(" bei "), q, F.lit(" % mehr.")).alias("comment"), (o % 7 == 0).alias("wrong"))


SCRIPTS = """written AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || '。译文' WHEN 2 THEN 'Привет мир и так далее ab' ELSE substr(text, 1, 5) || 'Привет' END AS text FROM documents)"""


@query("e01_scripts", SCRIPTS, r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') THEN 'cjk'
  WHEN len(regexp_extract_all(text, '[\x{0400}-\x{04ff}]')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'cyrillic' ELSE 'latin' END AS script FROM written""")
def scripts(t: Tables):
    d, x = F.col("doc_id") % 4, F.col("text")
    text = F.when(d == 0, x).when(d == 1, F.concat(x, F.lit("。译文"))).when(d == 2, "Привет мир и так далее ab").otherwise(F.concat(F.substring(x, 1, 5), F.lit("Привет")))
    return t.documents.select("doc_id", N.script_of(text).alias("script"))


@query("e02_canonical_numbers", PAIRS, "SELECT key, numbers FROM shown")
def canonical_numbers(t: Tables):
    found = F.transform(N.numbers(F.lower("text")), lambda x: x["t"])
    return _pairs(t).select("key", F.array_join(found, "|").alias("numbers"))


# what the comments themselves say, the other number of every seventh order too
SAID = PAIRS.replace("FROM pairs)", "FROM (SELECT key, hi + CASE WHEN wrong THEN 1 ELSE 0 END AS hi, lo, q FROM pairs) s)")


@query("e03_local_numbers", SAID, "SELECT key, numbers FROM shown")
@query("e03_whole_local_numbers", SAID, "SELECT key, numbers FROM shown")
def local_numbers(t: Tables):
    found = F.transform(N.numbers(F.lower(N.local_numbers(F.col("comment")))), lambda x: x["t"])
    return _pairs(t).select("key", F.array_join(found, "|").alias("numbers"))


@query("e04_compound_numbers", """SELECT o_orderkey, concat('약 ', CAST((o_orderkey % 9 + 1) * 100000000 + (o_orderkey % 7 + 1) * 10000000 AS BIGINT), ' 개') AS text FROM orders""")
def compound_numbers(t: Tables):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("약 "), (k % 9 + 1).cast("string"), F.lit("억 "), (k % 7 + 1).cast("string"), F.lit("천만 개"))
    return t.orders.select("o_orderkey", F.regexp_replace(N.join_compounds(text), r"\s+", " ").alias("text"))


WORDS = ("three", "seven", "twelve", "twenty")


@query("e05_text_variants", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def text_variants(t: Tables):
    """Dates and numbers in words against their digits in the comment; every fifth comment names another number."""
    k = F.col("o_orderkey")
    months = ("January", "April", "September", "December")
    month, word = F.element_at(F.array(*[F.lit(m) for m in months]), (k % 4 + 1).cast("int")), F.element_at(F.array(*[F.lit(w) for w in WORDS]), (k % 3 + 1).cast("int"))
    n = F.element_at(F.array(*[F.lit(x) for x in (1, 4, 9, 12)]), (k % 4 + 1).cast("int"))
    runs = F.element_at(F.array(*[F.lit(x) for x in (3, 7, 12)]), (k % 3 + 1).cast("int")) + F.when(k % 5 == 0, 1000).otherwise(0)
    rows = spread(t.orders).select("o_orderkey", F.lit("highlight").alias("type"), F.concat(F.lit("In "), month, F.lit(" 2021 the group made "), word, F.lit(" runs.")).alias("text"),
                           F.concat(F.lit("该组于 2021 年 "), n.cast("string"), F.lit(" 月运行了 "), runs.cast("string"), F.lit(" 次。")).alias("comment"))
    return X.translation_warnings(rows).filter("extra <> ''").select("o_orderkey")


@query("e06_token_sets")
def token_sets(t: Tables):
    rows = spread(t.documents).withColumn("plain", N.nfkc(N.prepare(F.col("text")))).select("doc_id", N.token_set(F.col("plain")).alias("terms"))
    return rows.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join(F.array_sort("terms"), " ")).alias("digest"))


@query("e07_coverage", PAIRS, "SELECT key FROM pairs WHERE wrong")
def coverage(t: Tables):
    return X.translation_warnings(_pairs(t)).filter("extra <> ''").select("key")


@query("e08_term_words", r"""words AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM documents) x
  WHERE (length(w) >= 2 AND regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '[\p{Ll}\p{Lt}]')) OR regexp_matches(w, '[a-zß-ÿ][A-ZÀ-Þ]') OR regexp_matches(w, '[\d\x{0370}-\x{03ff}]'))""", """
SELECT doc_id, lower(w) AS term FROM words GROUP BY doc_id, lower(w)""")
def term_words(t: Tables):
    return t.documents.select("doc_id", F.explode(N.term_words(F.col("text"))).alias("term"))


LENGTHS = r"""spans AS (SELECT doc_id, id, text, repeat('译', CAST(1 + (doc_id * 7 + id * 5) % 60 AS INT)) AS comment FROM sentences),
counted AS (SELECT doc_id, id, length(comment) AS wide, len(regexp_extract_all(text, '[A-Za-z]+')) AS n, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: NOT list_contains(['a', 'an', 'the', 'of', 'to',
  'and', 'or', 'in', 'on', 'at', 'by', 'for', 'with', 'from', 'as', 'is', 'are', 'was', 'were', 'be', 'been', 'has', 'have', 'had', 'it', 'its', 'that', 'this', 'which', 'than', 'into', 'via', 'per'], lower(w)))) AS carried FROM spans)"""


@query("e09_length_bands", *TO_SENTENCES, LENGTHS, """SELECT doc_id, id, CASE WHEN n >= 6 AND wide / n > 2.8 THEN 'long' WHEN carried >= 6 AND wide / carried <= 1.0 THEN 'short' END AS length_warning FROM counted
WHERE (n >= 6 AND wide / n > 2.8) OR (carried >= 6 AND wide / carried <= 1.0)""")
def length_bands(t: Tables):
    comment = F.repeat(F.lit("译"), (1 + (F.col("doc_id") * 7 + F.col("id") * 5) % 60).cast("int"))
    rows = fx.sentences(t).select("doc_id", "id", F.lit("highlight").alias("type"), "text", comment.alias("comment"))
    return X.length_bands(X.translation_tokens(rows)).filter("length_warning IS NOT NULL").select("doc_id", "id", "length_warning")
