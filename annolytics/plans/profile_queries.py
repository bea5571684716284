"""Profiles of libraries and papers over annotations, notes and items."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from . import fixtures as fx
from .diff_queries import NOTES_SQL, _notes, title_sql
from .fixtures import ANNOTATIONS_SQL, ITEMS_SQL
from .registry import Tables, query
from .text_queries import HTML_SQL

LIBRARY = r"""lib AS (SELECT * REPLACE (CASE WHEN parent % 7 = 2 AND page % 3 <> 0 AND comment <> '' THEN '重点内容说明' || comment ELSE comment END AS comment,
   CASE WHEN ord % 61 = 0 THEN '#aaaaaa' ELSE color END AS color), parent % 7 AS library, 6 + ord % 7 AS font_size FROM annotations),
others AS (SELECT *, trim(comment) <> '' AS has FROM lib WHERE NOT own)"""
TO_LIB = [ANNOTATIONS_SQL, LIBRARY]


def _library(t: Tables):
    a = fx.annotations(t)
    han = (F.col("parent") % 7 == 2) & (F.col("page") % 3 != 0) & (F.col("comment") != "")
    return a.withColumns({"comment": F.when(han, F.concat(F.lit("重点内容说明"), "comment")).otherwise(F.col("comment")),
                          "color": F.when(F.col("ord") % 61 == 0, "#aaaaaa").otherwise(F.col("color")),
                          "library": F.col("parent") % 7, "font_size": 6 + F.col("ord") % 7})


def _median(by, value, where, name):
    return f"""{name} AS (SELECT {by}, list_sort(list({value}))[count(*) // 2 + 1] AS m FROM others WHERE {where} GROUP BY {by})"""


@query("g01_counts", *TO_LIB, "SELECT library, own, type, color, count(*) AS n FROM lib GROUP BY library, own, type, color")
def counts(t: Tables):
    return P.counts(_library(t), ["library"])


@query("g01_counts_pivoted", *TO_LIB, """SELECT library, count(*) FILTER (type = 'highlight') AS highlight, count(*) FILTER (type = 'underline') AS underline,
  count(*) FILTER (type = 'text') AS "text", count(*) FILTER (type = 'note') AS note FROM lib GROUP BY library""")
def counts_pivoted(t: Tables):
    return P.counts_by_type(_library(t), ["library"], ["highlight", "underline", "text", "note"])


@query("g02_library_profile", *TO_LIB, _median("library", "length(comment)", "has", "lens"),
       "papers AS (SELECT library, parent, count(*) AS n FROM others GROUP BY library, parent)", r"""
SELECT o.*, lens.m AS comment_len_median, p.per_paper_median, p.papers FROM (SELECT library, count(*) AS annotations,
  round_even(count(*) FILTER (type = 'highlight') / count(*), 3) AS share_highlight, round_even(count(*) FILTER (type = 'underline') / count(*), 3) AS share_underline,
  round_even(count(*) FILTER (type = 'text') / count(*), 3) AS share_text, round_even(count(*) FILTER (type = 'note') / count(*), 3) AS share_note,
  count(*) FILTER (type = 'underline') / count(*) > 0.05 AS uses_underline, count(*) FILTER (type = 'text') / count(*) > 0.05 AS uses_margin_text,
  count(*) FILTER (type = 'note') / count(*) > 0.05 AS uses_sticky_notes, round_even(count(*) FILTER (has) / count(*), 2) AS comment_rate,
  round_even(count(*) FILTER (has AND regexp_matches(comment, '^[^：:\n]{1,10}[：:]')) / count(*) FILTER (has), 2) AS label_colon_rate,
  round_even(count(*) FILTER (has AND regexp_matches(comment, '(^|\n)\s*(\d+[.、)]|[-•*])\s')) / count(*) FILTER (has), 2) AS list_rate,
  round_even(count(*) FILTER (has AND contains(comment, chr(10))) / count(*) FILTER (has), 2) AS multiline_rate FROM others GROUP BY library) o
JOIN lens USING (library) JOIN (SELECT library, list_sort(list(n))[count(*) // 2 + 1] AS per_paper_median, count(*) AS papers FROM papers GROUP BY library) p USING (library)""")
def library_profile(t: Tables):
    return P.library_profile(_library(t), "library")


@query("g03_colour_profile", *TO_LIB, """per AS (SELECT library, color, count(*) AS n, min(ord) AS seen, count(*) FILTER (has) AS c FROM others GROUP BY library, color),
ranked AS (SELECT *, n / sum(n) OVER (PARTITION BY library) AS s, row_number() OVER (PARTITION BY library ORDER BY n DESC, seen) AS r FROM per),
med AS (SELECT library, color, list_sort(list(length(trim(comment))))[count(*) // 2 + 1] AS m FROM others WHERE has GROUP BY library, color)""", """
SELECT library, color, CAST(r AS INT) AS rank, n AS count, round_even(s, 3) AS share, round_even(c / n, 2) AS comment_rate, coalesce(m, 0) AS comment_len_median
FROM ranked a LEFT JOIN med USING (library, color)
WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.library = a.library AND b.r <= a.r AND b.r > 2 AND b.s < 0.03)""")
def colour_profile(t: Tables):
    return P.colour_profile(_library(t), "library")


@query("g03_colour_samples", *TO_LIB, r"""both_kinds AS (SELECT library, color, ord, 'comment' AS what, substr(regexp_replace(trim(comment), '\s*\n\s*', ' / ', 'g'), 1, 80) AS sample FROM others WHERE has
  UNION ALL SELECT library, color, ord, 'text', substr(text, 1, 80) FROM others WHERE text <> '')""", """
SELECT library, color, what, sample, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY library, color, what ORDER BY ord, sample) AS r FROM both_kinds) b
WHERE r <= CASE what WHEN 'comment' THEN 4 ELSE 3 END""")
def colour_samples(t: Tables):
    return P.colour_samples(_library(t), "library")


@query("g04_style_rates", *TO_LIB, r"""SELECT color, round_even(avg(regexp_matches(comment, '^[^：:\n]{1,10}[：:]')::INT), 4) AS label_colon,
  round_even(avg(regexp_matches(comment, '(^|\n)\s*(\d+[.、)]|[-•*])\s')::INT), 4) AS list, round_even(avg(contains(comment, chr(10))::INT), 4) AS multiline FROM others WHERE has GROUP BY color""")
def style_rates(t: Tables):
    rows = _library(t).filter(~F.col("own") & P.has_comment())

    def rate(c):
        return F.bround(F.avg(c.cast("int")), 4)
    return rows.groupBy("color").agg(rate(F.col("comment").rlike(P.LABEL_START)).alias("label_colon"), rate(F.col("comment").rlike(P.LIST_LINE)).alias("list"),
                                     rate(F.col("comment").contains("\n")).alias("multiline"))


@query("g05_placement_habits", *TO_LIB, """paper AS (SELECT *, parent % 300 AS who FROM others WHERE type IN ('text', 'note')),
votes AS (SELECT who, count(*) FILTER (x1 - x0 < 250) AS v, count(*) FILTER (x1 - x0 < 250 AND (x0 + x1) / 2 < 300) AS l,
  count(*) FILTER (type = 'text') AS texts, count(*) FILTER (type = 'text' AND y1 >= 670 AND x1 - x0 >= 250) AS top FROM paper GROUP BY who)""", """
SELECT who, round_even(top / greatest(texts, 1), 2) AS page_top_notes, CASE WHEN v < 3 OR (l / greatest(v, 1) > 0.25 AND l / greatest(v, 1) < 0.75) THEN 'mixed'
  WHEN l / v >= 0.75 THEN 'left' ELSE 'right' END AS margin_side, m AS font_size_median
FROM votes LEFT JOIN (SELECT who, CAST(list_sort(list(font_size))[count(*) // 2 + 1] AS DOUBLE) AS m FROM paper WHERE type = 'text' GROUP BY who) f USING (who)""")
def placement_habits(t: Tables):
    return P.placement_habits(_library(t).withColumn("who", F.col("parent") % 300), "who")


@query("g06_upper_median", "SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_suppkey")
def upper_median(t: Tables):
    return P.upper_median(t.lineitem, ["l_suppkey"], F.col("l_quantity"), "median")


@query("g07_language_vote", *TO_LIB, r"""SELECT library, CASE WHEN list_sort(list(length(regexp_replace(comment, '[^\x{4e00}-\x{9fff}]', '', 'g')) / length(comment)))[count(*) // 2 + 1] > 0.3
  THEN 'zh' ELSE 'en' END AS language FROM others WHERE has GROUP BY library""")
def language_vote(t: Tables):
    return P.language_vote(_library(t).filter("NOT own"), "library")


@query("g08_note_statistics", r"""texts AS (SELECT page_id % 9 AS library, CASE WHEN page_id % 4 = 0 THEN 'Comment: ' || page_id
  ELSE trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) END AS plain FROM pages)""", """
SELECT library, count(*) AS notes, count(*) FILTER (length(plain) >= 300) AS long_notes, list_sort(list(length(plain)))[count(*) // 2 + 1] AS len_median
FROM texts WHERE NOT (starts_with(plain, 'Comment:') AND length(plain) < 120) GROUP BY library""")
def note_statistics(t: Tables):
    html = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<p>Comment: "), F.col("page_id").cast("string"), F.lit("</p>"))).otherwise(F.col("html"))
    return P.note_statistics(t.pages.select((F.col("page_id") % 9).alias("library"), html.alias("html")), "library")


SAMPLED = """{0} WHERE n <= 4 OR list_contains([0, CAST(round_even((n - 1) / 3, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 3, 0) AS BIGINT), n - 1], rn - 1)"""


@query("g09_spread_sample", SAMPLED.format("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM events) e"""))
def spread_sample(t: Tables):
    from ..operators.ordered import time_chunk
    return P.spread_sample(t.events, ["user_id"], ["ts", "event_id"], time_chunk(t.events, "ts", 86400), 4).select("user_id", "event_id")


@query("g10_recent_papers", *TO_LIB, "SELECT parent, max(modified) AS modified FROM lib WHERE own AND parent % 10 <> 3 GROUP BY parent ORDER BY modified DESC, parent LIMIT 20")
def recent_papers(t: Tables):
    rows = _library(t)
    return P.recent_papers(rows, rows.filter("parent % 10 = 3").select("parent").distinct(), 20)


@query("g11_paper_samples", *TO_LIB, """kinds AS (SELECT *, CASE WHEN type IN ('highlight', 'underline') AND comment <> '' THEN 'highlight' WHEN type IN ('text', 'note') THEN 'text' END AS kind FROM lib WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent, kind ORDER BY page, y0, ord, key) AS rn, count(*) OVER (PARTITION BY parent, kind) AS n FROM kinds WHERE kind IS NOT NULL)""",
       SAMPLED.format("SELECT parent, kind, key, page, CASE kind WHEN 'highlight' THEN substr(text, 1, 160) END AS text, substr(comment, 1, 240) AS comment FROM ranked"))
def paper_samples(t: Tables):
    return P.paper_samples(_library(t), 4)


@query("g11_latest_notes", NOTES_SQL, r"""SELECT parent, substr(trim(regexp_replace(regexp_replace(arg_max(html, (key * 7 % 50, key)), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 700) AS note_start
FROM notes WHERE own GROUP BY parent""")
def latest_notes(t: Tables):
    return P.latest_notes(_notes(t)[0].withColumn("modified", F.col("key") * 7 % 50))


@query("g12_paper_status", ITEMS_SQL, """on_pdfs AS (SELECT 'C' || l_orderkey AS key, l_linestatus = 'O' AS own FROM lineitem)""", """
SELECT i.key, i.parent, count(*) FILTER (a.own) AS own, count(*) FILTER (NOT a.own) AS others FROM lib_items i LEFT JOIN on_pdfs a USING (key)
WHERE item_type = 'attachment' AND content_type = 'application/pdf' GROUP BY i.key, i.parent""")
def paper_status(t: Tables):
    marks = t.lineitem.select(F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("parent"), (F.col("l_linestatus") == "O").alias("own"))
    return P.paper_status(fx.lib_items(t), marks)


@query("g12_citations", """SELECT c_custkey AS key, c_name AS title, '19' || (60 + c_custkey % 40) AS year,
  array_to_string(list_concat(l[:12], CASE WHEN len(l) > 12 THEN ['… ' || len(l) - 12 || ' more'] ELSE [] END), '; ') AS authors,
  CASE WHEN c_custkey % 3 = 0 THEN 'Journal ' || c_nationkey WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END AS venue
FROM (SELECT *, list_transform(list_filter(range(c_custkey % 17), lambda i: i % 5 <> 4), lambda i: CASE WHEN i % 3 = 0 THEN 'Group ' || i ELSE 'First' || i || ' Last' || i END) AS l FROM customer) c""")
def citations(t: Tables):
    k = F.col("c_custkey")
    n = F.sequence(F.lit(0).cast("long"), F.greatest(k % 17 - 1, F.lit(0).cast("long")))

    def person(i):
        s = i.cast("string")
        group = i % 3 == 0
        return F.struct(F.when(group, "").otherwise(F.concat(F.lit("First"), s)).alias("first"), F.when(group, "").otherwise(F.concat(F.lit("Last"), s)).alias("last"),
                        F.when(group, F.concat(F.lit("Group "), s)).otherwise("").alias("name"), F.when(i % 5 == 4, "editor").when(i % 2 == 0, "author").alias("type"))
    rows = t.customer.select(
        k.alias("key"), F.col("c_name").alias("title"), F.concat(F.lit("19"), (60 + k % 40).cast("string"), F.lit("-05-01")).alias("date"),
        F.when(k % 17 == 0, F.slice(F.transform(n, person), 1, 0)).otherwise(F.transform(n, person)).alias("creators"),
        F.when(k % 3 == 0, F.concat(F.lit("Journal "), F.col("c_nationkey").cast("string"))).otherwise("").alias("publication_title"),
        F.when(k % 3 == 1, F.col("c_mktsegment")).alias("publisher"))
    return P.citation(rows).withColumn("authors", F.array_join("authors", "; "))


@query("g13_title_search", "SELECT p_partkey AS key, substr(p_name, 1, 150) AS title FROM part WHERE contains(lower(p_name), 'small') AND contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 10")
def title_search(t: Tables):
    return P.title_search(t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title")), "ring Small")


@query("g14_annotation_card", *TO_LIB, NOTES_SQL, """SELECT l.parent, count(*) FILTER (type IN ('highlight', 'underline')) AS highlights,
  count(*) FILTER (type IN ('highlight', 'underline') AND color = '#ff6666') AS core, count(*) FILTER (type = 'text') AS margin, count(*) FILTER (type = 'note') AS notes,
  count(*) FILTER (type = 'image') AS areas, coalesce(max(r), 0) AS reading_notes FROM lib l LEFT JOIN (SELECT parent, count(*) AS r FROM notes WHERE own GROUP BY parent) n USING (parent) WHERE l.own GROUP BY l.parent""")
def annotation_card(t: Tables):
    return P.annotation_card(_library(t), _notes(t)[0])


@query("g15_highlight_facts", *TO_LIB, """refs AS (SELECT p_partkey AS parent, 20 + p_size AS reference_page FROM part WHERE p_partkey % 3 <> 0)""", """
SELECT parent, count(*) AS highlights, count(*) FILTER (color = '#ff6666') AS core, count(DISTINCT page) AS pages, count(*) FILTER (page >= reference_page) AS after_references,
  CASE WHEN max(reference_page) IS NOT NULL THEN round_even(count(*) FILTER (page >= reference_page) / count(*), 3) END AS share_after,
  count(*) FILTER (trim(comment) = '') AS empty, round_even(avg(length(comment)), 1) AS comment_chars_mean
FROM lib LEFT JOIN refs USING (parent) WHERE type IN ('highlight', 'underline') GROUP BY parent""")
def highlight_facts(t: Tables):
    refs = t.part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("parent"), (20 + F.col("p_size")).alias("reference_page"))
    return P.highlight_facts(_library(t), refs)


@query("g15_highlights_per_page", *TO_LIB, "SELECT parent, page, count(*) AS n FROM lib WHERE type IN ('highlight', 'underline') GROUP BY parent, page")
def highlights_per_page(t: Tables):
    return P.highlights_per_page(_library(t))


@query("g16_note_facts", rf"""SELECT page_id AS key, length({HTML_SQL.format('html')}) AS chars, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS paragraphs,
  len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) AS headings, regexp_matches(html, '(?i)<h1[\s>]') AS has_title,
  contains(lower({HTML_SQL.format('html')}), 'the of') AS cites_source FROM pages""")
def note_facts(t: Tables):
    return P.note_facts(t.pages.select(F.col("page_id").alias("key"), "html"), "the of")


@query("g17_distinct", *TO_LIB, "SELECT library, count(DISTINCT page) AS pages, count(DISTINCT color) AS colors, count(DISTINCT parent) AS papers FROM lib GROUP BY library")
def distinct(t: Tables):
    return P.distinct_counts(_library(t), "library")


@query("g18_grand_total", *TO_LIB, """SELECT library, CAST(sum(n) AS BIGINT) AS n, CAST(sum(own_n) AS BIGINT) AS own_n FROM (SELECT library, parent, count(*) AS n, count(*) FILTER (own) AS own_n FROM lib GROUP BY library, parent) p
GROUP BY ROLLUP (library)""")
def grand_total(t: Tables):
    per = _library(t).groupBy("library", "parent").agg(F.count("*").alias("n"), F.count_if("own").alias("own_n"))
    return P.with_grand_total(per, "library", ["n", "own_n"])


@query("g12_note_list", NOTES_SQL, rf"""SELECT key, parent, {title_sql('html')} AS title, own,
  length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS characters FROM notes""")
def note_list(t: Tables):
    return P.note_list(_notes(t)[0])
