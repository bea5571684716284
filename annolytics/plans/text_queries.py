"""Text structuring over the documents and pages tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import document_rows as D
from ..operators import text as X
from ..operators.ordered import once, spread
from . import fixtures as fx
from .fixtures import LINES_SQL, norm_sql
from .registry import Tables, query

N = norm_sql("text")

KEPT = r"""kept AS (
SELECT doc_id, row_no, page, block, size, bold, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text
FROM lines WHERE abs(dir_x - 1) <= 0.01 AND abs(dir_y) <= 0.01 AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> '')"""
BODY = """body AS (
SELECT doc_id, min(size) AS body_size FROM (
  SELECT doc_id, size, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY size, row_no) AS upto,
         sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM kept) s
WHERE upto * 2 >= total GROUP BY doc_id)"""
CLASSED = rf"""classed AS (
SELECT k.*, body_size, {norm_sql("k.text")} AS norm,
  length(k.text) < 70 AND (size >= body_size + 0.8 OR (bold AND size >= body_size - 0.1)) AS heading,
  row_number() OVER (PARTITION BY k.doc_id, page ORDER BY row_no) <= 3
    OR row_number() OVER (PARTITION BY k.doc_id, page ORDER BY row_no DESC) <= 3 AS edge,
  regexp_full_match(k.text, '(?i)(\d{{1,4}}|[ivxlcdm]{{1,7}})') AS numeral
FROM kept k JOIN body USING (doc_id))"""
RECURRING = """recurring AS (
SELECT doc_id, norm FROM (SELECT DISTINCT doc_id, page, norm FROM classed WHERE edge AND norm <> '') e
JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY doc_id) p USING (doc_id)
GROUP BY doc_id, norm HAVING count(*) * 2 > max(pages) AND max(pages) >= 3)"""
MARKED = """marked AS (
SELECT c.*, edge AND EXISTS (SELECT 1 FROM recurring r WHERE r.doc_id = c.doc_id AND r.norm = c.norm) AS is_running,
  numeral AND (edge OR bool_and(numeral) OVER (PARTITION BY doc_id, page, block)) AS is_page_number
FROM classed c)"""
FLAGGED = rf"""flagged AS (
SELECT m.*,
  regexp_full_match(norm, '(\d+|[ivxl]+)?\.?(references(andnotes)?|bibliography|literaturecited|workscited|参考文献)[.:：]?') AS opens_refs,
  heading OR starts_with(norm, 'appendix') OR starts_with(norm, 'supplementary') AS ends_refs,
  heading AND regexp_matches(norm, '^([a-z]|\d+)?\.?(technical)?(appendix|appendices|supplementa(ry|l))') AS is_appendix,
  heading AND regexp_full_match(norm, '([a-z]|\d+)?\.?(neurips|icml|iclr|aaai|ijcai|acl|emnlp|naacl|cvpr|iccv|eccv|ml)?(paper|reproducibility|responsiblenlp(research)?)?checklist:?') AS checklist_head
FROM marked m WHERE NOT is_running AND NOT is_page_number)"""
# one letter per row, walked as a list per document
WALK = """walk AS (
SELECT doc_id, row_no, page, block, text, heading, i, opens_refs, ends_refs, is_appendix,
  checklist_head AND bool_or(opens_refs) OVER (PARTITION BY doc_id ORDER BY row_no) AS is_checklist
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS i FROM flagged) f)"""
STATES = """codes AS (
SELECT doc_id, list(CASE WHEN opens_refs AND ends_refs THEN 'X' WHEN opens_refs THEN 'R' WHEN is_appendix THEN 'A'
  WHEN is_checklist THEN 'C' WHEN ends_refs THEN 'E' ELSE '-' END ORDER BY row_no) AS l FROM walk GROUP BY doc_id),
states AS (
SELECT w.*, list_reduce(list_prepend('b', l[1:i - 1]), lambda s, c: CASE
   WHEN s = 'k' THEN CASE WHEN c = 'A' THEN 'b' ELSE 'k' END
   WHEN s = 'r' THEN CASE WHEN c IN ('R', '-') THEN 'r' WHEN c = 'C' THEN 'k' ELSE 'b' END
   WHEN c IN ('R', 'X') THEN 'r' WHEN c = 'C' THEN 'k' ELSE 'b' END) AS state
FROM walk w JOIN codes USING (doc_id))"""
CUT = """cut AS (
SELECT doc_id, row_no, page, block,
  CASE WHEN state = 'b' AND opens_refs THEN 'marker' WHEN is_checklist THEN 'marker' WHEN heading THEN 'heading' ELSE 'para' END AS kind,
  CASE WHEN state = 'b' AND opens_refs THEN '[references removed]' WHEN is_checklist THEN '[checklist removed]' ELSE text END AS text
FROM states WHERE NOT (state = 'k' AND NOT is_appendix) AND NOT (state = 'r' AND NOT ends_refs))"""
PARAS = r"""plain AS (
SELECT doc_id, row_no, page, block, kind, CASE WHEN kind = 'marker' THEN text
  ELSE replace(replace(replace(replace(text, '’', ''''), '‘', ''''), '“', chr(34)), '”', chr(34)) END AS text FROM cut),
opened AS (
SELECT *, CASE WHEN kind = 'para' AND lag(kind) OVER w = 'para' AND lag(page) OVER w = page AND lag(block) OVER w = block
  THEN 0 ELSE 1 END AS opens FROM plain WINDOW w AS (PARTITION BY doc_id ORDER BY row_no)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY row_no) AS para FROM opened),
paras AS (
SELECT doc_id, CAST(para AS INT) AS para, min(page) AS page, min(kind) AS kind,
  regexp_replace(list_reduce(list(text ORDER BY row_no), lambda a, b: CASE WHEN ends_with(a, '-') AND regexp_matches(b, '^\p{Ll}')
    THEN substr(a, 1, length(a) - 1) || b ELSE a || ' ' || b END), '([A-Za-z])-\s+([a-z])', '\1\2', 'g') AS text
FROM numbered GROUP BY doc_id, para)"""
# pieces folded one by one into sentences
SENTS = r"""pieces AS (
SELECT doc_id, para, page, kind, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(
    trim(regexp_replace(text, '\s+', ' ', 'g')),
    '([.!?]["''”’)\]]*)(\s+[A-Z0-9(\["“‘])', '\1' || chr(1) || '\2', 'g'),
    '([.!?]["''”’)\]]*)(\s+[A-Z0-9(\["“‘])', '\1' || chr(1) || '\2', 'g'),
    '(^|[^\p{L}\p{N}_])((?:e\.g|i\.e|et al|cf|vs|viz|resp|approx|ca|Fig|Figs|Eq|Eqs|Sec|Secs|Tab|Ref|Refs|No|Nos|Dr|Prof|Mr|Ms|Mrs|St|Vol|pp|Ch|Def|Thm|Lem|Prop|Cor|Alg|App|[A-Z])\.["''”’)\]]*)' || chr(1) || '+', '\1\2', 'g'),
    chr(1)), lambda p: trim(p)), lambda p: length(p) > 0) AS l FROM paras WHERE kind = 'para'),
folded AS (
SELECT doc_id, para, page, list_reduce(list_transform(l, lambda p: [p]), lambda a, b:
  CASE WHEN len(string_split(b[1], ' ')) < 3 OR len(string_split(a[-1], ' ')) < 3
    THEN list_concat(a[:-2], [a[-1] || ' ' || b[1]]) ELSE list_concat(a, b) END) AS l FROM pieces WHERE len(l) > 0),
sents AS (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, pos) AS id
FROM (SELECT doc_id, para, page, unnest(l) AS text, unnest(range(len(l))) AS pos FROM folded) u)"""
ITEMS = """items AS (
SELECT doc_id, page, para, CAST(pos AS INT) AS pos, 'sentence' AS kind, id, text FROM sents
UNION ALL SELECT doc_id, page, para, 0, kind, NULL, text FROM paras WHERE kind <> 'para')"""
LISTED = r"""framed AS (
SELECT *, lag(page) OVER w AS p, lag(kind) OVER w AS k, lag(para) OVER w AS a
FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY para, pos)),
made AS (
SELECT doc_id, page, para, pos, list_concat(
  CASE WHEN p IS NOT NULL AND p <> page THEN [''] ELSE [] END,
  CASE WHEN p IS NULL OR p <> page THEN ['--- p.' || page || ' ---']
       WHEN kind = 'sentence' AND k = 'sentence' AND a <> para THEN [''] ELSE [] END,
  [CASE kind WHEN 'sentence' THEN id || ' | ' || text WHEN 'heading' THEN '## ' || text ELSE text END]) AS l FROM framed),
listed AS (
SELECT doc_id, page, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, pos, i) AS INT) AS line_no
FROM (SELECT doc_id, page, para, pos, unnest(l) AS line, unnest(range(len(l))) AS i FROM made) u)"""
TO_CLASSED = [LINES_SQL, KEPT, BODY, CLASSED]
TO_MARKED = TO_CLASSED + [RECURRING, MARKED]
TO_CUT = TO_MARKED + [FLAGGED, WALK, STATES, CUT]
TO_PARAS = TO_CUT + [PARAS]
TO_SENTS = TO_PARAS + [SENTS]
TO_LISTED = TO_SENTS + [ITEMS, LISTED]


@query("document_overview", *TO_SENTS, f"""
SELECT doc_id, paragraphs, headings, sentences, distinct_sentences, words FROM
 (SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (kind = 'heading') AS headings FROM paras GROUP BY doc_id) p
 JOIN (SELECT doc_id, count(*) AS sentences, count(DISTINCT {N}) AS distinct_sentences,
              CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words FROM sents GROUP BY doc_id) s USING (doc_id)""")
def document_overview(t: Tables):
    docs = once(fx.documents(t), paras=X.paragraphs(F.col("lines")))
    words = F.filter("paras", lambda p: p["kind"] == "para")
    sents = F.flatten(F.transform(words, lambda p: T.split_sentences(p["text"])))
    docs = once(docs, sents=sents).select("doc_id", "sents", F.size("paras").cast("long").alias("paragraphs"),
                                          F.size(F.filter("paras", lambda p: p["kind"] == "heading")).cast("long").alias("headings"))
    return docs.filter(F.size("sents") > 0).select(
        "doc_id", "paragraphs", "headings", F.size("sents").cast("long").alias("sentences"),
        F.size(F.array_distinct(F.transform("sents", lambda x: T.norm_key(x)))).cast("long").alias("distinct_sentences"),
        F.aggregate("sents", F.lit(0).cast("long"), lambda n, x: n + T.word_count(x)).alias("words"))


@query("b01_orientation", LINES_SQL, """
SELECT page, count(*) FILTER (dir_x = 1 AND dir_y = 0) AS kept, count(*) FILTER (NOT (dir_x = 1 AND dir_y = 0)) AS dropped
FROM lines GROUP BY page""")
def orientation(t: Tables):
    sides = fx.documents(t).select("lines", X.left_to_right(F.col("lines")).alias("kept"))
    one = sides.select(F.inline("lines"), F.transform("kept", lambda r: r["row_no"]).alias("kept"))
    return one.groupBy("page").agg(F.count_if(F.array_contains("kept", F.col("row_no"))).alias("kept"),
                                   F.count_if(~F.array_contains("kept", F.col("row_no"))).alias("dropped"))


@query("b02_collapse", LINES_SQL, KEPT, "SELECT doc_id, row_no, text, trim(substr(text, 1, 80)) AS short FROM kept")
def collapse(t: Tables):
    rows = fx.documents(t).select("doc_id", F.inline(X.clean_lines(F.col("lines"))))
    return rows.select("doc_id", "row_no", "text", T.brief("text").alias("short"))


@query("b03_body_size", LINES_SQL, KEPT, BODY, "SELECT doc_id, body_size FROM body")
def body_size(t: Tables):
    rows = once(fx.documents(t), rows=X.clean_lines(F.col("lines"))).filter(F.size("rows") > 0)
    return rows.select("doc_id", X.body_size(F.col("rows")).alias("body_size"))


@query("b04_headings", *TO_CLASSED, "SELECT doc_id, row_no, text FROM classed WHERE heading")
def headings(t: Tables):
    rows = fx.documents(t).select("doc_id", F.inline(X.classify_rows(F.col("lines"))))
    return rows.filter("heading").select("doc_id", "row_no", "text")


@query("b05_running_lines", *TO_MARKED, "SELECT doc_id, row_no, norm FROM marked WHERE is_running")
def running_lines(t: Tables):
    rows = fx.documents(t).select("doc_id", F.inline(X.mark_running_rows(F.col("lines"))))
    return rows.filter("is_running").select("doc_id", "row_no", "norm")


@query("b06_page_numbers", *TO_MARKED, "SELECT doc_id, row_no, text FROM marked WHERE is_page_number")
def page_numbers(t: Tables):
    rows = fx.documents(t).select("doc_id", F.inline(X.mark_running_rows(F.col("lines"))))
    return rows.filter("is_page_number").select("doc_id", "row_no", "text")


# without checklists a row sets the state, clears it or swaps it: the last set value and the parity of swaps after it
@query("b07_bibliography", *TO_MARKED, FLAGGED, """ops AS (
SELECT doc_id, row_no, CASE WHEN opens_refs AND ends_refs THEN 's' WHEN opens_refs THEN '1' WHEN ends_refs THEN '0' ELSE '-' END AS op FROM flagged),
spans AS (SELECT *, sum(CASE WHEN op IN ('0', '1') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_no) AS span FROM ops),
after AS (SELECT *, (sum(CASE WHEN op = 's' THEN 1 WHEN op = '1' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, span ORDER BY row_no)) % 2 AS now FROM spans)""", """
SELECT doc_id, row_no, CAST(coalesce(lag(now) OVER (PARTITION BY doc_id ORDER BY row_no), 0) AS INT) AS state FROM after""")
def bibliography(t: Tables):
    states = X.region_states(X.drop_running_rows(F.col("lines")), checklists=False)
    return fx.documents(t).select("doc_id", F.inline(states)).select("doc_id", "row_no", "state")


@query("b08_checklists", *TO_CUT, "SELECT doc_id, row_no, kind, text FROM cut")
def checklists(t: Tables):
    rows = fx.documents(t).select("doc_id", F.inline(X.cut_regions(X.drop_running_rows(F.col("lines")))))
    return rows.select("doc_id", "row_no", "kind", "text")


@query("b09_dehyphenate", r"""
SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(text, 'he', 'h- e'), '’', ''''), '‘', ''''), '“', chr(34)), '”', chr(34)),
  '([A-Za-z])-\s+([a-z])', '\1\2', 'g')) AS digest FROM documents""")
def dehyphenate(t: Tables):
    broken = F.replace("text", F.lit("he"), F.lit("h- e"))
    return t.documents.select("doc_id", F.md5(T.dehyphenate(T.expand_ligatures(broken))).alias("digest"))


@query("b10_paragraphs", *TO_PARAS, "SELECT doc_id, para, page, kind, text FROM paras")
def paragraphs(t: Tables):
    return fx.documents(t).select("doc_id", F.inline(X.paragraphs(F.col("lines"))))


PAGES_SQL = """page_texts AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 0 THEN '7' ELSE text END AS text FROM lines),
page_dims AS (SELECT DISTINCT doc_id, page, 612 AS width, 792 AS height FROM lines),
images AS (SELECT doc_id, page, (doc_id * 7 + page * 13) % 90 - 20 AS x0, 0 AS y0, 300 + (doc_id * 31 + page * 17) % 400 AS x1,
  300 + (doc_id * 11 + page * 29) % 500 AS y1 FROM page_dims WHERE page % 5 <> 4)"""


@query("b11_scans", LINES_SQL, PAGES_SQL, r"""
SELECT doc_id, count(*) AS pages, count(*) FILTER (chars <= 10 AND covered * 2 >= 612 * 792) AS scanned,
  count(*) FILTER (chars <= 10 AND covered * 2 >= 612 * 792) * 2 > count(*) AS refused FROM (
  SELECT doc_id, page, (SELECT sum(length(regexp_replace(text, '\s', '', 'g'))) FROM page_texts t WHERE t.doc_id = d.doc_id AND t.page = d.page) AS chars,
    CASE WHEN x0 IS NULL THEN 0 ELSE (least(x1, 612) - greatest(x0, 0)) * (least(y1, 792) - greatest(y0, 0)) END AS covered
  FROM page_dims d LEFT JOIN images USING (doc_id, page)) s GROUP BY doc_id""")
def scans(t: Tables):
    rows = fx.lines(t)
    doc, page = F.col("doc_id"), F.col("page")
    texts = rows.select("doc_id", "page", F.when((doc + page) % 3 == 0, "7").otherwise(F.col("text")).alias("text"))
    pages = rows.select("doc_id", "page").distinct().select("*", F.lit(612).alias("width"), F.lit(792).alias("height"))
    images = pages.filter(page % 5 != 4).select(
        "doc_id", "page", ((doc * 7 + page * 13) % 90 - 20).alias("x0"), F.lit(0).alias("y0"),
        (300 + (doc * 31 + page * 17) % 400).alias("x1"), (300 + (doc * 11 + page * 29) % 500).alias("y1"))
    return X.scanned_documents(pages, texts, images)


WHOLE_TEXTS = "paras AS (SELECT doc_id, 1 AS para, 1 AS page, 'para' AS kind, text FROM documents)"


@query("b12_sentence_split", WHOLE_TEXTS, SENTS, "SELECT doc_id, CAST(pos AS INT) AS pos, text FROM sents")
def sentence_split(t: Tables):
    return spread(t.documents).select("doc_id", F.posexplode(T.split_sentences("text")).alias("pos", "text"))


@query("b13_numbering", *TO_SENTS, ITEMS, "SELECT doc_id, page, para, kind, id, text FROM items")
def numbering(t: Tables):
    rows = fx.documents(t).select("doc_id", F.inline(X.items(X.paragraphs(F.col("lines")))))
    return rows.select("doc_id", "page", "para", "kind", "id", "text")


@query("b14_norm_key", WHOLE_TEXTS, SENTS, f"SELECT doc_id, {N} AS norm, count(*) AS n FROM sents GROUP BY ALL")
def norm_keys(t: Tables):
    return (spread(t.documents).select("doc_id", F.explode(T.split_sentences("text")).alias("text"))
            .groupBy("doc_id", T.norm_key("text").alias("norm")).agg(F.count("*").alias("n")))


@query("b15_repeats", *TO_SENTS, f"""
SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, page, {N} ORDER BY id) AS occurrence,
  count(*) OVER (PARTITION BY doc_id, page, {N}) AS same_text_count FROM sents""")
def repeats(t: Tables):
    sents = X.explode_sentences(fx.documents(t), X.items(X.paragraphs(F.col("lines"))))
    return X.number_repeats(sents).select("doc_id", "id", "occurrence", "same_text_count")


@query("b16_heading_before", *TO_SENTS, """
SELECT s.doc_id, s.id, (SELECT h.text FROM paras h WHERE h.doc_id = s.doc_id AND h.kind = 'heading' AND h.para < s.para
   AND h.para > coalesce(s.before, 0) ORDER BY h.para DESC LIMIT 1) AS heading_before
FROM (SELECT *, lag(para) OVER (PARTITION BY doc_id ORDER BY id) AS before FROM sents) s""")
def heading_before(t: Tables):
    sents = X.explode_sentences(fx.documents(t), X.items(X.paragraphs(F.col("lines"))))
    return sents.select("doc_id", "id", "heading_before")


@query("a08_listing", *TO_LISTED, "SELECT doc_id, line_no, line FROM listed")
def listing(t: Tables):
    made = X.listing_lines(X.items(X.paragraphs(F.col("lines"))))
    rows = fx.documents(t).select("doc_id", F.posexplode(made).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


INDEX = rf"""pages_at AS (SELECT doc_id, min(line_no) AS first_page FROM listed WHERE starts_with(line, '--- p.') GROUP BY doc_id),
refs AS (SELECT doc_id, min(line_no) AS pos_at, arg_min(page, line_no) AS page, arg_min(starts_with(line, '## '), line_no) AS kept FROM listed
  WHERE line = '[references removed]' OR (starts_with(line, '## ') AND regexp_full_match({norm_sql("line[4:]")},
    '(\d+|[ivxl]+)?\.?(references(andnotes)?|bibliography|literaturecited|workscited|参考文献)[.:：]?')) GROUP BY doc_id),
later AS (SELECT l.*, kept FROM listed l JOIN refs r ON l.doc_id = r.doc_id AND l.line_no > r.pos_at AND NOT starts_with(line, '--- p.')),
start AS (SELECT doc_id, min(line_no) AS after FROM later WHERE CASE WHEN kept THEN starts_with(line, '## ')
  ELSE trim(line) <> '' AND NOT starts_with(line, '[') END GROUP BY doc_id),
appx AS (SELECT doc_id, min(line_no) AS appendix FROM later WHERE starts_with(line, '## ')
  AND regexp_matches({norm_sql("line[4:]")}, '^([a-z]|\d+)?\.?(technical)?(appendix|appendices|supplementa(ry|l))') GROUP BY doc_id),
shown AS (SELECT s.doc_id, after FROM start s LEFT JOIN appx a USING (doc_id)
  WHERE (appendix IS NULL OR appendix <> after)
    AND EXISTS (SELECT 1 FROM later l WHERE l.doc_id = s.doc_id AND l.line_no >= after AND regexp_matches(l.line, '^\d+ \| '))),
heads AS (SELECT p.doc_id, first_page, pos_at, page, after, appendix,
  3 + (pos_at IS NOT NULL)::INT * 2 + (after IS NOT NULL)::INT + (appendix IS NOT NULL)::INT AS head
  FROM pages_at p LEFT JOIN refs USING (doc_id) LEFT JOIN shown USING (doc_id) LEFT JOIN appx USING (doc_id))"""


@query("b17_document_index", *TO_LISTED, INDEX, """
SELECT doc_id, first_page + head AS main_first, pos_at + head - 1 AS main_last, pos_at + head AS references_line, page AS references_page,
  after + head AS after_line, appendix + head AS appendix_line FROM heads""")
def document_index(t: Tables):
    made = X.listing_lines(X.items(X.paragraphs(F.col("lines"))))
    docs = once(fx.documents(t), listing=made).filter(F.size("listing") > 0)
    return once(docs, ix=X.document_index(F.col("listing"))).select("doc_id", "ix.*")


DOC_LINES = """doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"""


@query("b18_read_parts", "RECURSIVE " + DOC_LINES, r"""costs AS (SELECT doc_id, line_no, length(line) + 8 AS cost FROM doc_lines),
packed(doc_id, line_no, start, size) AS (
  SELECT doc_id, line_no, line_no, cost FROM costs WHERE line_no = 1
  UNION ALL
  SELECT c.doc_id, c.line_no, CASE WHEN p.size + c.cost > 3000 THEN c.line_no ELSE p.start END,
    CASE WHEN p.size + c.cost > 3000 THEN c.cost ELSE p.size + c.cost END
  FROM packed p JOIN costs c ON c.doc_id = p.doc_id AND c.line_no = p.line_no + 1)""", """
SELECT doc_id, start AS "offset", count(*) AS lines FROM packed GROUP BY doc_id, start""")
def read_parts(t: Tables):
    parts = X.read_parts(F.split("text", "\n"), limit=3000)
    return t.documents.select("doc_id", F.inline(parts))


@query("b19_token_estimate", """
SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines,
  CAST(floor(wide * 1.3::DOUBLE + (length(text) - wide) / 4.0::DOUBLE) AS BIGINT) AS tokens
FROM (SELECT *, len(regexp_extract_all(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7af}]')) AS wide FROM documents) d""".replace("\\\\", "\\"))
def token_estimate(t: Tables):
    lines = F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)
    return t.documents.select("doc_id", F.length("text").cast("long").alias("chars"), lines.cast("long").alias("lines"),
                              T.token_estimate("text").alias("tokens"))


# the character references that the pages hold
HTML_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("b21_html_text", rf"""
SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), 1, 200) AS title,
  {HTML_SQL.format("regexp_replace(html, '(?is)<h1[^>]*>.*?</h1>', ' ')")} AS body FROM pages""")
def html_text(t: Tables):
    return t.pages.select("page_id", T.note_title("html").alias("title"), T.note_body("html").alias("body"))


@query("b22_page_range", LINES_SQL, "SELECT doc_id, row_no, page FROM lines WHERE page >= 2 AND page <= 4")
def page_range(t: Tables):
    from ..functions.rules import page_range as between
    return fx.lines(t).filter(between("page", "2-4")).select("doc_id", "row_no", "page")


@query("b29_reference_page", LINES_SQL, r"""
SELECT doc_id, min(page) AS page FROM lines WHERE regexp_matches(text, '(?i)^\s*(\d+\s*)?(references|bibliography)\s*$') GROUP BY doc_id""")
def reference_page(t: Tables):
    docs = fx.documents(t).select("doc_id", X.reference_page(F.col("lines")).alias("page"))
    return docs.filter("page IS NOT NULL")


# --- the same over a table of lines: a document of any length is cut into chunks ---------------------------------------------
@query("b06_marked_rows", *TO_MARKED, "SELECT doc_id, row_no, is_running, is_page_number FROM marked")
def marked_rows(t: Tables):
    return D.marked_rows(fx.lines(t)).select("doc_id", "row_no", "is_running", "is_page_number")


@query("b08_cut_rows", *TO_CUT, "SELECT doc_id, row_no, kind, text FROM cut")
def cut_rows(t: Tables):
    return D.cut_rows(fx.lines(t)).select("doc_id", "row_no", "kind", "text")


@query("b13_item_rows", *TO_SENTS, ITEMS, """, headed AS (SELECT s.doc_id, s.id, (SELECT h.text FROM paras h WHERE h.doc_id = s.doc_id AND h.kind = 'heading' AND h.para < s.para
   AND h.para > coalesce(s.before, 0) ORDER BY h.para DESC LIMIT 1) AS heading_before
FROM (SELECT *, lag(para) OVER (PARTITION BY doc_id ORDER BY id) AS before FROM sents) s)""".lstrip(", "), """
SELECT doc_id, page, para, kind, id, text, heading_before FROM items LEFT JOIN headed USING (doc_id, id)""")
def item_rows(t: Tables):
    return D.item_rows(D.paragraph_rows(fx.lines(t))).drop("pos")


@query("b15_repeated_rows", *TO_SENTS, f"""
SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, page, {N} ORDER BY id) AS occurrence,
  count(*) OVER (PARTITION BY doc_id, page, {N}) AS same_text_count FROM sents""")
def repeated_rows(t: Tables):
    return X.number_repeats(D.sentence_rows(D.paragraph_rows(fx.lines(t)))).select("doc_id", "id", "occurrence", "same_text_count")


@query("a08_listing_rows", *TO_LISTED, "SELECT doc_id, line_no, line FROM listed")
def listing_rows(t: Tables):
    return D.listing_rows(D.paragraph_rows(fx.lines(t)))
