"""Phrases, ids, citations and labels to their places."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from ..functions import text as T
from ..operators import anchor as A
from ..operators import captions as C
from ..session import stored
from . import fixtures as fx
from .fixtures import (ANNOTATIONS_SQL, CAPTIONS_SQL, INDEXED_SQL, INTENTS_SQL, ITEMS_SQL, LINES_SQL, SENTENCES_SQL, WORDS_SQL,
                       norm_sql)
from .registry import Tables, query
from .text_queries import SENTS, WHOLE_TEXTS

TO_WORDS = [LINES_SQL, WORDS_SQL, INDEXED_SQL]
TO_INTENTS = TO_WORDS + [INTENTS_SQL]
TO_SENTENCES = [WHOLE_TEXTS, SENTS, SENTENCES_SQL]
# the n-th occurrence by splitting at the key
FOUND = f"""keyed AS (SELECT i.*, {norm_sql('phrase')} AS k, coalesce(occurrence, 1) AS o, t.text AS page_text
  FROM intents i JOIN texts t USING (doc_id, page)),
found AS (SELECT *, CASE WHEN k = '' THEN 0 ELSE len(string_split(page_text, k)) - 1 END AS matches,
  CASE WHEN k <> '' AND len(string_split(page_text, k)) > o
    THEN length(array_to_string(string_split(page_text, k)[1:o], '')) + (o - 1) * length(k) END AS start FROM keyed)"""


@query("c01_phrase_match", *TO_INTENTS, FOUND, """
SELECT f.doc_id, f.page, phrase, start, (SELECT string_agg(word, ' ' ORDER BY word_no) FROM indexed w WHERE w.doc_id = f.doc_id
  AND w.page = f.page AND w."offset" < start + length(k) AND w."offset" + n > start) AS matched FROM found f WHERE start IS NOT NULL""")
def phrase_match(t: Tables):
    found = A.match_phrases(fx.intents(t), A.page_index(fx.pages(t)))
    return found.filter("start IS NOT NULL").select("doc_id", "page", "phrase", "start", "matched")


@query("c02_phrase_count", *TO_INTENTS, FOUND, """
SELECT doc_id, page, phrase, matches, matches > 1 AND occurrence IS NULL AS ambiguous FROM found""")
def phrase_count(t: Tables):
    return A.match_phrases(fx.intents(t), A.page_index(fx.pages(t))).select("doc_id", "page", "phrase", "matches", "ambiguous")


MOVED = FOUND.replace("FROM intents i JOIN texts t USING (doc_id, page)", "FROM moved i LEFT JOIN texts t USING (doc_id, page)")


@query("c01_missed_phrases", *TO_INTENTS, "moved AS (SELECT * REPLACE (page + doc_id % 3 AS page) FROM intents)", MOVED, """
SELECT doc_id, page, phrase, occurrence, coalesce(matches, 0) AS matches, CASE WHEN page_text IS NULL THEN 'no such page'
  WHEN coalesce(matches, 0) = 0 THEN 'not found' ELSE 'too few occurrences' END AS reason FROM found WHERE start IS NULL""")
def missed_phrases(t: Tables):
    """Phrases looked for on their page and one or two pages further on, where some documents have none."""
    moved = fx.intents(t).withColumn("page", F.col("page") + F.col("doc_id") % 3)
    return A.match_phrases(moved, A.page_index(fx.pages(t))).filter("start IS NULL").select("doc_id", "page", "phrase", "occurrence", "matches", "reason")


@query("c03_span_match", *TO_WORDS, f"""
span_intents AS (SELECT doc_id, page, array_to_string(ws[3:3 + CAST(doc_id % 3 AS INT)], ' ') AS first,
  array_to_string(ws[9:10 + CAST(page % 2 AS INT)], ' ') AS last, CASE WHEN page % 3 = 0 THEN 1 END AS occurrence FROM texts WHERE len(ws) >= 10),
span_keys AS (SELECT s.*, {norm_sql('first')} AS a, {norm_sql('last')} AS b, t.text FROM span_intents s JOIN texts t USING (doc_id, page)),
begun AS (SELECT *, unnest(range(1, greatest(length(text) - length(a) + 1, 1) + 1)) AS i FROM span_keys),
ended AS (SELECT doc_id, page, i - 1 AS start, i + length(a) - 1 + strpos(substr(text, i + length(a)), b) - 1 + length(b) AS stop
  FROM begun WHERE substr(text, i, length(a)) = a AND strpos(substr(text, i + length(a)), b) > 0),
spans AS (SELECT doc_id, page, count(*) AS n, min(start) AS start, arg_min(stop, start) AS stop
  FROM (SELECT DISTINCT * FROM ended) d GROUP BY doc_id, page),
judged AS (SELECT k.doc_id, k.page, first, last, coalesce(n, 0) AS n_spans, start, stop,
  CASE WHEN length(a) < 8 OR length(b) < 8 THEN 'anchor too short' WHEN n IS NULL THEN 'not found'
       WHEN occurrence IS NULL AND n > 1 THEN 'several spans' END AS reason FROM span_keys k LEFT JOIN spans USING (doc_id, page))""", """
SELECT doc_id, page, n_spans, reason, CASE WHEN reason IS NULL THEN start END AS start, CASE WHEN reason IS NULL THEN stop END AS stop FROM judged""")
def span_match(t: Tables):
    ws = F.transform("words", lambda w: w["word"])
    intents = fx.pages(t).filter(F.size("words") >= 10).select(
        "doc_id", "page", F.array_join(F.slice(ws, F.lit(3), (F.col("doc_id") % 3 + 1).cast("int")), " ").alias("first"),
        F.array_join(F.slice(ws, F.lit(9), (F.col("page") % 2 + 2).cast("int")), " ").alias("last"),
        F.when(F.col("page") % 3 == 0, 1).alias("occurrence"))
    return A.match_spans(intents, A.page_index(fx.pages(t))).select("doc_id", "page", "n_spans", "reason", "start", "stop")


@query("c04_closest_passage")
def closest_passage(t: Tables):
    """Phrases with a letter lost inside, which no page has."""
    words = F.transform("words", lambda w: w["word"])
    whole = F.array_join(F.slice(words, 4, 8), " ")
    broken = F.concat(F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int") - 1), F.lit("zq"),
                      F.substring(whole, F.floor(F.length(whole) / 2).cast("int") + 1, F.length(whole)))
    intents = fx.pages(t).filter(F.size("words") >= 12).select("doc_id", "page", broken.alias("phrase"))
    return A.closest_passages(intents, A.page_index(fx.pages(t)), ["doc_id", "page", "phrase"])


# Phrases of eight words with one character lost and "zq" in its place. Their longest block on the page is the longer half, with the
# lost character where that is a z or q; the window around it matches both halves. Halves that stand on the page twice are not judged.
BROKEN = f"""whole AS (SELECT doc_id, page, text, array_to_string(ws[4:11], ' ') AS w FROM texts WHERE len(ws) >= 12),
broken AS (SELECT doc_id, page, text, substr(w, 1, length(w) // 2 - 1) || 'zq' || substr(w, length(w) // 2 + 1) AS phrase,
  {norm_sql("substr(w, 1, length(w) // 2 - 1)")} AS a, {norm_sql("substr(w, length(w) // 2, 1)")} AS c, {norm_sql("substr(w, length(w) // 2 + 1)")} AS b FROM whole),
laid AS (SELECT *, length(a) + length(b) + 2 AS size, length(a) + (c = 'z')::INT >= length(b) + (c = 'q')::INT AS first_half,
  CASE WHEN length(a) + (c = 'z')::INT >= length(b) + (c = 'q')::INT THEN a ELSE b END AS half FROM broken),
judged AS (SELECT *, strpos(substr(text, strpos(text, half) + 1), half) > 0 OR strpos(text, a || 'zq' || b) > 0 AS twice,
  CASE WHEN first_half THEN strpos(text, half) - 1 ELSE greatest(0, strpos(text, half) - 1 - length(a) - 2) END AS lies FROM laid),
rated AS (SELECT *, 2.0::DOUBLE * (length(a) + length(b) + (c IN ('z', 'q'))::INT) / (least(size, length(text) - lies) + size) AS ratio FROM judged)"""


@query("c04_snapped_phrases", *TO_WORDS, BROKEN, """
SELECT r.doc_id, r.page, twice, CASE WHEN NOT twice THEN CASE WHEN ratio >= 0.95 THEN 'snapped' ELSE 'missed' END END AS how,
  CASE WHEN NOT twice AND ratio >= 0.95 THEN ratio END AS similarity,
  CASE WHEN NOT twice AND ratio >= 0.95 THEN min(w."offset")::INT END AS start, CASE WHEN NOT twice AND ratio >= 0.95 THEN max(w."offset" + w.n)::INT END AS stop
FROM rated r JOIN indexed w ON w.doc_id = r.doc_id AND w.page = r.page AND w."offset" < lies + size AND w."offset" + w.n > lies AND w.n > 0
GROUP BY r.doc_id, r.page, twice, ratio""")
def snapped_phrases(t: Tables):
    index = A.page_index(fx.pages(t))
    words = F.transform("words", lambda w: w["word"])
    whole = fx.pages(t).filter(F.size("words") >= 12).select("doc_id", "page", F.array_join(F.slice(words, 4, 8), " ").alias("w"))
    half = F.floor(F.length("w") / 2).cast("int")
    parts = whole.select("doc_id", "page", F.substring("w", F.lit(1), half - 1).alias("a"), F.substring("w", half, F.lit(1)).alias("c"), F.substring("w", half + 1, F.length("w")).alias("b"))
    broken = parts.select("doc_id", "page", F.concat("a", F.lit("zq"), "b").alias("phrase"), F.lit(None).cast("int").alias("occurrence"),
                          *[T.norm_key(x).alias(x) for x in "abc"])
    found = A.snap_phrases(broken.select("doc_id", "page", "phrase", "occurrence"), index, near=False).drop("phrase", "occurrence")
    plus = lambda x: F.when(F.col("c") == x, 1).otherwise(0)
    longer = F.when(F.length("a") + plus("z") >= F.length("b") + plus("q"), F.col("a")).otherwise(F.col("b"))
    judged = broken.withColumn("half", longer).join(index.select("doc_id", "page", "text"), ["doc_id", "page"]).select(
        "doc_id", "page", ((F.call_function("locate", F.col("half"), F.col("text"), F.call_function("locate", F.col("half"), F.col("text")) + 1) > 0)
                           | F.contains("text", F.concat("a", F.lit("zq"), "b"))).alias("twice"))
    once_only = lambda c: F.when(~F.col("twice"), F.col(c)).alias(c)
    return judged.join(found, ["doc_id", "page"], "left").select("doc_id", "page", "twice", once_only("how"), *[once_only(c) for c in ("similarity", "start", "stop")])


# What a page prints: of every eleventh sentence the odd ones are lost, the even ones have "zq" in place of a character; every fifth page is rotated
PLACE = f"""printed AS (SELECT doc_id, page, id, text, CASE WHEN id % 22 = 0 THEN substr(text, 1, length(text) // 2 - 1) || 'zq' || substr(text, length(text) // 2 + 1) ELSE text END AS shown
  FROM sentences WHERE id % 11 <> 0 OR id % 22 = 0),
page_words AS (SELECT doc_id, page, id, unnest(string_split(shown, ' ')) AS word, unnest(range(len(string_split(shown, ' ')))) AS pos FROM printed),
placed_words AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page ORDER BY id, pos) - n AS "offset" FROM
  (SELECT doc_id, page, id, pos, {norm_sql('word')} AS norm, length({norm_sql('word')}) AS n FROM page_words WHERE word <> '') w),
page_text AS (SELECT doc_id, page, string_agg(norm, '' ORDER BY id, pos) AS text FROM placed_words GROUP BY doc_id, page),
counted AS (SELECT doc_id, page, id, text AS own, {norm_sql('text')} AS k, row_number() OVER (PARTITION BY doc_id, page, {norm_sql('text')} ORDER BY id) AS occ,
  count(*) OVER (PARTITION BY doc_id, page, {norm_sql('text')}) AS same FROM sentences),
met AS (SELECT c.*, p.text, CASE WHEN k = '' OR p.text IS NULL THEN 0 ELSE len(string_split(p.text, k)) - 1 END AS m,
  {norm_sql("substr(own, 1, length(own) // 2 - 1)")} AS a, {norm_sql("substr(own, length(own) // 2, 1)")} AS x, {norm_sql("substr(own, length(own) // 2 + 1)")} AS b
  FROM counted c LEFT JOIN page_text p USING (doc_id, page)),
laid AS (SELECT *, CASE WHEN m = 0 AND id % 22 = 0 AND page % 5 <> 0 AND length(k) > 0 THEN strpos(text, a || 'zq' || b) - 1
  + CASE WHEN length(a) + (x = 'z')::INT >= length(b) + (x = 'q')::INT THEN 0 ELSE 2 - length(x) END END AS lies,
  (length(k) - 2 + (x IN ('z', 'q'))::INT)::DOUBLE AS same_chars FROM met),
close AS (SELECT *, CASE WHEN lies IS NOT NULL AND 2.0::DOUBLE * same_chars / (2 * length(k)) >= 0.9 THEN 2.0::DOUBLE * same_chars / (2 * length(k)) END AS similarity FROM laid),
spans AS (SELECT c.doc_id, c.page, c.id, min(w."offset")::INT AS start, max(w."offset" + w.n)::INT AS stop FROM close c JOIN placed_words w
  ON w.doc_id = c.doc_id AND w.page = c.page AND w.n > 0 AND w."offset" < lies + length(k) AND w."offset" + w.n > lies WHERE similarity IS NOT NULL GROUP BY ALL)"""


@query("c05_sentence_places", *TO_SENTENCES, PLACE, """
SELECT doc_id, page, id, how, m AS matches, similarity, CASE how WHEN 'placed' THEN first WHEN 'closest' THEN start END AS start,
  CASE how WHEN 'placed' THEN first + length(k) WHEN 'closest' THEN stop END AS stop
FROM (SELECT c.*, s.start, s.stop, CASE WHEN page % 5 = 0 AND text IS NOT NULL THEN 'rotated' WHEN m = same THEN 'placed' WHEN m > 0 THEN 'ambiguous'
    WHEN similarity IS NOT NULL THEN 'closest' ELSE 'absent' END AS how,
  CASE WHEN m = same THEN length(array_to_string(string_split(text, k)[1:occ], '')) + (occ - 1) * length(k) END AS first
  FROM close c LEFT JOIN spans s USING (doc_id, page, id)) r""")
def sentence_places(t: Tables):
    from ..operators import text as X
    sents = fx.sentences(t)
    half = F.floor(F.length("text") / 2).cast("int")
    broken = F.concat(F.substring("text", F.lit(1), half - 1), F.lit("zq"), F.substring("text", half + 1, F.length("text")))
    shown = sents.filter((F.col("id") % 11 != 0) | (F.col("id") % 22 == 0)).withColumn("text", F.when(F.col("id") % 22 == 0, broken).otherwise(F.col("text")))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: F.filter(F.split(x["text"], " "), lambda w: w != ""))
    zero = F.lit(0)
    word = lambda w, i: F.struct(i.alias("word_no"), w.alias("word"), *[zero.alias(c) for c in ("block", "line", "x0", "x1", "y0", "y1")])
    pages = shown.groupBy("doc_id", "page").agg(F.flatten(in_order).alias("ws"))
    index = A.page_index(pages.select("doc_id", "page", F.transform("ws", word).alias("words"))).withColumn("rotated", F.col("page") % 5 == 0)
    return A.place_sentences(X.number_repeats(sents), index).select("doc_id", "page", "id", "how", "matches", "similarity", "start", "stop")


ID_INTENTS = """id_intents AS (SELECT doc_id, k, k * 7 + 1 AS first, k * 7 + 1 + CASE WHEN k = 3 THEN -1 ELSE (doc_id + k) % 4 END AS last
  FROM documents, (SELECT unnest(range(6)) AS k) r)"""


@query("c06_resolve_ids", *TO_SENTENCES, ID_INTENTS, """
SELECT doc_id, k, first, last, reason, CASE WHEN reason IS NULL THEN p0 END AS page, CASE WHEN reason IS NULL THEN t END AS text FROM (
  SELECT i.doc_id, k, first, last, min(page) AS p0, string_agg(text, ' ' ORDER BY id) AS t,
    CASE WHEN first > last THEN 'broken range' WHEN count(id) < last - first + 1 THEN 'unknown id'
         WHEN count(DISTINCT page) > 1 THEN 'several pages' END AS reason
  FROM id_intents i LEFT JOIN sentences s ON s.doc_id = i.doc_id AND s.id BETWEEN first AND last GROUP BY i.doc_id, k, first, last) r""")
def resolve_ids(t: Tables):
    ks = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k"))
    intents = ks.select("doc_id", "k", (F.col("k") * 7 + 1).alias("first"), (
        F.col("k") * 7 + 1 + F.when(F.col("k") == 3, F.lit(-1)).otherwise((F.col("doc_id") + F.col("k")) % 4)).alias("last"))
    return A.resolve_ids(intents, fx.sentences(t), ["doc_id", "k"])


@query("c07_word_offsets", *TO_WORDS, """SELECT doc_id, page, word_no, word, CAST("offset" AS BIGINT) AS "offset" FROM indexed""")
def word_offsets(t: Tables):
    rows = A.page_index(fx.pages(t)).select("doc_id", "page", F.explode("words").alias("w"))
    return rows.select("doc_id", "page", F.col("w.word_no").cast("long").alias("word_no"), "w.word", F.col("w.offset").cast("long").alias("offset"))


@query("c08_nearest_word", *TO_WORDS, """
SELECT doc_id, page, CAST(arg_min("offset", (dx * dx + dy * dy) * 100000 + word_no) AS BIGINT) AS "offset" FROM (
  SELECT *, greatest(0, x0 - bx1, bx0 - x1) AS dx, greatest(0, y0 - by1, by0 - y1) AS dy FROM (
    SELECT *, (doc_id * 29) % 500 AS bx0, (doc_id * 29) % 500 + 40 AS bx1, (page * 31 + doc_id) % 120 AS by0, (page * 31 + doc_id) % 120 + 8 AS by1
    FROM indexed) w) d GROUP BY doc_id, page""")
def nearest_word(t: Tables):
    d, p = F.col("doc_id"), F.col("page")
    near = G.box(d * 29 % 500, (p * 31 + d) % 120, d * 29 % 500 + 40, (p * 31 + d) % 120 + 8)
    best = F.array_min(F.transform("words", lambda w: F.struct(G.squared_gap(w, near).alias("gap"), w["word_no"].alias("n"), w["offset"].alias("o"))))
    return A.page_index(fx.pages(t)).select("doc_id", "page", best["o"].cast("long").alias("offset"))


@query("c09_line_boxes", *TO_INTENTS, FOUND, """
SELECT f.doc_id, f.page, CAST(row_number() OVER (PARTITION BY f.doc_id, f.page ORDER BY block, line) - 1 AS INT) AS pos,
  min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM found f JOIN indexed w
  ON w.doc_id = f.doc_id AND w.page = f.page AND w."offset" < start + length(k) AND w."offset" + n > start
GROUP BY f.doc_id, f.page, block, line""")
def line_boxes(t: Tables):
    found = A.match_phrases(fx.intents(t), A.page_index(fx.pages(t)))
    return found.select("doc_id", "page", F.posexplode("boxes").alias("pos", "b")).select(
        "doc_id", "page", "pos", "b.x0", "b.y0", "b.x1", "b.y1")


CITED = """cited AS (SELECT conv_id, turn, conv_id AS doc_id, text || ' [#' || (turn * 4 + 1) || '][#' || (turn * 4 + 2) || '] [#' || (turn * 9) ||
  '] and [#' || (conv_id + 900000) || '], [#' || (turn + 1) || ']' AS text FROM conversations WHERE role = 'assistant')"""


@query("c10_citations", *TO_SENTENCES, CITED, r"""runs AS (
SELECT conv_id, turn, doc_id, unnest(range(len(l))) AS run, unnest(l) AS r FROM (
  SELECT *, regexp_extract_all(text, '(?:\[#\d{1,18}\]\s*)+') AS l FROM cited) x),
ids AS (SELECT conv_id, turn, doc_id, run, unnest(range(len(l))) AS pos, CAST(unnest(l) AS BIGINT) AS id FROM (
  SELECT *, regexp_extract_all(r, '\[#(\d{1,18})\]', 1) AS l FROM runs) x),
paged AS (SELECT i.*, s.page, lag(s.page) OVER (PARTITION BY conv_id, turn, run ORDER BY pos) AS p FROM ids i LEFT JOIN sentences s USING (doc_id, id)),
chips AS (SELECT *, sum(CASE WHEN p = page THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn, run ORDER BY pos) AS chip FROM paged)""", """
SELECT conv_id, turn, CAST(run AS INT) AS run, CAST(chip AS INT) AS chip, min(page) AS page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids
FROM chips c WHERE EXISTS (SELECT 1 FROM paged q WHERE q.conv_id = c.conv_id AND q.turn = c.turn AND q.run = c.run AND q.page IS NOT NULL)
GROUP BY conv_id, turn, run, chip""")
def citations(t: Tables):
    c, n = F.col("conv_id"), F.col("turn")

    def s(x):
        return x.cast("string")
    text = F.concat("text", F.lit(" [#"), s(n * 4 + 1), F.lit("][#"), s(n * 4 + 2), F.lit("] [#"), s(n * 9), F.lit("] and [#"),
                    s(c + 900000), F.lit("], [#"), s(n + 1), F.lit("]"))
    answers = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", c.alias("doc_id"), text.alias("text"))
    return A.resolve_citations(answers, fx.sentences(t), ["conv_id", "turn"])


LABELS = r"""figures AS (
SELECT doc_id, page, row_no, CASE WHEN regexp_matches(lower(word), '^tab|表') THEN 'table' ELSE 'figure' END AS kind,
  CASE WHEN regexp_matches(num, '^[A-Za-z]') THEN upper(num) ELSE num END AS number FROM (
  SELECT *, regexp_extract(text, '^\s*((?i:fig(?:ure)?s?\.?|tab(?:le)?\.?)|图|表)\s*([A-Z]?\d+(?:\.\d+)?|[A-Z]\.\d+)\s*([:.|：．]|\s+[A-Z一-鿿]|$)', 1) AS word,
    regexp_extract(text, '^\s*((?i:fig(?:ure)?s?\.?|tab(?:le)?\.?)|图|表)\s*([A-Z]?\d+(?:\.\d+)?|[A-Z]\.\d+)\s*([:.|：．]|\s+[A-Z一-鿿]|$)', 2) AS num
  FROM caption_lines) c WHERE word <> '')"""


@query("c11_labels", LINES_SQL, CAPTIONS_SQL, LABELS, """
requests AS (SELECT doc_id, k, CASE WHEN k % 4 = 3 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN k % 4 = 3 THEN 'A.' || (k % 3) ELSE CAST(k % 7 AS VARCHAR) END AS number,
  CASE WHEN k % 5 = 0 THEN CAST(1 + k % 3 AS INT) END AS page FROM documents, (SELECT unnest(range(8)) AS k) r)""", """
SELECT doc_id, k, kind, number, page, reason, CASE WHEN reason IS NULL THEN p END AS found_page FROM (
  SELECT r.doc_id, k, r.kind, r.number, r.page, min(f.page) AS p, CASE WHEN count(f.page) = 0 THEN 'not found'
    WHEN count(DISTINCT f.page) > 1 THEN 'several pages' WHEN count(f.page) > 1 THEN 'several on a page' END AS reason
  FROM requests r LEFT JOIN figures f ON f.doc_id = r.doc_id AND f.kind = r.kind AND f.number = r.number AND (r.page IS NULL OR r.page = f.page)
  GROUP BY r.doc_id, k, r.kind, r.number, r.page) x""")
def labels(t: Tables):
    k = F.col("k")
    asked = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k")).select(
        "doc_id", "k", F.when(k % 4 == 3, "table").otherwise("figure").alias("kind"),
        F.when(k % 4 == 3, F.concat(F.lit("A."), (k % 3).cast("string"))).otherwise((k % 7).cast("string")).alias("number"),
        F.when(k % 5 == 0, (1 + k % 3).cast("int")).alias("page"))
    return A.look_up_labels(asked, C.captions(fx.caption_lines(t)), ["k"])


@query("c12_papers", ITEMS_SQL, """
SELECT q.key, q.item, count(c.key) FILTER (c.item_type = 'attachment' AND c.content_type = 'application/pdf') AS pdfs,
  count(c.key) FILTER (c.item_type = 'note') AS notes
FROM (SELECT key, CASE WHEN item_type = 'attachment' THEN parent ELSE key END AS item FROM lib_items WHERE item_type <> 'note') q
LEFT JOIN lib_items c ON c.parent = q.item GROUP BY q.key, q.item""")
def papers(t: Tables):
    lib = fx.lib_items(t)
    return A.resolve_papers(lib.filter("item_type <> 'note'").select("key"), lib)


PREFIXES = r"""full_texts AS (SELECT doc_id, id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM sentences),
listed AS (SELECT doc_id, id, trim(substr(body, 1, 80)) AS listed FROM full_texts WHERE id % 3 <> 0)"""


@query("c13_listed_texts", *TO_SENTENCES, PREFIXES, """
SELECT f.doc_id, f.id, (SELECT min(l.id) FROM listed l WHERE l.doc_id = f.doc_id AND
  (l.listed = f.body OR (length(l.listed) >= 76 AND starts_with(f.body, left(l.listed, -1))))) AS listed_id FROM full_texts f""")
def listed_texts(t: Tables):
    # read three times, split and collapsed once
    sents = stored(fx.sentences(t).select("doc_id", "id", T.collapse("text").alias("body"), F.when(F.col("id") % 3 != 0, T.brief("text")).alias("listed")))
    whole = sents.select("doc_id", "id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("id").cast("string")).alias("key"), "body")
    listed = sents.filter(F.col("id") % 3 != 0).select("doc_id", "listed", F.col("id").alias("listed_key"), F.col("id").alias("ord"))
    return A.listed_as(whole, listed, ["doc_id"]).select("doc_id", "id", F.col("listed_key").alias("listed_id"))


@query("c16_coordinate_shift", ANNOTATIONS_SQL, """
SELECT key, page, x0 + page % 7 AS x0, y0 - page % 5 AS y0, x1 + page % 7 AS x1, y1 - page % 5 AS y1 FROM annotations""")
def coordinate_shift(t: Tables):
    ann = fx.annotations(t)
    dims = ann.select(F.col("parent").alias("doc_id"), "page").distinct().select(
        "*", (F.col("page") % 7).alias("dx"), (-(F.col("page") % 5)).alias("dy"))
    boxes = ann.select("key", F.col("parent").alias("doc_id"), "page", F.array(G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).alias("rects"))
    return A.shift_boxes(boxes, dims).select("key", "page", F.inline("rects"))


# --- values of intents ------------------------------------------------------------------------------------------------------
@query("b24_colours", """src AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' Red ' WHEN 1 THEN '#ABCDEF' WHEN 2 THEN '' END AS explicit,
  CASE o_orderkey % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'method' END AS level, o_orderkey % 2 = 0 AS core FROM orders)""", """
SELECT o_orderkey, CASE WHEN explicit = ' Red ' THEN '#ff6666' WHEN explicit <> '' THEN lower(explicit) WHEN level = 'claim' THEN '#5fb236'
  WHEN level = 'method' THEN '#2ea8e5' WHEN core THEN '#ff6666' ELSE '#ffd400' END AS color FROM src""")
def colours(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(k % 5 == 0, " Red ").when(k % 5 == 1, "#ABCDEF").when(k % 5 == 2, "").alias("explicit"),
                           F.when(k % 3 == 0, "claim").when(k % 3 == 1, "method").alias("level"), (k % 2 == 0).alias("core"))
    return rows.select("o_orderkey", R.pick_colour("explicit", "level", "core", {"claim": "green", "method": "Blue"}).alias("color"))


@query("b25_tags", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE array_to_string(list_filter(['topic', 'T' || (o_orderkey % 3), o_orderstatus],
  lambda x, i: i = list_position(['topic', 'T' || (o_orderkey % 3), o_orderstatus], x)), ',') END AS tags FROM orders""")
def tags(t: Tables):
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.array(F.lit(" topic "), F.when(k % 7 == 0, "  ").otherwise("topic")).alias("config"),
                           F.array(F.concat(F.lit("T"), (k % 3).cast("string")), F.concat(F.col("o_orderstatus"), F.lit(" "))).alias("own"))
    return rows.select("o_orderkey", F.array_join(R.clean_tags("config", "own"), ",").alias("tags"))


@query("b26_ownership", ANNOTATIONS_SQL, "SELECT parent, count(*) AS n, count(*) FILTER (own) AS own FROM annotations GROUP BY parent")
def ownership(t: Tables):
    rows = fx.annotations(t).withColumn("tags", F.when(F.col("own"), F.array(F.lit("x"), F.lit(R.OWN_TAGS[0]))).otherwise(F.array(F.lit("x"))))
    return rows.groupBy("parent").agg(F.count("*").alias("n"), F.count_if(R.is_own("tags")).alias("own"))


@query("b27_sort_key", ANNOTATIONS_SQL, """
SELECT key, printf('%05d|%06d|%05d', page, least(ord, 999999), y0) AS sort_index FROM annotations""")
def sort_keys(t: Tables):
    return fx.annotations(t).select("key", R.sort_key("page", "ord", "y0").alias("sort_index"))


SUMMARIES_SQL = """summaries AS (SELECT o_orderkey AS k, o_orderkey % 12 AS page, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'note ' || o_orderkey END AS text,
  CASE o_orderkey % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'middle' END AS place, CASE WHEN o_orderkey % 4 = 1 THEN 'left' WHEN o_orderkey % 9 = 2 THEN 'up' END AS side,
  CASE o_orderkey % 3 WHEN 0 THEN 'note' END AS kind, CASE WHEN o_orderkey % 8 = 3 THEN 'Blue' WHEN o_orderkey % 13 = 5 THEN 'pinkish' END AS color,
  CASE WHEN o_orderkey % 7 = 2 THEN 40.0::DOUBLE WHEN o_orderkey % 7 = 3 THEN 10.0::DOUBLE END AS font_size,
  CASE WHEN o_orderkey % 6 = 1 THEN [o_orderkey % 600, 100, o_orderkey % 600 + o_orderkey % 80, 100 + o_orderkey % 40] END AS rect,
  CASE WHEN o_orderkey % 10 < 7 THEN 'an anchor' END AS anchor FROM orders)"""


@query("b23_summary_rules", SUMMARIES_SQL, r"""full_rows AS (SELECT *, coalesce(place, 'margin') AS p, coalesce(side, 'auto') AS s, coalesce(kind, 'text') AS d,
  CASE color WHEN 'Blue' THEN '#2ea8e5' WHEN 'pinkish' THEN 'pinkish' ELSE '#1a73e8' END AS c, coalesce(font_size, 8) AS f FROM summaries)""", """
SELECT k, reason, CASE WHEN reason IS NULL THEN p END AS place, CASE WHEN reason IS NULL THEN s END AS side, CASE WHEN reason IS NULL THEN d END AS kind,
  CASE WHEN reason IS NULL THEN c END AS color, CASE WHEN reason IS NULL THEN f END AS font_size FROM (SELECT *, CASE
  WHEN page < 1 OR page > 10 THEN 'page outside' WHEN trim(text) = '' THEN 'no text' WHEN p NOT IN ('margin', 'top', 'bottom') THEN 'place'
  WHEN s NOT IN ('auto', 'left', 'right') THEN 'side' WHEN d NOT IN ('text', 'note') THEN 'kind' WHEN NOT regexp_matches(c, '^#[0-9a-f]{6}$') THEN 'color'
  WHEN NOT f BETWEEN 4 AND 36 THEN 'font size' WHEN rect[1] < 0 OR rect[2] < 0 OR rect[3] > 612 OR rect[4] > 792 OR rect[1] >= rect[3] OR rect[2] >= rect[4] THEN 'rect outside'
  WHEN rect[3] - rect[1] < 30 THEN 'rect narrow' WHEN d = 'text' AND rect[4] - rect[2] < f * 1.5 + 6 THEN 'rect low'
  WHEN d = 'note' AND (rect[2] + 22 > 792 OR rect[1] + 22 > 612) THEN 'no room for icon'
  WHEN rect IS NULL AND (p = 'margin' OR d = 'note') AND anchor IS NULL THEN 'no anchor' END AS reason FROM full_rows) x""")
def summary_rules(t: Tables):
    from ..operators.checks import resolve_summaries
    k = F.col("o_orderkey")
    rect = F.when(k % 6 == 1, G.box(k % 600, F.lit(100).cast("long"), k % 600 + k % 80, 100 + k % 40))
    rows = t.orders.select(
        k.alias("k"), (k % 12).alias("page"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("note "), k.cast("string"))).alias("text"),
        F.when(k % 5 == 0, "top").when(k % 5 == 1, "middle").alias("place"), F.when(k % 4 == 1, "left").when(k % 9 == 2, "up").alias("side"),
        F.when(k % 3 == 0, "note").alias("kind"), F.when(k % 8 == 3, "Blue").when(k % 13 == 5, "pinkish").alias("color"),
        F.when(k % 7 == 2, 40.0).when(k % 7 == 3, 10.0).alias("font_size"), rect.alias("rect"), F.when(k % 10 < 7, "an anchor").alias("anchor"),
        F.lit(10).alias("pages"), F.lit(612).alias("width"), F.lit(792).alias("height"))
    return resolve_summaries(rows).select("k", "reason", "place", "side", "kind", "color", "font_size")
