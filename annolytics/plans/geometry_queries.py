"""Extents, overlaps, captions and free room, over words of documents and boxes of annotations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from ..operators import captions as C
from ..operators import layout as L
from . import fixtures as fx
from .anchor_queries import LABELS, TO_WORDS
from .fixtures import ANNOTATIONS_SQL, CAPTIONS_SQL, LINES_SQL
from .registry import Tables, query

EXTENTS = """body AS (SELECT doc_id, page, x0, x1, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0) - 1 AS i0,
  row_number() OVER (PARTITION BY doc_id, page ORDER BY x1) - 1 AS i1, count(*) OVER (PARTITION BY doc_id, page) AS n
  FROM words WHERE length(word) > 1 AND y0 > 40 AND y1 < 762),
extents AS (SELECT p.doc_id, p.page, coalesce(n, 0) AS n_words, coalesce(a, 50.0) AS body_x0, coalesce(b, 562.0) AS body_x1, coalesce(c, 0) < greatest(3.0, coalesce(n, 0) * 0.02) AS two_columns
  FROM (SELECT DISTINCT doc_id, page FROM words) p LEFT JOIN (SELECT doc_id, page, max(n) AS n, max(x0) FILTER (i0 = n // 50) AS a,
    max(x1) FILTER (i1 = n - greatest(1, n // 50)) AS b, count(*) FILTER (x0 < 300 AND x1 > 312) AS c FROM body GROUP BY doc_id, page) e USING (doc_id, page))"""


def _extents(t: Tables):
    return L.page_extents(fx.pages(t).select("*", F.lit(612).alias("width"), F.lit(792).alias("height")))


@query("d01_page_extents", *TO_WORDS, EXTENTS, """
SELECT doc_id, page, CAST(n_words AS INT) AS n_words, CAST(body_x0 AS DOUBLE) AS body_x0, CAST(body_x1 AS DOUBLE) AS body_x1 FROM extents""")
def page_extents(t: Tables):
    return _extents(t).select("doc_id", "page", "n_words", "body_x0", "body_x1")


@query("d02_document_extents", *TO_WORDS, EXTENTS, """
taken AS (SELECT e.*, row_number() OVER (PARTITION BY doc_id ORDER BY body_x0) - 1 AS i0, row_number() OVER (PARTITION BY doc_id ORDER BY body_x1) - 1 AS i1,
  count(*) OVER (PARTITION BY doc_id) AS m FROM extents e JOIN (SELECT doc_id, greatest(1, CAST(ceil(max(page) / 3) AS INT)) AS step FROM extents GROUP BY doc_id) s USING (doc_id)
  WHERE (page - 1) % step = 0 AND n_words >= 20)""", """
SELECT doc_id, CAST(max(body_x0) FILTER (i0 = m // 10) AS DOUBLE) AS x0, CAST(max(body_x1) FILTER (i1 = greatest(0, m - 1 - m // 10)) AS DOUBLE) AS x1 FROM taken GROUP BY doc_id""")
def document_extents(t: Tables):
    return L.document_extents(_extents(t), sample=3, min_words=20)


@query("d03_columns", *TO_WORDS, EXTENTS, "SELECT two_columns, count(*) AS pages FROM extents GROUP BY two_columns")
def columns(t: Tables):
    return _extents(t).groupBy("two_columns").agg(F.count("*").alias("pages"))


def _positions(t: Tables):
    """Annotations with their rectangles and ink paths as arrays of numbers."""
    a = fx.annotations(t)
    d = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    ink = (F.col("type") == "note") & (F.col("page") % 2 == 0)
    rects = F.when(ink, F.array().cast("array<array<double>>")).when(F.col("page") % 7 == 1, F.array(F.array(*d), F.array(d[0], d[1]))).otherwise(F.array(F.array(*d)))
    paths = F.when(ink, F.array(F.array(d[0], d[1], d[2], d[3], d[0] + 5, d[1] - 3)))
    return a.select("parent", "page", "key", F.when(ink, "ink").otherwise(F.col("type")).alias("type"), rects.alias("rects"), paths.alias("paths"),
                    F.when(F.col("own"), F.array(F.lit(R.OWN_TAGS[1]))).otherwise(F.array().cast("array<string>")).alias("tags"))


@query("d04_obstacles", ANNOTATIONS_SQL, """
SELECT parent, page, key, CAST(x0 AS DOUBLE) AS x0, CAST(y0 - CASE WHEN type = 'note' AND page % 2 = 0 THEN 3 ELSE 0 END AS DOUBLE) AS y0,
  CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM annotations WHERE type IN ('text', 'note') AND NOT own""")
def obstacles(t: Tables):
    return L.obstacles(_positions(t))


PAPER = "marks AS (SELECT *, parent % 50 AS paper FROM annotations)"


def _papers(t: Tables):
    return fx.annotations(t).withColumn("paper", F.col("parent") % 50)


@query("d05_overlaps", ANNOTATIONS_SQL, PAPER, """
SELECT a.key, count(*) AS hits, arg_min(b.key, (b.ord, b.key)) AS first_key FROM marks a JOIN marks b ON a.paper = b.paper AND a.page = b.page
  AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 2 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 2
WHERE NOT a.own AND b.own GROUP BY a.key""")
def overlaps(t: Tables):
    rows = _papers(t)
    return L.overlapping(rows.filter("NOT own"), rows.filter("own"), ["paper", "page"])


COVERS = """least(a.x1, b.x1) - greatest(a.x0, b.x0) > 2
  AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > greatest(2, least(a.y1 - a.y0, b.y1 - b.y0) / 2)"""


@query("d06_repeated_marks", ANNOTATIONS_SQL, PAPER, "hl AS (SELECT * FROM marks WHERE type IN ('highlight', 'underline'))", f"""
SELECT key, kind, arg_min(k, (o, k)) AS with_key FROM (
  SELECT a.key, b.key AS k, b.ord AS o, CASE WHEN a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1 THEN 'duplicate' ELSE 'overlap' END AS kind
  FROM hl a JOIN hl b ON a.paper = b.paper AND a.page = b.page AND b.ord < a.ord AND {COVERS}) p GROUP BY key, kind""")
def repeated_marks(t: Tables):
    return L.repeated_marks(_papers(t).filter(R.is_mark()), ["paper", "page"])


@query("d07_cover_existing", ANNOTATIONS_SQL, PAPER, f"""
SELECT a.key, arg_min(b.key, (b.ord, b.key)) AS first_key FROM marks a JOIN marks b ON a.paper = b.paper AND a.page = b.page AND {COVERS}
WHERE NOT a.own AND b.own AND a.type IN ('highlight', 'underline') GROUP BY a.key""")
def cover_existing(t: Tables):
    rows = _papers(t)
    return L.overlapping(rows.filter(~F.col("own") & R.is_mark()), rows.filter("own"), ["paper", "page"], G.covers).select("key", "first_key")


@query("d08_held_again", ANNOTATIONS_SQL, PAPER, """
sides AS (SELECT *, type IN ('highlight', 'underline') AS mark, CASE WHEN type IN ('highlight', 'underline') THEN text ELSE comment END AS body FROM marks)""", """
SELECT o.key FROM sides o WHERE own AND EXISTS (SELECT 1 FROM sides n WHERE NOT n.own AND n.paper = o.paper AND n.page = o.page AND n.mark = o.mark
  AND ((o.body <> '' AND n.body = o.body) OR (least(o.x1, n.x1) - greatest(o.x0, n.x0) > 2 AND least(o.y1, n.y1) - greatest(o.y0, n.y0) > 2)))""")
def held_again(t: Tables):
    rows = _papers(t).withColumn("mark", R.is_mark()).withColumn("body", F.when(F.col("mark"), F.col("text")).otherwise(F.col("comment")))
    return L.held_again(rows.filter("own"), rows.filter("NOT own"), ["paper", "page"]).select("key")


@query("d09_captions", LINES_SQL, CAPTIONS_SQL, LABELS, "SELECT doc_id, row_no, page, kind, number FROM figures")
def captions(t: Tables):
    return C.captions(fx.caption_lines(t))


SHAPES_SQL = """shapes AS (SELECT doc_id, page, row_no, CASE WHEN row_no % 2 = 0 THEN 'line' ELSE 'rect' END AS kind, (row_no * 53) % 300 AS x0,
  (row_no % 8) * 90 + 62 AS y0, (row_no * 53) % 300 + (row_no * 37) % 90 AS x1, (row_no % 8) * 90 + 62 + row_no % 4 AS y1 FROM lines)"""


def _shapes(t: Tables):
    n = F.col("row_no")
    return fx.lines(t).select("doc_id", "page", "row_no", F.when(n % 2 == 0, "line").otherwise("rect").alias("kind"), (n * 53 % 300).alias("x0"),
                              (n % 8 * 90 + 62).alias("y0"), (n * 53 % 300 + n * 37 % 90).alias("x1"), (n % 8 * 90 + 62 + n % 4).alias("y1"))


@query("d10_rules", LINES_SQL, SHAPES_SQL, """
SELECT doc_id, page, CAST(x0 AS DOUBLE) AS x0, y0 - pad AS y0, CAST(x1 AS DOUBLE) AS x1, y1 + pad AS y1 FROM (
  SELECT *, CASE kind WHEN 'line' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS pad FROM shapes) s
WHERE x1 - x0 >= 40 AND CASE kind WHEN 'line' THEN y1 - y0 < 1.5 ELSE y1 - y0 <= 2 END""")
def rules(t: Tables):
    return C.horizontal_rules(_shapes(t)).withColumns({"x0": F.col("x0").cast("double"), "x1": F.col("x1").cast("double")})


BLOCKS_SQL = """blocks AS (SELECT doc_id, page, row_no, text, 50 + 20 * (doc_id % 3) AS x0, 40 + 90 * (row_no % 8) AS y0,
  150 + 20 * (doc_id % 3) + (row_no * 37 + doc_id * 11) % 300 AS x1, 60 + 90 * (row_no % 8) AS y1 FROM caption_lines),
figs AS (SELECT doc_id, page, row_no, 60 AS x0, 64 + 90 * (row_no % 8) + (row_no * 7 + doc_id) % 40 AS y0, 100 + (row_no * 53) % 400 AS x1,
  94 + 90 * (row_no % 8) + (row_no * 7 + doc_id) % 40 AS y1 FROM caption_lines WHERE row_no % 5 IN (1, 2))"""


def _block_pages(t: Tables):
    """One row per page with its blocks, drawings and rules."""
    n, d = F.col("row_no"), F.col("doc_id")
    block = F.struct((50 + 20 * (d % 3)).cast("double").alias("x0"), (40 + 90 * (n % 8)).cast("double").alias("y0"),
                     (150 + 20 * (d % 3) + (n * 37 + d * 11) % 300).cast("double").alias("x1"), (60 + 90 * (n % 8)).cast("double").alias("y1"),
                     (1 + n % 4).alias("n_lines"), (20 + n % 30).cast("double").alias("mean_chars"), F.col("text"))
    y = 64 + 90 * (n % 8) + (n * 7 + d) % 40
    fig = F.when((n % 5).isin(1, 2), G.box(F.lit(60.0), y.cast("double"), (100 + n * 53 % 400).cast("double"), (y + 30).cast("double")))
    rule = F.when(n % 6 == 1, G.box(F.lit(55.0), (62.0 + 90 * (n % 8)).cast("double"), F.lit(400.0), (62.5 + 90 * (n % 8)).cast("double")))

    def column(e):
        # a page has eight rows
        return F.transform(F.array_sort(F.collect_list(F.when(e.isNotNull(), F.struct(n.alias("n"), e.alias("e"))))), lambda x: x["e"])
    return fx.caption_lines(t).groupBy("doc_id", "page").agg(
        column(block).alias("blocks"), column(fig).alias("figures"), column(rule).alias("rules")).withColumns(
        {"width": F.lit(612), "height": F.lit(792)})


BODIES = """caps AS (SELECT f.doc_id, f.page, f.row_no, kind, number, x0, y0, x1, y1 FROM figures f JOIN blocks b USING (doc_id, page, row_no)),
near AS (SELECT c.doc_id, c.page, c.row_no, kind, up, f.x0, f.y0, f.x1, f.y1, CASE WHEN up THEN c.y0 - f.y1 ELSE f.y0 - c.y1 END AS gap,
    row_number() OVER w AS i, CASE WHEN up THEN min(f.y0) OVER p - f.y1 ELSE f.y0 - max(f.y1) OVER p END AS step
  FROM caps c JOIN figs f USING (doc_id, page) CROSS JOIN (SELECT unnest([true, false]) AS up) u
  WHERE (least(f.x1, c.x1) - greatest(f.x0, c.x0)) / least(f.x1 - f.x0, c.x1 - c.x0) > 0.3 AND CASE WHEN up THEN f.y1 <= c.y0 + 3 ELSE f.y0 >= c.y1 - 3 END
  WINDOW w AS (PARTITION BY c.doc_id, c.page, c.row_no, up ORDER BY CASE WHEN up THEN -f.y1 ELSE f.y0 END, f.row_no),
    p AS (PARTITION BY c.doc_id, c.page, c.row_no, up ORDER BY CASE WHEN up THEN -f.y1 ELSE f.y0 END, f.row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chained AS (SELECT *, bool_and(i = 1 OR step <= 20) OVER (PARTITION BY doc_id, page, row_no, up ORDER BY i) AS joined,
  first_value(gap) OVER (PARTITION BY doc_id, page, row_no, up ORDER BY i) AS first_gap FROM near),
bodies AS (SELECT doc_id, page, row_no, kind, up, max(first_gap) AS gap, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM chained WHERE joined AND first_gap <= 60 GROUP BY doc_id, page, row_no, kind, up)"""
TO_BODIES = [LINES_SQL, CAPTIONS_SQL, LABELS, BLOCKS_SQL, BODIES]


def _drawn_sides(t: Tables):
    """Captions with the drawings above and below them."""
    pages = _block_pages(t)
    caps = pages.select("doc_id", "page", "figures", F.inline("blocks"))
    caps = caps.withColumn("label", C.label_parts(F.col("text"))).filter("label IS NOT NULL").withColumn("c", G.box(*[F.col(k) for k in L.BOX]))
    return caps.select("doc_id", "page", "label.kind", F.col("y0").alias("caption_y"), C.figure_body(F.col("c"), F.col("figures"), True).alias("up"),
                       C.figure_body(F.col("c"), F.col("figures"), False).alias("down"))


@query("d11_figure_bodies", *TO_BODIES, """
SELECT doc_id, page, 40 + 90 * (row_no % 8) AS caption_y, up, CAST(gap AS INT) AS gap, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1 FROM bodies""")
def figure_bodies(t: Tables):
    both = _drawn_sides(t).select("doc_id", "page", F.col("caption_y").cast("int").alias("caption_y"), F.inline(F.array(
        F.struct(F.lit(True).alias("up"), F.col("up").alias("b")), F.struct(F.lit(False).alias("up"), F.col("down").alias("b")))))
    return both.filter("b IS NOT NULL").select("doc_id", "page", "caption_y", "up", F.col("b.gap").cast("int").alias("gap"),
                                               *[F.col(f"b.region.{k}").cast("int").alias(k) for k in L.BOX])


@query("d12_find_figures")
def find_figures(t: Tables):
    return C.find_figures(_block_pages(t))


@query("d13_side_votes", *TO_BODIES, """
votes AS (SELECT doc_id, page, row_no, kind, arg_min(up, (gap, NOT up)) AS up FROM bodies GROUP BY doc_id, page, row_no, kind)""", """
SELECT c.doc_id, c.kind, CASE WHEN 2 * count(*) FILTER (up) = count(up) THEN c.kind = 'figure' ELSE 2 * count(*) FILTER (up) > count(up) END AS prefer_up
FROM caps c LEFT JOIN votes v USING (doc_id, page, row_no) GROUP BY c.doc_id, c.kind""")
def side_votes(t: Tables):
    return C.preferred_sides(_drawn_sides(t))


NEAR = "a.doc_id = b.doc_id AND a.page = b.page AND b.x0 <= a.x1 + 3 AND a.x0 - 3 <= b.x1 AND b.y0 <= a.y1 + 3 AND a.y0 - 3 <= b.y1"
# boxes take in what is near them, again and again; the last two rounds must agree, or the rows do not
ROUNDS = 9
CLUSTERS = ["near0 AS (SELECT DISTINCT doc_id, page, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 + row_no % 5 * 30 AS DOUBLE) AS y1 FROM shapes)",
            *[f"""near{k} AS (SELECT DISTINCT doc_id, page, n.x0, n.y0, n.x1, n.y1 FROM (SELECT a.doc_id, a.page, {{'x0': min(b.x0), 'y0': min(b.y0), 'x1': max(b.x1), 'y1': max(b.y1)}} AS n
  FROM near{k - 1} a JOIN near{k - 1} b ON {NEAR} GROUP BY a.doc_id, a.page, a.x0, a.y0, a.x1, a.y1) g)""" for k in range(1, ROUNDS + 1)]]


@query("d14_shape_clusters", LINES_SQL, SHAPES_SQL, *CLUSTERS, f"""SELECT * FROM near{ROUNDS} WHERE x1 - x0 >= 8 AND y1 - y0 >= 8 AND NOT (x1 - x0 > 0.95 * 612 AND y1 - y0 > 0.95 * 792)""")
def shape_clusters(t: Tables):
    shapes = _shapes(t).withColumn("y1", F.col("y1") + F.col("row_no") % 5 * 30)
    return C.cluster_shapes(shapes.withColumns({"width": F.lit(612), "height": F.lit(792)}), ["doc_id", "page"])


@query("d15_margin_boxes", *TO_WORDS, EXTENTS, """
SELECT doc_id, page, side, CASE WHEN use_left THEN 4.0::DOUBLE ELSE least(612.0 - 34, body_x1 + 4)::DOUBLE END AS "left",
  CASE WHEN use_left THEN greatest(34.0, body_x0 - 4)::DOUBLE ELSE 608.0::DOUBLE END AS "right" FROM (
  SELECT *, CASE side WHEN 'left' THEN true WHEN 'right' THEN false ELSE CASE WHEN two_columns THEN (page * 97) % 600 < 306 ELSE body_x0 - 8 >= 612 - body_x1 - 8 END END AS use_left
  FROM extents, (SELECT unnest(['auto', 'left', 'right']) AS side) s) e""")
def margin_boxes(t: Tables):
    rows = _extents(t).select("*", F.explode(F.array(F.lit("auto"), F.lit("left"), F.lit("right"))).alias("side"))
    m = L.margin_box(F.col("side"), F.col("page") * 97 % 600, F.col("body_x0"), F.col("body_x1"), F.col("width"), F.col("two_columns"))
    return rows.select("doc_id", "page", "side", m.alias("m")).select("doc_id", "page", "side", "m.left", "m.right")


FREE = "list_filter(list_concat([want], list_transform(taken, lambda t: {edge})), lambda c: c {side} want AND len(list_filter(taken, lambda t: c - h < t.hi + 3 AND c > t.lo - 3)) = 0)"
# one block of every page a step, highest wish first: the nearest free top below, else above, else where it is
MARGINS = f"""side_notes AS (SELECT parent, page, key, ord, own, CAST(y1 + 60 AS DOUBLE) AS y_top, CAST(x1 - x0 AS DOUBLE) AS h, CAST(y0 AS DOUBLE) AS lo, CAST(y1 AS DOUBLE) AS hi FROM annotations WHERE type IN ('text', 'note')),
turns AS (SELECT parent, page, key, h, CAST(least(greatest(y_top, 30 + h), 760) AS DOUBLE) AS want, row_number() OVER (PARTITION BY parent, page ORDER BY y_top DESC, ord, key) AS k FROM side_notes WHERE NOT own),
packed AS (SELECT parent, page, 0::BIGINT AS k, coalesce(list({{'lo': lo, 'hi': hi}}) FILTER (own), []) AS taken, NULL::VARCHAR AS key, NULL::DOUBLE AS y_top, NULL::DOUBLE AS h, NULL::VARCHAR AS flag FROM side_notes GROUP BY parent, page
  UNION ALL SELECT parent, page, k, list_append(taken, {{'lo': top - h, 'hi': top}}), key, top, h, CASE WHEN h > 730 THEN 'too tall' WHEN free IS NULL THEN 'no room' END FROM (
    SELECT *, CAST(CASE WHEN h > 730 THEN 760 ELSE coalesce(free, want) END AS DOUBLE) AS top FROM (
      SELECT *, coalesce(CASE WHEN below - h >= 30 THEN below END, CASE WHEN above <= 760 THEN above END) AS free FROM (
        SELECT *, list_max({FREE.format(edge="t.lo - 3", side="<=")}) AS below, list_min({FREE.format(edge="t.hi + 3 + h", side=">=")}) AS above FROM (
          SELECT p.parent, p.page, n.k, p.taken, n.key, n.h, n.want FROM packed p JOIN turns n ON n.parent = p.parent AND n.page = p.page AND n.k = p.k + 1) a) b) c) d)"""


@query("d16_margin_room", "RECURSIVE " + ANNOTATIONS_SQL, MARGINS, "SELECT parent, page, key, y_top, h, flag FROM packed WHERE k > 0")
def margin_room(t: Tables):
    """Margin notes of every page between what stands there already: the rows of a page are counted into its margin."""
    rows = fx.annotations(t).filter(F.col("type").isin("text", "note"))
    block = F.when(~F.col("own"), F.struct("ord", "key", (F.col("y1") + 60).cast("double").alias("y_top"), (F.col("x1") - F.col("x0")).cast("double").alias("h")))
    taken = F.when(F.col("own"), F.struct("ord", F.col("y0").cast("double").alias("lo"), F.col("y1").cast("double").alias("hi")))
    pages = rows.groupBy("parent", "page").agg(
        F.transform(F.array_sort(F.collect_list(block)), lambda b: F.struct(b["key"].alias("key"), b["y_top"].alias("y_top"), b["h"].alias("h"))).alias("blocks"),
        F.transform(F.array_sort(F.collect_list(taken)), lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"))).alias("occupied"))
    return L.pack_margins(pages.filter(F.size("blocks") > 0).withColumns({"floor": F.lit(30.0), "ceiling": F.lit(760.0)}))


GAPS = (*TO_WORDS, """
iv AS (SELECT doc_id, page, line, word_no, CAST(greatest(x0, 60) AS DOUBLE) AS a, CAST(least(x1, 400) AS DOUBLE) AS b FROM words WHERE x0 < 400 AND x1 > 60),
edges AS (SELECT doc_id, page, line, coalesce(max(b + 3) OVER w, 60) AS began, a - 3 AS stop FROM iv WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY a, b, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT p.doc_id, p.page, p.line, coalesce(max(b + 3), 60), 400 FROM (SELECT DISTINCT doc_id, page, line FROM words) p LEFT JOIN iv USING (doc_id, page, line) GROUP BY p.doc_id, p.page, p.line),
free AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY stop - greatest(began, 60) DESC, began) AS r FROM edges WHERE stop > greatest(began, 60))""", """
SELECT doc_id, page, line, CAST(greatest(began, 60) AS DOUBLE) AS a, CAST(stop AS DOUBLE) AS b FROM free WHERE r = 1 AND stop - greatest(began, 60) >= 60""")


@query("d17_free_gaps", *GAPS)
@query("d17_whole_free_gaps", *GAPS)
def free_gaps(t: Tables):
    lines = fx.pages(t).select("doc_id", "page", "words", F.explode(F.array_distinct(F.transform("words", lambda w: w["line"]))).alias("line"))
    blocked = F.transform(F.filter("words", lambda w: w["line"] == F.col("line")), lambda w: F.struct(w["x0"].alias("a"), w["x1"].alias("b")))
    rows = lines.select("doc_id", "page", "line", L.widest_gap(blocked, F.lit(60), F.lit(400)).alias("g"))
    return rows.filter("g IS NOT NULL").select("doc_id", "page", "line", "g.a", "g.b")


@query("d19_wrapped_lines", r"""chars AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda c: {'l': 0, 'w': CASE
  WHEN regexp_matches(c, '^[\x00-\x7f]$') OR c = chr(10) THEN CASE WHEN regexp_matches(c, '^\s') THEN 0.3::DOUBLE ELSE 0.55::DOUBLE END ELSE 1.0::DOUBLE END * 8.0::DOUBLE}) AS l FROM conversations),
wrapped AS (SELECT conv_id, turn, list_reduce(l, lambda a, b: CASE WHEN a.l = 0 THEN (CASE WHEN a.w + b.w > 117 THEN {'l': 2, 'w': b.w} ELSE {'l': 1, 'w': a.w + b.w} END)
  WHEN a.w + b.w > 117 THEN {'l': a.l + 1, 'w': b.w} ELSE {'l': a.l, 'w': a.w + b.w} END).l AS lines FROM chars)""", """
SELECT conv_id, turn, CAST(greatest(lines, 1) AS INT) AS lines, greatest(lines, 1) * 12.0::DOUBLE + 6 AS height FROM wrapped""")
def wrapped_lines(t: Tables):
    rows = t.conversations.select("conv_id", "turn", L.wrapped_lines(F.col("text"), F.lit(117.0), F.lit(8.0)).alias("lines"),
                                  L.box_height(F.lit("text"), F.col("text"), F.lit(120.0), F.lit(8.0)).alias("height"))
    return rows
