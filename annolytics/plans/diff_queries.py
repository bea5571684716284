"""Listings of annotations against the record of what was written and against a new configuration."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from ..operators import diff as D
from ..operators import layout as L
from ..session import stored
from . import fixtures as fx
from .fixtures import ANNOTATIONS_SQL
from .registry import Tables, query

# the listing: what the tool wrote and users edited since; the record: what it wrote; the new configuration
SNAPSHOTS = """src AS (SELECT * REPLACE (parent % 50 AS parent), page AS p, x0 AS a, y0 AS b FROM annotations WHERE own),
listing AS (SELECT key, parent, type, page, ord, CASE WHEN a % 84 = 0 THEN '#aaaaaa' ELSE color END AS color,
  CASE WHEN p % 8 = 2 THEN 'ii' ELSE CAST(p AS VARCHAR) END AS page_label, text, CASE WHEN p % 6 = 0 THEN comment || ' edited' ELSE comment END AS comment,
  CASE WHEN b % 5 = 0 THEN x0 + 240 ELSE x0 END AS x0, y0, CASE WHEN b % 5 = 0 THEN x1 + 240 ELSE x1 END AS x1, y1,
  list_concat(['annolytics'], CASE WHEN p % 10 = 3 THEN ['important'] ELSE [] END, CASE WHEN p % 4 = 1 AND a % 5 <> 0 THEN ['topic'] ELSE [] END) AS tags,
  added, modified, ord % 7 AS version FROM src),
places AS (SELECT *, page || '|' || x0 * 10 || ',' || y0 * 10 || ',' || x1 * 10 || ',' || y1 * 10 AS place FROM listing),
records AS (SELECT key, type, lower(color) AS color, CAST(p AS VARCHAR) AS page_label, comment, text,
  page || '|' || x0 * 10 || ',' || y0 * 10 || ',' || x1 * 10 || ',' || y1 * 10 AS place, CASE WHEN p % 4 = 1 THEN ['topic'] ELSE [] END AS tags FROM src WHERE p % 9 <> 0),
config AS (SELECT 'N' || key AS key, parent, type, page, ord, CASE WHEN a % 7 = 0 THEN '#a28ae5' ELSE lower(color) END AS color, CAST(p AS VARCHAR) AS page_label,
  text, CASE WHEN p % 11 = 0 THEN 'new ' || comment ELSE comment END AS comment, CASE WHEN b % 3 = 0 THEN x0 + 20 ELSE x0 END AS x0, y0,
  CASE WHEN b % 3 = 0 THEN x1 + 20 ELSE x1 END AS x1, y1, CASE WHEN p % 3 = 0 THEN ['topic'] ELSE [] END AS tags FROM src WHERE p % 13 <> 0),
config_places AS (SELECT *, page || '|' || x0 * 10 || ',' || y0 * 10 || ',' || x1 * 10 || ',' || y1 * 10 AS place FROM config)"""
TO_SNAPSHOTS = [ANNOTATIONS_SQL, SNAPSHOTS]


def _place(df):
    box = F.array(G.box(*[F.col(c) for c in L.BOX]))
    return df.withColumn("place", D.place_text(F.col("page"), box))


def _source(t: Tables):
    return fx.annotations(t).filter("own").withColumn("parent", F.col("parent") % 50)


def _tags(*conditions):
    return F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in conditions]))


def listing(t: Tables):
    p, a, b = F.col("page"), F.col("x0"), F.col("y0")
    moved = b % 5 == 0
    return _place(_source(t).select(
        "key", "parent", "type", "page", "ord", F.when(a % 84 == 0, "#aaaaaa").otherwise(F.col("color")).alias("color"),
        F.when(p % 8 == 2, "ii").otherwise(p.cast("string")).alias("page_label"), "text",
        F.when(p % 6 == 0, F.concat("comment", F.lit(" edited"))).otherwise(F.col("comment")).alias("comment"),
        F.when(moved, a + 240).otherwise(a).alias("x0"), "y0", F.when(moved, F.col("x1") + 240).otherwise(F.col("x1")).alias("x1"), "y1",
        _tags((F.lit(True), R.OWN_TAGS[0]), (p % 10 == 3, "important"), ((p % 4 == 1) & (a % 5 != 0), "topic")).alias("tags"),
        "added", "modified", (F.col("ord") % 7).alias("version")))


def records(t: Tables):
    p = F.col("page")
    rows = _place(_source(t).filter(p % 9 != 0).withColumn("page_label", p.cast("string")).withColumn("tags", _tags((p % 4 == 1, "topic"))))
    return D.prints(rows).select("key", *D.PRINTED, "tags")


def config(t: Tables):
    p, a, moved = F.col("page"), F.col("x0"), F.col("y0") % 3 == 0
    return _place(_source(t).filter(p % 13 != 0).select(
        F.concat(F.lit("N"), "key").alias("key"), "parent", "type", "page", "ord",
        F.when(a % 7 == 0, "#a28ae5").otherwise(F.lower("color")).alias("color"), p.cast("string").alias("page_label"), "text",
        F.when(p % 11 == 0, F.concat(F.lit("new "), "comment")).otherwise(F.col("comment")).alias("comment"),
        F.when(moved, a + 20).otherwise(a).alias("x0"), "y0", F.when(moved, F.col("x1") + 20).otherwise(F.col("x1")).alias("x1"), "y1",
        _tags((p % 3 == 0, "topic")).alias("tags")))


def fp(e):
    return f"substr(sha1(concat(length({e}), ':', {e})), 1, 16)"


CHANGES = """joined AS (SELECT l.*, r.key IS NOT NULL AS recorded, r.color AS r_color, r.page_label AS r_label, r.type AS r_type,
  list_filter(['type', 'color', 'page_label', 'comment', 'text', 'place'], lambda f: r.key IS NOT NULL AND CASE f WHEN 'type' THEN l.type <> r.type
    WHEN 'color' THEN lower(l.color) <> r.color WHEN 'page_label' THEN l.page_label <> r.page_label WHEN 'comment' THEN l.comment <> r.comment
    WHEN 'text' THEN l.text <> r.text ELSE l.place <> r.place END) AS diff,
  list_filter(l.tags, lambda x: x <> 'annolytics' AND NOT list_contains(coalesce(r.tags, []), x)) AS plus,
  list_filter(coalesce(r.tags, []), lambda x: NOT list_contains(l.tags, x)) AS minus FROM places l LEFT JOIN records r USING (key)),
changed AS (SELECT * FROM (SELECT *, list_concat(diff, CASE WHEN NOT recorded AND modified - added > 5 THEN ['other'] ELSE [] END,
  CASE WHEN len(plus) > 0 THEN ['tags'] ELSE [] END, CASE WHEN len(minus) > 0 THEN ['tags_removed'] ELSE [] END) AS changes FROM joined) j WHERE len(changes) > 0)"""


@query("f01_fingerprints", *TO_SNAPSHOTS, f"SELECT key, {fp('comment')} AS fp_comment, {fp('text')} AS fp_text, {fp('place')} AS fp_place FROM places")
def fingerprints(t: Tables):
    return D.prints(listing(t)).select("key", "fp_comment", "fp_text", "fp_place")


@query("f02_user_changes", *TO_SNAPSHOTS, CHANGES, """
SELECT key, array_to_string(changes, ',') AS changes, array_to_string(plus, ',') AS added, array_to_string(minus, ',') AS gone FROM changed""")
def user_changes(t: Tables):
    return D.user_changes(listing(t), records(t)).select("key", F.array_join("changes", ",").alias("changes"), F.array_join("tags_added", ",").alias("added"),
                                                         F.array_join("tags_gone", ",").alias("gone"))


@query("f03_change_sentences", *TO_SNAPSHOTS, CHANGES, """said AS (SELECT key, list_filter([
  CASE WHEN len(plus) > 0 THEN 'added the tag ' || array_to_string(list_transform(plus, lambda x: '“' || x || '”'), ', ') END,
  CASE WHEN len(minus) > 0 THEN 'removed the tag ' || array_to_string(list_transform(minus, lambda x: '“' || x || '”'), ', ') END,
  CASE WHEN list_contains(changes, 'page_label') THEN 'changed the page label ' || r_label || ' → ' || page_label END,
  CASE WHEN list_contains(changes, 'comment') THEN 'changed the comment' END,
  CASE WHEN list_contains(changes, 'color') THEN 'changed the colour ' || r_color || ' → ' || lower(color) END,
  CASE WHEN list_contains(changes, 'place') THEN 'moved or resized it' END, CASE WHEN list_contains(changes, 'other') THEN 'changed it' END],
  lambda x: x IS NOT NULL) AS l FROM changed)""", """
SELECT key, CASE WHEN len(l) < 3 THEN array_to_string(l, ' and ') ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS sentence FROM said""")
def change_sentences(t: Tables):
    return D.describe_changes(D.user_changes(listing(t), records(t))).select("key", "sentence")


BODY = "trim(regexp_replace(CASE WHEN type IN ('highlight', 'underline') THEN text ELSE comment END, '\\s+', ' ', 'g'))"


def _pass(n, name, keys, a, b, words):
    only = "WHERE body <> ''" if words else ""
    using = ", ".join(["parent", "type", "page", *keys, "nth"])
    by = ", ".join(["parent", "type", "page", *keys])
    return f"""pairs{n} AS (SELECT x.key AS new_key, y.key AS old_key, '{name}' AS how
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ord) AS nth FROM {a} {only}) x
  JOIN (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ord) AS nth FROM {b} {only}) y USING ({using})),
new{n} AS (SELECT * FROM {a} WHERE key NOT IN (SELECT new_key FROM pairs{n})), old{n} AS (SELECT * FROM {b} WHERE key NOT IN (SELECT old_key FROM pairs{n}))"""


PAIRS = [f"new0 AS (SELECT *, {BODY} AS body FROM config_places), old0 AS (SELECT *, {BODY} AS body FROM places)",
         _pass(1, "text and place", ["body", "place"], "new0", "old0", True), _pass(2, "place", ["place"], "new1", "old1", False),
         _pass(3, "text", ["body"], "new2", "old2", True), "pairs AS (SELECT * FROM pairs1 UNION ALL SELECT * FROM pairs2 UNION ALL SELECT * FROM pairs3)"]
PLAN = """plan AS (SELECT coalesce(n.parent, o.parent) AS parent, n.key AS new_key, o.key AS old_key, how,
  CASE WHEN n.key IS NOT NULL AND o.key IS NOT NULL THEN list_filter(['comment', 'color', 'text', 'place', 'page_label', 'tags'], lambda f: CASE f
    WHEN 'comment' THEN n.comment <> o.comment WHEN 'color' THEN lower(n.color) <> lower(o.color)
    WHEN 'text' THEN n.type IN ('highlight', 'underline') AND n.text <> o.text WHEN 'place' THEN n.place <> o.place
    WHEN 'page_label' THEN n.page_label <> o.page_label AND NOT (r.key IS NOT NULL AND r.page_label <> o.page_label)
    ELSE len(list_filter(n.tags, lambda x: NOT list_contains(o.tags, x))) > 0
      OR len(list_filter(coalesce(r.tags, []), lambda x: NOT list_contains(n.tags, x) AND list_contains(o.tags, x))) > 0 END) END AS fields,
  list_filter(n.tags, lambda x: NOT list_contains(o.tags, x)) AS plus,
  list_filter(coalesce(r.tags, []), lambda x: NOT list_contains(n.tags, x) AND list_contains(o.tags, x)) AS minus
  FROM config_places n LEFT JOIN pairs p ON n.key = p.new_key FULL OUTER JOIN places o ON o.key = p.old_key LEFT JOIN records r ON r.key = o.key),
acts AS (SELECT *, CASE WHEN old_key IS NULL THEN 'create' WHEN new_key IS NULL THEN 'remove' WHEN len(fields) = 0 THEN 'keep' ELSE 'update' END AS action FROM plan)"""
TO_PLAN = [*TO_SNAPSHOTS, *PAIRS, PLAN]
FIXTURE_CHUNK = 1 << 34    # the fixtures' order numbers are sparse


def _plan(t: Tables, *reads: str):
    """The plan, with the columns that a query ``reads`` or all."""
    new, old = config(t), listing(t)
    return stored(D.rewrite_plan(new, old, D.match_rewrite(new, old, overlap=False, chunk_rows=FIXTURE_CHUNK), records(t)).select(*(reads or ["*"])))


@query("f04_rewrite_pairs", *TO_SNAPSHOTS, *PAIRS, "SELECT new_key, old_key, how FROM pairs")
def rewrite_pairs(t: Tables):
    return D.match_rewrite(config(t), listing(t), overlap=False, chunk_rows=FIXTURE_CHUNK).select("new_key", "old_key", "how")


# one new row of every page a step takes the first of the old ones left that lies under it
GREEDY = """news AS (SELECT parent, type, page, key, x0, y0, x1, y1, row_number() OVER (PARTITION BY parent, type, page ORDER BY ord, key) AS k FROM new3),
taken AS (SELECT parent, type, page, 0::BIGINT AS k, list({'key': key, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY ord, key) AS free, NULL::VARCHAR AS new_key, NULL::VARCHAR AS old_key FROM old3 GROUP BY parent, type, page
  UNION ALL SELECT parent, type, page, k, list_filter(free, lambda o: o.key IS DISTINCT FROM pick), key, pick FROM (
    SELECT t.parent, t.type, t.page, n.k, t.free, n.key, list_filter(t.free, lambda o: least(o.x1, n.x1) - greatest(o.x0, n.x0) > 2 AND least(o.y1, n.y1) - greatest(o.y0, n.y0) > 2)[1].key AS pick
    FROM taken t JOIN news n ON n.parent = t.parent AND n.type = t.type AND n.page = t.page AND n.k = t.k + 1) s)"""


@query("f04_overlap_pairs", "RECURSIVE " + TO_SNAPSHOTS[0], *TO_SNAPSHOTS[1:], *PAIRS, GREEDY,
       "SELECT new_key, old_key, how FROM pairs UNION ALL SELECT new_key, old_key, 'overlap' FROM taken WHERE old_key IS NOT NULL")
def overlap_pairs(t: Tables):
    return D.match_rewrite(config(t), listing(t), chunk_rows=FIXTURE_CHUNK)


@query("f05_rewrite_plan", *TO_PLAN, "SELECT parent, action, new_key, old_key, array_to_string(fields, ',') AS fields FROM acts")
def rewrite_plan(t: Tables):
    return _plan(t).select("parent", "action", "new_key", "old_key", F.array_join("fields", ",").alias("fields"))


@query("f06_tag_deltas", *TO_PLAN, "SELECT old_key, array_to_string(plus, ',') AS plus, array_to_string(minus, ',') AS minus FROM acts WHERE list_contains(fields, 'tags')")
def tag_deltas(t: Tables):
    return _plan(t).filter(F.array_contains("fields", "tags")).select("old_key", F.array_join("tag_delta.add", ",").alias("plus"),
                                                                      F.array_join("tag_delta.remove", ",").alias("minus"))


@query("f07_clashes", *TO_PLAN, CHANGES, """undone AS (SELECT a.parent, c.key, CASE action WHEN 'remove' THEN 'delete' ELSE 'undo' END AS effect,
  CASE action WHEN 'remove' THEN changes WHEN 'update' THEN list_concat(list_filter(['comment', 'color', 'text', 'place', 'tags_removed'],
    lambda w: list_contains(changes, w) AND list_contains(fields, CASE w WHEN 'tags_removed' THEN 'tags' ELSE w END)),
    CASE WHEN list_contains(changes, 'other') THEN ['other'] ELSE [] END) END AS l FROM acts a JOIN changed c ON c.key = a.old_key)""", """
SELECT parent, key, effect, array_to_string(l, ',') AS undone FROM undone WHERE len(l) > 0""")
def clashes(t: Tables):
    return D.clashes(_plan(t), D.user_changes(listing(t), records(t))).select("parent", "key", "effect", F.array_join("undone", ",").alias("undone"))


SIDES = """held AS (SELECT o.key FROM places o WHERE EXISTS (SELECT 1 FROM config_places n WHERE n.parent = o.parent AND n.page = o.page
  AND (n.type IN ('highlight', 'underline')) = (o.type IN ('highlight', 'underline')) AND least(o.x1, n.x1) - greatest(o.x0, n.x0) > 2 AND least(o.y1, n.y1) - greatest(o.y0, n.y0) > 2)),
other AS (SELECT * FROM places WHERE key NOT IN (SELECT key FROM held) AND key NOT IN (SELECT key FROM records WHERE color <> '#ffd400'))"""


@query("f08_foreign_cleanup", *TO_SNAPSHOTS, SIDES, """
SELECT parent, count(*) AS n, array_to_string(list(key ORDER BY ord, key)[:8], ', ') AS keys,
  array_to_string(list_sort(list(DISTINCT page))[:12], ', ') AS pages FROM other GROUP BY parent""")
def foreign_cleanup(t: Tables):
    old, new = listing(t).withColumn("mark", R.is_mark()), config(t).withColumn("mark", R.is_mark())
    held = L.overlapping(old, new, ["parent", "page", "mark"]).select("key")
    return D.foreign_cleanup(old, records(t).filter("color <> '#ffd400'"), held)


@query("f09_version_check", *TO_SNAPSHOTS, """
SELECT parent, count(*) FILTER (p IS NULL OR now IS NULL) AS set_differs, count(*) FILTER (seen <> now) AS version_differs,
  count(*) FILTER (p IS NULL OR now IS NULL) > 0 OR count(*) FILTER (seen <> now) > 0 AS refused FROM (
  SELECT l.parent, CASE WHEN l.ord % 101 <> 0 THEN 1 END AS p, CASE WHEN l.ord % 103 <> 0 THEN l.version + CASE WHEN l.ord % 97 = 0 THEN 1 ELSE 0 END END AS now, l.version AS seen FROM listing l) x
WHERE p IS NOT NULL OR now IS NOT NULL GROUP BY parent""")
def version_check(t: Tables):
    rows = listing(t)
    current = rows.filter(F.col("ord") % 103 != 0).withColumn("version", F.col("version") + F.when(F.col("ord") % 97 == 0, 1).otherwise(0))
    return D.version_check(rows, current, rows.filter(F.col("ord") % 101 != 0))


READ_BACK = """expected AS (SELECT o.key, o.type, CASE WHEN list_contains(fields, 'comment') THEN n.comment ELSE o.comment END AS comment,
  CASE WHEN list_contains(fields, 'color') THEN n.color ELSE o.color END AS color, CASE WHEN list_contains(fields, 'text') THEN n.text ELSE o.text END AS text,
  CASE WHEN list_contains(fields, 'place') THEN n.place ELSE o.place END AS place, CASE WHEN list_contains(fields, 'page_label') THEN n.page_label ELSE o.page_label END AS page_label,
  CASE WHEN list_contains(fields, 'tags') THEN list_concat(list_filter(o.tags, lambda x: NOT list_contains(minus, x)), plus) ELSE o.tags END AS tags, o.parent, o.ord, action
  FROM acts a JOIN places o ON o.key = a.old_key LEFT JOIN config_places n ON n.key = a.new_key WHERE action <> 'remove'),
next AS (SELECT key, parent, type, comment, color, text, place, page_label, tags, ord, action FROM expected
  UNION ALL SELECT n.key, n.parent, n.type, n.comment, n.color, n.text, n.place, n.page_label, list_concat(['annolytics'], n.tags), n.ord, 'create'
  FROM config_places n JOIN acts a ON a.new_key = n.key AND action = 'create')"""


def _next(t: Tables, *reads: str):
    """The plan and the next snapshot; of the plan only the columns ``reads``, if any."""
    plan = _plan(t, *reads)
    keep = ["key", "parent", "type", "comment", "color", "text", "place", "page_label", "tags", "ord"]
    return plan, D.apply_plan(listing(t).select(*keep), config(t).select(*keep), plan)


@query("a09_next_snapshot", *TO_PLAN, READ_BACK, "SELECT key, parent, type, comment, color, text, place, page_label, array_to_string(tags, ',') AS tags FROM next")
def next_snapshot(t: Tables):
    return _next(t)[1].drop("ord").withColumn("tags", F.array_join("tags", ","))


@query("a10_item_json", *TO_SNAPSHOTS, r"""
SELECT key, '{"itemType":"annotation","parentItem":' || parent || ',"annotationType":"' || type || '","annotationComment":' || to_json(comment) ||
  ',"annotationColor":"' || color || '","annotationPageLabel":"' || page_label || '","annotationSortIndex":"' || printf('%05d|%06d|%05d', page, least(ord, 999999), y0) ||
  '","tags":[{"tag":"annolytics"}' || CASE WHEN len(tags) > 0 THEN ',{"tag":"topic"}' ELSE '' END || ']' ||
  CASE WHEN type IN ('highlight', 'underline') THEN ',"annotationText":' || to_json(text) ELSE '' END || '}' AS json FROM config_places""")
def item_json(t: Tables):
    rows = config(t).withColumn("sort_index", R.sort_key("page", "ord", "y0"))
    return rows.select("key", D.item_json(rows).alias("json"))


# the read-back loses some created rows and some updates
LOST = """back AS (SELECT * FROM next x WHERE NOT (action = 'create' AND ord % 7 = 0)),
seen AS (SELECT b.* REPLACE (CASE WHEN b.action = 'update' AND b.ord % 5 = 0 THEN o.comment ELSE b.comment END AS comment,
  CASE WHEN b.action = 'update' AND b.ord % 5 = 0 THEN o.color ELSE b.color END AS color, CASE WHEN b.action = 'update' AND b.ord % 5 = 0 THEN o.text ELSE b.text END AS text,
  CASE WHEN b.action = 'update' AND b.ord % 5 = 0 THEN o.page_label ELSE b.page_label END AS page_label) FROM back b LEFT JOIN places o USING (key))"""


def _read_back(t: Tables, *reads: str):
    """The plan, the next snapshot and the read-back, both with the fields that a query ``reads``: what no one reads is neither moved nor kept."""
    plan, expected = _next(t, "action", "new_key", "old_key", "fields", "tag_delta")
    expected = stored(expected.select("key", *reads, "ord"))    # read three times
    state = plan.select(F.coalesce("old_key", "new_key").alias("key"), "action")
    undone, fields = F.col("ord") % 5 == 0, [c for c in ("comment", "color", "text", "page_label") if c in reads]
    # only what a lost update takes back moves, each row does: the order number is part of the key
    was = listing(t).select("key", *[F.when(undone, F.col(c)).alias(f"w_{c}") for c in fields])
    rows = expected.join(state, "key").join(was, "key", "left").filter(~((F.col("action") == "create") & (F.col("ord") % 7 == 0)))
    lost = (F.col("action") == "update") & undone
    back = rows.withColumns({c: F.when(lost, F.col(f"w_{c}")).otherwise(F.col(c)) for c in fields})
    return plan, expected, back.select(*expected.columns)


@query("f10_record_merge", *TO_PLAN, READ_BACK, LOST, f"""landing AS (SELECT s.*, o.key IS NOT NULL AS known,
  s.comment = e.comment AND lower(s.color) = lower(e.color) AND s.text = e.text AND s.page_label = e.page_label AS landed, o.color AS o_color, o.place AS o_place, o.comment AS o_comment
  FROM seen s LEFT JOIN expected e USING (key) LEFT JOIN places o USING (key)),
merged AS (SELECT *, CASE WHEN action = 'create' THEN 'created' WHEN action = 'keep' THEN 'kept' WHEN landed THEN 'changed' ELSE 'not landed' END AS source FROM landing)""", f"""
SELECT key, source, CASE WHEN source IN ('created', 'changed') THEN lower(color) ELSE lower(o_color) END AS color,
  CASE WHEN source IN ('created', 'changed') THEN {fp('comment')} ELSE {fp('o_comment')} END AS fp_comment FROM merged""")
def record_merge(t: Tables):
    plan, expected, back = _read_back(t, "type", "comment", "color", "text", "page_label")
    return D.merge_records(back, expected, listing(t), plan, records(t), ("color", "fp_comment"))


@query("f11_verification", *TO_PLAN, READ_BACK, LOST, """
SELECT key, 'missing' AS problem FROM next WHERE action = 'create' AND key NOT IN (SELECT key FROM seen)
UNION ALL SELECT s.key, 'not landed' FROM seen s JOIN expected e USING (key) WHERE e.action = 'update' AND (s.comment <> e.comment OR lower(s.color) <> lower(e.color) OR s.text <> e.text)""")
def verification(t: Tables):
    plan, expected, back = _read_back(t, "comment", "color", "text")
    updated = expected.join(plan.filter("action = 'update'").select(F.col("old_key").alias("key")), "key", "left_semi")
    created = plan.filter("action = 'create'").select(F.col("new_key").alias("key"))
    return D.verify_write(back, created, updated)


NOTES_SQL = """notes AS (SELECT page_id AS key, page_id % 40 AS parent, page_id % 3 <> 0 AS own,
  CASE page_id % 5 WHEN 0 THEN '<h1>Reading note (v1, 2026-01-02)</h1>' WHEN 1 THEN '<h1>Summary</h1>' ELSE '<h1>Reading note ' || page_id % 7 || '</h1>' END || '<p>' || html || '</p>' AS html FROM pages),
new_notes AS (SELECT parent, CASE parent % 3 WHEN 0 THEN 'Reading' WHEN 1 THEN 'Summary' ELSE 'Other' END AS prefix, '<h1>Reading note (v3, 2026-01-05)</h1>' || CASE WHEN parent % 4 = 0
  THEN '<p>' || arg_min(html, page_id) || '</p>' ELSE '<p>new words</p>' END AS html FROM (SELECT page_id % 40 AS parent, page_id, html FROM pages WHERE page_id % 3 <> 0) p GROUP BY parent)"""


def _notes(t: Tables):
    k = F.col("page_id")
    head = (F.when(k % 5 == 0, "<h1>Reading note (v1, 2026-01-02)</h1>").when(k % 5 == 1, "<h1>Summary</h1>")
            .otherwise(F.concat(F.lit("<h1>Reading note "), (k % 7).cast("string"), F.lit("</h1>"))))
    notes = t.pages.select(k.alias("key"), (k % 40).alias("parent"), (k % 3 != 0).alias("own"), F.concat(head, F.lit("<p>"), "html", F.lit("</p>")).alias("html"))
    p = F.col("parent")
    first = t.pages.filter(k % 3 != 0).groupBy((k % 40).alias("parent")).agg(F.min_by("html", "page_id").alias("h"))
    new = first.select("parent", F.when(p % 3 == 0, "Reading").when(p % 3 == 1, "Summary").otherwise("Other").alias("prefix"), F.concat(
        F.lit("<h1>Reading note (v3, 2026-01-05)</h1><p>"), F.when(p % 4 == 0, F.col("h")).otherwise("new words"), F.lit("</p>")).alias("html"))
    return notes, new


def title_sql(e):
    return (rf"substr(trim(regexp_replace(regexp_replace(CASE WHEN regexp_matches({e}, '(?is)<h1[^>]*>.*?</h1>') THEN regexp_extract({e}, '(?is)<h1[^>]*>(.*?)</h1>', 1) ELSE {e} END, "
            r"'<[^>]+>', '', 'g'), '\s+', ' ', 'g')), 1, 200)")


def body_sql(e):
    from .text_queries import HTML_SQL
    return HTML_SQL.format(f"regexp_replace({e}, '(?is)<h1[^>]*>.*?</h1>', ' ')")


@query("f12_note_versions", NOTES_SQL, rf"""old AS (SELECT parent, own, {title_sql('html')} AS title, {body_sql('html')} AS body FROM notes),
asked AS (SELECT parent, prefix, {title_sql('html')} AS title, {body_sql('html')} AS body FROM new_notes),
counted AS (SELECT a.*, (SELECT count(*) FROM old o WHERE o.parent = a.parent AND starts_with(o.title, a.prefix)) AS n,
  EXISTS (SELECT 1 FROM old o WHERE o.parent = a.parent AND o.own AND o.body = a.body) AS skip FROM asked a)""", r"""
SELECT parent, skip, CASE WHEN n > 0 THEN regexp_replace(title, '\s*\(v\d+, \d{4}-\d{2}-\d{2}\)\s*$', '') || ' (v' || n + 1 || ', 2026-02-01)' ELSE prefix END AS new_title FROM counted""")
def note_versions(t: Tables):
    notes, new = _notes(t)
    return D.version_notes(new, notes, "2026-02-01")


@query("f13_edited_notes", NOTES_SQL, rf"""SELECT key FROM (SELECT key, own, {body_sql('html')} AS now, {body_sql("CASE WHEN key % 6 = 1 THEN html || ' more' ELSE replace(html, '<p>', '<p class=x>') END")} AS before FROM notes) n WHERE own AND now <> before""")
def edited_notes(t: Tables):
    from ..functions import text as T
    notes = _notes(t)[0].filter("own")
    then = F.when(F.col("key") % 6 == 1, F.concat("html", F.lit(" more"))).otherwise(F.replace("html", F.lit("<p>"), F.lit("<p class=x>")))
    return D.edited_notes(notes, notes.select("key", D.fingerprint(T.note_body(then)).alias("fp_body")))


@query("f14_set_operations", *TO_SNAPSHOTS, """
SELECT 'both' AS side, key FROM (SELECT key FROM listing INTERSECT SELECT key FROM records)
UNION ALL SELECT 'listing only', key FROM (SELECT key FROM listing EXCEPT SELECT key FROM records)
UNION ALL SELECT 'first of place', arg_min(key, (ord, key)) FROM places GROUP BY parent, type, place""")
def set_operations(t: Tables):
    a, b = listing(t), records(t).select("key")
    both = a.select("key").intersect(b).select(F.lit("both").alias("side"), "key")
    only = a.select("key").exceptAll(b).select(F.lit("listing only").alias("side"), "key")
    first = D.stable_distinct(a.select("parent", "type", "place", "ord", "key"), ["parent", "type", "place"], ["ord", "key"])
    return both.unionByName(only).unionByName(first.select(F.lit("first of place").alias("side"), "key"))
