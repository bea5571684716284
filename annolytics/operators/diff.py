"""Snapshots of annotations compared: what users changed, how a rewrite keeps what it can, and what a write left.

Rows of a listing: ``key, parent, type, page, color, page_label, text, comment, place, tags`` and a box; ``place`` is the
canonical text of a position.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import geometry as G
from ..functions import rules as R
from ..functions import text as T
from ..session import cut_lineage, stored
from .layout import BOX, box_pairs
from .ordered import first_rows, ordered_scan, running_count, running_max

CHANGED_AFTER = 5          # seconds between the dates of an annotation the user changed
# The fields of a rewrite that would undo each change of the user's
CLASHES = {"comment": ("comment",), "color": ("color",), "text": ("text",), "place": ("place",), "tags_removed": ("tags",)}
PRINTED = ("type", "color", "page_label", "fp_comment", "fp_text", "fp_place")
NO_TAGS = "array<string>"
PAGE = ["parent", "type", "page"]
HOT_ROWS = 1 << 20         # rows of a key's bucket from which its ranks are taken chunk by chunk
BUCKETS = 1 << 14
# a part of a page that one task serves in order: its rows, and the pairs of its distinct boxes; pages are cut along strips of so many points
PART_ROWS, PART_WORK, BAND_STRIP = 1 << 18, 1 << 22, 64.0


def fingerprint(*parts: Column | str) -> Column:
    """Sixteen hexadecimal digits over the parts; a part's length goes before it, so that parts cannot run together."""
    texts = [F.coalesce(T.col(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat(*[F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in texts])), 1, 16)


def place_text(page: Column, rects: Column, font_size: Column | None = None, rotation: Column | None = None) -> Column:
    """A position as text: its page, its boxes in tenths of a point, font size and rotation."""
    def tenth(v: Column) -> Column:
        return F.bround(v.cast("double") * 10).cast("long").cast("string")
    boxes = F.array_join(F.transform(rects, lambda r: F.concat_ws(",", *[tenth(r[c]) for c in BOX])), ";")
    rest = [F.coalesce(x.cast("string"), F.lit("")) for x in (font_size, rotation) if x is not None]
    return F.concat_ws("|", page.cast("string"), boxes, *rest)


def prints(listing: DataFrame, fields: tuple[str, ...] = PRINTED) -> DataFrame:
    """The record of annotations: type, colour, label and fingerprints of comment, text and place, or those of them in ``fields``."""
    return listing.withColumns({"color": F.lower("color")} | {f: fingerprint(f.removeprefix("fp_")) for f in fields if f.startswith("fp_")})


def user_changes(listing: DataFrame, records: DataFrame, own_tags: tuple[str, ...] = R.OWN_TAGS) -> DataFrame:
    """Annotations of the tool with what the user changed since it wrote them: ``changes`` holds field names, with ``tags``,
    ``tags_removed`` and, without a record, ``other`` when the dates are more than five seconds apart."""
    then = records.select("key", F.lit(True).alias("recorded"), F.col("tags").alias("r_tags"), *[F.col(c).alias(f"r_{c}") for c in PRINTED])
    rows = prints(listing).join(then, "key", "left")
    own = F.array(*[F.lit(x) for x in own_tags])
    tool = F.coalesce("r_tags", F.array().cast(NO_TAGS))
    added = F.array_sort(F.array_except(F.array_except("tags", own), tool))
    gone = F.array_sort(F.array_except(tool, F.col("tags")))
    fields = [F.when(F.col("recorded") & ~F.col(c).eqNullSafe(F.col(f"r_{c}")), F.lit(c.removeprefix("fp_"))) for c in PRINTED]
    other = F.when(F.col("recorded").isNull() & (F.col("modified") - F.col("added") > CHANGED_AFTER), F.lit("other"))
    changes = F.array_compact(F.array(*fields, other, F.when(F.size(added) > 0, F.lit("tags")), F.when(F.size(gone) > 0, F.lit("tags_removed"))))
    rows = rows.withColumns({"tags_added": added, "tags_gone": gone, "changes": changes})
    return rows.filter(F.size("changes") > 0)


def describe_changes(changed: DataFrame) -> DataFrame:
    """A sentence per changed annotation."""
    def has(c):
        return F.array_contains("changes", c)

    def tags(verb, c):
        return F.concat(F.lit(f"{verb} the tag"), F.when(F.size(c) > 1, "s").otherwise(""), F.lit(" "),
                        F.array_join(F.transform(c, lambda x: F.concat(F.lit("“"), x, F.lit("”"))), ", "))

    def moved(c, name):
        return F.concat(F.lit(f"changed {name} "), F.coalesce(F.col(f"r_{c}"), F.lit("none")), F.lit(" → "), F.coalesce(F.col(c), F.lit("none")))

    said = F.array_compact(F.array(
        F.when(has("tags"), tags("added", "tags_added")), F.when(has("tags_removed"), tags("removed", "tags_gone")),
        F.when(has("page_label"), moved("page_label", "the page label")), F.when(has("comment"), "changed the comment"),
        F.when(has("color"), moved("color", "the colour")), F.when(has("text"), "changed the text"),
        F.when(has("place"), "moved or resized it"), F.when(has("type"), moved("type", "its type")), F.when(has("other"), "changed it")))
    n = F.size(said)
    sentence = F.when(n < 3, F.array_join(said, " and ")).otherwise(
        F.concat(F.array_join(F.slice(said, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(said, F.lit(-1))))
    return changed.withColumn("sentence", sentence)


# --- matching new annotations with those already there ------------------------------------------------------------------------
def _pass(new: DataFrame, old: DataFrame, keys: list[str], chunk_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The n-th new row of each key paired with the n-th old one: (pairs, new rows left, old rows left). Ranks are taken chunk
    by chunk, and the pairing joins on the rank too, so any number of copies is spread."""
    def ranked(df):
        return cut_lineage(ordered_scan(df, keys, ["ord"], F.floor(F.col("ord") / chunk_rows), nth=running_count()))

    def left(df, other):
        counts = other.groupBy(*keys).agg(F.count("*").alias("others"))
        return df.join(counts, keys, "left").filter(F.col("nth") > F.coalesce("others", F.lit(0))).drop("nth", "others")

    a, b = ranked(new), ranked(old)
    pairs = a.select(*keys, "nth", "new_key").join(b.select(*keys, "nth", "old_key"), [*keys, "nth"]).select("new_key", "old_key")
    return pairs, left(a, b), left(b, a)


def _meet(rows: DataFrame, keys: list[str], name: str, words: bool) -> DataFrame:
    """Rows ``body, place, n, o, how`` with a new row ``n``, an old one ``o`` or both: free ones of a key are paired, the n-th with the
    n-th, the others stay as they are. Rows that are partitioned by some of the keys are not moved."""
    side = F.when(F.col("n").isNull(), 0).when(F.col("o").isNull(), 1).otherwise(2)
    able = reduce(and_, [F.col(k).isNotNull() for k in PAGE + keys], F.col("how").isNull())
    able = able & (F.col("body") != "") if words else able
    turn = Window.partitionBy(*PAGE, *keys, "lone", "side").orderBy(F.coalesce("n.ord", "o.ord").asc_nulls_last(), F.coalesce("n.key", "o.key"))
    rows = rows.withColumns({"side": side, "lone": F.when(~able, side)}).withColumn("nth", F.row_number().over(turn))
    rest = [F.max(c).alias(c) for c in ("body", "place") if c not in keys]
    met = rows.groupBy(*PAGE, *keys, "lone", "nth").agg(*rest, F.max("n").alias("n"), F.max("o").alias("o"), F.max("how").alias("how"))
    made = F.when(F.col("n").isNotNull() & F.col("o").isNotNull(), F.coalesce("how", F.lit(name)))
    return met.select(*PAGE, "body", "place", "n", "o", made.alias("how"))


def _meet_chunked(rows: DataFrame, steps: list[tuple], chunk_rows: int) -> DataFrame:
    """The same for keys with many copies, by ``_pass``."""
    def side(x, key):
        return cut_lineage(rows.filter(f"{x} IS NOT NULL").select(*PAGE, "body", "place", F.col(x).alias(key), F.col(f"{x}.ord").alias("ord")))

    def rows_of(df, n, o, how):
        return df.select(*PAGE, "body", "place", n.alias("n"), o.alias("o"), how.alias("how"))

    (a, b), found, none = (side("n", "new_key"), side("o", "old_key")), [], F.lit(None)
    kind, nothing = rows.schema["n"].dataType, F.lit(None).cast("string")
    for name, keys, words in steps:
        wordless = [x.filter("body = ''") for x in (a, b)] if words else []
        made, a, b = _pass(*[x.filter("body <> ''") if words else x for x in (a, b)], PAGE + keys, chunk_rows)
        found.append(made.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in PAGE], nothing.alias("body"), nothing.alias("place"),
                                 F.col("new_key").alias("n"), F.col("old_key").alias("o"), F.lit(name).alias("how")))
        if words:
            a, b = a.unionByName(wordless[0]), b.unionByName(wordless[1])
    left = [rows_of(a, F.col("new_key"), none.cast(kind), nothing), rows_of(b, none.cast(kind), F.col("old_key"), nothing)]
    return reduce(DataFrame.unionByName, found + left)


def _meet_by(rows: DataFrame, keys: list[str], steps: list[tuple], chunk_rows: int, hot_rows: int) -> DataFrame:
    """The steps, whose keys all hold ``keys``, after one shuffle by these. Keys are counted in buckets first; those of a bucket with
    more than ``hot_rows`` rows are ranked chunk by chunk, so that no key is one large task."""
    bucket = F.pmod(F.xxhash64(*PAGE, *keys), F.lit(BUCKETS))
    hot = [r.bucket for r in rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows")).filter(F.col("rows") > hot_rows).collect()]
    light = (rows.filter(~bucket.isin(hot)) if hot else rows).repartition(*PAGE, *keys)
    for name, own, words in steps:
        light = _meet(light, own, name, words)
    return light.unionByName(_meet_chunked(rows.filter(bucket.isin(hot)), steps, chunk_rows)) if hot else light


def _bands(rows: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """The boxes of ``rows`` (``fresh`` for new ones), one row each, with their ``part`` of the page: a new one begins where no box before reaches
    down to, so only boxes of one part can meet. ``work`` is what a part is to solve; parts with one side only are left out."""
    boxes = rows.groupBy(*keys, *BOX).agg(F.count("*").alias("rows"), F.max(F.col("fresh").cast("int")).alias("new"), F.max((~F.col("fresh")).cast("int")).alias("old"))
    boxes = boxes.withColumns({"low": F.least("y0", "y1"), "high": F.greatest("y0", "y1")}).withColumn("strip", F.floor(F.col("low") / BAND_STRIP))
    order = ["low", *BOX]
    boxes = ordered_scan(boxes, keys, order, "strip", reached=running_max(F.col("high"), before=True))
    boxes = ordered_scan(boxes, keys, order, "strip", part=running_count(F.col("low") > F.col("reached") + reach))
    parts = boxes.groupBy(*keys, "part").agg(F.sum("rows").alias("rows"), F.sum("new").alias("new"), F.sum("old").alias("old")).filter("new > 0 AND old > 0")
    return boxes.select(*keys, *BOX, "part").join(parts.select(*keys, "part", "rows", (F.col("new") * F.col("old")).alias("work")), [*keys, "part"])


def _served(boxes: np.ndarray, n_old: int, alike) -> Iterator[tuple[int, int]]:
    """(new, old) places of a part whose old rows come first, each side in order: each new row takes the first old one that is ``alike`` and free.
    Rows of equal boxes stand in one queue, so a row looks at the heads of the queues near it, however many copies these hold."""
    places, queue = np.unique(boxes[:n_old], axis=0, return_inverse=True)
    head, after, near = np.full(len(places), n_old), np.full(n_old, n_old), {}
    for i in range(n_old - 1, -1, -1):
        after[i], head[queue[i]] = head[queue[i]], i
    for j in range(n_old, len(boxes)):
        box = boxes[j].tobytes()
        if box not in near:
            near[box] = np.flatnonzero(alike(places, boxes[j])).astype("int32")
        if len(near[box]):
            at = near[box][head[near[box]].argmin()]
            if head[at] < n_old:
                yield j, head[at]
                head[at] = after[head[at]]


def _serve_parts(alike):
    """``_served`` over batches of rows that are sorted by part, a part at a time."""
    def pairs(part: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
        rows = pd.concat(part)
        names = rows["name"].to_numpy()
        found = list(_served(rows[BOX].to_numpy("float64"), int((~rows["fresh"]).sum()), alike))
        return names[[j for j, _ in found]], names[[i for _, i in found]]

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            made, at = [], 0
            for begin in np.flatnonzero(batch["nth"].to_numpy() == 1):
                held.append(batch.iloc[at:begin])
                if sum(map(len, held)):
                    made.append(pairs(held))
                held, at = [], begin
            held.append(batch.iloc[at:])
            if made:
                yield pd.DataFrame({name: np.concatenate([m[i] for m in made]) for i, name in enumerate(("new_key", "old_key"))})
        if sum(map(len, held)):
            yield pd.DataFrame(dict(zip(("new_key", "old_key"), pairs(held))))
    return serve


def _first_free(new: DataFrame, old: DataFrame, keys: list[str], test, alike, reach: float = 0.0, part_rows: int = PART_ROWS, part_work: int = PART_WORK) -> DataFrame:
    """(new_key, old_key): each new row in order takes the first old row, in order, that passes ``test`` with it and is free. ``alike`` is the test in
    arrays: many boxes against one.

    Pages are cut into parts between which nothing can meet. A part of at most ``part_rows`` rows and ``part_work`` pairs of distinct boxes is
    served in order by one task, without a row per candidate; larger ones, and those with a row that stands in several places, go by ``_asked``."""
    def side(df, key, fresh):
        return df.select(*keys, *BOX, F.lit(fresh).alias("fresh"), F.struct("ord", F.col(key).alias("key")).alias("row"))

    rows = cut_lineage(side(new, "new_key", True).unionByName(side(old, "old_key", False)).dropna(subset=[*keys, *BOX]))
    laid = cut_lineage(rows.join(_bands(rows, keys, reach), [*keys, *BOX]).withColumn("small", (F.col("rows") <= part_rows) & (F.col("work") <= part_work)).drop("rows", "work"))
    place = F.struct(*keys, *BOX)
    strewn = laid.groupBy("fresh", "row").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select("fresh", "row")
    apart = cut_lineage(laid.filter("NOT small").unionByName(laid.join(strewn, ["fresh", "row"], "left_semi").select(*laid.columns)).select(*keys, "part").distinct())
    turn = Window.partitionBy(*keys, "part").orderBy("fresh", "row")
    again = F.coalesce((F.lag("fresh").over(turn) == F.col("fresh")) & F.lag("row").over(turn).eqNullSafe(F.col("row")), F.lit(False))
    queued = laid.join(apart, [*keys, "part"], "left_anti").withColumns({"again": again, "nth": F.row_number().over(turn)}).filter("NOT again")
    found = queued.select("nth", "fresh", F.col("row.key").alias("name"), *BOX).mapInPandas(
        _serve_parts(alike), StructType([StructField(k, new.schema["new_key"].dataType) for k in ("new_key", "old_key")]))
    if apart.isEmpty():
        return found
    rest = cut_lineage(laid.join(apart, [*keys, "part"], "left_semi").select(*keys, *BOX, "fresh", "row.ord", "row.key"))
    return found.unionByName(_asked(rest.filter("fresh").withColumnRenamed("key", "new_key"), rest.filter("NOT fresh").withColumnRenamed("key", "old_key"), keys, test, reach))


def _asked(new: DataFrame, old: DataFrame, keys: list[str], test, reach: float) -> DataFrame:
    """The same for parts of any size.

    It is the one pairing in which no new row could have an earlier old row from a later new one, so it is found for all rows at
    once: every new row asks its first candidate, an old row holds the earliest that asks, and candidates that are held by an earlier
    row are struck off. Rounds end when no two ask for the same. Candidates come from the grid of ``box_pairs``: no page is one task."""
    a = new.select(*keys, *BOX, F.struct("ord", "new_key").alias("n"))
    b = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in BOX], F.struct("ord", "old_key").alias("o"))
    met = box_pairs(a.select(*keys, *BOX).distinct(), old.select(*keys, *BOX).distinct(), keys, test, [], reach)
    asks = cut_lineage(met.join(a, [*keys, *BOX]).join(b, [*keys, *[f"o_{c}" for c in BOX]]).select("n", "o"))
    while True:
        held = cut_lineage(asks.groupBy("n").agg(F.min("o").alias("o")).groupBy("o").agg(F.min("n").alias("holder"), F.count("*").alias("askers")))
        if held.filter("askers > 1").isEmpty():
            return held.select("holder.new_key", "o.old_key")
        asks = cut_lineage(asks.join(held, "o", "left").filter("holder IS NULL OR n <= holder").select("n", "o"))


def _over(boxes: np.ndarray, box: np.ndarray, tol: float = 2.0) -> np.ndarray:
    """``G.overlaps`` of many boxes with one."""
    shared = np.minimum(boxes[:, 2:], box[2:]) - np.maximum(boxes[:, :2], box[:2])
    return (shared > tol).all(axis=1)


def _near(tolerance: float):
    def test(a: Column, b: Column) -> Column:
        return reduce(and_, [F.abs(a[c] - b[c]) <= tolerance for c in BOX])
    return test


def match_rewrite(new: DataFrame, old: DataFrame, overlap: bool = True, chunk_rows: int = 1 << 16, tolerance: float | None = None,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """New annotations paired with at most one old one each: by text and place, by place, by text, then by overlap, within the
    document, type and page.

    A pass over an equality pairs the n-th with the n-th, which is what taking the first free one in order gives. The passes over places
    share one shuffle of both sides, the one over texts moves what they leave. With a ``tolerance`` (in points, half of one for positions
    that were rounded on their way) rows that a pass over places leaves are paired by places that near, equal ones first. Rows without
    a whole box are not near and do not overlap.
    """
    body = T.collapse(F.when(R.is_mark(), F.coalesce("text", F.lit(""))).otherwise(F.coalesce("comment", F.lit(""))))
    if tolerance is not None:
        return _match_near(*[df.select(*PAGE, "ord", F.col("key").alias(key), body.alias("body"), "place", *BOX)
                             for df, key in ((new, "new_key"), (old, "old_key"))], overlap, chunk_rows, tolerance)
    row = F.struct("ord", "key", *(BOX if overlap else []))

    def side(df, x, other):
        rows = df.select(*PAGE, body.alias("body"), "place", row.alias(x))
        return rows.withColumns({other: F.lit(None).cast(rows.schema[x].dataType), "how": F.lit(None).cast("string")})

    def made(rows):
        return rows.filter("how IS NOT NULL").select(F.col("n.key").alias("new_key"), F.col("o.key").alias("old_key"), "how")

    rows = side(new, "n", "o").unionByName(side(old, "o", "n"))
    # no place is looked at again, and the text of those only that are not paired
    unplaced = {"place": F.lit(None).cast("string"), "body": F.when(F.col("how").isNull(), F.col("body"))}
    placed = stored(_meet_by(rows, ["place"], [("text and place", ["body", "place"], True), ("place", ["place"], False)], chunk_rows, hot_rows).withColumns(unplaced))
    said = _meet_by(placed.filter("how IS NULL"), ["body"], [("text", ["body"], True)], chunk_rows, hot_rows).drop("body", "place")
    said = stored(said if overlap else said.filter("how IS NOT NULL"))
    found = made(placed).unionByName(made(said))
    if overlap:
        a, b = [said.filter(f"how IS NULL AND {x} IS NOT NULL").select(*PAGE, f"{x}.ord", F.col(f"{x}.key").alias(key), *[f"{x}.{c}" for c in BOX])
                for x, key in (("n", "new_key"), ("o", "old_key"))]
        found = found.unionByName(_first_free(a, b, PAGE, G.overlaps, _over).withColumn("how", F.lit("overlap")))
    return found


def _match_near(a: DataFrame, b: DataFrame, overlap: bool, chunk_rows: int, tolerance: float) -> DataFrame:
    """The passes with a ``tolerance``."""
    def without(df, pairs, key):
        return cut_lineage(df.join(pairs.select(key), key, "left_anti"))

    found = []
    for name, keys in (("text and place", ["body", "place"]), ("place", ["place"]), ("text", ["body"])):
        wordless = [x.filter("body = ''") for x in (a, b)] if "body" in keys else []
        made, a, b = _pass(*[x.filter("body <> ''") if wordless else x for x in (a, b)], PAGE + keys, chunk_rows)
        found.append(made.withColumn("how", F.lit(name)))
        if "place" in keys:
            made = _first_free(a, b, PAGE + [k for k in keys if k != "place"], _near(tolerance), lambda boxes, box: (np.abs(boxes - box) <= tolerance).all(axis=1), tolerance)
            a, b = without(a, made, "new_key"), without(b, made, "old_key")
            found.append(made.withColumn("how", F.lit(name)))
        if wordless:
            a, b = a.unionByName(wordless[0]), b.unionByName(wordless[1])
    if overlap:
        found.append(_first_free(cut_lineage(a), cut_lineage(b), PAGE, G.overlaps, _over).withColumn("how", F.lit("overlap")))
    return reduce(DataFrame.unionByName, found)


def tag_delta(had: Column, want: Column, now: Column) -> Column:
    """``add`` and ``remove``: the tool's wanted tags that are missing, and those it had written and no longer wants."""
    return F.struct(F.array_sort(F.array_except(want, now)).alias("add"),
                    F.array_sort(F.array_intersect(F.array_except(had, want), now)).alias("remove"))


def rewrite_plan(new: DataFrame, old: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row per new and per unpaired old annotation: ``action`` create, update, keep or remove, with the changed fields.
    Tags are the user's; a page label the user set stays."""
    def c(p, x):
        return F.col(f"{p}.{x}")

    n, o = new.alias("n"), old.alias("o")
    labels = records.select(F.col("key").alias("r_key"), F.col("page_label").alias("r_label"), F.col("tags").alias("r_tags"))
    # the record meets the old rows before they meet the new ones: both move once, by their key
    was = o.join(labels, F.col("r_key") == c("o", "key"), "left")
    rows = n.join(pairs, c("n", "key") == F.col("new_key"), "left").join(was, c("o", "key") == F.col("old_key"), "full_outer")
    none = F.array().cast(NO_TAGS)
    delta = tag_delta(F.coalesce("r_tags", none), F.coalesce(c("n", "tags"), none), F.coalesce(c("o", "tags"), none))
    user_label = F.col("r_key").isNotNull() & (F.col("r_label") != c("o", "page_label"))
    both = c("n", "key").isNotNull() & c("o", "key").isNotNull()
    changed = F.array_compact(F.array(
        F.when(F.coalesce(c("n", "comment"), F.lit("")) != F.coalesce(c("o", "comment"), F.lit("")), "comment"),
        F.when(F.lower(c("n", "color")) != F.lower(c("o", "color")), "color"),
        F.when(c("n", "type").isin(*R.MARK_TYPES) & (F.coalesce(c("n", "text"), F.lit("")) != F.coalesce(c("o", "text"), F.lit(""))), "text"),
        F.when(c("n", "place") != c("o", "place"), "place"),
        F.when((c("n", "page_label") != c("o", "page_label")) & ~user_label, "page_label"),
        F.when((F.size(delta["add"]) > 0) | (F.size(delta["remove"]) > 0), "tags")))
    fields = F.when(both, changed)
    action = (F.when(c("o", "key").isNull(), "create").when(c("n", "key").isNull(), "remove")
              .when(F.size(fields) == 0, "keep").otherwise("update"))
    return rows.select(F.coalesce(c("n", "parent"), c("o", "parent")).alias("parent"), action.alias("action"), c("n", "key").alias("new_key"),
                       c("o", "key").alias("old_key"), "how", fields.alias("fields"), F.when(both, delta).alias("tag_delta"))


def clashes(plan: DataFrame, changed: DataFrame) -> DataFrame:
    """Planned changes that would undo what the user changed: ``undo`` with the user's changes, or ``delete``."""
    rows = plan.filter("old_key IS NOT NULL").join(changed.select(F.col("key").alias("old_key"), "changes"), "old_key")
    by_field = F.array_compact(F.array(*[F.when(F.array_contains("changes", w) & F.arrays_overlap("fields", F.array(*[F.lit(f) for f in fs])), F.lit(w))
                                         for w, fs in CLASHES.items()],
                                       F.when(F.array_contains("changes", "other") & (F.size("fields") > 0), F.lit("other"))))
    undone = F.when(F.col("action") == "remove", F.col("changes")).when(F.col("action") == "update", by_field)
    rows = rows.withColumn("undone", undone).filter(F.size("undone") > 0)
    return rows.select("parent", F.col("old_key").alias("key"), F.when(F.col("action") == "remove", "delete").otherwise("undo").alias("effect"), "undone")


def foreign_cleanup(own: DataFrame, written: DataFrame, held: DataFrame, max_keys: int = 8, max_pages: int = 12) -> DataFrame:
    """Documents with annotations of the tool that a cleanup would delete though this configuration neither wrote nor holds
    them: how many, the first keys and pages named in the message."""
    other = own.join(written.select("key").distinct(), "key", "left_anti").join(held.select("key").distinct(), "key", "left_anti")
    first = (first_rows(other.select("parent", "ord", "key"), ["parent"], [F.col("ord"), F.col("key")], max_keys).groupBy("parent")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]), ", ").alias("keys")))
    pages = (other.groupBy("parent", "page").agg(F.count("*").alias("n"))
             .withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("page"))).groupBy("parent").agg(
                 F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= max_pages, F.col("page")))), ", ").alias("pages")))
    return pages.join(first, "parent")


def version_check(seen: DataFrame, current: DataFrame, planned: DataFrame) -> DataFrame:
    """Per document whether a write may go on: the planned keys are the current ones, and each seen version still stands."""
    a, b = planned.select("parent", "key", F.lit(1).alias("p")), current.select("parent", "key", F.col("version").alias("now"))
    rows = a.join(b, ["parent", "key"], "full_outer").join(seen.select("parent", "key", F.col("version").alias("then")), ["parent", "key"], "left")
    return rows.groupBy("parent").agg(
        F.count_if(F.col("p").isNull() | F.col("now").isNull()).alias("set_differs"),
        F.count_if(F.col("then").isNotNull() & F.col("now").isNotNull() & (F.col("then") != F.col("now"))).alias("version_differs")
    ).withColumn("refused", (F.col("set_differs") > 0) | (F.col("version_differs") > 0))


# --- the next snapshot, records and verification ------------------------------------------------------------------------------
FIELDS = ("comment", "color", "text", "place", "page_label")


def apply_plan(old: DataFrame, new: DataFrame, plan: DataFrame) -> DataFrame:
    """The next snapshot: kept rows as they are, updated ones with their changed fields, created ones with the tool's tag;
    removed ones are left out. Rows that are not the plan's pass through."""
    wanted = plan.filter("action IN ('update', 'remove')").select(F.col("old_key").alias("key"), "action", "fields", "new_key", "tag_delta")
    values = new.select(F.col("key").alias("new_key"), *[F.col(f).alias(f"n_{f}") for f in FIELDS])
    rows = old.join(wanted.join(values, "new_key", "left"), "key", "left").filter(F.coalesce(F.col("action") != "remove", F.lit(True)))
    set_fields = {f: F.when(F.array_contains("fields", f), F.col(f"n_{f}")).otherwise(F.col(f)) for f in FIELDS}
    tags = F.when(F.array_contains("fields", "tags"), F.array_union(F.array_except("tags", F.col("tag_delta.remove")), F.col("tag_delta.add"))).otherwise(F.col("tags"))
    kept = rows.withColumns({**set_fields, "tags": tags}).select(*old.columns)
    created = new.join(plan.filter("action = 'create'").select(F.col("new_key").alias("key")), "key", "left_semi")
    return kept.unionByName(created.withColumn("tags", own_first("tags")).select(*old.columns))


def own_first(tags: str | Column, own_tags: tuple[str, ...] = R.OWN_TAGS) -> Column:
    """The tool's tag, then the other ones."""
    own = F.array(*[F.lit(x) for x in own_tags])
    return F.concat(F.array(F.lit(own_tags[0])), F.array_except(F.coalesce(T.col(tags), F.array().cast(NO_TAGS)), own))


def item_json(rows: DataFrame) -> Column:
    """The JSON of an annotation to create."""
    tags = F.transform(own_first("tags"), lambda x: F.struct(x.alias("tag")))
    fields = [F.lit("annotation").alias("itemType"), F.col("parent").alias("parentItem"), F.col("type").alias("annotationType"),
              F.coalesce("comment", F.lit("")).alias("annotationComment"), F.col("color").alias("annotationColor"),
              F.col("page_label").alias("annotationPageLabel"), F.col("sort_index").alias("annotationSortIndex"), tags.alias("tags"),
              F.when(R.is_mark(), F.coalesce("text", F.lit(""))).alias("annotationText")]
    return F.to_json(F.struct(*fields))


def _content(p: str) -> Column:
    return F.struct(*[F.coalesce(F.col(f"{p}.{c}"), F.lit("")) for c in ("type", "comment", "text", "page_label")], F.lower(F.col(f"{p}.color")))


def merge_records(read_back: DataFrame, expected: DataFrame, old: DataFrame, plan: DataFrame, records: DataFrame,
                  fields: tuple[str, ...] = PRINTED) -> DataFrame:
    """The next record: created ones as read back, changed ones as read back when the change landed and as they were when it
    did not, kept ones as planned, the others as recorded before. ``source`` says which. It has the ``fields`` asked for; what only others
    need, as the place, the rows need not have."""
    state = plan.filter("old_key IS NOT NULL").select(F.col("old_key").alias("key"), "action")
    now, was, want = prints(read_back, fields).alias("now"), prints(old, fields).alias("was"), expected.alias("want")
    rows = (now.join(state.alias("s"), F.col("now.key") == F.col("s.key"), "left")
            .join(was, F.col("now.key") == F.col("was.key"), "left").join(want, F.col("now.key") == F.col("want.key"), "left")
            .join(records.alias("r"), F.col("now.key") == F.col("r.key"), "left"))
    landed = _content("now") == _content("want")
    unchanged = _content("now") == _content("was")
    source = (F.when(F.col("was.key").isNull(), "created").when((F.col("s.action") == "update") & landed, "changed")
              .when((F.col("s.action") == "update") & unchanged, "not landed").when(F.col("s.action") == "keep", "kept")
              .when(F.col("s.action").isNull() & F.col("r.key").isNotNull(), "untouched"))
    pick = {c: F.when(F.col("source").isin("created", "changed"), F.col(f"now.{c}")).when(F.col("source").isin("not landed", "kept"), F.col(f"was.{c}"))
            .otherwise(F.col(f"r.{c}")) for c in fields}
    return rows.withColumn("source", source).filter("source IS NOT NULL").select(F.col("now.key").alias("key"), "source", *[e.alias(c) for c, e in pick.items()])


def verify_write(read_back: DataFrame, created: DataFrame, expected: DataFrame) -> DataFrame:
    """Created keys that are missing and updates that did not land."""
    missing = created.select("key").join(read_back, "key", "left_anti").select("key", F.lit("missing").alias("problem"))
    a = read_back.select("key", F.coalesce("comment", F.lit("")).alias("c"), F.lower("color").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    b = expected.select("key", F.coalesce("comment", F.lit("")).alias("c2"), F.lower("color").alias("k2"), F.coalesce("text", F.lit("")).alias("t2"))
    wrong = a.join(b, "key").filter("c <> c2 OR k <> k2 OR t <> t2").select("key", F.lit("not landed").alias("problem"))
    return missing.unionByName(wrong)


# --- notes -----------------------------------------------------------------------------------------------------------------
def version_notes(new: DataFrame, existing: DataFrame, stamp: str) -> DataFrame:
    """New notes (``parent, prefix, html``) against the tool's notes of the parent: ``skip`` when one has the same body, else
    the title with its version when titles with the prefix exist. Existing notes are counted per parent and prefix first."""
    ex = existing.select("parent", T.note_title("html").alias("title"), T.note_body("html").alias("body"), "own")
    bodies = ex.filter("own").select("parent", "body").distinct().withColumn("same", F.lit(True))
    titles = ex.groupBy("parent", "title").agg(F.count("*").alias("n"))
    # titles meet prefixes on their first characters, cut to each length asked for, never title by title
    lengths = new.filter("prefix <> ''").select("parent", F.length("prefix").alias("len")).distinct()
    counts = (titles.join(lengths, "parent").groupBy("parent", F.expr("substring(title, 1, len)").alias("prefix"))
              .agg(F.sum("n").alias("earlier")))
    rows = new.withColumns({"title": T.note_title("html"), "body": T.note_body("html")})
    rows = rows.join(bodies, ["parent", "body"], "left").join(counts, ["parent", "prefix"], "left")
    base = F.regexp_replace("title", r"\s*\(v\d+, \d{4}-\d{2}-\d{2}\)\s*$", "")
    versioned = F.concat(base, F.lit(" (v"), (F.col("earlier") + 1).cast("string"), F.lit(f", {stamp})"))
    return rows.select("parent", F.coalesce("same", F.lit(False)).alias("skip"),
                       F.when(F.col("earlier") > 0, versioned).otherwise(F.col("prefix")).alias("new_title"))


def edited_notes(notes: DataFrame, records: DataFrame) -> DataFrame:
    """The tool's notes whose text differs from the recorded one."""
    now = notes.select("key", fingerprint(T.note_body("html")).alias("fp_body"))
    return now.join(records.select("key", F.col("fp_body").alias("then")), "key").filter("fp_body <> then").select("key")


def stable_distinct(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, pre-aggregated."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
