"""Phrases, ids, citations and labels to their places.

A page is one row: ``doc_id, page, words`` with ``words`` an array of ``word_no, word, block, line, x0, y0, x1, y1`` in reading
order. Matching happens on the page's normalised text, the concatenation of the words' keys.
"""
from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import geometry as G
from ..functions import text as T
from ..functions.text import let
from .ordered import once
from .text import fields

MIN_ANCHOR = 8
SNAP, CLOSE = 0.95, 0.9   # the least similarity of a passage taken for a phrase, and for a sentence


def page_index(pages: DataFrame) -> DataFrame:
    """Pages with the words' keys, their offsets in the page's text, and the text. The keys of a page are made in one go; ``words`` and ``text`` are
    plain columns, so that what a query does not use is not computed."""
    sep = "\u0001"
    whole = F.split(T.norm_key(F.array_join(F.transform("raw_words", lambda w: w["word"]), sep)), sep)
    # one by one where a word is null or holds the separator
    each = F.transform("raw_words", lambda w: T.norm_key(w["word"]))
    keyed = once(pages.withColumnRenamed("words", "raw_words"), keys=let(whole, lambda ks: F.when(F.size(ks) == F.size("raw_words"), ks).otherwise(each)))
    place = let(T.sums_before(F.transform("keys", lambda k: F.length(k))), lambda at: F.transform("raw_words", lambda w, i: F.struct(
        *fields(w, "word_no", "word", "block", "line", "x0", "y0", "x1", "y1"), F.get(at, i).alias("offset"), F.length(F.get("keys", i)).alias("n"))))
    return keyed.withColumns({"words": place, "text": F.array_join("keys", "")}).drop("raw_words", "keys")


def _pieces(text: Column, key: Column) -> Column:
    return F.split(text, F.concat(F.lit("\\Q"), key, F.lit("\\E")))


def count_phrase(text: Column, key: Column) -> Column:
    """Occurrences of a key in a page's text; more than one is ambiguous."""
    return F.when(key == "", 0).otherwise(F.size(_pieces(text, key)) - 1)


def find_phrase(text: Column, key: Column, occurrence: Column) -> Column:
    """The offset of the n-th occurrence, counted without overlaps; null without one."""
    def at(p: Column) -> Column:
        before = F.slice(p, F.lit(1), F.least(occurrence, F.size(p)))
        length = F.aggregate(before, F.lit(0), lambda n, x: n + F.length(x))
        return F.when(F.size(p) > occurrence, length + (occurrence - 1) * F.length(key))
    return F.when(key != "", let(_pieces(text, key), at))


def words_in(words: Column, start: Column, end: Column) -> Column:
    return F.filter(words, lambda w: (w["offset"] < end) & (w["offset"] + w["n"] > start))


def words_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["word"]), " ")


def line_boxes(words: Column) -> Column:
    """One box per text line the words lie on, in the order of the lines."""
    lines = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.struct(w["block"].alias("block"), w["line"].alias("line")))))
    return F.transform(lines, lambda k: let(
        F.filter(words, lambda w: (w["block"] == k["block"]) & (w["line"] == k["line"])), G.union_all))


def match_phrases(intents: DataFrame, index: DataFrame) -> DataFrame:
    """Intents (``doc_id, page, phrase, occurrence``) with the place of the n-th occurrence of each on its page, its words
    and line boxes, how often the page has it, and for those without a place the ``reason``."""
    key = T.norm_key("phrase")
    found = (intents.withColumn("key", key).join(index, ["doc_id", "page"], "left"))
    found = once(found, matches=F.coalesce(count_phrase(F.col("text"), F.col("key")), F.lit(0)),
                 start=find_phrase(F.col("text"), F.col("key"), F.coalesce("occurrence", F.lit(1))))
    hit = F.when(F.col("start").isNotNull(), words_in(F.col("words"), F.col("start"), F.col("start") + F.length("key")))
    reason = (F.when(F.col("start").isNotNull(), None).when(F.col("text").isNull(), "no such page")
              .when(F.col("matches") == 0, "not found").otherwise("too few occurrences"))
    return found.withColumns({"hit": hit, "matched": let(hit, words_text), "boxes": let(hit, line_boxes), "reason": reason,
                              "ambiguous": (F.col("matches") > 1) & F.col("occurrence").isNull()}).drop("words", "text")


def find_spans(text: Column, a: Column, b: Column, max_span: int | None = None) -> Column:
    """Every occurrence of ``a`` with the next ``b`` after it, at most ``max_span`` long if that is given, as distinct ``start, stop``."""
    # the text cut before every occurrence of ``a``, also of overlapping ones
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), a, F.lit("\\E)")))
    starts = let(pieces, lambda ps: F.filter(F.transform(T.sums_before(F.transform(ps, lambda p: F.length(p))), lambda at, k: F.when(
        (k > 0) | text.startswith(a), at + 1)), lambda at: at.isNotNull()))
    spans = F.transform(starts, lambda i: let(F.call_function("locate", b, text, i + F.length(a)),
                                              lambda j: F.struct((i - 1).alias("start"), (j - 1 + F.length(b)).alias("stop"), (j > 0).alias("ok"))))
    good = F.filter(spans, lambda s: s["ok"] & (s["stop"] - s["start"] <= max_span) if max_span else s["ok"])
    return F.array_sort(F.array_distinct(F.transform(good, lambda s: F.struct(*fields(s, "start", "stop")))))


def match_spans(intents: DataFrame, index: DataFrame, max_span: int | None = None) -> DataFrame:
    """Intents (``doc_id, page, first, last, occurrence``) with the one span from ``first`` to ``last``, or why there is none."""
    rows = (intents.withColumns({"a": T.norm_key("first"), "b": T.norm_key("last")}).join(index.drop("words"), ["doc_id", "page"], "left"))
    rows = once(rows, spans=find_spans(F.col("text"), F.col("a"), F.col("b"), max_span))
    n, want = F.coalesce(F.size("spans"), F.lit(0)), F.col("occurrence")
    reason = (F.when(F.col("text").isNull(), "no such page").when((F.length("a") < MIN_ANCHOR) | (F.length("b") < MIN_ANCHOR), "anchor too short").when(n == 0, "not found")
              .when(want.isNotNull() & (n < want), "too few spans").when(want.isNull() & (n > 1), "several spans"))
    chosen = F.when(reason.isNull(), F.get("spans", F.coalesce(want, F.lit(1)) - 1))
    return rows.select("doc_id", "page", "first", "last", "occurrence", n.alias("n_spans"), reason.alias("reason"),
                       chosen["start"].alias("start"), chosen["stop"].alias("stop"))


# --- the closest passage ---------------------------------------------------------------------------------------------------
def shared_block(text: Column, key: Column) -> Column:
    """The longest block of characters that a key shares with a text, as struct(size, at, key_at), places from 0: of equally long ones
    the first in the text, and for it the first in the key. Size 0 where they share nothing.

    The size grows along the key: at each place it is raised while one more character still stands somewhere in the text, so 2 * |key| searches
    find it, all by the JVM's own substring search."""
    def longer(s: Column, _: Column) -> Column:
        fits = (s["i"] + s["n"] < F.length(key)) & F.contains(text, F.substring(key, s["i"] + 1, s["n"] + 1))
        return F.struct(F.when(fits, s["i"]).otherwise(s["i"] + 1).alias("i"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"))
    size = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), 2 * F.length(key))), zero, longer, lambda s: s["n"])

    def place(n: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - n + 1)), lambda i: F.call_function("locate", F.substring(key, i, n), text))
        return let(F.array_min(F.filter(found, lambda x: x > 0)), lambda at: F.struct(
            n.alias("size"), (at - 1).alias("at"), (F.call_function("locate", F.substring(text, at, n), key) - 1).alias("key_at")))

    return let(size, lambda n: F.when(n > 0, place(n)).otherwise(F.struct(n.alias("size"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("key_at"))))


def shares_enough(text: Column, key: Column, min_ratio: float) -> Column:
    """Whether some window of a text, no longer than the key, can be alike to ``min_ratio``: a count filter over the key's n-grams.

    A ratio of r leaves at most e = 2 (1 - r) |key| characters of window and key unmatched, and each spoils at most n of the key's |key| - n + 1
    n-grams; all others stand in the text. Eight characters are taken for ratios from 0.95 on, four below. Nothing that is alike enough
    is lost, keys too short for the filter pass it."""
    n = 8 if min_ratio >= 0.95 else 4
    size = F.length(key)
    needed = size - n + 1 - n * F.floor((2 * (1 - min_ratio) + 1e-9) * size)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.substring(key, i, F.lit(n)))
    return (needed <= 0) | (F.size(F.filter(grams, lambda g: F.contains(text, g))) >= needed)


def ratio_bound(window: Column, key: Column) -> Column:
    """A ratio that the two texts cannot exceed: characters are matched one to one, wherever they stand."""
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    letters = F.array_distinct(F.split(key, ""))
    both = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n + F.least(count(window, c), count(key, c)))
    return F.when(F.length(window) + F.length(key) > 0, 2.0 * both / (F.length(window) + F.length(key))).otherwise(0.0)


@F.pandas_udf(DoubleType())
def window_ratio(windows: pd.Series, keys: pd.Series) -> pd.Series:
    """How alike a window and a key are, null where either is: twice the characters in common blocks over all characters."""
    return pd.Series([None if w is None or k is None else difflib.SequenceMatcher(None, w, k, autojunk=False).ratio() for w, k in zip(windows, keys)], dtype="Float64")


def snapped(words: Column, start: Column, stop: Column) -> Column:
    """The bounds of the words that a stretch of a page's text touches, as struct(start, stop); null without one. ``words`` carry their
    offsets in the page's text (``page_index``)."""
    return let(F.filter(words_in(words, start, stop), lambda w: w["n"] > 0), lambda ws: F.when(F.size(ws) > 0, F.struct(
        F.array_min(F.transform(ws, lambda w: w["offset"])).alias("start"), F.array_max(F.transform(ws, lambda w: w["offset"] + w["n"])).alias("stop"))))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def laid_windows(rows: DataFrame, wanted: Column, min_ratio: float) -> DataFrame:
    """Rows (``text, key``) with ``_start`` and ``_window`` of the window of the text in which the key lies best, laid by their longest shared block;
    ``_window`` is null where not ``wanted`` or where filters by n-grams and by characters, in columns, say that it is not alike to ``min_ratio``."""
    rows = once(rows, _try=wanted & (F.length("key") > 0) & shares_enough(F.col("text"), F.col("key"), min_ratio))
    rows = once(rows, _block=F.when(F.col("_try"), shared_block(F.col("text"), F.col("key"))))
    rows = once(rows, _start=F.when(F.col("_block.size") > 0, F.greatest(F.lit(0), F.col("_block.at") - F.col("_block.key_at"))))
    rows = once(rows, _window=F.substring("text", F.col("_start") + 1, F.length("key"))).drop("_try", "_block")
    return rows.withColumn("_window", F.when(ratio_bound(F.col("_window"), F.col("key")) >= min_ratio, F.col("_window")))


def rated_windows(rows: DataFrame, min_ratio: float) -> DataFrame:
    """Laid windows with ``start``, ``window`` and ``similarity``, null where not alike to ``min_ratio``. Only windows and keys go to Python."""
    rows = rows.withColumn("similarity", window_ratio("_window", F.when(F.col("_window").isNotNull(), F.col("key"))))
    good = F.col("similarity") >= min_ratio
    return rows.withColumns({"start": F.when(good, F.col("_start")), "window": F.when(good, F.col("_window")),
                             "similarity": F.when(good, F.col("similarity"))}).drop("_start", "_window")


def with_closest_window(rows: DataFrame, wanted: Column, min_ratio: float) -> DataFrame:
    """Rows (``text, key``) with ``start``, ``window`` and ``similarity`` of the window of the text in which the key lies best, laid by their longest
    shared block; null where not ``wanted`` or not alike to ``min_ratio``. Filters by n-grams and by characters come first, in
    columns; only the windows and keys that pass, never a page's text, go to Python for the ratio."""
    return rated_windows(laid_windows(rows, wanted, min_ratio), min_ratio)


def closest_passages(intents: DataFrame, index: DataFrame, key_columns: list[str], near: bool = True, min_ratio: float = 0.0) -> DataFrame:
    """For phrases a page does not have, the most alike passage of the page, the one before or the one after it, of those that are
    alike to ``min_ratio``; the page itself wins a tie, then the one before. An intent meets at most three pages by an equi-join. Gives the page,
    the similarity, the words touched and the bounds of these in the page's text."""
    order = F.array(F.lit(0), F.lit(-1), F.lit(1)) if near else F.array(F.lit(0))
    probes = (intents.withColumn("key", T.norm_key("phrase")).select("*", F.posexplode(order).alias("try", "step"))
              .withColumns({"own_page": F.col("page"), "page": F.col("page") + F.col("step")}))
    met = with_closest_window(probes.join(index, ["doc_id", "page"]), F.lit(True), min_ratio).filter("similarity > 0")
    stop = F.col("start") + F.length("key")
    hit = words_in(F.col("words"), F.col("start"), stop)
    best = F.max_by(F.struct(F.col("page"), "similarity", words_text(hit).alias("closest"), snapped(F.col("words"), F.col("start"), stop).alias("span")),
                    F.struct(F.col("similarity"), -F.col("try")))
    return met.groupBy(*[F.col("own_page").alias("page") if c == "page" else F.col(c) for c in key_columns]).agg(best.alias("b")).select(
        *key_columns, F.col("b.page").alias("closest_page"), "b.similarity", "b.closest", F.col("b.span.start").alias("start"), F.col("b.span.stop").alias("stop"))


def snap_phrases(intents: DataFrame, index: DataFrame, min_ratio: float = SNAP, near: bool = True) -> DataFrame:
    """Intents (``doc_id, page, phrase, occurrence``) that their page does not have, with the passage taken instead: the closest one, snapped to
    the bounds of its words, where no page of the three has a closer one, no occurrence is asked for and it is alike to ``min_ratio``. ``how`` is
    snapped, elsewhere (a neighbour has it), or missed; an intent of a missing page is missed."""
    missed = match_phrases(intents, index).filter("start IS NULL").select("doc_id", "page", "phrase", "occurrence")
    close = closest_passages(missed.filter("occurrence IS NULL").select("doc_id", "page", "phrase").distinct(), index, ["doc_id", "page", "phrase"], near, min_ratio)
    m, c = missed.alias("m"), close.alias("c")
    rows = m.join(c, (F.col("m.doc_id") == F.col("c.doc_id")) & (F.col("m.page") == F.col("c.page")) & (F.col("m.phrase") == F.col("c.phrase")) & F.col("m.occurrence").isNull(), "left")
    how = F.when(F.col("c.similarity").isNull(), "missed").when(F.col("c.closest_page") == F.col("m.page"), "snapped").otherwise("elsewhere")
    mine = lambda name: F.when(F.col("c.closest_page") == F.col("m.page"), F.col(f"c.{name}")).alias(name)
    return rows.select("m.*", how.alias("how"), "c.closest_page", "c.similarity", mine("start"), mine("stop"), mine("closest"))


def place_sentences(sents: DataFrame, index: DataFrame, min_ratio: float = CLOSE) -> DataFrame:
    """Numbered sentences (with ``occurrence`` and ``same_text_count``) on their pages: the n-th occurrence when the page has the text as often
    as the sentences have it, ambiguous when not. A sentence that the page does not have takes the closest passage if that is alike
    to ``min_ratio``, snapped to the bounds of its words, and is absent otherwise or when there is no such page. On a page that the index marks as
    ``rotated`` a sentence gets no place."""
    turned = F.coalesce(F.col("rotated"), F.lit(False)) if "rotated" in index.columns else F.lit(False)
    # of a page's words only their places go with its sentences, and neither they nor its text go on to Python
    offsets, sizes = [F.transform("words", lambda w: w[c]) if "words" in index.columns else F.lit(None).cast("array<int>") for c in ("offset", "n")]  # noqa: B023
    rows = sents.join(index.select("doc_id", "page", F.col("text").alias("page_text"), offsets.alias("offset"), sizes.alias("n"), turned.alias("turned")), ["doc_id", "page"], "left")
    rows = once(rows, matches=F.coalesce(count_phrase(F.col("page_text"), F.col("norm")), F.lit(0)))
    placed = F.col("matches") == F.col("same_text_count")
    rows = rows.withColumnsRenamed({"text": "sentence", "page_text": "text", "norm": "key"})
    rows = laid_windows(rows, (F.col("matches") == 0) & ~placed & ~F.coalesce("turned", F.lit(False)) & F.col("text").isNotNull(), min_ratio)
    stop = F.col("_start") + F.length("key")
    close = F.when(F.col("_window").isNotNull(), F.coalesce(snapped(F.arrays_zip("offset", "n"), F.col("_start"), stop), F.struct(F.col("_start").alias("start"), stop.alias("stop"))))
    first = find_phrase(F.col("text"), F.col("key"), F.col("occurrence").cast("int"))
    rows = once(rows, _close=close, _first=F.when(placed, first)).drop("offset", "n", "text")
    rows = rated_windows(rows, min_ratio)
    how = (F.when(F.coalesce("turned", F.lit(False)), "rotated").when(placed, "placed").when(F.col("matches") > 0, "ambiguous")
           .when(F.col("similarity").isNotNull(), "closest").otherwise("absent"))
    rows = once(rows, how=how)
    rows = once(rows, span=F.when(F.col("how") == "placed", F.struct(F.col("_first").alias("start"), (F.col("_first") + F.length("key")).alias("stop")))
                .when(F.col("how") == "closest", F.col("_close")))
    return rows.select("doc_id", "page", "id", F.col("sentence").alias("text"), "how", "matches", F.col("span.start").alias("start"), F.col("span.stop").alias("stop"),
                       "similarity")


# --- ids, citations, labels, papers -----------------------------------------------------------------------------------------
ID_CHUNK = 64


def _turns(block: Column, upto: Column) -> Column:
    """How often the page changes along the first ``upto`` sentences of a block; one whose rows name several pages is a change too."""
    at = lambda k: F.element_at(block, k)
    return F.when(upto < 2, 0).otherwise(F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), upto)), lambda k: (
        at(k - 1)["to_page"] != at(k)["page"]) | (at(k)["page"] != at(k)["to_page"]))))


def resolve_ids(intents: DataFrame, sents: DataFrame, keys: list[str], width: int = ID_CHUNK) -> DataFrame:
    """Intents naming sentence ids (``first, last``) with the sentences' page and text, or why they do not resolve.

    Sentences lie in blocks of ``width`` ids; one small row per block carries how many sentences and changes of page its document has
    before it. A range is judged by its two ends alone: it is whole where as many sentences lie between them as ids, and on one page
    where no change does. No row is made per id and citation. Only ranges that resolve, each once however often it is cited, meet the blocks of
    their texts. Rows that repeat an id give its texts one after the other; rows without an id or a page count as missing."""
    blocks = (sents.filter("id IS NOT NULL AND page IS NOT NULL").select("doc_id", "id", "page", "text", F.floor(F.col("id") / width).alias("chunk"))
              .repartition("doc_id", "chunk").groupBy("doc_id", "chunk", "id")
              .agg(F.min("page").alias("page"), F.max("page").alias("to_page"), F.sort_array(F.collect_list("text")).alias("texts"))
              .groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "page", "to_page", "texts"))).alias("block")))
    block, order = F.col("block"), Window.partitionBy("doc_id").orderBy("chunk")
    head, tail = F.element_at("block", 1), F.element_at("block", -1)
    sums = blocks.select("doc_id", "chunk", F.size("block").alias("n"), _turns(block, F.size("block")).alias("inside"), head["page"].alias("from"),
                         (head["page"] != head["to_page"]).alias("torn"), tail["to_page"].alias("to"))
    opens = F.when(F.col("torn") | (F.lag("to").over(order) != F.col("from")), 1).otherwise(0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("opens", opens).select("doc_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), (
        F.coalesce(F.sum("inside").over(before), F.lit(0)) + F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("turns_before"))

    ranges = intents.filter("first <= last").select("doc_id", "first", "last").distinct()
    ends = ranges.select("*", F.explode(F.array_distinct(F.array("first", "last"))).alias("id")).withColumn("chunk", F.floor(F.col("id") / width))
    met = once(ends.join(blocks, ["doc_id", "chunk"]), i=F.array_position(F.transform("block", lambda x: x["id"]), F.col("id")).cast("int")).filter("i > 0")
    own = F.element_at("block", F.col("i"))
    met = met.select("doc_id", "chunk", "first", "last", "id", "i", _turns(block, F.col("i")).alias("turns"), own["page"].alias("page"), (own["page"] != own["to_page"]).alias("torn"))
    met = met.join(sums, ["doc_id", "chunk"])
    end = F.struct("page", "torn", (F.col("n_before") + F.col("i")).alias("n"), (F.col("turns_before") + F.col("turns")).alias("turns"))
    judged = (met.groupBy("doc_id", "first", "last").agg(F.max(F.when(F.col("id") == F.col("first"), end)).alias("a"), F.max(F.when(F.col("id") == F.col("last"), end)).alias("b"))
              .filter("b.n - a.n = last - first")
              .select("doc_id", "first", "last", "a.page", (F.col("a.torn") | (F.col("a.turns") != F.col("b.turns"))).alias("several")))
    parts = (judged.filter(~F.col("several")).select("doc_id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("chunk"))
             .join(blocks, ["doc_id", "chunk"])
             .withColumn("texts", F.flatten(F.transform(F.filter("block", lambda x: x["id"].between(F.col("first"), F.col("last"))), lambda x: x["texts"]))))
    texts = parts.groupBy("doc_id", "first", "last").agg(F.array_join(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk", "texts"))), lambda x: x["texts"])), " ").alias("text"))
    found = judged.join(texts, ["doc_id", "first", "last"], "left")
    reason = (F.when(~F.coalesce(F.col("first") <= F.col("last"), F.lit(False)), "broken range")
              .when(F.col("several").isNull(), "unknown id").when(F.col("several"), "several pages"))
    return intents.select(*dict.fromkeys([*keys, "doc_id", "first", "last"])).join(found, ["doc_id", "first", "last"], "left").select(
        *keys, "first", "last", reason.alias("reason"), F.when(reason.isNull(), F.col("page")).alias("page"), F.when(reason.isNull(), F.col("text")).alias("text"))


def resolve_citations(answers: DataFrame, sents: DataFrame, keys: list[str]) -> DataFrame:
    """Citations ``[#id]`` of answers as chips: neighbours of one page are one chip, an unknown id stays text. ``answers`` has
    the keys, ``doc_id`` and ``text``."""
    runs = answers.select(*keys, "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"((?:\[#\d{1,18}\]\s*)+)"), 1)).alias("run", "r"))
    cited = runs.select(*keys, "doc_id", "run", F.posexplode(F.regexp_extract_all("r", F.lit(r"\[#(\d{1,18})\]"), 1)).alias("pos", "id"))
    cited = cited.withColumn("id", F.col("id").cast("long"))
    met = cited.join(sents.select("doc_id", "id", "page"), ["doc_id", "id"], "left")
    # a run is a few characters of one answer
    row = F.array_sort(F.collect_list(F.struct("pos", "id", "page")))

    def opens(xs):
        return lambda x, i: F.coalesce(F.get(xs, i - 1)["page"] != x["page"], F.lit(True))

    def chips(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, i: F.when(opens(xs)(x, i), i)), lambda i: i.isNotNull())
        return let(starts, lambda st: F.transform(st, lambda at, k: let(
            F.slice(xs, at + 1, F.coalesce(F.get(st, k + 1), F.size(xs)) - at), lambda part: F.struct(
                (k + 1).alias("chip"), part[0]["page"].alias("page"),
                F.array_join(F.transform(part, lambda x: x["id"].cast("string")), ",").alias("ids")))))

    return (met.groupBy(*keys, "run").agg(row.alias("xs")).filter(F.exists("xs", lambda x: x["page"].isNotNull()))
            .select(*keys, "run", F.inline(let(F.col("xs"), chips))))


def look_up_labels(requests: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """Requests (``doc_id, kind, number`` and perhaps ``page``) with the one figure each names, or why there is not one."""
    f = figures.groupBy("doc_id", "kind", "number", F.col("page").alias("f_page")).agg(F.count("*").alias("n"))
    met = requests.join(f, ["doc_id", "kind", "number"], "left").withColumn(
        "meets", F.col("f_page").isNotNull() & (F.col("page").isNull() | (F.col("page") == F.col("f_page"))))
    per = met.groupBy(*keys, "doc_id", "kind", "number", "page").agg(
        F.sum(F.when(F.col("meets"), F.col("n")).otherwise(0)).alias("hits"), F.count_if("meets").alias("pages"),
        F.min(F.when(F.col("meets"), F.col("f_page"))).alias("found_page"))
    reason = (F.when(F.col("hits") == 0, "not found").when(F.col("pages") > 1, "several pages")
              .when(F.col("hits") > 1, "several on a page"))
    return per.select(*keys, "doc_id", "kind", "number", "page", reason.alias("reason"),
                      F.when(reason.isNull(), F.col("found_page")).alias("found_page"))


def resolve_papers(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Requested keys (``key``) with their item and how many PDFs and notes it has. Children are counted per parent before
    the join, so a parent with most of all children meets its requests as one row."""
    children = items.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("item")).agg(
        F.count_if((F.col("item_type") == "attachment") & (F.col("content_type") == "application/pdf")).alias("pdfs"),
        F.count_if(F.col("item_type") == "note").alias("notes"))
    own = items.select("key", "item_type", "parent")
    found = requests.join(own, "key", "left").withColumn(
        "item", F.when(F.col("item_type") == "attachment", F.col("parent")).otherwise(F.when(F.col("item_type").isNotNull(), F.col("key"))))
    return found.join(children, "item", "left").select(
        "key", "item", F.coalesce("pdfs", F.lit(0)).alias("pdfs"), F.coalesce("notes", F.lit(0)).alias("notes"))


PREFIX, CUT_LENGTH = 75, 76


def listed_as(texts: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Full texts (``body``) with the first listed one (``listed``, ``listed_key``, ``ord``) that is the text or, cut at about
    80 characters, begins it. Equal texts meet on the text; longer ones on their first characters, where the listed side
    is one row per distinct text."""
    known = listed.groupBy(*keys, "listed").agg(F.min(F.struct("ord", "listed_key")).alias("first"))
    exact = texts.join(known, (texts["body"] == known["listed"]) & _same(texts, known, keys), "left").select(
        texts["*"], F.col("first").alias("exact"))
    long = known.filter(F.length("listed") >= CUT_LENGTH).withColumn("prefix", F.substring("listed", 1, PREFIX))
    probe = (texts.filter(F.length("body") >= PREFIX).withColumn("prefix", F.substring("body", 1, PREFIX))
             .join(long, [*keys, "prefix"]).filter(F.col("body").startswith(F.expr("substring(listed, 1, length(listed) - 1)")))
             .groupBy("key").agg(F.min("first").alias("begun")))
    best = F.least(F.col("exact"), F.col("begun"))
    return (exact.join(probe, "key", "left").withColumn("best", best)
            .select(*texts.columns, F.col("best.listed_key").alias("listed_key")))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def shift_boxes(boxes: DataFrame, dims: DataFrame, to_stored: bool = True) -> DataFrame:
    """Boxes moved between page space and stored space by their page's offset, rounded to two digits half-even."""
    sign = 1 if to_stored else -1
    moved = boxes.join(dims.select("doc_id", "page", "dx", "dy"), ["doc_id", "page"])
    return moved.withColumn("rects", F.transform("rects", lambda r: F.struct(
        F.bround(r["x0"] + sign * F.col("dx"), 2).alias("x0"), F.bround(r["y0"] + sign * F.col("dy"), 2).alias("y0"),
        F.bround(r["x1"] + sign * F.col("dx"), 2).alias("x1"), F.bround(r["y1"] + sign * F.col("dy"), 2).alias("y1")))).drop("dx", "dy")


def to_page_space(x0, y0, x1, y1, height) -> Column:
    """A box of stored space (y upward) with its origin at the top left, and back."""
    return G.box(x0, height - y1, x1, height - y0)
