"""From page lines to paragraphs, numbered sentences and a document index.

A document is one row: ``doc_id`` and ``lines``, an array of ``row_no, page, block, text, size, bold, dir_x, dir_y`` in reading
order. Every rule here looks at one document only, so each step is an expression over that array: structuring a corpus
needs no shuffle, no join and no Python, whatever its size, and a corpus dominated by one source or one group of copies
is spread like any other. What a line takes from the lines before it (its state, the last heading, its number) is looked up once
per run of lines, not per line, so that the expressions grow with the lines of a document (and the logarithm of sorting them).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from ..session import stored
from .ordered import chunk_of, group_total, ordered_scan, running_count

DEFAULT_BODY_SIZE = 10.0
EDGE_ROWS = 3
REFERENCES_MARK, CHECKLIST_MARK = "[references removed]", "[checklist removed]"
BODY, IN_REFERENCES, IN_CHECKLIST = 0, 1, 2
READ_PART_COST = 56000


def fields(r: Column, *names: str) -> list[Column]:
    return [r[n].alias(n) for n in names]


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def positions(xs: Column, test: Callable[[Column, Column], Column]) -> Column:
    """The indexes, from 0, of the elements that pass."""
    return F.array_compact(F.transform(xs, lambda x, i: F.when(test(x, i), i)))


def runs(xs: Column, starts: Column) -> Column:
    """``xs`` cut before the given indexes, in order; the first is 0, so that the runs hold every element once."""
    return F.zip_with(starts, F.slice(starts, 2, 1 << 30), lambda at, end: F.slice(xs, at + 1, F.coalesce(end, F.size(xs)) - at))


# --- rows ------------------------------------------------------------------------------------------------------------------
def left_to_right(lines: Column) -> Column:
    """Lines not written from left to right (a vertical stamp in a margin) are dropped."""
    return F.filter(lines, lambda r: (F.abs(r["dir_x"] - 1) <= 0.01) & (F.abs(r["dir_y"]) <= 0.01))


def clean_lines(lines: Column) -> Column:
    made = F.transform(left_to_right(lines), lambda r: F.struct(
        *fields(r, "row_no", "page", "block", "size", "bold"), T.collapse(r["text"]).alias("text")))
    return F.filter(made, lambda r: F.length(r["text"]) > 0)


def body_size(rows: Column) -> Column:
    """The length-weighted median font size: the first size at which half of the characters are reached."""
    weights = F.array_sort(F.transform(rows, lambda r: F.struct(r["size"].cast("double").alias("size"),
                                                                F.length(r["text"]).cast("long").alias("n"))))

    def find(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + x["n"])
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("size"))

        def add(half: Column) -> Column:
            return F.aggregate(s, start, lambda a, x: F.struct(
                (a["upto"] + x["n"]).alias("upto"),
                F.coalesce(a["size"], F.when((a["upto"] + x["n"]) * 2 >= half, x["size"])).alias("size")))["size"]
        return let(total, add)

    return F.coalesce(let(weights, find), F.lit(DEFAULT_BODY_SIZE))


def is_heading(r: Column, body: Column) -> Column:
    return (F.length(r["text"]) < 70) & ((r["size"] >= body + 0.8) | (r["bold"] & (r["size"] >= body - 0.1)))


def classify_rows(lines: Column) -> Column:
    """Cleaned rows with whether each is a heading, stands at the edge of its page, is a lone numeral, and its key."""
    def classify(rows: Column) -> Column:
        def with_body(body: Column) -> Column:
            def row(r: Column, i: Column) -> Column:
                above, below = F.get(rows, i - EDGE_ROWS), F.get(rows, i + EDGE_ROWS)
                edge = (F.coalesce(above["page"] != r["page"], F.lit(True)) | F.coalesce(below["page"] != r["page"], F.lit(True)))
                return F.struct(*fields(r, "row_no", "page", "block", "text"), is_heading(r, body).alias("heading"),
                                edge.alias("edge"), r["text"].rlike(T.PAGE_NUMBER).alias("numeral"),
                                T.norm_key(r["text"]).alias("norm"))
            return F.transform(rows, row)
        return let(body_size(rows), with_body)
    return let(clean_lines(lines), classify)


def recurring_keys(rows: Column, pages: Column) -> Column:
    """Keys at the edge of at least three pages and of more than half of the pages: in the sorted keys such a one meets
    itself half the pages further on."""
    seen = F.array_sort(F.transform(F.filter(rows, lambda r: r["edge"] & (r["norm"] != "")), lambda r: F.struct(r["norm"], r["page"])))
    keys = let(seen, lambda es: F.transform(F.filter(es, lambda e, i: (i == 0) | ~e.eqNullSafe(F.get(es, i - 1))), lambda e: e["norm"]))
    half = F.floor(pages / 2).cast("int")
    found = let(F.struct(keys.alias("k"), half.alias("h")), lambda s: F.array_distinct(
        F.filter(s["k"], lambda n, i: F.coalesce(F.get(s["k"], i + s["h"]) == n, F.lit(False)))))
    return F.when(pages >= 3, found).otherwise(_none())


def lone_numerals(rows: Column) -> Column:
    """For each row whether its block has numerals only: sorted by block, words before numerals, the first of a block tells."""
    def tell(order: Column) -> Column:
        def opens(x: Column, i: Column) -> Column:
            before = F.get(order, i - 1)
            return (i == 0) | ~(before["page"].eqNullSafe(x["page"]) & before["block"].eqNullSafe(x["block"]))
        blocks = runs(order, positions(order, opens))
        return F.flatten(F.transform(blocks, lambda b: F.transform(b, lambda x: F.struct(x["at"].alias("at"), b[0]["numeral"].alias("lone")))))

    order = F.array_sort(F.transform(rows, lambda r, i: F.struct(*fields(r, "page", "block", "numeral"), i.alias("at"))))
    return F.transform(F.array_sort(let(order, tell)), lambda x: x["lone"])


def mark_running_rows(lines: Column) -> Column:
    """Classified rows with why each would be dropped: ``is_running`` (headers and footers) and ``is_page_number``."""
    pages = F.size(F.array_distinct(F.transform(lines, lambda r: r["page"])))

    def mark(s: Column) -> Column:
        def row(r: Column, i: Column) -> Column:
            number = F.when(r["numeral"], r["edge"] | F.get(s["lone"], i)).otherwise(False)
            return F.struct(*fields(r, "row_no", "page", "block", "text", "heading", "norm"),
                            (r["edge"] & F.array_contains(s["recurring"], r["norm"])).alias("is_running"), number.alias("is_page_number"))
        return F.transform(s["rows"], row)

    return let(classify_rows(lines), lambda rows: let(
        F.struct(rows.alias("rows"), recurring_keys(rows, pages).alias("recurring"), lone_numerals(rows).alias("lone")), mark))


def drop_running_rows(lines: Column) -> Column:
    return F.filter(mark_running_rows(lines), lambda r: ~r["is_running"] & ~r["is_page_number"])


# --- bibliography and checklist: a three-state automaton over the rows that can change it ------------------------------------
FLAGGED = ("row_no", "page", "block", "text", "heading", "opens_refs", "ends_refs", "is_appendix", "is_checklist")


def _is_event(r: Column) -> Column:
    return r["opens_refs"] | r["ends_refs"] | r["is_appendix"] | r["is_checklist"]


def region_states(rows: Column, bibliography: bool = True, checklists: bool = True) -> Column:
    """Rows with the ``state`` before each: in the body, in the bibliography, in a checklist after it. A checklist counts as one
    from the first references heading on. The automaton runs over the rows that can change its state and leaves a character
    for each; the rows up to the next such row share it."""
    def flag(r: Column) -> Column:
        return F.struct(
            *fields(r, "row_no", "page", "block", "text", "heading"), r["norm"].rlike(T.REFERENCES).alias("opens_refs"),
            (r["heading"] | r["norm"].startswith("appendix") | r["norm"].startswith("supplementary")).alias("ends_refs"),
            (r["heading"] & r["norm"].rlike(T.APPENDIX)).alias("is_appendix"),
            (r["heading"] & r["norm"].rlike(T.CHECKLIST)).alias("is_checklist"))

    def after_references(flagged: Column) -> Column:
        first = F.array_position(F.transform(flagged, lambda r: r["opens_refs"]), F.lit(True))
        return let(F.struct(flagged.alias("rows"), first.alias("first")), lambda s: F.transform(s["rows"], lambda r, i: F.struct(
            *fields(r, *FLAGGED[:-1]),
            (r["is_checklist"] & (s["first"] > 0) & (i + 1 >= s["first"])).alias("is_checklist"))))

    def next_state(s: Column, r: Column) -> Column:
        checklist = r["is_checklist"] if checklists else F.lit(False)
        opens = r["opens_refs"] if bibliography else F.lit(False)
        return (F.when(s == IN_CHECKLIST, F.when(r["is_appendix"], BODY).otherwise(IN_CHECKLIST))
                .when(s == IN_REFERENCES, F.when(~r["ends_refs"], IN_REFERENCES).when(checklist, IN_CHECKLIST).otherwise(BODY))
                .when(opens, IN_REFERENCES).when(checklist, IN_CHECKLIST).otherwise(BODY))

    def step(a: Column, r: Column) -> Column:
        state = next_state(a["state"], r)
        return F.struct(state.alias("state"), F.concat(a["path"], state.cast("string")).alias("path"))

    def spread_states(rs: Column) -> Column:
        events = F.filter(rs, _is_event)
        start = F.struct(F.lit(BODY).alias("state"), F.lit(str(BODY)).alias("path"))
        states = F.split(F.aggregate(events, start, step)["path"], "")
        after_events = positions(rs, lambda r, i: (i == 0) | _is_event(F.get(rs, i - 1)))
        return F.flatten(F.zip_with(runs(rs, after_events), states, lambda run, state: F.transform(
            F.coalesce(run, F.slice(rs, 1, 0)), lambda r: F.struct(*fields(r, *FLAGGED), state.cast("int").alias("state")))))

    return let(let(F.transform(rows, flag), after_references), spread_states)


def cut_regions(rows: Column, keep_references: bool = False) -> Column:
    """Body rows with ``kind`` heading, para or marker; the bibliography and a checklist after it leave one marker each."""
    def inside(r: Column) -> Column:
        return (((r["state"] == IN_CHECKLIST) & ~r["is_appendix"]) | ((r["state"] == IN_REFERENCES) & ~r["ends_refs"]))

    def row(r: Column) -> Column:
        opens = F.lit(False) if keep_references else (r["state"] == BODY) & r["opens_refs"]
        kind = F.when(opens | r["is_checklist"], "marker").when(r["heading"], "heading").otherwise("para")
        text = F.when(opens, REFERENCES_MARK).when(r["is_checklist"], CHECKLIST_MARK).otherwise(r["text"])
        return F.struct(*fields(r, "row_no", "page", "block"), kind.alias("kind"), text.alias("text"))

    states = region_states(rows, bibliography=not keep_references)
    return F.transform(F.filter(states, lambda r: ~inside(r)), row)


# --- paragraphs and sentences --------------------------------------------------------------------------------------------
def assemble_paragraphs(rows: Column) -> Column:
    """Consecutive text rows of one block as one paragraph; a hyphen before a lower-case row joins without a space."""
    def plain(r: Column) -> Column:
        return F.struct(*fields(r, "page", "block", "kind"),
                        F.when(r["kind"] == "marker", r["text"]).otherwise(T.expand_ligatures(r["text"])).alias("text"))

    def assemble(rs: Column) -> Column:
        def follows(r: Column, i: Column) -> Column:
            b = F.get(rs, i - 1)
            return F.coalesce((r["kind"] == "para") & (b["kind"] == "para") & (b["page"] == r["page"])
                              & (b["block"] == r["block"]), F.lit(False))

        def piece(r: Column, i: Column) -> Column:
            after = F.get(rs, i + 1)
            low = r["text"].endswith("-") & after["text"].rlike(r"^\p{Ll}")
            return (F.when(after.isNull(), r["text"]).when(~follows(after, i + 1), F.concat(r["text"], F.lit(T.CUT)))
                    .when(low, F.substring(r["text"], F.lit(1), F.length(r["text"]) - 1))
                    .otherwise(F.concat(r["text"], F.lit(" "))))

        heads = F.filter(rs, lambda r, i: ~follows(r, i))
        texts = F.split(F.array_join(F.transform(rs, piece), ""), T.CUT)
        # no rows: splitting the empty text gives one piece, which has no head
        found = F.filter(F.zip_with(heads, texts, lambda h, t: F.struct(h.alias("h"), t.alias("t"))), lambda x: x["h"].isNotNull())
        return F.transform(found, lambda x, i: F.struct((i + 1).alias("para"), x["h"]["page"].alias("page"), x["h"]["kind"].alias("kind"),
                                                        T.dehyphenate(x["t"]).alias("text")))

    return let(F.transform(rows, plain), assemble)


def paragraphs(lines: Column, keep_references: bool = False) -> Column:
    return assemble_paragraphs(cut_regions(drop_running_rows(lines), keep_references))


def items(paras: Column) -> Column:
    """Sentences, headings and markers in reading order. A sentence has an ``id`` counted over the document, and the first
    one of a paragraph the last heading that stands between it and the sentence before."""
    def other(p: Column) -> Column:
        return F.struct(*fields(p, "page", "para"), F.lit(0).alias("pos"), *fields(p, "kind", "text"),
                        F.lit(None).cast("string").alias("heading_before"))

    def of_run(run: Column) -> Column:
        """A run is the headings and markers before a paragraph, and the paragraph; the last one may lack it."""
        apart = F.filter(run, lambda p: p["kind"] != "para")
        last = F.try_element_at(run, F.lit(-1))
        heading = F.try_element_at(F.filter(run, lambda p: p["kind"] == "heading"), F.lit(-1))["text"]
        sentences = F.transform(T.split_sentences(last["text"]), lambda t, i: F.struct(
            *fields(last, "page", "para"), i.alias("pos"), F.lit("sentence").alias("kind"), t.alias("text"),
            F.when(i == 0, heading).alias("heading_before")))
        others = F.transform(apart, other)
        return F.when(last["kind"] == "para", F.concat(others, sentences)).otherwise(others)

    def build(ps: Column) -> Column:
        starts = positions(ps, lambda p, i: (i == 0) | (F.get(ps, i - 1)["kind"] == "para"))
        return F.flatten(F.transform(runs(ps, starts), of_run))

    def number(xs: Column) -> Column:
        """A run starts with a heading or marker, of which k stand before run k and one more in it, but for an opening sentence."""
        def ids(s: Column) -> Column:
            return F.flatten(F.zip_with(runs(xs, s), F.transform(s, lambda at, k: at - k), lambda run, at: F.transform(run, lambda x, i: F.struct(
                F.when(x["kind"] == "sentence", at + i + apart).cast("long").alias("id"),
                *fields(x, "page", "para", "pos", "kind", "text", "heading_before")))))

        apart = F.when(F.get(xs, F.lit(0))["kind"] == "sentence", 1).otherwise(0)
        return let(positions(xs, lambda x, i: (i == 0) | (x["kind"] != "sentence")), ids)

    return let(let(paras, build), number)


def explode_sentences(docs: DataFrame, all_items: Column) -> DataFrame:
    rows = docs.select("doc_id", F.explode(F.filter(all_items, lambda x: x["kind"] == "sentence")).alias("s"))
    return rows.select("doc_id", "s.id", "s.page", "s.para", "s.text", "s.heading_before")


def number_repeats(sents: DataFrame) -> DataFrame:
    """Each sentence's place among the equal ones of its page, and how many there are. Equal keys meet by 128 bits of their SHA-256. Sentences
    and digests are made once, as a table, of which counting reads the digests only."""
    keyed = stored(sents.withColumn("__same", F.substring(F.unhex(F.sha2(T.norm_key("text"), 256)), 1, 16)))
    rows = ordered_scan(keyed, ["doc_id", "page", "__same"], ["id"], chunk_of("id"), occurrence=running_count(),
                        same_text_count=group_total(F.lit(1).cast("long")))
    return rows.select("doc_id", "page", T.norm_key("text").alias("norm"), *[c for c in rows.columns if c not in ("doc_id", "page", "__same")])


# --- the listing and its index -------------------------------------------------------------------------------------------
def listing_lines(all_items: Column) -> Column:
    """The listing an agent reads as an array of lines: page marks, ``## heading``, ``id | sentence``, a blank line between
    paragraphs. Exploded, it is written as sorted text whatever its length."""
    def build(xs: Column) -> Column:
        def lines_of(x: Column, i: Column) -> Column:
            b = F.get(xs, i - 1)
            new_page = F.coalesce(b["page"] != x["page"], F.lit(True))
            apart = F.coalesce((x["kind"] == "sentence") & (b["kind"] == "sentence") & (b["para"] != x["para"]), F.lit(False))
            mark = F.concat(F.lit("--- p."), x["page"].cast("string"), F.lit(" ---"))
            line = (F.when(x["kind"] == "sentence", F.concat_ws(" | ", x["id"].cast("string"), x["text"]))
                    .when(x["kind"] == "heading", F.concat(F.lit("## "), x["text"])).otherwise(x["text"]))
            return F.concat(F.when(new_page & (i > 0), F.array(F.lit(""))).otherwise(_none()),
                            F.when(new_page, F.array(mark)).when(apart, F.array(F.lit(""))).otherwise(_none()), F.array(line))
        return F.flatten(F.transform(xs, lines_of))
    return let(all_items, build)


def document_index(lines: Column) -> Column:
    """The line numbers, after the index itself is put before the listing, at which the main text starts and ends, the
    references start, the text after them and an appendix start."""
    def flags(line: Column, i: Column) -> Column:
        head = line.startswith("## ")
        key = F.when(head, T.norm_key(F.substring(line, 4, 1 << 30)))
        return F.struct((i + 1).alias("at"), F.regexp_extract(line, r"^--- p\.(\d+)\b", 1).alias("mark"), head.alias("head"),
                        F.when(head, key.rlike(T.REFERENCES)).otherwise(line == REFERENCES_MARK).alias("refs"),
                        F.coalesce(key.rlike(T.APPENDIX), F.lit(False)).alias("appendix"),
                        ((F.trim(line) != "") & ~line.startswith("[")).alias("words"), line.rlike(r"^\d+ \| ").alias("sentence"))

    def first(xs: Column, test) -> Column:
        return F.get(F.filter(xs, test), F.lit(0))

    def build(xs: Column) -> Column:
        refs = first(xs, lambda x: (x["mark"] == "") & x["refs"])

        def after_refs(r: Column) -> Column:
            later = F.filter(xs, lambda x: (x["mark"] == "") & (x["at"] > r["at"]))

            def locate(ls: Column) -> Column:
                after = first(ls, lambda x: F.when(r["head"], x["head"]).otherwise(x["words"]))["at"]
                appendix = first(ls, lambda x: x["appendix"])["at"]
                last = F.try_element_at(F.filter(ls, lambda x: x["sentence"]), F.lit(-1))["at"]
                shown = F.when((last >= after) & ~F.coalesce(after == appendix, F.lit(False)), after)
                page = F.try_element_at(F.filter(xs, lambda x: (x["mark"] != "") & (x["at"] < r["at"])), F.lit(-1))["mark"].cast("int")
                head = (F.lit(3) + F.when(r.isNotNull(), 2).otherwise(0) + F.when(shown.isNotNull(), 1).otherwise(0)
                        + F.when(appendix.isNotNull(), 1).otherwise(0))
                start = first(xs, lambda x: x["mark"] != "")["at"]
                return F.struct((start + head).alias("main_first"), (r["at"] + head - 1).alias("main_last"),
                                (r["at"] + head).alias("references_line"), page.alias("references_page"),
                                (shown + head).alias("after_line"), (appendix + head).alias("appendix_line"))
            return let(F.coalesce(later, F.slice(xs, 1, 0)), locate)
        return let(refs, after_refs)
    return let(F.transform(lines, flags), build)


def line_cost(line: Column) -> Column:
    """What a listing line costs a reader: its characters, its number, and two more per wide character."""
    return F.length(line) + 8 + 2 * T.count_matches(line, T.CJK)


def read_parts(lines: Column, limit: int = READ_PART_COST) -> Column:
    """Consecutive lines packed into parts ``offset, lines`` of at most ``limit`` cost; a single line may exceed it."""
    costs = F.transform(lines, lambda line, i: F.struct((i + 1).alias("at"), line_cost(line).cast("long").alias("cost")))
    start = F.struct(F.lit(0).cast("long").alias("size"), F.array(F.lit(1)).alias("starts"))

    def pack(a: Column, x: Column) -> Column:
        full = (a["size"] + x["cost"] > limit) & (x["at"] > F.try_element_at(a["starts"], F.lit(-1)))
        return F.struct(F.when(full, x["cost"]).otherwise(a["size"] + x["cost"]).alias("size"),
                        F.when(full, F.concat(a["starts"], F.array(x["at"]))).otherwise(a["starts"]).alias("starts"))

    starts = F.aggregate(costs, start, pack)["starts"]
    return let(F.struct(starts.alias("s"), F.size(lines).alias("n")), lambda z: F.transform(z["s"], lambda at, i: F.struct(
        at.alias("offset"), (F.coalesce(F.get(z["s"], i + 1), z["n"] + 1) - at).alias("lines"))))


def scanned_documents(pages: DataFrame, texts: DataFrame, images: DataFrame, max_chars: int = 10) -> DataFrame:
    """Per document its pages, those that are scans (hardly any text under an image over half of the page), and whether it
    is refused because most are."""
    chars = texts.groupBy("doc_id", "page").agg(F.sum(F.length(F.regexp_replace("text", r"(?U)\s", ""))).alias("chars"))
    width = F.greatest(F.least("x1", "width") - F.greatest("x0", F.lit(0)), F.lit(0))
    height = F.greatest(F.least("y1", "height") - F.greatest("y0", F.lit(0)), F.lit(0))
    boxes = images.join(pages, ["doc_id", "page"]).groupBy("doc_id", "page").agg(F.max(width * height).alias("covered"))
    scan = ((F.coalesce("chars", F.lit(0)) <= max_chars)
            & (F.coalesce("covered", F.lit(0)) * 2 >= F.col("width") * F.col("height")))
    return (pages.join(chars, ["doc_id", "page"], "left").join(boxes, ["doc_id", "page"], "left")
            .groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(scan).alias("scanned"))
            .withColumn("refused", F.col("scanned") * 2 > F.col("pages")))


def reference_page(lines: Column) -> Column:
    """The first page with a references or bibliography line."""
    found = F.filter(lines, lambda r: r["text"].rlike(r"(?i)^\s*(\d+\s*)?(references|bibliography)\s*$"))
    return F.array_min(F.transform(found, lambda r: r["page"]))
