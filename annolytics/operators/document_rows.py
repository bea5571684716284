"""Structuring over a table of lines: the rules of ``text`` for documents of any length.

``lines`` has a row per line: ``doc_id, row_no, page, block, text, size, bold, dir_x, dir_y``. Where ``text`` takes a document as one array in one
task, here a document is cut into chunks along its row numbers, and what a line takes from the lines before it crosses chunks as one
small row each: counts and last values through ``ordered_scan``, the state of bibliography and checklists as a function. A chunk's
function says in which state it ends for each state in which it may start, and functions are composed along the chunks. So a
document that holds a third of all rows is as many tasks as it has chunks. Both forms give the same rows.

A chunk's rows are moved to one place by ``(doc_id, chunk)`` and what they take from elsewhere is put beside the chunk, not beside the row: the body size,
pages and blocks that other chunks share, recurring keys, the first state. So windows and look-ups inside a chunk move nothing, and texts move only three
times: to be classified (a Parquet table then), to be cut, and to their paragraphs (a checkpoint, with sentences split).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage, stored
from . import text as X
from .ordered import CHUNK_ROWS, by_chunks, chunk_of, histogram, last_known, ordered_scan, running_sum

# states before a row: in the body before and after the first references heading, in the bibliography, in a checklist
UNSEEN, SEEN, REFERENCES, CHECKLIST = range(4)
AT = ["doc_id", "chunk"]
FLAGS = ("opens", "ends", "appendix", "checklist")


def _cleaned(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Lines with blanks collapsed, and which are written from left to right and hold words."""
    rows = lines.select("doc_id", "row_no", "page", "block", F.col("size").cast("double").alias("size"), "bold", T.collapse(F.col("text")).alias("text"), "dir_x", "dir_y")
    return rows, (F.abs(F.col("dir_x") - 1) <= 0.01) & (F.abs("dir_y") <= 0.01) & (F.length("text") > 0)


def clean_rows(lines: DataFrame) -> DataFrame:
    """Lines written from left to right that hold words, with blanks collapsed."""
    rows, kept = _cleaned(lines)
    return rows.filter(kept).drop("dir_x", "dir_y")


def _counted(lines: DataFrame, chunk_rows: int) -> DataFrame:
    """Per chunk, page and font size how many cleaned rows there are, and their characters; pages without any have ``n`` 0."""
    rows, kept = _cleaned(lines)
    rows = rows.select("doc_id", chunk_of("row_no", chunk_rows).alias("chunk"), "page", "size", F.when(kept, F.length("text")).cast("long").alias("chars"))
    return cut_lineage(rows.groupBy(*AT, "page", "size").agg(F.count("chars").alias("n"), F.sum("chars").alias("chars")))


def _pages(counts: DataFrame) -> DataFrame:
    return counts.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.count("*").alias("pages"))


def _classified(lines: DataFrame, counts: DataFrame, chunk_rows: int) -> DataFrame:
    """Cleaned rows with their chunk, what each is (``heading``, ``edge``, ``numeral``, ``FLAGS``), and of rows at the edges of three pages or more
    128 bits of their key's SHA-256."""
    held = counts.filter("n > 0")
    half = histogram(held, ["doc_id"], F.col("size"), F.col("chars")).filter("upto * 2 >= total").groupBy("doc_id").agg(F.min("value").alias("body"))
    # pages that other chunks hold rows of
    page = Window.partitionBy("doc_id", "page")
    counted = held.groupBy(*AT, "page").agg(F.sum("n").alias("n"))
    counted = counted.withColumns({"before": F.coalesce(F.sum("n").over(page.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(page)})
    shared = counted.filter("total > n").groupBy(*AT).agg(F.collect_list(F.struct("page", "before", "total")).alias("shared"))
    facts = held.select(*AT).distinct().join(half, "doc_id", "left").join(_pages(counts), "doc_id", "left").join(shared, AT, "left")
    rows = by_chunks(clean_rows(lines).withColumn("chunk", chunk_of("row_no", chunk_rows)), *AT).join(facts, AT, "left")
    here = Window.partitionBy(*AT, "page")
    rows = rows.withColumns({"place": F.row_number().over(here.orderBy("row_no")), "on_page": F.count("*").over(here),
                             "other": F.get(F.filter("shared", lambda p: p["page"] == F.col("page")), F.lit(0))})
    known = F.when(F.col("doc_id").isNotNull() & F.col("page").isNotNull(), F.coalesce("other.total", "on_page"))
    place = F.col("place") + F.coalesce("other.before", F.lit(0))
    heading = X.is_heading(F.struct("text", "size", "bold"), F.coalesce("body", F.lit(X.DEFAULT_BODY_SIZE)))
    rows = rows.select(*AT, "row_no", "page", "block", "text", heading.alias("heading"), ((place <= X.EDGE_ROWS) | (place > known - X.EDGE_ROWS)).alias("edge"),
                       F.col("text").rlike(T.PAGE_NUMBER).alias("numeral"), (F.coalesce("pages", F.lit(0)) >= 3).alias("paged"))
    # the key is made where it is looked at: in headings, in rows that may name a part, at the edges of pages of which there are three
    rows = rows.withColumn("norm", F.when(F.col("heading") | F.col("text").rlike(T.MAY_NAME_PART) | (F.col("edge") & F.col("paged")), T.norm_key("text")).otherwise(""))
    norm, heading = F.col("norm"), F.col("heading")
    return stored(rows.select(*AT, "row_no", "page", "block", "text", "heading", "edge", "numeral", norm.rlike(T.REFERENCES).alias("opens"),
                              (heading | norm.startswith("appendix") | norm.startswith("supplementary")).alias("ends"),
                              (heading & norm.rlike(T.APPENDIX)).alias("appendix"), (heading & norm.rlike(T.CHECKLIST)).alias("checklist"),
                              F.when(F.col("edge") & F.col("paged") & (norm != ""), F.substring(F.unhex(F.sha2(norm, 256)), 1, 16)).alias("key")))


def classified_rows(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cleaned rows with their chunk, whether each is a heading, stands at the edge of its page, is a lone numeral, and its key."""
    rows = _classified(lines, _counted(lines, chunk_rows), chunk_rows)
    return rows.select("doc_id", "row_no", "chunk", "page", "block", "text", "heading", "edge", "numeral", T.norm_key("text").alias("norm"))


def _marked(lines: DataFrame, chunk_rows: int) -> DataFrame:
    """Classified rows, by chunk, with why each would be dropped. A document has fewer than twelve recurring keys, since a page has six rows at its edges,
    so they are one list; the blocks of numerals that a chunk has inside its pages are another."""
    counts, c = _counted(lines, chunk_rows), F.col
    rows = _classified(lines, counts, chunk_rows)
    keys = rows.filter("key IS NOT NULL").select("doc_id", "page", "key").repartition("doc_id", "key").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
    recurring = (keys.join(_pages(counts), "doc_id").filter((c("n") * 2 > c("pages")) & (c("pages") >= 3)).groupBy("doc_id").agg(F.collect_list("key").alias("recurring")))
    block = ["doc_id", "page", "block"]
    lone = rows.groupBy(*block).agg(F.min("numeral").alias("lone")).filter("lone").select(*block)
    inside = rows.filter("numeral AND NOT edge").select("chunk", *block).distinct()
    blocks = inside.join(lone, block).groupBy(*AT).agg(F.collect_list(F.struct("page", "block")).alias("blocks"))
    facts = cut_lineage(counts.filter("n > 0").select(*AT).distinct().join(recurring, "doc_id", "left").join(blocks, AT, "left").filter("recurring IS NOT NULL OR blocks IS NOT NULL"))
    rows = by_chunks(rows, *AT).join(facts, AT, "left")
    recurs = F.coalesce(F.array_contains("recurring", c("key")), F.lit(False))
    alone = F.coalesce(F.array_contains("blocks", F.struct("page", "block")), F.lit(False))
    return rows.select("doc_id", "row_no", "chunk", "page", "block", "text", "heading", (c("edge") & recurs).alias("is_running"),
                       (c("numeral") & (c("edge") | (~c("edge") & alone))).alias("is_page_number"), *FLAGS)


def marked_rows(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Classified rows with why each would be dropped: ``is_running`` (its key stands at the edge of over half of the pages, three at least) and
    ``is_page_number`` (a numeral at an edge, or in a block of numerals only)."""
    return _marked(lines, chunk_rows).select("doc_id", "row_no", "chunk", "page", "block", "text", "heading", T.norm_key("text").alias("norm"), "is_running", "is_page_number")


def _next(state: Column, e: Column, bibliography: bool, checklists: bool) -> Column:
    seen = (state != UNSEEN) | e["opens"]
    checklist = (e["checklist"] & seen) if checklists else F.lit(False)
    opens = e["opens"] if bibliography else F.lit(False)
    return (F.when(state == CHECKLIST, F.when(e["appendix"], SEEN).otherwise(CHECKLIST))
            .when(state == REFERENCES, F.when(~e["ends"], REFERENCES).when(checklist, CHECKLIST).otherwise(SEEN))
            .when(opens, REFERENCES).when(checklist, CHECKLIST).when(seen, SEEN).otherwise(UNSEEN))


def row_states(lines: DataFrame, bibliography: bool = True, checklists: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows that are neither running nor numbers with the ``state`` before each (``text.BODY``, ``IN_REFERENCES``, ``IN_CHECKLIST``), and whether each
    opens or ends references, is an appendix or, after the first references heading, a checklist.

    Only rows that can change the state are gathered, those of one chunk into one list. Walking it from each of the four states gives the
    chunk's function; a document's functions, one short string a chunk, are composed in order and give each chunk its first state, from
    which its list is walked once more. All other rows take the state of the last such row, or their chunk's first."""
    kept = _marked(lines, chunk_rows).filter(~F.col("is_running") & ~F.col("is_page_number"))
    event = F.expr(" OR ".join(FLAGS))
    lists = cut_lineage(kept.groupBy(*AT).agg(F.array_sort(F.collect_list(F.when(event, F.struct("row_no", *FLAGS)))).alias("events")))

    def walk(a: Column, e: Column) -> Column:
        return F.transform(a, lambda s: _next(s, e, bibliography, checklists))

    ends = F.aggregate("events", F.array(*[F.lit(s) for s in range(4)]), walk)
    functions = lists.select(*AT, F.array_join(ends.cast("array<string>"), "").alias("f"))
    # the state after each chunk, as a string of digits; the first one starts in the body
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "f")))
    path = F.aggregate("fs", F.lit(str(UNSEEN)), lambda p, x: F.concat(p, F.substring(x["f"], F.substring(p, F.length(p), F.lit(1)).cast("int") + 1, F.lit(1))))
    starts = (functions.groupBy("doc_id").agg(ordered.alias("fs")).select("doc_id", "fs", path.alias("path"))
              .select("doc_id", F.posexplode("fs").alias("i", "x"), "path").select("doc_id", "x.chunk", F.substring("path", F.col("i") + 1, F.lit(1)).cast("int").alias("start")))

    first = F.struct(F.col("start").alias("s"), F.lit("").alias("path"))
    states = F.aggregate("events", first, lambda a, e: _then(a, _next(a["s"], e, bibliography, checklists)), lambda a: a["path"])
    after = lists.join(starts, AT).select(*AT, "start", "events", states.alias("path")).select(*AT, "start", F.transform("events", lambda e, i: F.struct(
        e["row_no"].alias("row_no"), F.substring("path", i + 1, F.lit(1)).cast("int").alias("after"))).alias("turns"))
    own = F.filter("turns", lambda x: x["row_no"] == F.col("row_no"))["after"]
    rows = kept.join(after, AT, "left").withColumn("after", F.explode_outer(F.when(event, own))).drop("turns")
    earlier = Window.partitionBy(*AT).orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.last("after", ignorenulls=True).over(earlier), F.col("start"), F.lit(UNSEEN)))
    before = F.col("before")
    checklist = F.col("checklist") & ((before != UNSEEN) | F.col("opens"))
    state = F.when(before == REFERENCES, X.IN_REFERENCES).when(before == CHECKLIST, X.IN_CHECKLIST).otherwise(X.BODY)
    return rows.select("doc_id", "row_no", "chunk", "page", "block", "text", "heading", "opens", "ends", "appendix", checklist.alias("checklist"), state.alias("state"))


def _then(a: Column, state: Column) -> Column:
    return F.struct(state.alias("s"), F.concat(a["path"], state.cast("string")).alias("path"))


def cut_rows(lines: DataFrame, keep_references: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Body rows with ``kind`` heading, para or marker; the bibliography and a checklist after it leave one marker each."""
    rows, c = row_states(lines, bibliography=not keep_references, chunk_rows=chunk_rows), F.col
    inside = ((c("state") == X.IN_CHECKLIST) & ~c("appendix")) | ((c("state") == X.IN_REFERENCES) & ~c("ends"))
    opens = F.lit(False) if keep_references else (c("state") == X.BODY) & c("opens")
    kind = F.when(opens | c("checklist"), "marker").when(c("heading"), "heading").otherwise("para")
    text = F.when(opens, X.REFERENCES_MARK).when(c("checklist"), X.CHECKLIST_MARK).otherwise(c("text"))
    return rows.filter(~inside).select("doc_id", "row_no", "chunk", "page", "block", kind.alias("kind"), text.alias("text"))


def paragraph_rows(lines: DataFrame, keep_references: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, para, page, kind, text, chunk): consecutive text rows of one block as one paragraph, numbered over the document; a hyphen before
    a lower-case row joins without a space. ``chunk`` cuts the paragraphs of a document like its rows.

    Rows open paragraphs inside their chunk; whether a chunk's first row goes on with the one before, and how many paragraphs stand before it, is told by one row a chunk."""
    rows, c = cut_rows(lines, keep_references, chunk_rows), F.col

    def follows(a: str, b: str) -> Column:
        same = (c(f"{a}.kind") == "para") & (c(f"{b}.kind") == "para") & (c(f"{b}.page") == c(f"{a}.page")) & (c(f"{b}.block") == c(f"{a}.block"))
        return F.coalesce(same, F.lit(False))

    inside, across = Window.partitionBy(*AT).orderBy("row_no"), Window.partitionBy("doc_id").orderBy("chunk")
    rows = rows.withColumn("at", F.struct("kind", "page", "block"))
    rows = rows.withColumn("b", F.lag("at").over(inside)).withColumn("opens", F.when(follows("at", "b"), 0).otherwise(1))
    ends = rows.groupBy(*AT).agg(F.sum("opens").alias("opened"), F.min_by("at", "row_no").alias("first"), F.max_by("at", "row_no").alias("last"))
    ends = ends.withColumn("ended", F.lag("last").over(across)).withColumn("on", F.when(follows("first", "ended"), 1).otherwise(0))
    upto = F.coalesce(F.sum(c("opened") - c("on")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(ends.select(*AT, (upto - c("on")).alias("base")), AT, "left")
    rows = rows.withColumn("para", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("base", F.lit(0)))
    text = F.when(c("kind") == "marker", c("text")).otherwise(T.expand_ligatures(c("text")))
    rows = by_chunks(rows.select("doc_id", "para", "row_no", "page", "kind", text.alias("text"), chunk_of("para", chunk_rows).alias("chunk")), *AT)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]), T.CUT)
    joined = F.replace(F.regexp_replace(whole, rf"-{T.CUT}(?=\p{{Ll}})", ""), F.lit(T.CUT), F.lit(" "))
    made = rows.groupBy(*AT, "para").agg(F.min("page").alias("page"), F.min("kind").alias("kind"), T.dehyphenate(joined).alias("text"))
    return made.select("doc_id", c("para").cast("int").alias("para"), "page", "kind", "text", "chunk")


def _laid_out(paras: DataFrame, chunk_paras: int) -> DataFrame:
    """Paragraphs with their sentences, split once, and what they take from those before: the sentences up to there, the last heading since the last
    text, and page and kind of the last one that gives an item. Chunks that the paragraphs have are kept."""
    c = F.col
    rows = paras if "chunk" in paras.columns else by_chunks(paras.withColumn("chunk", chunk_of("para", chunk_paras)), *AT)
    split = F.when(c("kind") == "para", T.split_sentences("text")).otherwise(F.array("text"))
    rows = cut_lineage(rows.select(*AT, "para", "page", "kind", split.alias("parts")))
    spoken = F.when(c("kind") == "para", F.size("parts")).otherwise(0).cast("long")
    heading = F.when(c("kind") != "marker", F.struct(F.when(c("kind") == "heading", F.get("parts", F.lit(0))).alias("text")))
    shown = F.when(F.size("parts") > 0, F.struct("page", "kind"))
    return ordered_scan(rows, ["doc_id"], ["para"], "chunk", spoken=running_sum(spoken, before=True), above=last_known(heading, before=True), last=last_known(shown, before=True))


def item_rows(paras: DataFrame, chunk_paras: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, page, para, pos, kind, id, text, heading_before): sentences, numbered over the document, headings and markers. The first
    sentence of a paragraph has the last heading that stands between it and the text before."""
    c = F.col
    rows = _laid_out(paras, chunk_paras).select("doc_id", "page", "para", "kind", "spoken", "above", F.posexplode("parts").alias("pos", "part"))
    sentence = c("kind") == "para"
    return rows.select("doc_id", "page", "para", "pos", F.when(sentence, "sentence").otherwise(c("kind")).alias("kind"), F.when(sentence, c("spoken") + c("pos") + 1).alias("id"),
                       c("part").alias("text"), F.when(sentence & (c("pos") == 0), c("above.text")).alias("heading_before"))


def sentence_rows(paras: DataFrame, chunk_paras: int = CHUNK_ROWS) -> DataFrame:
    return item_rows(paras, chunk_paras).filter("kind = 'sentence'").select("doc_id", "id", "page", "para", "text", "heading_before")


def listing_rows(paras: DataFrame, chunk_paras: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, line_no, line): the listing an agent reads, page marks, ``## heading``, ``id | sentence``, a blank line between paragraphs."""
    c = F.col
    rows = _laid_out(paras, chunk_paras)
    new_page = F.coalesce(c("last.page") != c("page"), F.lit(True))
    apart = F.coalesce((c("kind") == "para") & (c("last.kind") == "para"), F.lit(False))
    mark = F.concat(F.lit("--- p."), c("page").cast("string"), F.lit(" ---"))
    above = F.when(new_page, F.when(c("last").isNotNull(), F.array(F.lit(""), mark)).otherwise(F.array(mark))).when(apart, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    said = F.transform("parts", lambda t, i: F.when(c("kind") == "para", F.concat_ws(" | ", (c("spoken") + i + 1).cast("string"), t))
                       .when(c("kind") == "heading", F.concat(F.lit("## "), t)).otherwise(t))
    made = rows.filter(F.size("parts") > 0).select("doc_id", "para", "chunk", F.concat(above, said).alias("lines"))
    made = ordered_scan(made, ["doc_id"], ["para"], "chunk", up=running_sum(F.size("lines").cast("long"), before=True))
    return made.select("doc_id", "up", F.posexplode("lines").alias("i", "line")).select("doc_id", (c("up") + c("i") + 1).cast("int").alias("line_no"), "line")
