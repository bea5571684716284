"""Profiles of libraries and papers: distributions, medians, habits, samples and status."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from .ordered import first_rows, group_total, ordered_scan, running_count, upper_median

# Style patterns and thresholds of the habits
LABEL_START = r"^[^：:\n]{1,10}[：:]"
LIST_LINE = r"(^|\n)\s*(\d+[.、)]|[-•*])\s"
HAN = f"[{T.HAN_RANGE}]"
TOP_EDGE, CENTRE, BAND_WIDTH = 670, 300, 250
MIN_SHARE, MIN_COLOURS, HABIT = 0.03, 2, 0.05
VENUE_FIELDS = ("publication_title", "proceedings_title", "conference_name", "book_title", "university", "repository", "publisher")
MAX_AUTHORS = 12


def share(part: Column, whole: Column, digits: int) -> Column:
    return F.bround(part / F.greatest(whole, F.lit(1)), digits)


def has_comment() -> Column:
    return F.trim(F.coalesce("comment", F.lit(""))) != ""


def counts(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations by type and colour, the tool's and others'."""
    return annotations.groupBy(*keys, "own", "type", F.coalesce("color", F.lit("")).alias("color")).agg(F.count("*").alias("n"))


def counts_by_type(annotations: DataFrame, keys: list[str], types: list[str]) -> DataFrame:
    return annotations.groupBy(*keys).pivot("type", types).agg(F.count(F.lit(1))).na.fill(0)


def library_profile(annotations: DataFrame, key: str) -> DataFrame:
    """Shares of types, rates and medians per library, from one aggregate and three histograms. Without own annotations."""
    own = annotations.filter("NOT own")
    n, commented = F.count("*"), F.count_if(has_comment())

    def of(kind):
        return F.count_if(F.col("type") == kind)
    facts = own.groupBy(key).agg(
        n.alias("annotations"), *[share(of(k), n, 3).alias(f"share_{k}") for k in ("highlight", "underline", "text", "note")],
        (of("underline") / n > HABIT).alias("uses_underline"), (of("text") / n > HABIT).alias("uses_margin_text"),
        (of("note") / n > HABIT).alias("uses_sticky_notes"), share(commented, n, 2).alias("comment_rate"),
        share(F.count_if(has_comment() & F.col("comment").rlike(LABEL_START)), commented, 2).alias("label_colon_rate"),
        share(F.count_if(has_comment() & F.col("comment").rlike(LIST_LINE)), commented, 2).alias("list_rate"),
        share(F.count_if(has_comment() & F.col("comment").contains("\n")), commented, 2).alias("multiline_rate"))
    lengths = upper_median(own.filter(has_comment()), [key], F.length("comment"), "comment_len_median")
    papers = own.groupBy(key, "parent").agg(F.count("*").alias("per_paper"))
    per_paper = upper_median(papers, [key], F.col("per_paper"), "per_paper_median")
    annotated = papers.groupBy(key).agg(F.count("*").alias("papers"))
    return (facts.join(lengths, key, "left").join(per_paper, key, "left").join(annotated, key, "left")
            .withColumn("comment_len_median", F.coalesce("comment_len_median", F.lit(0))))


def language_vote(annotations: DataFrame, key: str, limit: float = 0.3) -> DataFrame:
    """zh where the median share of Han characters in comments is over the limit, else en."""
    rows = annotations.filter(has_comment())
    ratio = T.count_matches("comment", HAN) / F.length("comment")
    return upper_median(rows, [key], F.bround(ratio, 6), "ratio").select(key, F.when(F.col("ratio") > limit, "zh").otherwise("en").alias("language"))


def colour_profile(annotations: DataFrame, key: str) -> DataFrame:
    """Colours by descending count, first seen first on a tie, up to the first one under three percent after two are kept;
    with its comment rate and median comment length."""
    own = annotations.filter("NOT own")
    per = own.groupBy(key, "color").agg(F.count("*").alias("n"), F.min("ord").alias("seen"), F.count_if(has_comment()).alias("commented"))
    whole = Window.partitionBy(key)
    ranked = Window.partitionBy(key).orderBy(F.desc("n"), "seen")
    rows = per.withColumns({"total": F.sum("n").over(whole), "rank": F.row_number().over(ranked)})
    small = (F.col("n") / F.col("total") < MIN_SHARE) & (F.col("rank") > MIN_COLOURS)
    rows = rows.withColumn("cut", F.max(small).over(ranked.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("cut"))
    medians = upper_median(own.filter(has_comment()), [key, "color"], F.length(F.trim("comment")), "comment_len_median")
    return rows.join(medians, [key, "color"], "left").select(
        key, "color", "rank", F.col("n").alias("count"), F.bround(F.col("n") / F.col("total"), 3).alias("share"),
        F.bround(F.col("commented") / F.col("n"), 2).alias("comment_rate"), F.coalesce("comment_len_median", F.lit(0)).alias("comment_len_median"))


def colour_samples(annotations: DataFrame, key: str, comments: int = 4, texts: int = 3) -> DataFrame:
    """The first comments and texts of each colour, one row each."""
    own = annotations.filter("NOT own")
    c = own.filter(has_comment()).select(key, "color", "ord", F.lit("comment").alias("what"), F.substring(
        F.regexp_replace(F.trim("comment"), r"\s*\n\s*", " / "), 1, 80).alias("sample"))
    x = own.filter(F.coalesce("text", F.lit("")) != "").select(key, "color", "ord", F.lit("text").alias("what"), F.substring("text", 1, 80).alias("sample"))
    few = first_rows(c.unionByName(x), [key, "color", "what"], [F.col("ord"), F.col("sample")], max(comments, texts))
    return few.filter((F.col("what") == "comment") & (F.col("rank") <= comments) | (F.col("what") == "text") & (F.col("rank") <= texts)).drop("ord")


def placement_habits(annotations: DataFrame, key: str) -> DataFrame:
    """Where users put text boxes and notes, from the first box of each: the share of bands at the top of a page, the margin
    most narrow ones stand in, and the median font size."""
    rows = annotations.filter(~F.col("own") & F.col("type").isin("text", "note"))
    width = F.col("x1") - F.col("x0")
    votes, left = F.count_if(width < BAND_WIDTH), F.count_if((width < BAND_WIDTH) & ((F.col("x0") + F.col("x1")) / 2 < CENTRE))
    texts = F.count_if(F.col("type") == "text")
    top = F.count_if((F.col("type") == "text") & (F.col("y1") >= TOP_EDGE) & (width >= BAND_WIDTH))
    ratio = left / F.greatest(votes, F.lit(1))
    side = (F.when((votes < 3) | ((ratio > 0.25) & (ratio < 0.75)), "mixed").when(ratio >= 0.75, "left").otherwise("right"))
    facts = rows.groupBy(key).agg(share(top, texts, 2).alias("page_top_notes"), side.alias("margin_side"))
    sizes = upper_median(rows.filter("type = 'text' AND font_size IS NOT NULL"), [key], F.col("font_size").cast("double"), "font_size_median")
    return facts.join(sizes, key, "left")


def note_statistics(notes: DataFrame, key: str) -> DataFrame:
    """Child notes without imported stubs: how many, how many long ones, the median length."""
    rows = notes.withColumn("plain", T.collapse(F.regexp_replace("html", r"<[^>]+>", " ")))
    rows = rows.filter(~(F.col("plain").startswith("Comment:") & (F.length("plain") < 120)))
    facts = rows.groupBy(key).agg(F.count("*").alias("notes"), F.count_if(F.length("plain") >= 300).alias("long_notes"))
    return facts.join(upper_median(rows, [key], F.length("plain"), "len_median"), key)


# --- samples ---------------------------------------------------------------------------------------------------------------
def spread_sample(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, k: int) -> DataFrame:
    """``k`` rows of each key: the first, the last and evenly between, at round(i (n - 1) / (k - 1)) half-even."""
    ranked = ordered_scan(rows, keys, order, chunk, rn=running_count(), n=group_total(F.lit(1).cast("long")))
    if k < 2:
        return ranked.filter(F.col("rn") <= k).drop("n", "rn")
    wanted = F.array(*[F.bround(F.lit(i) * (F.col("n") - 1) / F.lit(k - 1)).cast("long") for i in range(k)])
    return ranked.filter((F.col("n") <= k) | F.array_contains(wanted, F.col("rn") - 1)).drop("n", "rn")


def recent_papers(annotations: DataFrame, exclude: DataFrame, top: int) -> DataFrame:
    """The papers whose own annotations changed last, without the excluded ones."""
    latest = annotations.filter("own").groupBy("parent").agg(F.max("modified").alias("modified"))
    return latest.join(exclude.select("parent"), "parent", "left_anti").orderBy(F.desc("modified"), "parent").limit(top)


def paper_samples(annotations: DataFrame, per_kind: int) -> DataFrame:
    """A few own highlights with comments and a few margin texts of each paper, evenly spread in reading order."""
    kind = F.when(R.is_mark() & (F.coalesce("comment", F.lit("")) != ""), "highlight").when(F.col("type").isin("text", "note"), "text")
    rows = annotations.filter("own").withColumn("kind", kind).filter("kind IS NOT NULL")
    few = spread_sample(rows, ["parent", "kind"], ["page", "y0", "ord", "key"], F.col("page").cast("long"), per_kind)
    return few.select("parent", "kind", "key", "page", F.when(F.col("kind") == "highlight", F.substring("text", 1, 160)).alias("text"),
                      F.substring("comment", 1, 240).alias("comment"))


def latest_notes(notes: DataFrame, n_chars: int = 700) -> DataFrame:
    """The start of the newest own note of each paper."""
    plain = T.collapse(F.regexp_replace("html", r"<[^>]+>", " "))
    return (notes.filter("own").groupBy("parent").agg(F.max_by("html", F.struct("modified", "key")).alias("html"))
            .select("parent", F.substring(plain, 1, n_chars).alias("note_start")))


# --- status ----------------------------------------------------------------------------------------------------------------
def citation(items: DataFrame) -> DataFrame:
    """What a citation line needs: title, year, the first twelve authors and the first venue given."""
    def name(c):
        return F.coalesce(F.when(c["name"] != "", c["name"]), F.concat_ws(" ", F.when(c["first"] != "", c["first"]), F.when(c["last"] != "", c["last"])))
    people = F.transform(F.filter("creators", lambda c: F.coalesce(c["type"], F.lit("author")) == "author"), name)
    more = F.when(F.size(people) > MAX_AUTHORS, F.array(F.concat(F.lit("… "), (F.size(people) - MAX_AUTHORS).cast("string"), F.lit(" more")))
                  ).otherwise(F.array().cast("array<string>"))
    venue = F.coalesce(*[F.when(F.col(f) != "", F.col(f)) for f in VENUE_FIELDS if f in items.columns], F.lit(""))
    return items.select("key", F.substring("title", 1, 200).alias("title"), F.substring("date", 1, 4).alias("year"),
                        F.concat(F.slice(people, 1, MAX_AUTHORS), more).alias("authors"), venue.alias("venue"))


def paper_status(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each PDF with its paper and how many annotations of the tool and of others it holds."""
    pdfs = items.filter("item_type = 'attachment' AND content_type = 'application/pdf'").select("key", "parent")
    per = annotations.groupBy(F.col("parent").alias("key")).agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("others"))
    return pdfs.join(per, "key", "left").select("key", "parent", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("others", F.lit(0)).alias("others"))


def note_list(notes: DataFrame) -> DataFrame:
    return notes.select("key", "parent", T.note_title("html").alias("title"), "own",
                        F.length(T.collapse(F.regexp_replace("html", r"<[^>]+>", " "))).alias("characters"))


def title_search(items: DataFrame, words: str, top: int = 10) -> DataFrame:
    test = F.lit(True)
    for w in words.lower().split():
        test = test & F.contains(F.lower("title"), F.lit(w))
    return items.filter(test).orderBy("key").limit(top).select("key", F.substring("title", 1, 150).alias("title"))


def annotation_card(annotations: DataFrame, notes: DataFrame, core_color: str = "#ff6666") -> DataFrame:
    """The numbers a paper's card shows: highlights, core ones, margin notes, sticky notes, areas, reading notes."""
    def of(*kinds):
        return F.count_if(F.col("type").isin(*kinds))
    card = annotations.filter("own").groupBy("parent").agg(
        of(*R.MARK_TYPES).alias("highlights"), F.count_if(R.is_mark() & (F.lower("color") == core_color)).alias("core"),
        of("text").alias("margin"), of("note").alias("notes"), of("image").alias("areas"))
    reading = notes.filter("own").groupBy("parent").agg(F.count("*").alias("reading_notes"))
    return card.join(reading, "parent", "left").withColumn("reading_notes", F.coalesce("reading_notes", F.lit(0)))


def highlight_facts(annotations: DataFrame, reference_pages: DataFrame, core_color: str = "#ff6666") -> DataFrame:
    """Per paper: highlights, core ones, pages with them, those from the references on, empty comments, mean comment length."""
    hl = annotations.filter(R.is_mark()).join(reference_pages, "parent", "left")
    after = F.count_if(F.col("page") >= F.col("reference_page"))
    return hl.groupBy("parent").agg(
        F.count("*").alias("highlights"), F.count_if(F.lower("color") == core_color).alias("core"), F.count_distinct("page").alias("pages"),
        after.alias("after_references"), F.bround(F.when(F.max("reference_page").isNotNull(), after / F.count("*")), 3).alias("share_after"),
        F.count_if(~has_comment()).alias("empty"), F.bround(F.avg(F.length(F.coalesce("comment", F.lit("")))), 1).alias("comment_chars_mean"))


def highlights_per_page(annotations: DataFrame) -> DataFrame:
    return annotations.filter(R.is_mark()).groupBy("parent", "page").agg(F.count("*").alias("n"))


def note_facts(notes: DataFrame, cited: str = "") -> DataFrame:
    """Characters, paragraphs and headings of notes, and whether a note has a title and names its source."""
    body = T.html_text("html")
    return notes.select("key", F.length(body).alias("chars"), T.count_matches("html", r"(?i)<p[\s>]").alias("paragraphs"),
                        T.count_matches("html", r"(?i)<h[1-6][\s>]").alias("headings"), F.col("html").rlike(r"(?i)<h1[\s>]").alias("has_title"),
                        (F.contains(F.lower(body), F.lit(cited.lower())) if cited else F.lit(False)).alias("cites_source"))


def distinct_counts(annotations: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    """Distinct pages, colours and papers per key."""
    n = F.approx_count_distinct if approximate else F.count_distinct
    return annotations.groupBy(key).agg(n("page").alias("pages"), n("color").alias("colors"), n("parent").alias("papers"))


def with_grand_total(rows: DataFrame, key: str, additive: list[str]) -> DataFrame:
    """One row per key and one total row (null key), with the additive columns only."""
    return rows.rollup(key).agg(*[F.sum(c).alias(c) for c in additive])
