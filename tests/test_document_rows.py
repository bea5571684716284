"""Structuring over a table of lines equals structuring of whole documents, wherever chunks are cut."""
import os
import random

import pytest
from pyspark.sql import functions as F

from annolytics.operators import document_rows as D
from annolytics.operators import text as X
from annolytics.session import checkpoint_dir

LINE = "doc_id long, row_no long, page int, block int, text string, size double, bold boolean, dir_x double, dir_y double"
PARTS = ["1 References", "References", "Bibliography:", "A. Paper Checklist", "Reproducibility checklist", "B Appendix", "Supplementary notes", "appendix text goes on", "Short heading",
         "A sentence ends. Another begins", "and goes on with a hy-", "phen at the end.", "Running Header", "12", "iv", "  ", "", "Ends here.", "One. Two. Three!", "ﬁne ligatures", "no end"]


def lines_of(rng, doc, n):
    rows = []
    for i in range(n):
        text = "Running Header" if i % 6 == 0 else rng.choice(PARTS)
        rows.append((doc, i, i // 6 + 1, i // rng.choice((2, 3)), text, rng.choice((10.0, 10.0, 10.0, 14.0)), rng.random() < 0.1, 0.0 if rng.random() < 0.05 else 1.0, 0.0))
    return rows


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(21)
    rows = [r for doc, n in enumerate((1, 2, 7, 40, 90, 150, 33, 64, 64, 64)) for r in lines_of(rng, doc, n)]
    rows += [(77, 0, 1, 0, " ", 10.0, False, 1.0, 0.0), (None, 0, 1, 0, "No id. It is dropped by no rule", 10.0, False, 1.0, 0.0)]
    lines = spark.createDataFrame([r for r in rows if r[0] is not None], LINE)
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", *[c for c in lines.columns if c not in ("doc_id", "row_no")]))).alias("lines"))
    return lines, whole


def rows_of(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("chunk", [3, 7])
def test_rows_equal_whole_documents(both, chunk):
    lines, whole = both
    marked = ("doc_id", "row_no", "is_running", "is_page_number")
    assert rows_of(D.marked_rows(lines, chunk), *marked) == rows_of(whole.select("doc_id", F.inline(X.mark_running_rows(F.col("lines")))), *marked)
    for options in ({}, {"bibliography": False}, {"checklists": False}):
        got = D.row_states(lines, chunk_rows=chunk, **options)
        want = whole.select("doc_id", F.inline(X.region_states(X.drop_running_rows(F.col("lines")), **options)))
        assert rows_of(got, "doc_id", "row_no", "state") == rows_of(want, "doc_id", "row_no", "state")
    cut = ("doc_id", "row_no", "kind", "text")
    for keep in (False, True):
        assert rows_of(D.cut_rows(lines, keep, chunk), *cut) == rows_of(whole.select("doc_id", F.inline(X.cut_regions(X.drop_running_rows(F.col("lines")), keep))), *cut)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_items_and_listing_equal_whole_documents(both, chunk):
    lines, whole = both
    paras = D.paragraph_rows(lines, chunk_rows=chunk)
    own = X.paragraphs(F.col("lines"))
    columns = ("doc_id", "para", "page", "kind", "text")
    assert rows_of(paras, *columns) == rows_of(whole.select("doc_id", F.inline(own)), *columns)
    columns = ("doc_id", "page", "para", "pos", "kind", "id", "text", "heading_before")
    assert rows_of(D.item_rows(paras, chunk), *columns) == rows_of(whole.select("doc_id", F.inline(X.items(own))), *columns)
    listed = whole.select("doc_id", F.posexplode(X.listing_lines(X.items(own))).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")
    assert rows_of(D.listing_rows(paras, chunk), "doc_id", "line_no", "line") == rows_of(listed, "doc_id", "line_no", "line")


def test_one_document_is_many_tasks(spark):
    """All rows are of one document: no task of the steps holds more than a few of its chunks."""
    lines = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("row_no"), (F.col("id") / 40).cast("int").alias("page"), (F.col("id") / 4).cast("int").alias("block"),
                                       F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # so small a table would be put together into one partition again
    try:
        states = D.row_states(lines, chunk_rows=256)
        per_task = [r.n for r in states.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set(name, "true")
    assert sum(per_task) == 20_000 and len(per_task) >= 4 and max(per_task) <= 10_000


def test_no_lines(spark):
    none = spark.createDataFrame([], LINE)
    assert D.listing_rows(D.paragraph_rows(none)).collect() == [] and D.marked_rows(none).collect() == []


def test_texts_are_kept_once(spark):
    """What the steps write is not a multiple of the texts, whose letters hardly compress, and sentences are digested once."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(1500)]
    lines = spark.createDataFrame([(i // 50, i % 50, i % 50 // 8 + 1, i // 4, x, 10.0, False, 1.0, 0.0) for i, x in enumerate(texts)], LINE)

    def kept():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(checkpoint_dir(spark).removeprefix("file:")) for f in files)

    before = kept()
    assert D.cut_rows(lines, chunk_rows=16).count() == len(texts)
    assert kept() - before < 2 * sum(map(len, texts))
    sents = lines.select("doc_id", F.col("row_no").alias("id"), "page", "text")
    assert "sha2" not in X.number_repeats(sents)._jdf.queryExecution().toString()


def test_abbreviations_end_no_sentence(spark):
    """Only the end of a piece is looked at, behind closing marks and from the start of a word."""
    from annolytics.functions import text as T
    cases = {"It is so in Fig.)’ Next words stand here.": 1, "It is so in the aFig. Next words stand here.": 2, "Said so et al.\" Next words stand here.": 1, "As we met approx. Ten words stand here.": 1,
             "As we met Xapprox. Ten words stand here.": 2, "By one named J. Doe and some others.": 1, "Dr. No was here before. Dr. Yes was not there.": 2}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", F.size(T.split_sentences("t")).alias("n")).collect()}
    assert got == cases
