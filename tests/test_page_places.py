"""What pages and sentences carry through joins and to Python."""
from pyspark.sql import functions as F

from annolytics.functions import text as T
from annolytics.operators import anchor as A
from annolytics.operators import text as S

WORDS = "array<struct<word_no:int,word:string,block:int,line:int,x0:int,x1:int,y0:int,y1:int>>"


def page(n, text):
    return (1, n, [(i, w, 0, 0, 0, 0, 0, 0) if w is not None else (i, None, 0, 0, 0, 0, 0, 0) for i, w in enumerate(text)])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_a_page_are_those_of_its_words(spark):
    rows = [page(1, ["Fine", "ﬁne-Grained", "ΟΔΟΣ", "ΟΔΟΣ’", "–", "", "a\u0001b", "x"]), page(2, ["İ", "ΣΑΣ", "Co-­op", " "]), page(3, []),
            page(4, ["a", None, "b"]), page(5, [""])]
    df = spark.createDataFrame(rows, f"doc_id long, page int, words {WORDS}")
    want = {r.page: r.ks for r in df.select("page", F.transform("words", lambda w: T.norm_key(w["word"])).alias("ks")).collect()}
    for r in A.page_index(df).collect():
        ks, at = want[r.page], 0
        assert r.text == "".join(k for k in ks if k is not None)
        assert [w.n for w in r.words] == [None if k is None else len(k) for k in ks]
        for w, k in zip(r.words, ks):
            if None in ks:
                break
            assert w.offset == at
            at += len(k)


def test_words_of_a_page_are_made_only_where_they_are_used(spark):
    df = spark.createDataFrame([page(1, ["one", "two"])], f"doc_id long, page int, words {WORDS}")
    wanted = spark.createDataFrame([(1, 1, "two", None)], "doc_id long, page int, phrase string, occurrence int")
    assert "word_no" not in plan(A.page_index(df).select("doc_id", "page", "text")).split("Scan")[0].split("Generate")[0]
    counted = A.match_phrases(wanted, A.page_index(df)).select("matches")
    assert "array_append" not in plan(counted) and [r.matches for r in counted.collect()] == [1]


def test_repeats_meet_without_their_texts(spark):
    sents = spark.createDataFrame([(1, 1, 1, "Same words here."), (1, 2, 1, "Other words here."), (1, 3, 1, "same words-here."), (1, 4, 2, "Same words here."),
                                   (1, 5, 2, None)], "doc_id long, id long, page int, text string")
    out = S.number_repeats(sents)
    got = sorted((r.id, r.norm, r.occurrence, r.same_text_count) for r in out.collect())
    assert got == [(1, "samewordshere.", 1, 2), (2, "otherwordshere.", 1, 1), (3, "samewordshere.", 2, 2), (4, "samewordshere.", 1, 1), (5, None, 1, None)]
    keys = [x for x in plan(out).split("\n") if "hashpartitioning" in x]
    assert keys and not any("norm#" in x for x in keys)


def test_sentences_go_to_python_without_their_page(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    index = A.page_index(spark.createDataFrame([page(1, words)], f"doc_id long, page int, words {WORDS}"))
    sents = spark.createDataFrame([(1, 1, 1, "Alpha beta gamma."), (1, 2, 1, "alpha beta gamma delta epsxlon zeta eta theta iota kappa")], "doc_id long, id long, page int, text string")
    out = A.place_sentences(S.number_repeats(sents), index)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    before = text.split("ArrowEvalPython")[1].split("\n")[1]
    assert "page_text" not in before and "words#" not in before and " offset#" not in before
    got = {r.id: (r.how, r.start, r.stop) for r in out.collect()}
    assert got == {1: ("closest", 0, len("alphabetagammadelta")), 2: ("closest", 0, sum(map(len, words)))}
