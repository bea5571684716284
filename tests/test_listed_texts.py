"""Sentences that are looked up as listed texts are split once."""
from annolytics.plans import anchor_queries as Q


class Documents:
    def __init__(self, spark, rows):
        self.spark, self.documents = spark, spark.createDataFrame(rows, "doc_id long, text string")


def test_sentences_are_split_once(spark):
    long = "A sentence that is much longer than the eighty characters a listing has room for, by some words."
    out = Q.listed_texts(Documents(spark, [(1, f"One. Two is here. Three ends. Two is here. {long} {long}"), (2, None), (3, long)]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Relation") >= 3
    rows = sorted((r.doc_id, r.id, r.listed_id) for r in out.collect())
    first = {}
    bodies = {(r.doc_id, r.id): r.text for r in Q.fx.sentences(Documents(spark, [(1, f"One. Two is here. Three ends. Two is here. {long} {long}"), (3, long)])).collect()}
    for (d, i), body in sorted(bodies.items()):
        if i % 3:
            first.setdefault((d, body), i)
    assert rows == [(d, i, first.get((d, body))) for (d, i), body in sorted(bodies.items())]
