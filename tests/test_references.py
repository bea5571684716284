"""Character references are read as Python reads them, and texts stay out of Python."""
import html
import random

from pyspark.sql import functions as F

from annolytics.functions import text as T


def test_references_are_read_like_html(spark):
    rnd = random.Random(5)
    parts = ["&amp;", "&lt", "&notit;", "&#38;", "&#x41", "&#0;", "&#xD800;", "&", "&;", "&&", "#", ";", " ", "&Aacute", "&nope;", "é", "𝒳", "&𝒳x;", "&#;", "&gt;&gt;", "\n", "&" + "a" * 40 + ";"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(9))) for _ in range(2000)] + [None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.unescape("t").alias("u")).collect()
    assert {r.i: r.u for r in got} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_only_references_go_to_python(spark):
    plan = spark.range(3).select(F.concat(F.lit("a&amp;"), F.col("id").cast("string")).alias("t")).select(T.unescape("t"))._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.split("\n") if "ArrowEvalPython" in line]
    assert sent and all("(regexp_extract_all" in line or "read_references" in line for line in sent)
