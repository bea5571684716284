"""Fill-in-middle: the learned index against the plain list of boundaries, outputs against a brute-force transformation."""
import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from annolytics.llm import fill_middle as fm
from test_llm import CLASH, DOCS, ODD

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts():
    rng = random.Random(4)
    words = ["a", "of", "und", "größer", "слово", "字", "🙂🙂", "internationalisation", "x" * 300]
    gaps = [" ", "  ", "\n", "\t \r\n", "\x0b\x0c"]
    made = ["", " ", "\n\n", "one", " one ", "one  two\n", " no break", "a<P>b c", "x <S", "<", "<M> y"]
    for n in (2, 3, 7, 50, 700, 9_000):
        made.append("".join(rng.choice(words) + rng.choice(gaps) for _ in range(n)))
        made.append("".join(rng.choice(gaps) + rng.choice(words) for _ in range(n)))
    return made + [("word " * 3_000 + "y" * 5_000 + " ") * 3, "z" * 100_000, "a " * 60_000]


def brute(doc_id, text):
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(pre + mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(pre + mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("error", [1, 8, 48, 120])
def test_segments_keep_the_error_and_residuals_mend_it(error):
    for text in texts():
        y = fm.boundaries(text)
        assert y.tolist() == [0, *np.cumsum([len(u) for u in UNIT.findall(text)])]
        n, starts, bases, slopes, rest = fm.index_of(text, error)
        guess = fm.predicted(np.arange(n + 1), starts, bases, slopes)
        assert np.abs(guess - y).max() <= error + 1
        assert (guess + np.frombuffer(rest, np.uint8) - 128).tolist() == y.tolist()


def test_a_line_is_one_segment_and_a_bend_two():
    line = np.arange(5_000) * 7
    assert len(fm.fit_segments(line, 1)[0]) == 1
    assert len(fm.fit_segments(np.concatenate([line, line[-1] + 40 * np.arange(1, 3_000)]), 4)[0]) == 2


def test_offsets_looked_up_in_spark_equal_the_boundaries(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "i long, text string").withColumn("x", fm.rank_index(F.col("text"), 5))
    picked = F.transform(F.sequence(F.lit(0).cast("long"), F.col("x")["n"], F.greatest(F.lit(1).cast("long"), F.floor(F.col("x")["n"] / 40))), lambda r: F.struct(r.alias("r"), fm.offset_at(F.col("x"), r).alias("o")))
    for row in df.select("text", picked.alias("p")).collect():
        y = fm.boundaries(row.text)
        assert all(y[p.r] == p.o for p in row.p)


def test_outputs_equal_brute_force_and_can_be_taken_apart(spark):
    made = texts()
    rows = [(i, made[i % len(made)]) for i in range(8 * len(made))] + [(None, "a b c d e f g"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fm.fill_middle(df).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.n, r.form, r.first_cut, r.second_cut, r.output) for r in out))) == sorted(repr((i, t, *brute(i, t or ""))) for i, t in rows)
    assert all(r.back == (r.text or "") for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}


def test_odd_rows_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for c in [*CLASH, "form", "n", "first_cut", "h0", "index", "text_", "a"]:
        df = df.withColumn(c, F.lit("x"))
    out = fm.fill_middle(df)
    rows = out.collect()
    assert len(rows) == len(ODD) and len(set(out.columns)) == len(out.columns)
    assert all(r.row == "x" and r.h0 == "x" and r.a == "x" for r in rows)
    assert sorted(r.n for r in rows) == sorted(len(UNIT.findall(x[1] or "")) for x in ODD)
    assert fm.fill_middle(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fm.rank_index(F.col("text"), 200)
