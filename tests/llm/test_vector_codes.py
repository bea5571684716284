"""Vector codes: the equal-average search and the whole operator against brute force in Python integers."""
import hashlib
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from annolytics.llm import vector_codes as vc
from test_llm import CLASH

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) * 4096 < vc.LARGEST for x in v)]
    if not kept:
        return [], None
    width = -(-max([1, *(len(v) for _, v, _ in kept)]) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    dim = width // parts
    cut = lambda v, p: v[p * dim:(p + 1) * dim]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in groups.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    coded = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in kept]
    rows = [(i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)) for i, label, found in coded]
    total = {}
    for _, label, _, error in rows:
        total[label] = total.get(label, 0) + error
    return [(i, label, code, error, total[label]) for i, label, code, error in rows], hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("size,dim,spread", [(1, 1, 3), (16, 8, 4), (16, 8, 4000), (256, 3, 40), (7, 12, 1 << 26)])
def test_search_finds_the_nearest_entry_and_the_lowest_of_ties(size, dim, spread):
    rng = np.random.default_rng(size)
    points, entries = rng.integers(-spread, spread, (400, dim)), rng.integers(-spread, spread, (size, dim))
    entries[size // 2:] = entries[:size - size // 2]  # equal entries and equal sums
    index, distance = vc.nearest(points, entries)
    all_ = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_search_of_nothing():
    index, distance = vc.nearest(np.zeros((0, 4), np.int64), np.ones((3, 4), np.int64))
    assert len(index) == len(distance) == 0


@pytest.mark.parametrize("n", [3, 16, 300])
def test_codes_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(3 * n), [rng.gauss(0, 0.3) for _ in range(16)], rng.choice([None, 0, 1, 1, 1])) for _ in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rows += [rows[0], (None, rows[1][1], 2), (5, None, 1), (6, [None] * 16, 1), (7, [math.nan] + [0.0] * 15, 0), (8, [math.inf] * 16, 0), (9, [1e30] * 16, 0), (10, [0.5] * 9, 1), (11, [], None)]
    want, digest = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in [*CLASH, "code", "error", "x", "c"]:
        df = df.withColumn(c, F.lit("x"))
    got = vc.compress(df).collect()
    assert sorted((repr((r.vec_id, r.label, r.code, r.error, r.label_error)) for r in got)) == sorted(map(repr, want))
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_no_usable_vector_no_rows(spark):
    assert vc.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.compress(spark.createDataFrame([(1, None, 1), (2, [None], 1)], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([], SCHEMA), entries=300)
