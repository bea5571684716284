"""Near-duplicate vectors against brute force: exact where every cell is visited, recall with production parameters."""
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from annolytics.llm import vector_dedup as vd
from test_llm import CLASH

SCHEMA = "vec_id long, embedding array<float>"


def planted(rng, n, dim, groups, noise):
    """Random directions, and groups of near copies around some of them."""
    x = [rng.normal(size=dim) for _ in range(n)]
    for size in groups:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        x += [centre + rng.normal(size=dim) * noise / math.sqrt(dim) for _ in range(size)]
    return [[float(v) for v in np.float32(r)] for r in x]


def brute(rows, threshold=0.9):
    """{row number: (n_links, component)}"""
    width = max((len(v) for _, v in rows if v), default=1)
    x = np.zeros((len(rows), width))
    for i, (_, v) in enumerate(rows):
        if v and all(e is not None and math.isfinite(e) for e in v):
            x[i, :len(v)] = v
    norm = np.sqrt((x * x).sum(1))
    usable = norm > 0
    x[usable] /= norm[usable, None]
    mask = (x @ x.T >= threshold) & usable[:, None] & usable[None]
    np.fill_diagonal(mask, False)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(mask[todo.pop()]):
                if j not in group:
                    group.add(int(j))
                    todo.append(int(j))
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (int(mask[j].sum()), min(ids) if ids else None)
    return out


def same(got, rows, **options):
    want = sorted(repr((rows[i][0], n, c, c == rows[i][0])) for i, (n, c) in brute(rows, **options).items())
    assert sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want


@pytest.mark.parametrize("noise", [0.15, 0.33, 0.45])  # cores only; cosines about the threshold; below it
def test_one_cell_is_exact(spark, noise):
    rng = np.random.default_rng(int(noise * 100))
    x = planted(rng, 60, 16, (1, 2, 5, 40), noise)
    order = rng.permutation(len(x))
    rows = [(int(i), x[k]) for i, k in enumerate(order)] + [(500 + i, x[i]) for i in range(7)] + [(3, x[int(order[3])]), (None, x[0]), (None, [-1.0] * 16)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in [*CLASH, "vec", "weight", "home", "least"]:
        df = df.withColumn(c, F.lit("x"))
    same(vd.near_duplicates(df, cell_rows=10_000).collect(), rows)


@pytest.mark.parametrize("noise", [0.15, 0.33])
def test_small_blocks_and_all_visits_are_exact(spark, noise):
    rng = np.random.default_rng(7)
    rows = [(i, v) for i, v in enumerate(planted(rng, 80, 8, (50, 30, 3), noise))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same(vd.near_duplicates(df, cell_rows=20, block=8, visits=400, probes=400).collect(), rows)


def test_recall_and_no_link_below_the_threshold(spark):
    rng = np.random.default_rng(11)
    x = planted(rng, 4_000, 48, [2] * 300 + [4] * 100 + [60, 500], 0.3)
    rows = [(i, v) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in vd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(8), cell_rows=64).collect()}
    want = {i: n for i, (n, _) in brute(rows).items()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(want.values()) > 100_000 and sum(got.values()) >= 0.97 * sum(want.values())
    linked = [i for i, n in want.items() if n]
    assert sum(got[i] > 0 for i in linked) >= 0.97 * len(linked)


def test_vectors_without_a_cosine(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0]), (9, [1e30, 1e20]), (10, [3e-30, 0.0]), (None, None)]
    got = vd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {i: (0, i) for i in (1, 2, 3, 4, 5, 6)} | {i: (3, 7) for i in (7, 8, 9, 10)} | {None: (0, None)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert vd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vd.near_duplicates(spark.createDataFrame(rows[:3], SCHEMA)).count() == 3
    assert sorted(r.vec_id or 0 for r in vd.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    doubles = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e200, 1e150])], "vec_id long, embedding array<double>")
    assert {r.n_links for r in vd.near_duplicates(doubles).collect()} == {1}


def test_groups_of_a_product_are_its_components():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        left, right = np.flatnonzero(rng.random(n) < 0.7), np.flatnonzero(rng.random(n) < 0.7)
        mask = rng.random((len(left), len(right))) < 0.08
        label = list(range(n))
        for _ in range(n):
            for i, j in zip(*np.nonzero(mask)):
                label[left[i]] = label[right[j]] = min(label[left[i]], label[right[j]])
        assert vd.linked_groups(mask, left, right, n).tolist() == label
