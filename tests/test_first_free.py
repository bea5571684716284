"""Overlapping rows are paired in order: as by brute force, whatever the copies, and without a round for each of them."""
import random

import pytest

from annolytics.operators import diff as D

SCHEMA = "parent long, type string, page long, ord long, key string, x0 double, y0 double, x1 double, y1 double"
BOXES = ["x0", "y0", "x1", "y1"]


def _rows(rnd, name, n, far):
    out = []
    for i in range(n):
        x, y = rnd.randrange(0, far), rnd.randrange(0, far)
        out.append((rnd.randrange(2), "note", rnd.randrange(2), rnd.randrange(n), f"{name}{i}", float(x), float(y), x + 9.0, y + float(rnd.choice((6, 9, 30)))))
    return out


def _greedy(new, old, fits):
    free, found = sorted(old, key=lambda r: r[3:5]), set()
    for n in sorted(new, key=lambda r: r[3:5]):
        for o in free:
            if o[:3] == n[:3] and fits(n[5:], o[5:]):
                found.add((n[4], o[4]))
                free.remove(o)
                break
    return found


def _over(a, b):
    return min(a[2], b[2]) - max(a[0], b[0]) > 2 and min(a[3], b[3]) - max(a[1], b[1]) > 2


def _found(spark, new, old, test, alike, reach=0.0, **limits):
    a, b = spark.createDataFrame(new, SCHEMA).withColumnRenamed("key", "new_key"), spark.createDataFrame(old, SCHEMA).withColumnRenamed("key", "old_key")
    return [(r.new_key, r.old_key) for r in D._first_free(a, b, D.PAGE, test, alike, reach, **limits).collect()]


@pytest.mark.parametrize("far", [12, 60, 400])
@pytest.mark.parametrize("limits", [{}, {"part_rows": 0}, {"part_rows": 40, "part_work": 60}])
def test_first_free_by_brute_force(spark, far, limits):
    rnd = random.Random(far)
    new, old = _rows(rnd, "n", 90, far), _rows(rnd, "o", 90, far)
    got = _found(spark, new, old, D.G.overlaps, D._over, **limits)
    assert len(got) == len(set(got)) and set(got) == _greedy(new, old, _over)


def test_near_places_by_brute_force(spark):
    rnd = random.Random(7)
    new, old = _rows(rnd, "n", 80, 12), _rows(rnd, "o", 80, 12)
    got = _found(spark, new, old, D._near(1.0), lambda boxes, box: (abs(boxes - box) <= 1.0).all(axis=1), 1.0)
    assert set(got) == _greedy(new, old, lambda a, b: all(abs(x - y) <= 1.0 for x, y in zip(a, b)))


def test_copies_take_no_round_each(spark, monkeypatch):
    # 400 copies of a new box over 300 of each of two old ones: candidates were 240,000 rows and struck off one a round
    new = [(1, "note", 1, i, f"n{i:03}", 10.0, 10.0, 70.0, 20.0) for i in range(400)]
    old = [(1, "note", 1, i, f"o{i:03}", 20.0 + 20 * (i % 2), 10.0, 90.0, 20.0) for i in range(600)]
    kept = []
    monkeypatch.setattr(D, "cut_lineage", lambda df: kept.append(df) or df.localCheckpoint() if len(kept) < 6 else pytest.fail("a round for each copy"))
    rows = [spark.createDataFrame(x, SCHEMA).selectExpr("*", "concat_ws(',', key) place", "'' text", "'' comment") for x in (new, old)]
    got = {(r.new_key, r.old_key) for r in D.match_rewrite(*rows).collect()}
    assert got == {(f"n{i:03}", f"o{i:03}") for i in range(400)}


def test_rows_that_stand_twice_and_rows_without_keys(spark):
    box = (10.0, 10.0, 70.0, 20.0)
    new = [(1, "note", 1, 1, "a", *box)] * 2 + [(1, "note", 1, 2, "b", *box), (1, "note", 2, 2, "b", *box), (1, "note", 3, None, None, *box)]
    old = [(1, "note", 1, 1, "x", *box)] * 2 + [(1, "note", 1, 2, "y", *box), (1, "note", 2, 3, "z", *box), (1, "note", 3, 5, "w", *box), (1, "note", 3, 5, "w", *box)]
    assert sorted(map(str, _found(spark, new, old, D.G.overlaps, D._over))) == sorted(map(str, [("a", "x"), ("b", "y"), (None, "w")]))
