"""What a write's record and verification do not read is neither moved nor kept."""
import datetime

import pytest
from pyspark.sql import functions as F

from annolytics import session
from annolytics.operators import diff as D
from annolytics.plans import diff_queries as Q
from annolytics.plans.registry import Tables


@pytest.fixture
def kept(monkeypatch):
    """The tables that are kept in the shared folder, in their order."""
    found = []

    def stored(df):
        found.append(session.stored(df))
        return found[-1]
    for module in (D, Q):
        monkeypatch.setattr(module, "stored", stored)
    return found


def _tables(spark, folder):
    day = datetime.datetime(2021, 3, 4)
    rows = [(o, n, (o * 7 + n) % 60 + 1, (o + n * 3) % 20, float((o * 3 + n) % 30 + 1), "RAN"[(o + n) % 3], "OF"[o % 5 == 0], day) for o in range(120) for n in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, "
                                "l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return Tables(spark, str(folder))


def _side(spark, rows):
    cols = "key string, parent long, type string, page int, ord long, text string, comment string, x0 int, y0 int, x1 int, y1 int"
    return Q._place(spark.createDataFrame(rows, cols))


def test_paired_rows_keep_no_texts_and_no_row_its_place(spark, kept):
    old = _side(spark, [(f"o{i}", 1, "highlight", 1, i, f"words {i}", "", i, 0, i + 5, 5) for i in range(6)])
    new = _side(spark, [(f"n{i}", 1, "highlight", 1, i, f"words {i}" if i < 5 else "else", "", i + 100 * (i in (3, 5)), 0, i + 5 + 100 * (i in (3, 5)), 5) for i in range(6)])
    got = {(r.new_key, r.old_key): r.how for r in D.match_rewrite(new, old, overlap=False).collect()}
    assert got == {**{(f"n{i}", f"o{i}"): "text and place" for i in (0, 1, 2, 4)}, ("n3", "o3"): "text"}
    placed, said = kept
    assert placed.filter("place IS NOT NULL OR (how IS NOT NULL AND body IS NOT NULL)").isEmpty() and placed.filter("body IS NOT NULL").count() == 4
    assert "place" not in said.columns and "body" not in said.columns and said.count() == 1


@pytest.mark.parametrize("build, fields", [(Q.record_merge, {"key", "type", "comment", "color", "text", "page_label", "ord"}), (Q.verification, {"key", "comment", "color", "text", "ord"})])
def test_next_snapshot_and_plan_keep_what_is_read(spark, kept, tmp_path, build, fields):
    assert build(_tables(spark, tmp_path)).count() > 0
    found = [set(df.columns) for df in kept]
    assert fields in found and {"action", "new_key", "old_key", "fields", "tag_delta"} in found
    assert not any("tags" in c for c in found)


def test_a_record_has_the_fields_asked_for(spark, tmp_path, kept):
    t = _tables(spark, tmp_path)
    plan, expected = Q._next(t)
    back, old, was = expected.filter("ord % 7 <> 0"), Q.listing(t), Q.records(t)
    whole = D.merge_records(back, expected, old, plan, was)
    few = D.merge_records(back.drop("place"), expected.drop("place", "tags"), old.drop("place"), plan, was, ("color", "fp_comment"))
    assert few.columns == ["key", "source", "color", "fp_comment"] and whole.columns == ["key", "source", *D.PRINTED]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.select(*few.columns).collect())) != []


def test_lost_updates_take_back_the_old_values(spark, tmp_path, kept):
    t = _tables(spark, tmp_path)
    plan, expected, back = Q._read_back(t, "comment", "color", "text")
    lost = plan.filter("action = 'update'").select(F.col("old_key").alias("key")).join(Q.listing(t).filter("ord % 5 = 0"), "key").select("key", "comment", "color", "text")
    assert lost.count() > 0 and lost.exceptAll(back.select(*lost.columns)).isEmpty()
