"""Every registered query against its SQL, or for rows where SQL cannot say it."""
import pytest
from oracle import compare, connect

from annolytics.plans import load_queries

SF = "sf0.001"
QUERIES = load_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, message = compare(spark, con, SF, QUERIES[name])
    assert message == ""
    assert rows > 0 or name == "f13_edited_notes"


def test_comment_numbers_of_every_row_are_read(spark):
    from annolytics.plans.registry import Tables
    t = Tables(spark, f"/root/testdata/{SF}")
    assert QUERIES["e03_whole_local_numbers"].build(t).count() == t.lineitem.count()
