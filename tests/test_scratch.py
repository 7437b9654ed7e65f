import os

import pytest

from quadfield.operators import boundary as bd
from quadfield.operators import scans
from quadfield.operators.scans import checkpointed, release, scratch
from quadfield.sources import generators as gen


@pytest.fixture
def folder(monkeypatch, tmp_path):
    """A shared folder of its own for the tables of a test."""
    monkeypatch.setattr(scans, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def test_nothing_is_left_of_a_query(spark, folder):
    with scratch(spark):
        rows = bd.detect_boundaries(gen.box(spark, 4, 3, 4)).collect()
        assert len(os.listdir(folder)) >= 4
    assert len(rows) == 14 and os.listdir(folder) == []


def test_a_registered_query_leaves_nothing(spark, folder):
    import __spark_entry__ as entry

    with scratch(spark):
        assert entry.queries()["boundary_sides"](spark, "/root/testdata/sf0.001").count() > 0
        assert os.listdir(folder)
    assert os.listdir(folder) == []


def test_nested_blocks_and_errors(spark, folder):
    with scratch(spark):
        kept = checkpointed(spark.range(5))
        with pytest.raises(ZeroDivisionError), scratch(spark):
            checkpointed(spark.range(6))
            assert len(os.listdir(folder)) == 2
            raise ZeroDivisionError
        assert len(os.listdir(folder)) == 1 and kept.count() == 5
    assert os.listdir(folder) == []


def test_a_write_that_fails(spark, folder):
    with scratch(spark):
        with pytest.raises(Exception, match="stop"):
            checkpointed(spark.range(3).selectExpr("raise_error('stop') AS x"))
    assert os.listdir(folder) == []


def test_release_by_hand(spark, folder):
    a = checkpointed(spark.range(3))
    assert a.count() == 3 and release(spark) >= 1 and os.listdir(folder) == [] and release(spark) == 0


def test_sizes_of_regular_tables(spark):
    """Repeating values don't make a table look small to the choice of broadcasts; compact tables may."""
    rows = spark.range(200_000).selectExpr("id % 3 AS case", "array_repeat(cast(id % 5 AS double), 10) AS x")
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    with scratch(spark):
        assert size(checkpointed(rows)) >= 200_000 * 8 * 11 > 10 * size(checkpointed(rows, compact=True))
