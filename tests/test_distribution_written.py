"""Uses of a wall distribution read narrow tables; the mesh isn't gone through again for each."""

import os

import pytest

from quadfield.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_lengths_are_written_once(spark):
    plan = QUERIES["joined_distribution"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "ArrowEvalPython" not in plan
