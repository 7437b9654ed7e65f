"""Tables that grow with the mesh are never broadcast, however small Spark takes them for."""

import pytest

import quadfield.operators.boundary as bd
import quadfield.operators.scans as scans
from quadfield.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that are written on the way."""
    seen = []

    def noted(df, compact=False):
        seen.append(plan_of(df))
        return scans.checkpointed(df, compact)

    for module in (bd, __import__("quadfield.plans.boundary_plans", fromlist=["x"]), __import__("quadfield.plans.force_plans", fromlist=["x"])):
        monkeypatch.setattr(module, "checkpointed", noted)
    return seen


@pytest.mark.parametrize("name", ["boundary_one_loop", "boundary_sides", "edit_boundary", "manual_boundary", "wall_normals", "pressure_force", "joined_distribution", "wall_crossings"])
def test_walls(spark, plans, name):
    out = QUERIES[name](spark, SMALL)
    assert not [p for p in [*plans, plan_of(out)] if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


@pytest.mark.parametrize("name", ["force_total", "force_rollup", "force_series", "force_table", "moving_mesh_force"])
def test_forces(spark, plans, name):
    out = QUERIES[name](spark, SMALL)
    assert not [p for p in plans if "BroadcastHashJoin" in p]
    # the days alone
    joins = [line for line in plan_of(out).splitlines() if "BroadcastHashJoin" in line]
    assert all("_slot" in line for line in joins)
