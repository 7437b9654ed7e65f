"""Forces from the kernel's sums, from steps that hold their own mesh, and in a table that goes through the walls once."""

import pytest
from pyspark.sql import functions as F

import quadfield.operators.forces as fc
import quadfield.sources.generators as gen
from quadfield.operators import boundary as bd
from quadfield.operators.scans import checkpointed


@pytest.fixture(scope="module")
def flow(spark):
    """A mesh, its walls, and three steps of a flow whose mesh drifts; a pressure and a velocity are missing."""
    mesh = checkpointed(gen.annulus(spark, 2, 8, 6))
    walls = checkpointed(bd.detect_boundaries(mesh))
    rows = mesh.select("case", "elem", "x", "y")
    for name, f in (("u", lambda x, y: x * y), ("v", lambda x, y: y - x), ("p", lambda x, y: x + y * y), ("w", lambda x, y: 2 * x - y), ("dens", lambda x, y: 2 + 0.5 * x), ("visc", lambda x, y: 0.1 + 0.01 * y)):
        rows = gen.analytic_field(rows, name, f)
    rows = rows.withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    rows = rows.withColumns({k: F.zip_with(k, F.array_repeat("step", F.size(k)), lambda v, s: v + s) for k in ("x", "y", "p")})
    rows = rows.withColumns({"p": F.when(F.expr("step = 1 and elem = 4"), None).otherwise(F.col("p")), "u": F.when(F.expr("step = 2 and elem = 3"), None).otherwise(F.col("u"))})
    return mesh, walls, checkpointed(rows)


def rows_of(df):
    return {tuple(r[:2]): r[2:] for r in df.select("step", "boundary", "length", "fpx", "fpy", "fvx", "fvy", "fvz", "rho_ref", "q").collect()}


@pytest.mark.parametrize("given", [{"rho": "dens", "mu": "visc"}, {"rho": 1.5, "mu": 0.1}, {"rho": "dens", "mu": 0.1}])
def test_sums_are_those_of_the_nodes(flow, given):
    mesh, walls, rows = flow
    nodes = fc.wall_nodes(walls, rows.select("case", "step", "elem", "x", "y"), rows.drop("x", "y"), w="w", **given)
    want = rows_of(fc.integrate(nodes, U_ref=3.0))
    assert len(want) == 6
    for coordinates, fields in ((rows.select("case", "step", "elem", "x", "y"), rows.drop("x", "y")), (None, rows)):
        got = rows_of(fc.forces(walls, coordinates, fields, U_ref=3.0, w="w", **given))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_no_nodes_in_rows(spark):
    """Forces don't spread the nodes of an edge over rows, and a step's own mesh is not joined to its values."""
    from quadfield.plans import QUERIES

    moving, still = (QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for name in ("moving_mesh_force", "force_series"))
    assert "posexplode" not in moving + still
    assert moving.count("Join") < still.count("Join")


def test_table_reads_the_forces_once(flow, monkeypatch):
    mesh, walls, rows = flow
    parts = fc.forces(walls, None, rows, U_ref=3.0, w="w", rho="dens", mu=0.1)
    table = fc.force_table(parts)
    assert "ArrowEvalPython" not in table._jdf.queryExecution().executedPlan().toString()
    got = {(r.step, r.boundary, r.axis): r for r in table.collect()}
    assert len(got) == 3 * 3 * 3
    want = {(r.step, r.boundary): r for r in parts.collect()}
    for (step, name, axis), r in got.items():
        own = [want[step, name]] if name != "total" else [want[step, "B1"], want[step, "B2"]]
        press, visc = (sum(o[f"f{k}{axis}"] for o in own) if k + axis != "pz" else 0.0 for k in "pv")
        assert (r.pressure, r.viscous, r.coefficient) == pytest.approx((press, visc, (press + visc) / own[0].q))
