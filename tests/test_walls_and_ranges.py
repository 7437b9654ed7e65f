import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadfield.functions import kernels
from quadfield.operators import boundary as bd
from quadfield.operators import forces as fc
from quadfield.operators.fields import field_range
from quadfield.operators.scans import checkpointed
from quadfield.sources import cases
from quadfield.sources import generators as gen


@pytest.fixture(scope="module")
def flow(spark):
    m = gen.annulus(spark, 2, 8, 7, case="ring").unionByName(gen.box(spark, 3, 2, 5, (0, 1), (0, 1), case="box"))
    m = m.unionByName(gen.box(spark, 3, 2, 6, (0, 1), (0, 1), case="mirror").withColumn("x", F.transform("x", lambda v: -v)))
    for name, f in (("u", lambda x, y: x * x * y + y), ("v", lambda x, y: F.sin(x) * y), ("w", lambda x, y: x - 2 * y), ("p", lambda x, y: x + y)):
        m = gen.analytic_field(m, name, f)
    return checkpointed(m)


def test_fused_gradients(flow):
    """All sides of straight, bent and mirrored elements of several orders: the same as one kernel per field."""
    sides = flow.withColumn("side", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("frame", kernels.wall_frame("x", "y", "side"))
    both = sides.select(
        "frame", kernels.edge_frame("x", "y", "side").alias("old"), kernels.wall_gradients({k: F.col(k) for k in ("u", "v", "w")}, "frame", "side").alias("g"),
        *[kernels.edge_gradient(F.col(k), "x", "y", "side").alias(f"e_{k}") for k in ("u", "v", "w")],
    )
    rows = both.collect()
    assert len(rows) == 4 * (16 + 6 + 6) and {r.frame.mirrored for r in rows} == {True, False}
    for r in rows:
        assert all(np.allclose(r.frame[k], r.old[k], rtol=0, atol=1e-13) for k in kernels.EDGE_PARTS)
        for k in ("u", "v", "w"):
            e = r[f"e_{k}"]
            assert np.allclose(r.g[f"{k}_dx"], e.dx, rtol=1e-11, atol=1e-11) and np.allclose(r.g[f"{k}_dy"], e.dy, rtol=1e-11, atol=1e-11)
    none = sides.limit(2).select(kernels.wall_gradients({"u": F.lit(None).cast("array<double>")}, "frame", "side").alias("g")).collect()
    assert all(r.g is None for r in none)


def test_one_kernel_for_all_gradients(flow):
    walls = checkpointed(bd.detect_boundaries(flow.select("case", "elem", "gid", "n", "x", "y")))
    steps = flow.select("case", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), "elem", "u", "v", "w", "p")
    nodes = fc.wall_nodes(walls, flow.select("case", "elem", "x", "y"), steps, w="w", mu=0.1)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    kernels_used = re.findall(r"ArrowEvalPython", plan)
    assert len(kernels_used) == 2  # the frame of each edge, then u, v and w together


def test_parts_and_total_in_one_aggregation(flow):
    walls = checkpointed(bd.detect_boundaries(flow.select("case", "elem", "gid", "n", "x", "y")))
    steps = flow.select("case", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), "elem", "u", "v", "w", "p")
    nodes = checkpointed(fc.wall_nodes(walls, flow.select("case", "elem", "x", "y"), steps, w="w", mu=0.1, rho=1.5))
    got = fc.forces_with_total(nodes, U_ref=2.0)
    parts = fc.integrate(nodes, U_ref=2.0)
    want = parts.unionByName(fc.force_totals(parts).select(parts.columns))
    key = lambda r: (r.case, r.step, r.boundary)
    a, b = ({key(r): r for r in df.collect()} for df in (got, want))
    assert set(a) == set(b) and len(a) == got.count()
    for k in a:
        assert all(a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-12) for c in ("length", "fpx", "fpy", "fvx", "fvy", "fvz", "rho_ref", "q"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?m)^[ :+-]*Aggregate ", plan)) == 1


def test_ranges_are_stored(spark, tmp_path):
    m = gen.taylor_green(gen.annulus(spark, 2, 6, 6))
    bad = F.when(F.col("elem") == 3, F.transform("p", lambda v: F.lit(float("nan")))).otherwise(F.col("p"))
    data = m.select("case", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), "elem", "u", "v", bad.alias("p"))
    data = data.withColumns({"time": F.col("step") * 0.5, "void": F.transform("p", lambda v: F.lit(float("inf")))})
    cases.write_case(data, f"{tmp_path}/c", ranges=True)
    got = cases.series_ranges(spark, f"{tmp_path}/c")
    rows = {(r.step, r.field): (r.lo, r.hi) for r in got.collect()}
    want = {(r.step, r.field): (r.lo, r.hi) for r in field_range(data.drop("time", "elem"), ["u", "v", "p", "void"]).collect()}
    assert rows == want and rows[0, "void"] == (0.0, 1.0) and {(r.time, r.nelv) for r in got.collect()} == {(0.0, 12), (0.5, 12)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "array<" not in plan and cases.read_case(spark, f"{tmp_path}/c").columns == ["elem", "time", "u", "v", "p", "void", "case", "step"]
    # more steps: the table follows
    cases.write_case(data.withColumns({"step": F.col("step") + 2, "u": F.transform("u", lambda v: v * 9)}), f"{tmp_path}/c", mode="append", ranges=True)
    assert {r.step for r in cases.series_ranges(spark, f"{tmp_path}/c").collect()} == {0, 1, 2, 3}
    assert math.isclose(cases.series_ranges(spark, f"{tmp_path}/c").where("step = 2 and field = 'u'").first().hi, 9 * rows[0, "u"][1])
