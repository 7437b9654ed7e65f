import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadfield.operators import boundary as bd
from quadfield.operators import forces as fc
from quadfield.operators.nearest import nearest_wall
from quadfield.operators.scans import checkpointed, running_sum
from quadfield.sources import generators as gen


def reversed_in_r(mesh, n, which):
    """Mirror the chosen elements: their nodes run backwards along r."""
    flat = F.sequence(F.lit(0), F.lit(n * n - 1))
    back = lambda k: F.when(which, F.transform(flat, lambda p: F.get(F.col(k), p - 2 * (p % n) + (n - 1)))).otherwise(F.col(k))
    return mesh.withColumns({"x": back("x"), "y": back("y")})


@pytest.fixture(scope="module")
def cases(spark):
    """Several cases in one table; every operator keeps them apart."""
    m = gen.box(spark, 6, 4, 6, (0, 3), (0, 2), case="box").unionByName(gen.annulus(spark, 3, 24, 7, case="ring"))
    m = m.unionByName(gen.annulus(spark, 2, 8, 6, theta=(0.0, math.pi / 2), case="sector"))
    m = m.unionByName(reversed_in_r(gen.box(spark, 9, 4, 6, (0, 3), (0, 1), case="mixed"), 6, F.col("elem") % 3 != 1))
    m = m.unionByName(gen.box(spark, 3, 2, 5, (0, 1), (0, 1), case="mirror").withColumn("x", F.transform("x", lambda v: -v)))
    return checkpointed(m)


@pytest.fixture(scope="module")
def walls(cases):
    return checkpointed(bd.detect_boundaries(cases))


def test_external_edges(cases):
    n = {r.case: r["count"] for r in bd.external_edges(cases).groupBy("case").count().collect()}
    assert n == {"box": 20, "ring": 48, "sector": 20, "mixed": 26, "mirror": 10}
    assert {r.case: r["count"] for r in bd.external_edges(cases.where("case = 'box'"), tol=1e-6).groupBy("case").count().collect()} == {"box": 20}


def test_detected_boundaries(cases, walls):
    got = {(r.case, r.boundary): (r.edges, r.closed) for r in bd.boundary_census(walls).collect()}
    want = {("box", f"B{k + 1}"): (v, False) for k, v in enumerate((6, 4, 6, 4))}
    want |= {("ring", "B1"): (24, True), ("ring", "B2"): (24, True)}
    want |= {("sector", f"B{k + 1}"): (v, False) for k, v in enumerate((2, 8, 2, 8))}
    want |= {("mirror", k): v for k, v in got_case(got, "mirror").items()}
    assert {k: v for k, v in got.items() if k[0] != "mixed"} == want
    assert sorted(v for k, v in got.items() if k[0] == "mixed") == [(4, False), (4, False), (9, False), (9, False)]
    assert sorted(v[0] for k, v in got.items() if k[0] == "mirror") == [2, 2, 3, 3]
    length = {(r.case, r.boundary): r.length for r in bd.boundary_length(walls, cases).collect()}
    assert sorted(v for k, v in length.items() if k[0] == "box") == pytest.approx([2, 2, 3, 3], abs=1e-12)
    assert sorted(v for k, v in length.items() if k[0] == "ring") == pytest.approx([math.pi, 3 * math.pi], abs=1e-8)


def got_case(got, case):
    return {k[1]: v for k, v in got.items() if k[0] == case}


def test_other_angles(cases):
    one = {(r.case, r.boundary): (r.edges, r.closed) for r in bd.boundary_census(bd.detect_boundaries(cases, 179.0)).collect()}
    assert one == {("box", "B1"): (20, True), ("ring", "B1"): (24, True), ("ring", "B2"): (24, True), ("sector", "B1"): (20, True), ("mixed", "B1"): (26, True), ("mirror", "B1"): (10, True)}
    every = bd.boundary_census(bd.detect_boundaries(cases.where("case = 'sector'"), 1e-9))
    assert every.count() == 20 and every.where("edges <> 1").count() == 0


def test_edges_follow_each_other(cases, walls):
    ends = bd.edge_table(cases).select("case", "elem", "side", "x0", "y0", "x1", "y1")
    w = walls.join(ends, ["case", "elem", "side"])
    nxt = w.select("case", "boundary", (F.col("seq") - 1).alias("seq"), F.col("x0").alias("nx0"), F.col("y0").alias("ny0"))
    j = w.join(nxt, ["case", "boundary", "seq"])
    assert j.where(F.hypot(F.col("x1") - F.col("nx0"), F.col("y1") - F.col("ny0")) > 1e-9).count() == 0
    # every boundary is numbered 0..k-1
    assert w.groupBy("case", "boundary").agg(F.count(F.lit(1)).alias("k"), F.max("seq").alias("m"), F.count_distinct("seq").alias("d")).where("k <> d or m <> k - 1").count() == 0


def test_normals_point_outward(cases, walls):
    nd = bd.boundary_nodes(walls, cases)
    ring = nd.where("case = 'ring'").withColumn("rad", F.hypot("x", "y"))
    sign = F.when(F.col("rad") < 1, -1).otherwise(1)
    assert ring.agg(F.max(F.abs(F.col("nx") - sign * F.col("x") / F.col("rad")))).first()[0] < 1e-8
    for case, (cx, cy) in {"mirror": (-0.5, 0.5), "mixed": (1.5, 0.5)}.items():
        away = (F.col("x") - cx) * F.col("nx") + (F.col("y") - cy) * F.col("ny")
        assert nd.where(F.col("case") == case).agg(F.min(away)).first()[0] > 0


def test_single_precision_copies_and_a_crack(spark):
    """Shared vertices that differ by rounding still match; a gap beyond the tolerance does not."""
    m = gen.box(spark, 4, 3, 4, (100, 104), (0, 3), case="f32")
    noisy = m.withColumns({k: F.transform(k, lambda v: v + 5e-6 * F.sin(v * 1e4 + F.col("elem") * 7.0)) for k in ("x", "y")})
    assert bd.external_edges(noisy).count() == 14
    crack = m.withColumn("x", F.when(F.col("elem") % 4 >= 2, F.transform("x", lambda v: v + 0.01)).otherwise(F.col("x")))
    assert bd.external_edges(crack).count() == 14 + 6


def test_many_copies_of_one_element(spark):
    """A third of all elements are copies of one: their edges all match, and nothing explodes."""
    m = gen.box(spark, 20, 20, 3, (0, 20), (0, 20), case="c")
    copies = m.where("elem = 0").select("case", F.explode(F.sequence(F.lit(1000).cast("long"), F.lit(1199).cast("long"))).alias("elem"), "gid", "n", "x", "y")
    e = bd.external_edges(m.unionByName(copies))
    assert e.count() == 80 - 2 and e.where("elem = 0 or elem >= 1000").count() == 0


def test_manual_boundaries(spark, cases):
    picks = spark.createDataFrame([("box", "one", 0, 0), ("box", "one", 2, 0), ("box", "one", 1, 0), ("box", "two", 5, 0), ("box", "two", 0, 0)], "case string, boundary string, elem long, side int")
    b = bd.boundary_from_edges(cases, picks)
    rows = {k: [(r.elem, r.chain) for r in b.where(F.col("boundary") == k).orderBy("seq").collect()] for k in ("one", "two")}
    assert rows == {"one": [(0, 0), (1, 0), (2, 0)], "two": [(0, 0), (5, 1)]}
    assert bd.boundary_length(b.where("boundary = 'one'"), cases).first().length == pytest.approx(1.5)


def test_wall_normal_segments(spark, cases):
    seeds = spark.createDataFrame([("ring", 0, 3, 2, 0.25), ("ring", 3, 3, 4, -0.25)], "case string, elem long, side int, node int, length double")
    for r in bd.normal_segments(seeds, cases).collect():
        assert math.hypot(r.x0, r.y0) == pytest.approx(0.5, abs=1e-9)
        assert math.hypot(r.x1, r.y1) == pytest.approx(0.5 + r.length, abs=1e-6)
    t = spark.createDataFrame([("mixed", 0, 0, 0.5, 0.2), ("mixed", 1, 0, 0.5, 0.2)], "case string, elem long, side int, t double, length double")
    got = {r.elem: r for r in bd.normal_segments(t, cases, traversal=True).collect()}
    # along the traversal both points lie three quarters into their edge
    assert got[0].x0 == pytest.approx(0.25) and got[1].x0 == pytest.approx(1 / 3 + 0.25)
    assert got[0].y1 == pytest.approx(0.2)
    assert bd.default_normal_length(cases.where("case = 'box'")).first().length == pytest.approx(0.2)


def test_polyline_and_edits(cases, walls):
    p = bd.boundary_polyline(walls, cases, 5).groupBy("case", "boundary").count().collect()
    n = {(r.case, r.boundary): r["count"] for r in p}
    assert n[("ring", "B1")] == 24 * 4 + 1 and n[("box", "B1")] == 6 * 4 + 1
    b = walls.where("case = 'box' and boundary = 'B1'")
    assert bd.edit_boundary(b, remove=b.where("seq < 2")).count() == 4
    assert bd.edit_boundary(b, add=b).count() == 6
    assert bd.runs_with_edges(walls, b.limit(1)).count() == 6


def test_nearest_wall_against_brute_force(spark, cases):
    ring = cases.where("case = 'ring'")
    rng = np.random.default_rng(2)
    a, r = rng.uniform(0, 2 * math.pi, 400), rng.uniform(0.4, 1.6, 400)
    pts = spark.createDataFrame([("ring", k, float(q * math.cos(t)), float(q * math.sin(t))) for k, (t, q) in enumerate(zip(a, r))], "case string, pid long, x double, y double")
    got = {g.pid: g for g in nearest_wall(pts, bd.external_edges(ring), ring, 0.2).collect()}
    want = np.minimum(np.abs(r - 0.5), np.abs(r - 1.5))
    assert set(got) == set(np.nonzero(want < 0.2)[0].tolist())
    assert max(abs(g.dist - want[k]) for k, g in got.items()) < 1e-6
    assert max(abs(math.hypot(g.nx, g.ny) - 1) for g in got.values()) < 1e-12
    snap = {g.pid: g for g in nearest_wall(pts, bd.external_edges(ring), ring, 0.2, snap=True).collect()}
    assert all(g.dist >= got[k].dist - 1e-9 and g.node >= 0 for k, g in snap.items())


def test_running_sum_matches_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 9, 500)
    df = spark.createDataFrame([(k % 2, k // 2, int(x)) for k, x in enumerate(v)], "g int, o long, v long")
    got = running_sum(df, ["g"], "o", "v", "s", block=16).orderBy("g", "o").collect()
    for g in (0, 1):
        part = v[g::2]
        assert [r.s for r in got if r.g == g] == (np.cumsum(part) - part).tolist()


# --------------------------------------------------------------------------- forces
def with_values(mesh, **funcs):
    for k, f in funcs.items():
        mesh = gen.analytic_field(mesh, k, f)
    return mesh.select("case", "elem", *funcs)


def test_shear_flow(spark):
    m = checkpointed(gen.box(spark, 6, 3, 7, (0, 2), (0, 1)))
    data = with_values(m, u=lambda x, y: y, v=lambda x, y: 0 * x, p=lambda x, y: 0 * x + 3, w=lambda x, y: 2 * y, visc=lambda x, y: 0 * x + 0.1, dens=lambda x, y: 0 * x + 2)
    b = checkpointed(bd.detect_boundaries(m))
    nodes = fc.wall_nodes(b, m, data, w="w", mu="visc", rho="dens")
    f = {r.boundary: r for r in fc.integrate(nodes, U_ref=3.0).collect()}
    assert (f["B1"].fvx, f["B1"].fvy) == pytest.approx((0.2, 0), abs=1e-10) and f["B3"].fvx == pytest.approx(-0.2, abs=1e-10)
    assert f["B1"].fpy == pytest.approx(-6, abs=1e-10) and f["B3"].fpy == pytest.approx(6, abs=1e-10)
    assert f["B1"].fvz == pytest.approx(0.4, abs=1e-10) and f["B1"].q == pytest.approx(9)
    parts = fc.integrate(nodes)
    d = fc.wall_distribution(b, m, nodes, parts).where("boundary = 'B1'").orderBy("s").collect()
    assert len(d) == 6 * 6 + 1 and d[-1].s == pytest.approx(2) and all(abs(r.cf * 1.0 - 0.1) < 1e-9 for r in d)
    table = fc.force_table(parts, {"a": (0, 2.0)}, L_ref=2.0)
    rows = {(r.boundary, r.axis): r for r in table.collect()}
    assert rows[("total", "z")].total == pytest.approx(0, abs=1e-10) and rows[("B1", "a")].pressure == pytest.approx(-6)
    assert ("total", "a") in rows and rows[("B1", "a")].coefficient == pytest.approx(-6 / 2)
    one = fc.force_table(parts.where("boundary = 'B1'")).select("boundary").distinct().collect()
    assert [r.boundary for r in one] == ["B1"]


def test_pressure_on_cylinders_and_potential_flow(spark):
    m = checkpointed(gen.annulus(spark, 3, 32, 8))
    b = checkpointed(bd.detect_boundaries(m))
    f = {r.boundary: r for r in fc.forces(b, m, with_values(m, u=lambda x, y: 0 * x, v=lambda x, y: 0 * x, p=lambda x, y: x + 0)).collect()}
    assert f["B1"].fpx == pytest.approx(-math.pi / 4, abs=1e-8) and f["B2"].fpx == pytest.approx(2.25 * math.pi, abs=1e-8)
    assert abs(f["B1"].fpy) < 1e-8
    big = checkpointed(gen.annulus(spark, 3, 32, 10, 1.0, 6.0))
    r2 = lambda x, y: x * x + y * y
    u = lambda x, y: 1 - (x * x - y * y) / r2(x, y) / r2(x, y)
    v = lambda x, y: -2 * x * y / r2(x, y) / r2(x, y)
    data = with_values(big, u=u, v=v, p=lambda x, y: 0.5 * (1 - u(x, y) * u(x, y) - v(x, y) * v(x, y)))
    wall = checkpointed(bd.detect_boundaries(big)).where("boundary = 'B1'")
    nodes = fc.wall_nodes(wall, big, data)
    parts = fc.integrate(nodes)
    r = parts.first()
    assert abs(r.fpx) < 1e-4 and abs(r.fpy) < 1e-4
    d = fc.wall_distribution(wall, big, nodes, parts)
    assert d.agg(F.max(F.abs(F.col("cp") - (1 - 4 * F.col("y") * F.col("y"))))).first()[0] < 2e-3


def test_mixed_orientation_forces(cases, walls):
    mixed = cases.where("case = 'mixed'")
    data = with_values(mixed, u=lambda x, y: y, v=lambda x, y: 0 * x, p=lambda x, y: x + 0)
    b = walls.where("case = 'mixed'")
    nodes = fc.wall_nodes(b, mixed, data)
    parts = fc.integrate(nodes)
    bottom = parts.where("abs(fvx - 3) < 1e-9").collect()
    assert len(bottom) == 1 and bottom[0].length == pytest.approx(3)
    d = fc.wall_distribution(b, mixed, nodes, parts).where(F.col("boundary") == bottom[0].boundary).orderBy("s").collect()
    assert d[-1].s == pytest.approx(3) and np.all(np.diff([r.x for r in d]) > 0) and np.all(np.diff([r.s for r in d]) > 0)


def test_wrong_requests(cases, walls):
    with pytest.raises(ValueError):
        fc.unit_axes({"a": (0, 0)})
    with pytest.raises(ValueError):
        fc.integrate(walls, rho_ref=0.0)
    with pytest.raises(ValueError):
        fc.force_axes(walls, L_ref=0.0)
    ring = cases.where("case = 'ring'")
    data = with_values(ring, u=lambda x, y: 0 * x, v=lambda x, y: 0 * x, p=lambda x, y: x + 0)
    with pytest.raises(Exception, match="dynamic pressure"):
        fc.forces(walls.where("case = 'ring'"), ring, data, rho=-1.0).collect()
    assert fc.rotated_axes(90.0) == [("x", (0.0, 1.0)), ("y", (-1.0, 0.0))]
