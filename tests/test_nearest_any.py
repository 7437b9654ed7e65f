import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadfield.operators import boundary as bd
from quadfield.operators.nearest import nearest_wall, nearest_wall_any
from quadfield.operators.scans import checkpointed
from quadfield.sources import generators as gen

POINTS = "case string, pid long, x double, y double"


@pytest.fixture(scope="module")
def cases(spark):
    m = gen.box(spark, 6, 4, 6, (0, 3), (0, 2), case="box").unionByName(gen.annulus(spark, 3, 24, 7, case="ring"))
    return checkpointed(m)


@pytest.fixture(scope="module")
def walls(cases):
    return checkpointed(bd.external_edges(cases))


def box_distance(x, y):
    dx, dy = max(-x, 0, x - 3), max(-y, 0, y - 2)
    return math.hypot(dx, dy) if dx or dy else min(x, 3 - x, y, 2 - y)


def test_any_distance(spark, cases, walls):
    rng = np.random.default_rng(2)
    rows = [("box", k, *map(float, rng.uniform(-1, 4, 2))) for k in range(300)] + [("box", 300 + k, *map(float, 10.0 ** rng.uniform(1, 6) * rng.normal(size=2))) for k in range(60)]
    rows += [("ring", 1000 + k, *map(float, rng.uniform(-2, 2, 2))) for k in range(300)] + [("ring", 1400, 0.0, 0.0), ("ring", 1401, 500.0, 0.0)]
    points = spark.createDataFrame(rows, POINTS).repartition(3)
    got = {r.pid: r for r in nearest_wall_any(points, walls, cases).collect()}
    assert len(got) == len(rows)
    for case, pid, x, y in rows:
        want = box_distance(x, y) if case == "box" else min(abs(math.hypot(x, y) - 0.5), abs(math.hypot(x, y) - 1.5))
        assert got[pid].dist == pytest.approx(want, rel=1e-5, abs=2e-4), (case, x, y)
        assert math.hypot(got[pid].wx - x, got[pid].wy - y) == pytest.approx(got[pid].dist, abs=1e-9) and got[pid].case == case


def test_agrees_with_the_limited_search(spark, cases, walls):
    rng = np.random.default_rng(3)
    rows = [(c, k, *map(float, rng.uniform(-0.3, 2.3, 2))) for k in range(250) for c in ("box", "ring")]
    points = spark.createDataFrame(rows, POINTS).repartition(4)
    for snap in (False, True):
        near = {(r.case, r.pid): r for r in nearest_wall(points, walls, cases, 0.4, snap=snap).collect()}
        far = {(r.case, r.pid): r for r in nearest_wall_any(points, walls, cases, snap=snap).collect()}
        assert len(far) == len(rows) and 0 < len(near) < len(far)
        for k, a in near.items():
            b = far[k]
            assert (a.elem, a.side, a.node) == (b.elem, b.side, b.node) and all(abs(a[c] - b[c]) < 1e-12 for c in ("t", "wx", "wy", "nx", "ny", "dist"))


def test_graded_edges(spark):
    """Tiny edges beside huge ones: both are found from far and near."""
    small = gen.box(spark, 40, 2, 4, (0, 0.01), (0, 0.001), case="g")
    large = gen.box(spark, 2, 2, 4, (50, 250), (0, 200), case="g").withColumn("elem", F.col("elem") + 1000)
    mesh = checkpointed(small.unionByName(large))
    edges = checkpointed(bd.external_edges(mesh))
    points = spark.createDataFrame([("g", 1, 0.005, 0.0015), ("g", 2, -1000.0, 0.0), ("g", 3, 1000.0, 100.0), ("g", 4, 30.0, 50.0), ("g", 5, 20.0, 0.0005)], POINTS)
    got = {r.pid: r for r in nearest_wall_any(points, edges, mesh).collect()}
    assert got[1].dist == pytest.approx(0.0005, abs=1e-9) and got[2].dist == pytest.approx(1000) and got[3].dist == pytest.approx(750) and got[4].dist == pytest.approx(20)
    assert got[5].dist == pytest.approx(19.99) and got[5].elem < 1000 and got[4].elem >= 1000


def test_odd_points(spark, cases, walls):
    rows = [("box", 1, 1.0, 1.5), ("box", 1, 1.0, 1.5), ("box", 2, float("nan"), 0.0), ("box", 3, float("inf"), 0.0), ("box", 4, None, 0.0), ("nowhere", 5, 0.0, 0.0), (None, 6, 0.0, 0.0), ("box", None, 1.0, 0.25)]
    got = nearest_wall_any(spark.createDataFrame(rows, POINTS), walls, cases).collect()
    assert sorted((str(r.pid), round(r.dist, 9)) for r in got) == [("1", 0.5), ("1", 0.5), ("None", 0.25)]
    assert nearest_wall_any(spark.createDataFrame([], POINTS), walls, cases).count() == 0
    assert nearest_wall_any(spark.createDataFrame(rows, POINTS), walls.limit(0), cases).count() == 0


def test_far_groups_meet_few_edges(spark, monkeypatch):
    """A long wall: a point far away is compared with edges around its foot only, not with all of them."""
    import quadfield.operators.nearest as nearest

    mesh = checkpointed(gen.box(spark, 2000, 1, 3, (0, 2000), (0, 1), case="w"))
    edges = checkpointed(bd.external_edges(mesh).where("side = 2"))
    seen = []

    def counted(df):
        out = checkpointed(df)
        if "wall" in out.columns and "_gx0" in out.columns:
            seen.append(out)
        return out

    monkeypatch.setattr(nearest, "checkpointed", counted)
    points = spark.createDataFrame([("w", k, 37.3 * k, 3.0 + k % 3 * 20.0) for k in range(50)], POINTS)
    got = nearest.nearest_wall_any(points, edges, mesh).collect()
    assert all(r.dist == pytest.approx(2.0 + r.pid % 3 * 20.0) and r.elem == int(37.3 * r.pid) for r in got)
    per = seen[-1].where("wall is not null").groupBy("_g").count().agg(F.max("count")).first()[0]
    assert per <= 60 and all("SortAggregate" not in s._jdf.queryExecution().toString() for s in seen)
