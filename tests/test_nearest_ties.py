"""Edges that are equally near: the one that holds the point's foot gets it."""

import pytest

from quadfield.operators import boundary as bd
from quadfield.operators.nearest import nearest_wall, nearest_wall_any
from quadfield.operators.scans import checkpointed
from quadfield.sources import generators as gen


@pytest.mark.parametrize("limit", [5.0, None])
def test_foot_beside_a_vertex(spark, limit):
    """Distances to two edges in line agree to 12 digits; the foot is 1e-8 off their common vertex."""
    mesh = checkpointed(gen.box(spark, 4, 1, 3, (0, 4), (0, 1), case="w"))
    top = bd.external_edges(mesh).where("side = 2")
    points = spark.createDataFrame([("w", 1, 2.0 + 1e-8, 4.0), ("w", 2, 2.0 - 1e-8, 4.0), ("w", 3, 2.0, 4.0), ("w", 4, 2.5, 4.0), ("w", 5, -1.0, 1.0)], "case string, pid long, x double, y double")
    got = (nearest_wall(points, top, mesh, limit) if limit else nearest_wall_any(points, top, mesh)).collect()
    assert {r.pid: r.elem for r in got} == {1: 2, 2: 1, 3: 2, 4: 2, 5: 0}
