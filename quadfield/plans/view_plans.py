"""Level-of-detail tables of the bent embedding box."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadfield.operators import lod
from quadfield.operators.layout import visible, with_bbox
from quadfield.operators.scans import shared_folder
from quadfield.plans.registry import plan, rounded
from quadfield.plans.tables import HEIGHT_SQL, WAVE, cell_mesh, height, nodes_sql
from quadfield.sources import cases
from quadfield.sources.generators import analytic_field

#: the window: data units across, shares of the box's height up, so that it grows with the box
XLIM, YSHARE = (0.413, 1.307), (0.21321, 0.77731)
SCALE = (310.0, 190.0)

_BOX = f"WITH {nodes_sql(True)}, b AS (SELECT elem, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nd GROUP BY elem)"
_SEEN = f"x1 >= {XLIM[0]} AND x0 <= {XLIM[1]} AND y1 >= {YSHARE[0]} * {HEIGHT_SQL} AND y0 <= {YSHARE[1]} * {HEIGHT_SQL}"
_LEVEL = f"least(64, greatest(2, ceil(greatest((x1 - x0) * {SCALE[0]}, (y1 - y0) * {SCALE[1]}) / 3)))::INT"
_POWER = "(list_value(2, 4, 8, 16, 32, 64))[(least(5, greatest(0, ceil(log2(greatest(greatest(x1 - x0, y1 - y0) * 900 / 6.0, 1))) - 1)) + 1)::INT]"


def _up(spark, folder):
    return tuple(height(spark, folder) * s for s in YSHARE)


@plan("visible_elements", f"{_BOX} SELECT elem FROM b WHERE {_SEEN}")
def visible_elements(spark, folder):
    return visible(with_bbox(cell_mesh(spark, folder, WAVE)), XLIM, _up(spark, folder)).select("elem")


ACROSS, UP = (0.3137, 0.6241), (0.4113, 0.5527)


@plan("visible_stored", f"""{_BOX}, d AS (SELECT min(x0) AS l, max(x1) - min(x0) AS w, min(y0) AS t, max(y1) - min(y0) AS h FROM b)
SELECT elem, round(x0, 6) + 0.0 AS xmin, round(y1, 6) + 0.0 AS ymax FROM b, d WHERE x1 >= l + w * {ACROSS[0]} AND x0 <= l + w * {ACROSS[1]} AND y1 >= t + h * {UP[0]} AND y0 <= t + h * {UP[1]}""")
def visible_stored(spark, folder):
    """The bent box stored along a curve; a window that grows with the domain reads only the row groups it touches."""
    out = f"{shared_folder(spark)}/mesh-{uuid.uuid4().hex}"
    cases.write_mesh(cell_mesh(spark, folder, WAVE).select("case", "elem", "gid", "n", "x", "y"), out)
    seen = cases.read_window(spark, out, *cases.window_of(spark, out, ACROSS, UP), ["elem", "xmin", "ymax"])
    return seen.select("elem", rounded("xmin").alias("xmin"), rounded("ymax").alias("ymax"))


@plan("lod_level", f"{_BOX} SELECT elem, {_LEVEL} AS spectral, greatest(4, least(64, greatest(2, ceil(greatest((x1 - x0) * {SCALE[0]}, (y1 - y0) * {SCALE[1]}) / 1.5))))::INT AS contour, {_POWER} AS power FROM b")
def lod_level(spark, folder):
    b = with_bbox(cell_mesh(spark, folder, WAVE))
    return b.select("elem", lod.lod_level(SCALE).alias("spectral"), lod.contour_level(SCALE).alias("contour"), lod.lod_power(900.0).alias("power"))


def _view(spark, folder):
    # polynomial data on the straight box, so that every vertex has a closed form
    mesh = analytic_field(cell_mesh(spark, folder), "q", lambda x, y: x * x * y + 3 * y)
    return lod.lod_elements(mesh, XLIM, _up(spark, folder), lod.lod_level(SCALE))


_FLAT = f"WITH {nodes_sql()}, b AS (SELECT elem, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nd GROUP BY elem), s AS (SELECT *, {_LEVEL} AS m FROM b WHERE {_SEEN})"


@plan("surface_vertices", f"{_FLAT}, v AS (SELECT elem, m, a, x0 + (x1 - x0) * (a % (m + 1)) / m AS x, y0 + (y1 - y0) * (a // (m + 1)) / m AS y FROM (SELECT *, unnest(range((m + 1) * (m + 1))) AS a FROM s)) SELECT elem, m, a, round(x, 6) AS x, round(y, 6) AS y, round(x * x * y + 3 * y, 6) AS q FROM v")
def surface_vertices(spark, folder):
    v = lod.lod_vertices(_view(spark, folder), ["q"])
    return v.select("elem", "m", F.col("a").cast("long").alias("a"), *[rounded(k).alias(k) for k in ("x", "y", "q")])


@plan("surface_triangles", f"{_FLAT}, t AS (SELECT elem, m, unnest(range(2 * m * m)) AS tri FROM s), c AS (SELECT *, (tri // 2) // m * (m + 1) + (tri // 2) % m AS a FROM t) SELECT elem, tri, a AS v0, CASE WHEN tri % 2 = 0 THEN a + 1 ELSE a + m + 2 END AS v1, CASE WHEN tri % 2 = 0 THEN a + m + 2 ELSE a + m + 1 END AS v2 FROM c")
def surface_triangles(spark, folder):
    t = lod.lod_triangles(_view(spark, folder))
    return t.select("elem", *[F.col(k).cast("long").alias(k) for k in ("tri", "v0", "v1", "v2")])


_ALONG = "CASE side WHEN 0 THEN (k / 8.0) WHEN 1 THEN 1.0 WHEN 2 THEN 1 - k / 8.0 ELSE 0.0 END"
_UP = "CASE side WHEN 0 THEN 0.0 WHEN 1 THEN k / 8.0 WHEN 2 THEN 1.0 ELSE 1 - k / 8.0 END"


@plan("edge_polylines", f"{_FLAT}, l AS (SELECT elem, side, k, x0 + (x1 - x0) * ({_ALONG}) AS x, y0 + (y1 - y0) * ({_UP}) AS y FROM s, unnest(range(4)) AS a(side), unnest(range(9)) AS b(k)) SELECT elem, side, k, round(x, 6) AS x, round(y, 6) AS y FROM l")
def edge_polylines(spark, folder):
    p = lod.edge_polylines(_view(spark, folder))
    return p.select("elem", F.col("side").cast("long").alias("side"), F.col("k").cast("long").alias("k"), rounded("x").alias("x"), rounded("y").alias("y"))
