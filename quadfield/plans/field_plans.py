"""Layouts, derived fields, derivatives, resampling and aggregates on the embedding box."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadfield import basis
from quadfield.functions import expressions as ex
from quadfield.functions import ieee, kernels
from quadfield.operators import fields, layout, resampling
from quadfield.plans.registry import plan, rounded
from quadfield.plans.tables import BLOCK_SQL, BOX_X, BOX_Y, HEIGHT_SQL, N, N_BOX, WAVE, block_mesh, cell_mesh, height, nodes_sql, table, values
from quadfield.sources import generators

D = values("d", basis.derivative_matrix(N))


@plan("box_nodes", f"WITH {nodes_sql()} SELECT elem, j, i, round(x, 6) AS x, round(y, 6) AS y, round(f, 6) + 0.0 AS f FROM nd")
def box_nodes(spark, folder):
    nd = layout.to_nodes(cell_mesh(spark, folder).select("elem", "x", "y", "f"))
    return nd.select("elem", "j", "i", rounded("x").alias("x"), rounded("y").alias("y"), rounded("f").alias("f"))


@plan("layout_roundtrip", f"WITH {nodes_sql()} SELECT elem, count(*) AS nodes, round(sum(f * (j * {N} + i + 1)), 6) + 0.0 AS moment FROM nd GROUP BY elem")
def layout_roundtrip(spark, folder):
    nd = layout.to_nodes(cell_mesh(spark, folder).select("elem", "f"))
    back = layout.to_elements(nd, ["elem"], ["f"])
    moment = F.aggregate(F.transform("f", lambda v, p: v * (p + 1)), F.lit(0.0), lambda a, v: a + v)
    return back.select("elem", F.size("f").cast("long").alias("nodes"), rounded(moment).alias("moment"))


@plan("domain_bounds", f"WITH {nodes_sql(True)} SELECT round(min(x), 6) + 0.0 AS xmin, round(max(x), 6) AS xmax, round(min(y), 6) + 0.0 AS ymin, round(max(y), 6) AS ymax FROM nd")
def domain_bounds(spark, folder):
    b = fields.domain_bounds(cell_mesh(spark, folder, WAVE))
    return b.select(*[rounded(k).alias(k) for k in ("xmin", "xmax", "ymin", "ymax")])


@plan("elem_bounds", f"""WITH {nodes_sql(True)}, b AS (SELECT elem, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nd GROUP BY elem)
SELECT elem, round(x0 - 0.1 * (x1 - x0), 6) + 0.0 AS xmin, round(x1 + 0.1 * (x1 - x0), 6) + 0.0 AS xmax, round(y0 - 0.1 * (y1 - y0), 6) + 0.0 AS ymin, round(y1 + 0.1 * (y1 - y0), 6) + 0.0 AS ymax FROM b""")
def elem_bounds(spark, folder):
    b = layout.with_bbox(cell_mesh(spark, folder, WAVE), 0.1)
    return b.select("elem", *[rounded(k).alias(k) for k in ("xmin", "xmax", "ymin", "ymax")])


@plan("elem_centroid", f"WITH {nodes_sql(True)} SELECT elem, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM nd GROUP BY elem")
def elem_centroid(spark, folder):
    return cell_mesh(spark, folder, WAVE).select("elem", rounded(layout.centroid("x")).alias("cx"), rounded(layout.centroid("y")).alias("cy"))


_CORNERS = ", ".join(f"round(max(CASE WHEN j = {j} AND i = {i} THEN {c} END), 6) + 0.0 AS {c}{k}" for k, (j, i) in enumerate([(0, 0), (0, N - 1), (N - 1, 0), (N - 1, N - 1)]) for c in ("x", "y"))


@plan("elem_corners", f"WITH {nodes_sql(True)} SELECT elem, {_CORNERS} FROM nd GROUP BY elem")
def elem_corners(spark, folder):
    c = layout.corners(cell_mesh(spark, folder, WAVE))
    return c.select("elem", *[rounded(f"{k}{q}").alias(f"{k}{q}") for q in range(4) for k in ("x", "y")])


def _up(spark, folder, *shares):
    """Ends of a window that grows with the box."""
    return tuple(height(spark, folder) * s for s in shares)


@plan("nodes_in_window", f"WITH {nodes_sql(True)} SELECT elem, count(*) AS nodes, round(sum(f), 6) + 0.0 AS total FROM nd WHERE x BETWEEN 0.31 AND 1.27 AND y BETWEEN 0.22131 * {HEIGHT_SQL} AND 0.71317 * {HEIGHT_SQL} GROUP BY elem")
def nodes_in_window(spark, folder):
    nd = layout.to_nodes(cell_mesh(spark, folder, WAVE).select("elem", "x", "y", "f"))
    inside = layout.nodes_in_window(nd, "f", (0.31, 1.27), _up(spark, folder, 0.22131, 0.71317))
    return inside.groupBy("elem").agg(F.count(F.lit(1)).alias("nodes"), rounded(F.sum("f")).alias("total"))


@plan("field_range", f"""WITH {nodes_sql()}, r AS (SELECT f, CASE WHEN f > 0 THEN ln(f) END AS g FROM nd)
SELECT 'f' AS field, round(min(f), 6) AS lo, round(max(f), 6) AS hi FROM r UNION ALL SELECT 'g', round(min(g), 6), round(max(g), 6) FROM r""")
def field_range(spark, folder):
    # log of a negative value is NaN and of zero -inf: neither counts
    df = fields.with_fields(cell_mesh(spark, folder), {"g": ex.call("log", "f")})
    return fields.field_range(df, ["f", "g"]).select("field", rounded("lo").alias("lo"), rounded("hi").alias("hi"))


@plan("view_range", f"""WITH {nodes_sql(True)}, r AS (SELECT min(f) AS lo, max(f) AS hi, count(*) AS nodes FROM nd WHERE x BETWEEN 0.4 AND 0.9 AND y BETWEEN 0.30113 * {HEIGHT_SQL} AND 0.60331 * {HEIGHT_SQL})
SELECT 'plain' AS kind, round(lo, 6) AS lo, round(hi, 6) AS hi, nodes FROM r UNION ALL
SELECT 'symmetric', round(-greatest(abs(lo), abs(hi)), 6), round(greatest(abs(lo), abs(hi)), 6), nodes FROM r UNION ALL
SELECT 'flat', 1.5, 2.5, nodes FROM r""")
def view_range(spark, folder):
    df = fields.with_fields(cell_mesh(spark, folder, WAVE), {"two": ex.constant(2.0)})
    win = ((0.4, 0.9), _up(spark, folder, 0.30113, 0.60331))
    kinds = [("plain", "f", False), ("symmetric", "f", True), ("flat", "two", False)]
    out = None
    for kind, name, sym in kinds:
        r = fields.view_range(df, name, *win, symmetric=sym).select(F.lit(kind).alias("kind"), rounded("lo").alias("lo"), rounded("hi").alias("hi"), "nodes")
        out = r if out is None else out.unionByName(r)
    return out


@plan("jacobian_sign", f"WITH {BLOCK_SQL}, e AS (SELECT unnest(range({BOX_X * BOX_Y})) AS elem) SELECT c AS supplier, elem, CASE WHEN elem % 3 = 1 THEN -1 ELSE 1 END AS sign FROM blk, e")
def jacobian_sign(spark, folder):
    m = layout.with_metric(block_mesh(spark, folder).select("case", "elem", "x", "y"))
    return m.select(F.col("case").alias("supplier"), "elem", fields.jacobian_sign().alias("sign"))


# --------------------------------------------------------------------------- calculator
@plan("calc_pointwise", f"""WITH {nodes_sql(True)}, e AS (SELECT elem, sqrt(f * f + x * x) AS a, atan2(f, 1 + y) AS b, exp(-abs(f)) * sin(pi() * x) AS c, greatest(f, y - 0.5) - least(f, x) AS m, pow(1 + abs(f), 1.5) AS q FROM nd)
SELECT elem, round(sum(a), 6) AS a, round(sum(b), 6) + 0.0 AS b, round(sum(c), 6) + 0.0 AS c, round(sum(m), 6) + 0.0 AS m, round(sum(q), 6) AS q FROM e GROUP BY elem""")
def calc_pointwise(spark, folder):
    f, x, y = ex.field("f"), ex.field("x"), ex.field("y")
    df = fields.with_fields(cell_mesh(spark, folder, WAVE), {
        "a": ex.call("sqrt", f ** 2 + x ** 2), "b": ex.call("atan2", f, 1 + y), "c": ex.call("exp", -ex.call("abs", f)) * ex.call("sin", ex.PI * x),
        "m": ex.call("max", f, y - 0.5) - ex.call("min", f, x), "q": ex.call("pow", 1 + ex.call("abs", f), 1.5),
    })
    total = lambda k: rounded(F.aggregate(k, F.lit(0.0), lambda s, v: s + v)).alias(k)
    return df.select("elem", *[total(k) for k in ("a", "b", "c", "m", "q")])


_UNARY = {
    "log10": "log10(1 + abs(f))", "sign": "sign(f)", "cos": "cos(f)", "tan": "tan(f)", "asin": "asin(tanh(f))", "acos": "acos(tanh(f))", "atan": "atan(f)",
    "sinh": "sinh(f)", "cosh": "cosh(f)", "tanh": "tanh(f)", "log": "ln(exp(1) + abs(f))",
}


@plan("calc_unary", f"WITH {nodes_sql()} " + " UNION ALL ".join(f"SELECT '{k}' AS fn, elem, round(sum({v}), 6) + 0.0 AS total FROM nd GROUP BY elem" for k, v in _UNARY.items()))
def calc_unary(spark, folder):
    """The one-argument functions that no other analysis uses, and the constant e."""
    f = ex.field("f")
    inner = {"log10": 1 + ex.call("abs", f), "asin": ex.call("tanh", f), "acos": ex.call("tanh", f), "log": ex.EULER + ex.call("abs", f)}
    df = fields.with_fields(cell_mesh(spark, folder), {f"c_{k}": ex.call(k, inner.get(k, f)) for k in _UNARY})
    total = lambda k: rounded(F.aggregate(k, F.lit(0.0), lambda s, v: s + v))
    return df.select("elem", F.inline(F.array(*[F.struct(F.lit(k).alias("fn"), total(f"c_{k}").alias("total")) for k in _UNARY])))


@plan("select_fields", f"""WITH {nodes_sql(True)}, t AS (SELECT elem, sum(f) AS f, sum(2 * f + x) AS g, sum(x) AS x, sum(f + y) AS sum FROM nd GROUP BY elem)
SELECT elem, name, round(total, 6) + 0.0 AS total FROM (UNPIVOT t ON f, g, x, sum INTO NAME name VALUE total)""")
def select_fields(spark, folder):
    """All listed fields of a case, a coordinate, and an expression, picked by name."""
    df = fields.with_fields(cell_mesh(spark, folder, WAVE).select("case", "elem", "x", "y", "f"), {"g": 2 * ex.field("f") + ex.field("x")})
    picks = {k: k for k in layout.field_names(df)} | {"x": "x", "sum": ex.field("f") + ex.field("y")}
    total = lambda k: rounded(F.aggregate(fields.select_field(df, k), F.lit(0.0), lambda s, v: s + v))
    return df.select("elem", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), total(v).alias("total")) for k, v in picks.items()])))


_MAPS_SQL = {
    "box": ("2 * a", "b"), "annulus": ("(0.5 + a) * cos(2 * pi() * b)", "(0.5 + a) * sin(2 * pi() * b)"),
    "wavy": ("2 * a + 0.08 * sin(2 * pi() * b) * sin(pi() * a)", "b + 0.08 * sin(2 * pi() * a) * sin(pi() * b)"),
}


@plan("mesh_maps", f"""WITH {values('g4', basis.nodes(4))}, u AS (SELECT vec_id AS elem, (vec_id % 8 + (gi.v + 1) / 2) / 8 AS a, (vec_id // 8 % 6 + (gj.v + 1) / 2) / 6 AS b FROM embeddings, g4 gi, g4 gj)
""" + " UNION ALL ".join(f"SELECT '{k}' AS map, elem, round(sum({x}), 6) + 0.0 AS sx, round(sum({y}), 6) + 0.0 AS sy FROM u GROUP BY elem" for k, (x, y) in _MAPS_SQL.items()))
def mesh_maps(spark, folder):
    """Rows of a table as elements of a box, an annulus and a wavy box."""
    cells = table(spark, folder, "embeddings").select(F.col("vec_id").alias("elem"), (F.col("vec_id") % 8).alias("ex"), (F.floor(F.col("vec_id") / 8) % 6).alias("ey"))
    total = lambda k: rounded(F.aggregate(k, F.lit(0.0), lambda s, v: s + v))
    out = None
    for name, mapping in (("box", generators.box_map()), ("annulus", generators.annulus_map()), ("wavy", generators.wavy_map())):
        m = generators.place(cells, 8, 6, 4, mapping, ["elem"]).select(F.lit(name).alias("map"), "elem", total("x").alias("sx"), total("y").alias("sy"))
        out = m if out is None else out.unionByName(m)
    return out


_IEEE_IN = "SELECT l_returnflag AS flag, CAST(l_linenumber - 4 AS DOUBLE) AS a, CAST(l_partkey % 7 - 3 AS DOUBLE) AS b FROM lineitem"
_IEEE = {
    "div": "CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN 'nan' WHEN a > 0 THEN 'inf' ELSE '-inf' END ELSE 'fin' END",
    "log": "CASE WHEN a < 0 THEN 'nan' WHEN a = 0 THEN '-inf' ELSE 'fin' END",
    "mod": "CASE WHEN b = 0 THEN 'nan' ELSE 'fin' END",
    "pow": "CASE WHEN a < 0 THEN 'nan' WHEN a = 0 AND b < 0 THEN 'inf' ELSE 'fin' END",
    "min": "CASE WHEN a < 0 THEN 'nan' ELSE 'fin' END",
}
_IEEE_VALUE = {
    "div": "a / nullif(b, 0)", "log": "CASE WHEN a > 0 THEN ln(a) END", "mod": "a - b * floor(a / nullif(b, 0))",
    "pow": "CASE WHEN a > 0 OR (a = 0 AND b >= 0) THEN pow(a, b + 0.5) END", "min": "CASE WHEN a >= 0 THEN least(sqrt(a), b) END",
}


@plan("calc_ieee_edge", f"WITH r AS ({_IEEE_IN}) " + " UNION ALL ".join(
    f"SELECT flag, '{k}' AS fn, {_IEEE[k]} AS kind, count(*) AS n, coalesce(round(sum({_IEEE_VALUE[k]}), 6) + 0.0, 0.0) AS total FROM r GROUP BY 1, 2, 3" for k in _IEEE))
def calc_ieee_edge(spark, folder):
    r = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_linenumber") - 4).cast("double").alias("a"), (F.col("l_partkey") % 7 - 3).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    fns = {"div": ieee.div(a, b), "log": ieee.log(a), "mod": ieee.mod(a, b), "pow": ieee.power(a, b + 0.5), "min": ieee.minimum(F.sqrt(a), b)}
    rows = r.select("flag", F.inline(F.array(*[F.struct(F.lit(k).alias("fn"), v.alias("v")) for k, v in fns.items()])))
    kind = F.when(F.isnan("v"), "nan").when(F.col("v") == ieee.INF, "inf").when(F.col("v") == -ieee.INF, "-inf").otherwise("fin")
    total = F.coalesce(rounded(F.sum(F.when(ieee.is_finite(F.col("v")), F.col("v")))), F.lit(0.0))
    return rows.groupBy("flag", "fn", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@plan("definition_chain", f"""WITH {nodes_sql()}, e AS (SELECT elem, f * f + 1 AS en, 2 * (f * f + 1) - f AS mix, 7.5 AS c FROM nd)
SELECT elem, round(sum(en), 6) AS en, round(sum(mix), 6) + 0.0 AS mix, round(sum(mix * c / en), 6) + 0.0 AS ratio FROM e GROUP BY elem""")
def definition_chain(spark, folder):
    # given in the wrong order on purpose
    f = ex.field
    df = fields.with_fields(cell_mesh(spark, folder), {"ratio": f("mix") * f("c") / f("en"), "mix": 2 * f("en") - f("f"), "en": f("f") ** 2 + 1, "c": ex.constant(7.5)})
    total = lambda k: rounded(F.aggregate(k, F.lit(0.0), lambda s, v: s + v)).alias(k)
    return df.select("elem", total("en"), total("mix"), total("ratio"))


@plan("add_field", "WITH r AS (SELECT vec_id AS elem, list_sum(list_transform(embedding, lambda v: v::DOUBLE * 2)) AS s FROM embeddings) SELECT elem, round(s, 6) + 0.0 AS total FROM r")
def add_field(spark, folder):
    m = cell_mesh(spark, folder).drop("f")
    extra = table(spark, folder, "embeddings").select(F.lit("emb").alias("case"), F.col("vec_id").alias("elem"), F.transform("embedding", lambda v: v.cast("double") * 2).alias("twice"))
    df = fields.add_field(m, extra, "twice")
    return df.select("elem", rounded(F.aggregate("twice", F.lit(0.0), lambda s, v: s + v)).alias("total"))


# --------------------------------------------------------------------------- derivatives
@plan("deriv_ref", f"""WITH {nodes_sql()}, {D},
r AS (SELECT n.elem, n.j, d.a AS i, sum(d.v * n.f) AS dr FROM nd n JOIN d ON d.b = n.i GROUP BY ALL),
s AS (SELECT n.elem, d.a AS j, n.i, sum(d.v * n.f) AS ds FROM nd n JOIN d ON d.b = n.j GROUP BY ALL)
SELECT elem, j, i, round(dr, 5) + 0.0 AS dr, round(ds, 5) + 0.0 AS ds FROM r JOIN s USING (elem, j, i)""")
def deriv_ref(spark, folder):
    df = cell_mesh(spark, folder).select("elem", kernels.reference_derivatives("f").alias("g")).select("elem", "g.dr", "g.ds")
    nd = layout.to_nodes(df)
    return nd.select("elem", "j", "i", rounded("dr", 5).alias("dr"), rounded("ds", 5).alias("ds"))


_METRIC_SQL = f"""WITH {nodes_sql(True)}, {D},
r AS (SELECT n.elem, n.j, d.a AS i, sum(d.v * n.x) AS xr, sum(d.v * n.y) AS yr, sum(d.v * n.f) AS fr FROM nd n JOIN d ON d.b = n.i GROUP BY ALL),
s AS (SELECT n.elem, d.a AS j, n.i, sum(d.v * n.x) AS xs, sum(d.v * n.y) AS ys, sum(d.v * n.f) AS fs FROM nd n JOIN d ON d.b = n.j GROUP BY ALL),
m AS (SELECT *, xr * ys - xs * yr AS jac FROM r JOIN s USING (elem, j, i))"""


@plan("metric_terms", _METRIC_SQL + " SELECT elem, j, i, round(jac, 8) AS jac, round(ys / jac, 5) AS rx, round(-xs / jac, 5) + 0.0 AS ry, round(-yr / jac, 5) + 0.0 AS sx, round(xr / jac, 5) AS sy FROM m")
def metric_terms(spark, folder):
    nd = layout.to_nodes(layout.with_metric(cell_mesh(spark, folder, WAVE).select("elem", "x", "y")), ["jac", "rx", "ry", "sx", "sy"])
    return nd.select("elem", "j", "i", rounded("jac", 8).alias("jac"), *[rounded(k, 5).alias(k) for k in ("rx", "ry", "sx", "sy")])


@plan("grad_phys", _METRIC_SQL + " SELECT elem, j, i, round((fr * ys - fs * yr) / jac, 4) + 0.0 AS fx, round((fs * xr - fr * xs) / jac, 4) + 0.0 AS fy FROM m")
def grad_phys(spark, folder):
    df = fields.with_fields(cell_mesh(spark, folder, WAVE), {"fx": ex.dx("f"), "fy": ex.dy("f")})
    nd = layout.to_nodes(df.select("elem", "fx", "fy"))
    return nd.select("elem", "j", "i", rounded("fx", 4).alias("fx"), rounded("fy", 4).alias("fy"))


@plan("deriv2", f"""WITH {nodes_sql()}, {D}, d2 AS (SELECT p.a, q.b, sum(p.v * q.v) AS v FROM d p JOIN d q ON q.a = p.b GROUP BY ALL),
xx AS (SELECT n.elem, n.j, d2.a AS i, sum(d2.v * n.f) * {(2 / 0.08) ** 2!r} AS fxx FROM nd n JOIN d2 ON d2.b = n.i GROUP BY ALL),
x1 AS (SELECT n.elem, n.j, d.a AS i, sum(d.v * n.f) * {2 / 0.08!r} AS fx FROM nd n JOIN d ON d.b = n.i GROUP BY ALL),
xy AS (SELECT n.elem, d.a AS j, n.i, sum(d.v * n.fx) * {2 / 0.05!r} AS fxy FROM x1 n JOIN d ON d.b = n.j GROUP BY ALL)
SELECT elem, j, i, round(fxx, 2) + 0.0 AS fxx, round(fxy, 2) + 0.0 AS fxy FROM xx JOIN xy USING (elem, j, i)""")
def deriv2(spark, folder):
    df = fields.with_fields(cell_mesh(spark, folder), {"fxx": ex.dx("f", 2), "fxy": ex.dy(ex.dx("f"))})
    nd = layout.to_nodes(df.select("elem", "fxx", "fxy"))
    return nd.select("elem", "j", "i", rounded("fxx", 2).alias("fxx"), rounded("fxy", 2).alias("fxy"))


@plan("vorticity_tg", f"WITH {nodes_sql(True)} SELECT elem, j, i, round(2 * pi() * sin(pi() * x) * sin(pi() * y), 5) + 0.0 AS vort FROM nd")
def vorticity_tg(spark, folder):
    from quadfield.sources.generators import taylor_green

    df = fields.with_fields(taylor_green(cell_mesh(spark, folder, WAVE)), {"vort": ex.dx("v") - ex.dy("u")})
    return layout.to_nodes(df.select("elem", "vort")).select("elem", "j", "i", rounded("vort", 5).alias("vort"))


# --------------------------------------------------------------------------- resampling
def _tensor_sql(matrix, m: int, tail: str) -> str:
    return f"""WITH {nodes_sql()}, {values('w', matrix)},
h AS (SELECT n.elem, n.j, w.a AS i, sum(w.v * n.f) AS f FROM nd n JOIN w ON w.b = n.i GROUP BY ALL),
o AS (SELECT h.elem, w.a AS j, h.i, sum(w.v * h.f) AS f FROM h JOIN w ON w.b = h.j GROUP BY ALL) {tail}"""


def _resampled(kind: str, m: int):
    def run(spark, folder):
        df = resampling.resample(cell_mesh(spark, folder), ["f"], m, kind).select("elem", "f")
        return layout.to_nodes(df).select("elem", "j", "i", rounded("f").alias("f"))

    return run


for _name, _kind, _m in (("resample_uniform", "uniform", 11), ("resample_gll", "gll", 5), ("resample_cells", "cell_centers", 6)):
    plan(_name, _tensor_sql(basis.resample_matrix(N, _m, _kind), _m, "SELECT elem, j, i, round(f, 6) + 0.0 AS f FROM o"))(_resampled(_kind, _m))


@plan("tensor_apply", _tensor_sql(basis.derivative_matrix(N), N, "SELECT elem, j, i, round(f, 4) + 0.0 AS f FROM o"))
def tensor_apply(spark, folder):
    df = cell_mesh(spark, folder).select("elem", kernels.tensor_apply("f", basis.derivative_matrix(N)).alias("f"))
    return layout.to_nodes(df).select("elem", "j", "i", rounded("f", 4).alias("f"))


@plan("modal_decay", _tensor_sql(basis.modal_matrix(N), N, f"""SELECT elem, round(sum(CASE WHEN i = {N - 1} OR j = {N - 1} THEN f * f ELSE 0 END) / sum(f * f), 6) + 0.0 AS tail, round(max(CASE WHEN i = 0 AND j = 0 THEN f END), 6) + 0.0 AS mean_mode FROM o GROUP BY elem"""))
def modal_decay(spark, folder):
    df = resampling.modal(cell_mesh(spark, folder), ["f"])
    return df.select("elem", rounded(resampling.modal_decay("f", N)).alias("tail"), rounded(F.get("f", F.lit(0))).alias("mean_mode"))
