import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadfield.functions import expressions as ex
from quadfield.functions import ieee, kernels
from quadfield.operators import fields, layout, resampling
from quadfield.sources import generators as gen

NAN, INF = float("nan"), float("inf")


def arrays(df, *names):
    rows = df.orderBy("elem").select(*names).collect()
    return [np.array([r[k] for r in rows]) for k in range(len(names))]


def test_box_has_a_constant_metric(spark):
    m = layout.with_metric(gen.box(spark, 3, 2, 5, (0, 3), (0, 1)))
    jac, rx = arrays(m, "jac", "rx")
    assert np.allclose(jac, 0.125) and np.allclose(rx, 2.0)


def test_generator_order_and_ids(spark):
    rows = gen.box(spark, 3, 2, 5, (0, 3), (0, 1)).orderBy("elem").collect()
    assert [r.gid for r in rows] == [1, 2, 3, 4, 5, 6]
    assert rows[4].x[0] == pytest.approx(1.0) and rows[4].y[0] == pytest.approx(0.5)


def test_vorticity_on_curved_elements(spark):
    d = gen.taylor_green(gen.wavy_box(spark, 8, 4, 10, 0.05))
    d = fields.with_fields(d, {"vort": ex.dx("v") - ex.dy("u")})
    x, y, vort = arrays(d, "x", "y", "vort")
    assert np.abs(vort - 2 * math.pi * np.sin(math.pi * x) * np.sin(math.pi * y)).max() < 1e-4


def test_higher_and_mixed_derivatives(spark):
    d = gen.analytic_field(gen.box(spark, 3, 2, 7, (0, 3), (0, 1)), "f", lambda x, y: x ** 3 * y ** 2)
    d = fields.with_fields(d, {"xx": ex.dx("f", 2), "xy": ex.dx(ex.dy("f")), "yyy": ex.dy("f", 3), "zero": ex.dx(ex.constant(3.0) * 2)})
    x, y, xx, xy, yyy, zero = arrays(d, "x", "y", "xx", "xy", "yyy", "zero")
    assert np.abs(xx - 6 * x * y ** 2).max() < 1e-9
    assert np.abs(xy - 6 * x ** 2 * y).max() < 1e-9
    assert np.abs(yyy).max() < 1e-9 and not zero.any()


def test_metric_columns_are_computed_where_missing(spark):
    d = gen.analytic_field(gen.box(spark, 2, 2, 5), "f", lambda x, y: x)
    a = fields.with_fields(layout.with_metric(d), {"g": ex.dx("f")})
    b = fields.with_fields(d, {"g": ex.dx("f")})
    assert np.allclose(*[arrays(k, "g")[0] for k in (a, b)])


def test_definitions_are_checked():
    d = fields.Definitions(["u", "v"])
    d.define("speed", ex.call("sqrt", ex.field("u") ** 2 + ex.field("v") ** 2))
    d.define("twice", 2 * ex.field("speed"))
    assert d.available() == ["u", "v", "speed", "twice"] and d.levels() == [["speed"], ["twice"]]
    for name, expr in [("u", "v"), ("sin", "v"), ("x", "v"), ("2a", "v"), ("", "v"), ("a-b", "v"), ("w", "nothing"), ("speed", "twice"), ("self", "self")]:
        with pytest.raises(fields.DefinitionError):
            d.define(name, expr)
    assert d.levels() == [["speed"], ["twice"]]
    with pytest.raises(fields.DefinitionError):
        d.undefine("speed")
    with pytest.raises(KeyError):
        d.undefine("nope")
    d.define("speed", "u")  # redefinition
    d.undefine("twice")
    d.undefine("speed")
    for bad in (True, "text"):
        with pytest.raises(ValueError):
            ex.Constant(bad)
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            ex.dx("u", bad)
    with pytest.raises(ValueError):
        ex.call("sinc", "u")
    with pytest.raises(ValueError):
        ex.call("atan2", "u")


def test_cycles_and_unknown_fields(spark):
    m = gen.analytic_field(gen.box(spark, 1, 1, 3), "u", lambda x, y: x)
    with pytest.raises(fields.DefinitionError):
        fields.with_fields(m, {"a": ex.field("b") + 1, "b": ex.field("a") + 1})
    with pytest.raises(KeyError):
        fields.select_field(m, "q")
    assert layout.field_names(m) == ["u"]


def test_ieee_table(spark):
    rows = [(a, b) for a in (-7.0, -1.0, -0.0, 0.0, 0.5, 1.0, 7.0, INF, -INF, NAN) for b in (-3.0, -0.0, 0.0, 0.5, 3.0, INF, -INF, NAN)]
    df = spark.createDataFrame(rows, "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", ieee.div(a, b), ieee.mod(a, b), ieee.power(a, b), ieee.minimum(a, b), ieee.maximum(a, b), ieee.log(a), ieee.log10(a), F.sqrt(a), F.asin(a), F.signum(a), ieee.atan2(a, b)).collect()
    with np.errstate(all="ignore"):
        for r in got:
            u, v = np.float64(r[0]), np.float64(r[1])
            want = [u / v, np.mod(u, v), np.power(u, v), np.minimum(u, v), np.maximum(u, v), np.log(u), np.log10(u), np.sqrt(u), np.arcsin(u), np.sign(u), np.arctan2(u, v)]
            if u == -INF and v == 0.5:
                want[2] = np.float64(INF)  # the C rule; NumPy takes a square root for a constant 0.5
            for k, w in enumerate(want):
                assert np.isclose(r[2 + k], w, rtol=1e-14, equal_nan=True), (k, r[0], r[1], r[2 + k], w)


def test_calculator_functions_match_numpy(spark):
    m = gen.analytic_field(gen.box(spark, 2, 1, 4), "u", lambda x, y: x - 0.7)
    for name, fn in {"sqrt": np.sqrt, "exp": np.exp, "log": np.log, "abs": np.abs, "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan, "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh}.items():
        m = m.withColumn(name, ex.call(name, "u").array_column())
    u, = arrays(m, "u")
    with np.errstate(all="ignore"):
        for name, fn in {"sqrt": np.sqrt, "exp": np.exp, "log": np.log, "abs": np.abs, "sin": np.sin, "tan": np.tan, "asin": np.arcsin, "cosh": np.cosh, "tanh": np.tanh}.items():
            assert np.allclose(arrays(m, name)[0], fn(u), equal_nan=True), name


def test_node_and_element_expressions_agree(spark):
    m = gen.analytic_field(gen.wavy_box(spark, 2, 2, 4), "u", lambda x, y: x - y)
    e = (ex.field("u") / ex.field("x") + ex.field("y") ** 2) % 0.3 - ex.call("max", "u", 0.1)
    a = layout.to_nodes(m.select("elem", e.array_column().alias("v")))
    b = layout.to_nodes(m.select("elem", "x", "y", "u")).select("elem", "j", "i", e.node_column().alias("w"))
    bad = a.join(b, ["elem", "j", "i"]).where(~(F.abs(F.col("v") - F.col("w")) < 1e-14) & ~(F.isnan("v") & F.isnan("w")))
    assert bad.count() == 0
    with pytest.raises(ValueError):
        ex.dx("u").node_column()


def test_add_field_checks_the_shape(spark):
    m = gen.box(spark, 2, 1, 3).select("case", "elem", "x", "y")
    good = m.select("case", "elem", F.col("x").alias("f"))
    assert fields.add_field(m, good, "f").where("size(f) = 9").count() == 2
    bad = m.select("case", "elem", F.slice("x", 1, 4).alias("f"))
    with pytest.raises(Exception, match="shape of the mesh"):
        fields.add_field(m, bad, "f").collect()
    with pytest.raises(Exception, match="shape of the mesh"):
        fields.add_field(m, good.where("elem = 0"), "f").collect()


def test_ranges(spark):
    m = gen.analytic_field(gen.box(spark, 2, 2, 4), "u", lambda x, y: F.ln(x))  # NULL at x = 0
    m = m.withColumn("u", ex.call("log", "x").array_column()).withColumn("c", F.array_repeat(F.lit(2.0), 16)).withColumn("none", F.array_repeat(F.lit(NAN), 16))
    r = {k.field: (k.lo, k.hi) for k in fields.field_range(m, ["u", "c", "none"]).collect()}
    assert r["none"] == (0.0, 1.0) and r["c"] == (2.0, 2.0) and np.isfinite(r["u"][0])
    v = fields.view_range(m, "c", (0, 1), (0, 1)).first()
    assert (v.lo, v.hi) == (1.5, 2.5)
    assert fields.view_range(m, "none", (0, 1), (0, 1)).count() == 0


def test_resample_kinds_and_modes(spark):
    m = gen.analytic_field(gen.box(spark, 2, 1, 6, (0, 2), (0, 1)), "f", lambda x, y: x ** 3 - x * y ** 2)
    for kind in ("uniform", "gll", "cell_centers"):
        x, y, f = arrays(resampling.resample(m, ["f"], 9, kind), "x", "y", "f")
        assert f.shape == (2, 81) and np.abs(f - (x ** 3 - x * y ** 2)).max() < 1e-12
    with pytest.raises(ValueError):
        kernels.resample("f", 3, "other")
    f, = arrays(resampling.modal(m, ["f"]), "f")
    assert np.abs(f.reshape(2, 6, 6)[:, :, 4:]).max() < 1e-12  # cubic in r


def test_mixed_orders_and_nulls_in_one_table(spark):
    a = gen.box(spark, 2, 1, 4, case="a").select("case", "elem", "x", "y")
    b = gen.box(spark, 2, 1, 7, case="b").select("case", "elem", "x", "y")
    hole = spark.createDataFrame([("c", 0)], "case string, elem long").select("case", "elem", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("array<double>").alias("y"))
    d = a.unionByName(b).unionByName(hole).coalesce(1)
    rows = layout.with_metric(d).collect()
    assert sorted(len(r.jac) if r.jac else 0 for r in rows) == [0, 16, 16, 49, 49]
    bad = a.select("case", "elem", "x", F.slice("y", 1, 9).alias("y"))
    with pytest.raises(Exception, match="different lengths"):
        layout.with_metric(bad).collect()


def test_layout_round_trip_does_not_depend_on_partitions(spark):
    m = gen.wavy_box(spark, 3, 2, 5)
    for parts in (1, 8):
        nd = layout.to_nodes(m.repartition(parts).select("case", "elem", "x", "y"))
        back = layout.to_elements(nd, ["case", "elem"], ["x", "y"])
        assert np.array_equal(arrays(back, "x", "y")[0], arrays(m, "x")[0])
