import json
import os
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadfield.operators import lod, timeseries as ts
from quadfield.operators.layout import with_bbox
from quadfield.operators.locate import sample_lines
from quadfield.sources import cases, exports, fieldfiles as ff, generators as gen, probe_sets as ps


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Three steps of one case; a second file number and other names lie next to it."""
    d = tmp_path_factory.mktemp("case")
    m = gen.taylor_green(gen.annulus(spark, 2, 6, 6))
    for k in range(3):
        ff.write_field_file(m.withColumn("u", F.transform("u", lambda v: v + k)), str(d), "tg", k + 1, 0.5 * k).collect()
    (d / "tg0.f00009x").write_bytes(b"no")
    (d / "other0.f00001").write_bytes(b"no")
    (d / "tg.nek5000").write_text("filetemplate: %s%01d.f%05d\nfirsttimestep: 1\nnumtimesteps: 3\n")
    (d / "gap.nek5000").write_text("filetemplate: tg%01d.f%05d\nfirsttimestep: 2\nnumtimesteps: 5\n")
    return d, m


def names(df):
    return [os.path.basename(r.file) for r in df.orderBy("step").collect()]


def test_resolving_cases(spark, files, tmp_path):
    d, _ = files
    three = ["tg0.f00001", "tg0.f00002", "tg0.f00003"]
    assert names(ff.resolve_case(spark, f"{d}/tg0.f00002")) == three
    assert names(ff.resolve_case(spark, f"{d}/tg.nek5000")) == three
    assert names(ff.resolve_case(spark, f"{d}/tg0.f0000[12]")) == three[:2]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert names(ff.resolve_case(spark, f"{d}/gap.nek5000")) == three[1:]
    assert any("missing" in str(w.message) for w in seen)
    assert ff.resolve_case(spark, f"{d}/tg0.f00001").first().case == "tg"
    with pytest.raises(ValueError):
        ff.resolve_case(spark, str(d))  # two metafiles
    one = tmp_path / "one"
    one.mkdir()
    (one / "a.nek5000").write_text("filetemplate: nothing%01d.f%05d\n")
    with pytest.raises(FileNotFoundError):
        ff.resolve_case(spark, str(one))
    (one / "b.nek5000").write_text("no template here\n")
    with pytest.raises(ValueError):
        ff.resolve_case(spark, f"{one}/b.nek5000")
    for gone in ("missing0.f00001", "x*.f0"):
        with pytest.raises(FileNotFoundError):
            ff.resolve_case(spark, f"{d}/{gone}").collect()


def test_headers_and_data(spark, files):
    d, m = files
    steps = ff.read_steps_table(spark, f"{d}/tg0.f00001").orderBy("step").collect()
    assert [(r.step, r.time, r.nelv, r.n, r.has_mesh, r.variables) for r in steps] == [(k, 0.5 * k, 12, 6, True, "XUP") for k in range(3)]
    table = ff.read_steps_table(spark, f"{d}/tg0.f00001")
    assert ff.stored_names(table) == ["u", "v", "p"]
    got = ff.read_elements(table, ["u", "p", "absent"]).orderBy("step", "elem").collect()
    want = m.orderBy("elem").collect()
    assert len(got) == 36 and got[0].absent is None and got[3].gid == 4
    for r in got:
        assert np.abs(np.array(r.u) - np.array(want[r.elem].u) - r.step).max() < 1e-6
        assert np.abs(np.array(r.p) - np.array(want[r.elem].p)).max() < 1e-6
    xy = ff.read_mesh(table).orderBy("elem").collect()
    assert len(xy) == 12 and np.abs(np.array(xy[5].x) - np.array(want[5].x)).max() < 1e-6


def test_three_dimensional_files_are_refused(spark, tmp_path):
    head = f"#std 4  4  4  4 {1:10d} {1:10d} {0.0:20.13E} {0:9d} {0:6d} {1:6d} XUP"
    (tmp_path / "cube0.f00001").write_bytes(head.ljust(132).encode() + b"\0" * 5000)
    t = ff.read_steps_table(spark, f"{tmp_path}/cube0.f00001")
    assert t.first().lz == 4
    with pytest.raises(Exception, match="3-D"):
        ff.read_elements(t, ["u"]).collect()


def test_many_writers(spark, tmp_path):
    m = gen.analytic_field(gen.box(spark, 5, 4, 4), "q", lambda x, y: x + y)
    out = ff.write_field_file(m, str(tmp_path), "box", 7, 1.5, elements_per_file=6).collect()
    assert sorted((os.path.basename(r.file), r.elements) for r in out) == [("box0.f00007", 6), ("box1.f00007", 6), ("box2.f00007", 6), ("box3.f00007", 2)]
    for path in (f"{tmp_path}/box*.f00007", f"{tmp_path}/box2.f00007", f"file://{tmp_path}/box0.f00007"):
        t = ff.read_steps_table(spark, path)
        back = ff.read_elements(t, ["x", "y", "s0"])
        assert sorted((r.step, r.elem, r.gid) for r in back.collect()) == [(0, k, k + 1) for k in range(20)]
    gap = F.aggregate(F.zip_with("x", "y", lambda a, b: a + b), F.lit(0.0), lambda a, v: a + v) - F.aggregate("s0", F.lit(0.0), lambda a, v: a + v)
    assert back.agg(F.max(F.abs(gap))).first()[0] < 1e-5


def test_missing_parts_and_meshes(spark, tmp_path):
    m = gen.analytic_field(gen.box(spark, 5, 4, 4), "q", lambda x, y: x + y)
    for k in (1, 2):
        ff.write_field_file(m, str(tmp_path), "box", k, 0.5 * k, elements_per_file=8).collect()
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "box.nek5000").write_text(f"filetemplate: {tmp_path}/box%01d.f%05d\nfirsttimestep: 1\nnumtimesteps: 3\n")
    steps = ff.read_steps_table(spark, f"file://{tmp_path}/own")
    assert sorted((r.step, r.part, r.first_elem) for r in steps.collect()) == [(0, 0, 0), (0, 1, 8), (0, 2, 16), (1, 0, 0), (1, 1, 8), (1, 2, 16)]
    (tmp_path / "box1.f00002").unlink()
    with pytest.raises(Exception, match="box1.f00002"):
        ff.read_steps_table(spark, f"{tmp_path}/box0.f00001").collect()
    bare = tmp_path / "bare0.f00001"
    bare.write_bytes(f"#std 4  4  4  1 {1:10d} {1:10d} {0.0:20.13E} {0:9d} {0:6d} {1:6d} P".ljust(132).encode() + np.array([6.54321, 0], "<f4").tobytes() + np.ones(16, "<f4").tobytes())
    t = ff.read_steps_table(spark, str(bare))
    with pytest.raises(ValueError, match="mesh_file"):
        ff.read_mesh(t)
    borrowed = ff.read_mesh(t, f"{tmp_path}/box[012].f00001")
    assert borrowed.count() == 20 and {r.case for r in borrowed.select("case").collect()} == {"bare"}


def test_stored_case(spark, tmp_path):
    m = gen.taylor_green(gen.annulus(spark, 2, 6, 6))
    data = m.select("case", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), "elem", "p", "v", "u")
    assert cases.ordered_columns(data) == ["case", "step", "elem", "u", "v", "p"]
    cases.write_case(data, f"{tmp_path}/c", float32=True)
    back = cases.read_case(spark, f"{tmp_path}/c")
    assert dict(back.dtypes)["u"] == "array<double>"
    one = ts.pick_step(back, -1)
    assert "PartitionFilters: [isnotnull(step" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 12
    with pytest.raises(IndexError):
        ts.pick_step(back, 2)
    with pytest.raises(IndexError):
        ts.pick_step(back, -3)
    cases.write_mesh(m.select("case", "elem", "gid", "n", "x", "y"), f"{tmp_path}/m")
    mesh = spark.read.parquet(f"{tmp_path}/m")
    assert "xmin" in mesh.columns and "rx" in mesh.columns
    info, ranges = cases.describe_case(back, mesh)
    r = info.first()
    assert (r.nelv, r.order, r.steps, r.fields) == (12, 5, 2, ["u", "v", "p"]) and r.xmax == pytest.approx(1.5)
    assert ranges.count() == 6


def test_steps_in_time(spark):
    steps = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 1.5), ("a", 3, 100.0), ("b", 0, 7.0), ("a", 4, 1.0)], "case string, step int, time double")
    rng = np.random.default_rng(3)
    t = np.concatenate([rng.uniform(-5, 120, 300), [0.5, 1.25, 50.75, 1.0, -1e9, 1e9]])
    q = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(t)] + [("b", 9999, 3.0)], "case string, k long, time double")
    got = {r.k: r.step for r in ts.step_at_time(q, steps).collect()}
    known = np.array([0.0, 1.0, 1.5, 100.0])
    assert got == {k: int(np.argmin(np.abs(known - v))) for k, v in enumerate(t)} | {9999: 0}


def test_step_meshes(spark):
    m = gen.box(spark, 2, 1, 3).select("case", "elem", "x", "y")
    own = m.where("elem = 1").select("case", F.lit(1).alias("step"), "elem", F.transform("x", lambda v: v + 10).alias("x"), "y")
    f = m.select("case", "elem", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    got = {(r.step, r.elem): r.x[0] for r in ts.with_mesh(f, m, own).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 0.0, (1, 1): 11.0}
    both = m.select("case", F.explode(F.array(F.lit(3), F.lit(5))).alias("step"), "elem", "x", "y")
    assert ts.shared_mesh(both).count() == 2


def session(**over):
    return {
        "viewer_session": 1, "dataset": {"path": "data/tg0.f00000"}, "calc": {"defs": [{"name": "vort", "expr": "dx(v) - dy(u)"}]},
        "probe": {"pinned": {"x": 1.0, "y": 0.0}}, "boundaries": [{"name": "wall", "closed": True, "edges": [[0, 3], [2, 3]]}],
        "lines": [{"id": 1, "x0": 0.6, "y0": 0.0, "x1": 1.4, "y1": 0.0}, {"id": 2, "x0": 0, "y0": 0.6, "x1": 0, "y1": 1.4, "visible": False}],
        "forces": {"selection": ["wall"], "config": {"mu": "0.1"}},
    } | over


def test_saved_probe_sets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(session(), indent=2))
    (tmp_path / "b.json").write_text(json.dumps(session(dataset={"path": "/abs/x0.f00001", "step": 4}, lines=[])))
    sets = ps.read_probe_sets(spark, str(tmp_path))
    rows = {os.path.basename(r.set): r for r in sets.collect()}
    assert rows["a.json"].dataset == f"{tmp_path}/data/tg0.f00000" and rows["a.json"].step == 0
    assert rows["b.json"].dataset == "/abs/x0.f00001" and rows["b.json"].step == 4
    assert [(r.line, r.visible) for r in ps.probe_lines(sets).orderBy("line").collect()] == [("1", True), ("2", False)]
    assert ps.definitions(sets).where("set like '%a.json'").first().expr == "dx(v) - dy(u)"
    assert [(r.elem, r.side) for r in ps.probe_boundaries(sets).where("set like '%a.json'").orderBy("seq").collect()] == [(0, 3), (2, 3)]
    assert ps.pinned_probes(sets).count() == 2 and ps.force_settings(sets).first().config == {"mu": "0.1"}
    for k, bad in enumerate(({"foo": 1}, session(viewer_session=2), session(dataset={}))):
        d = tmp_path / f"bad{k}"
        d.mkdir()
        (d / "s.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="not a saved|newer|no dataset"):
            ps.read_probe_sets(spark, str(d)).collect()


def test_line_csv(spark, tmp_path):
    m = gen.analytic_field(gen.box(spark, 2, 1, 3), "f", lambda x, y: x)
    line = spark.createDataFrame([("box", "L1", -1.0, 0.5, 1.0, 0.5)], "case string, line string, x0 double, y0 double, x1 double, y1 double")
    exports.write_csv(exports.line_rows(sample_lines(line, m, None, ["f"], 5), "f", m), f"{tmp_path}/csv", sort=["line", "distance"])
    got = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/csv").orderBy("distance")
    assert got.columns == ["line", "distance", "x", "y", "element", "f"]
    assert [(r.x, r.element) for r in got.collect()] == [(0.0, 1), (0.5, 1), (1.0, 1)]


def test_levels_of_detail(spark):
    m = gen.analytic_field(gen.box(spark, 4, 2, 5), "f", lambda x, y: x * y)
    view = lod.lod_elements(with_bbox(m), (0.6, 2.0), (0.0, 0.4), lod.lod_level((30.0, 10.0)))
    assert {r.elem: r.m for r in view.select("elem", "m").collect()} == {1: 5, 2: 5, 3: 5}
    v = lod.lod_vertices(view, ["f"])
    assert v.count() == 3 * 36 and v.agg(F.max(F.abs(F.col("f") - F.col("x") * F.col("y")))).first()[0] < 1e-12
    t = lod.lod_triangles(view)
    assert t.count() == 3 * 50 and t.agg(F.max("v1"), F.max("v2")).first() == (35, 35)
    # the triangles cover the elements exactly
    at = lambda k: v.select("elem", F.col("a").alias(f"v{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    j = t.join(at(0), ["elem", "v0"]).join(at(1), ["elem", "v1"]).join(at(2), ["elem", "v2"])
    area = ((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / 2
    assert j.agg(F.sum(area), F.min(area)).first()[0] == pytest.approx(3 * 0.25)
    assert lod.edge_polylines(view).count() == 3 * 4 * 9
    assert [r.m for r in with_bbox(m).select(lod.lod_level((30.0, 10.0), fixed=7).alias("m"), lod.contour_level((1.0, 1.0)).alias("c")).limit(1).collect()] == [7]


def test_saved_sets_lie_in_one_folder(spark, tmp_path):
    """A file for each saved set, none of them in a folder of its own."""
    from quadfield.plans.series_plans import _save_sets

    _save_sets(spark.range(40).selectExpr("concat('set ', id) AS value"), str(tmp_path / "sets"))
    files = [p for p in (tmp_path / "sets").iterdir() if p.suffix == ".txt"]
    assert sorted(p.read_text().strip() for p in files) == sorted(f"set {k}" for k in range(40))
    assert not any(p.is_dir() for p in (tmp_path / "sets").iterdir())
