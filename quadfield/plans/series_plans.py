"""Steps in time, shared meshes, field-file round trips, and saved probe sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadfield.operators import timeseries as ts
from quadfield.operators.layout import to_nodes
from quadfield.operators.locate import sample_lines
from quadfield.operators.scans import checkpointed, shared_folder
from quadfield.plans.probe_plans import poly_mesh
from quadfield.plans.registry import plan, rounded
from quadfield.plans.tables import CASE, HEIGHT_SQL, STEPS_SQL, WAVE, cell_mesh, day_steps, each_day, height, nodes_sql, spread, table
from quadfield.sources import cases, exports, fieldfiles, probe_sets


def _scratch(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"




@plan("step_nearest", """WITH st AS (SELECT l AS c, t, dense_rank() OVER (PARTITION BY l ORDER BY t) - 1 AS step FROM (SELECT DISTINCT o_orderpriority AS l, epoch(o_orderdate) / 86400.0 AS t FROM orders)),
q AS (SELECT o_orderkey AS k, o_orderpriority AS c, epoch(o_orderdate) / 86400.0 + (o_custkey % 10) * 0.3 AS t FROM orders),
lo AS (SELECT q.k, q.c, q.t, st.step AS s0, st.t AS t0 FROM q ASOF LEFT JOIN st ON q.c = st.c AND q.t >= st.t),
hi AS (SELECT q.k, st.step AS s1, st.t AS t1 FROM q ASOF LEFT JOIN st ON q.c = st.c AND q.t <= st.t)
SELECT k AS orderkey, CASE WHEN t0 IS NULL THEN s1 WHEN t1 IS NULL THEN s0 WHEN abs(t - t0) <= abs(t - t1) THEN s0 ELSE s1 END AS step FROM lo JOIN hi USING (k)""")
def step_nearest(spark, folder):
    o = table(spark, folder, "orders")
    day = F.unix_timestamp("o_orderdate") / 86400.0
    c = F.col("o_orderpriority").alias("case")
    times = o.select(c, day.alias("time")).distinct()
    rank = F.dense_rank().over(ts.Window.partitionBy("case").orderBy("time")) - 1
    q = o.select(c, "o_orderkey", (day + F.col("o_custkey") % 10 * 0.3).alias("time"))
    got = ts.step_at_time(q, times.withColumn("step", rank))
    return got.select(F.col("o_orderkey").alias("orderkey"), F.col("step").cast("long").alias("step"))


@plan("pick_last_step", f"WITH {STEPS_SQL}, l AS (SELECT * FROM st WHERE step = (SELECT max(step) FROM st)) SELECT step, count(*) AS elems, round(sum(scale * list_sum(list_transform(embedding, lambda v: v::DOUBLE))), 4) + 0.0 AS total FROM l, embeddings GROUP BY step")
def pick_last_step(spark, folder):
    data = each_day(cell_mesh(spark, folder).select("case", "elem", "f"), ts.pick_step(day_steps(spark, folder), -1), "elem")
    total = F.aggregate("f", F.lit(0.0), lambda a, v: a + v) * F.col("scale")
    return data.groupBy("step").agg(F.count(F.lit(1)).alias("elems"), rounded(F.sum(total), 4).alias("total"))


@plan("mesh_sharing", f"WITH {STEPS_SQL}, {nodes_sql()}, b AS (SELECT sum(x) AS sx FROM nd) SELECT step, round(CASE WHEN step % 10 = 3 THEN sx + (SELECT count(*) FROM nd) * 0.5 ELSE sx END, 3) AS sx FROM st, b")
def mesh_sharing(spark, folder):
    # every tenth step moved its mesh by half a unit and stores it; the others share the first
    base = cell_mesh(spark, folder).select("case", "elem", "x", "y")
    days = day_steps(spark, folder).select("step")
    fields = each_day(base.select("case", "elem"), days, "elem")
    moved = each_day(base, days.where("step % 10 = 3"), "elem").withColumn("x", F.transform("x", lambda v: v + 0.5))
    all_ = ts.with_mesh(fields, base, moved)
    return all_.groupBy("step").agg(rounded(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)), 3).alias("sx"))


@plan("roundtrip_f32", f"""WITH {nodes_sql()} SELECT step, round(time, 6) AS time, elem, gid, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy, round(sum(f * (step + 1)), 3) + 0.0 AS sf
FROM (SELECT s AS step, s * 0.25 AS time, elem, elem + 1 AS gid, x, y, f FROM nd, (SELECT unnest(range(3)) AS s)) GROUP BY ALL""")
def roundtrip_f32(spark, folder):
    """Write three steps as single-precision field files (only the first with siblings' names), read them back."""
    out = _written(spark, folder, range(3))
    return _totals(fieldfiles.read_steps_table(spark, f"{out}/emb0.f00000"))


def _written(spark, folder, steps, case="emb", **how):
    """Field files of the embedding mesh, values times step + 1, in a fresh folder."""
    out = _scratch(spark, "files")
    spark.createDataFrame([], "x int").write.mode("overwrite").parquet(out)
    mesh = cell_mesh(spark, folder)
    for k in steps:
        step = mesh.select("elem", "gid", "x", "y", F.transform("f", lambda v: v * (k + 1)).alias("f"))
        fieldfiles.write_field_file(step, out, case, k, 0.25 * k, ["f"], **how).collect()
    return out


def _totals(steps):
    """Sums over every element of every step that is read back."""
    names = fieldfiles.stored_names(steps)
    data = fieldfiles.read_elements(steps, names)
    full = data.join(fieldfiles.read_mesh(steps).select("case", "elem", "x", "y"), ["case", "elem"])
    total = lambda k: rounded(F.aggregate(k, F.lit(0.0), lambda a, v: a + v), 3)
    return full.select(F.col("step").cast("long").alias("step"), rounded("time").alias("time"), "elem", F.col("gid").cast("long").alias("gid"), total("x").alias("sx"), total("y").alias("sy"), total(names[0]).alias("sf"))


_BACK = "SELECT {step} AS step, round(time, 6) AS time, elem, gid, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy, round(sum(f * (s + 1)), 3) + 0.0 AS sf FROM (SELECT s, s * 0.25 AS time, elem, elem + 1 AS gid, x, y, f FROM nd, (SELECT unnest({steps}) AS s)) GROUP BY ALL"


@plan("roundtrip_parts", f"WITH {nodes_sql()} " + _BACK.format(step="s", steps="range(2)"))
def roundtrip_parts(spark, folder):
    """Two steps, each stored in many files: every part is found, elements are numbered through them."""
    out = _written(spark, folder, range(2), elements_per_file=64)
    return _totals(fieldfiles.read_steps_table(spark, f"{out}/emb0.f00000"))


@plan("roundtrip_padded", f"WITH {nodes_sql()} " + _BACK.format(step="s", steps="range(2)"))
def roundtrip_padded(spark, folder):
    """Part numbers with leading zeros, opened by the file of one part."""
    out = _written(spark, folder, range(2), elements_per_file=40, part_digits=3)
    return _totals(fieldfiles.read_steps_table(spark, f"{out}/emb001.f00000"))


@plan("roundtrip_digit_case", f"WITH {nodes_sql()} " + _BACK.format(step="s", steps="range(2)"))
def roundtrip_digit_case(spark, folder):
    """A case whose name ends in digits, in parts, opened by a glob."""
    out = _written(spark, folder, range(2), case="run20", elements_per_file=100)
    return _totals(fieldfiles.read_steps_table(spark, f"{out}/run200.f*"))


@plan("metafile_case", f"WITH {nodes_sql()} " + _BACK.format(step="s - 1", steps="[1, 2]"))
def metafile_case(spark, folder):
    """A case named by a metafile, given as a URI."""
    out = _written(spark, folder, range(3))
    spark.createDataFrame([("filetemplate: %s%01d.f%05d\nfirsttimestep: 1\nnumtimesteps: 2",)], "value string").coalesce(1).write.text(f"{out}/meta")
    name = fieldfiles.list_files(spark, f"{out}/meta", "part-*").first().file
    system, there = fieldfiles._hadoop(spark, name)
    system.rename(there, fieldfiles._hadoop(spark, f"{out}/emb.nek5000")[1])
    return _totals(fieldfiles.read_steps_table(spark, fieldfiles.qualified(spark, f"{out}/emb.nek5000")))


@plan("directory_case", f"WITH {nodes_sql()} " + _BACK.format(step="s", steps="[0, 1]"))
def directory_case(spark, folder):
    """A folder with one metafile, steps in several parts, and one step file missing."""
    out = _written(spark, folder, range(2), elements_per_file=100)
    spark.createDataFrame([("filetemplate: emb%01d.f%05d\nnumtimesteps: 3",)], "value string").coalesce(1).write.text(f"{out}/meta")
    name = fieldfiles.list_files(spark, f"{out}/meta", "part-*").first().file
    system, there = fieldfiles._hadoop(spark, name)
    system.rename(there, fieldfiles._hadoop(spark, f"{out}/emb.nek5000")[1])
    return _totals(fieldfiles.read_steps_table(spark, out))


@plan("stored_case", f"WITH {STEPS_SQL}, {nodes_sql()}, s AS (SELECT step, round(min(f * scale), 4) + 0.0 AS lo, round(max(f * scale), 4) + 0.0 AS hi FROM nd, st WHERE step IN (4, 5) GROUP BY step) SELECT * FROM s")
def stored_case(spark, folder):
    """A case partitioned by step in Parquet (single precision); two steps are read back by partition pruning."""
    out = _scratch(spark, "case")
    data = each_day(cell_mesh(spark, folder).select("case", "elem", "f"), day_steps(spark, folder), "elem")
    data = data.select("case", "step", "time", "elem", F.zip_with("f", F.array_repeat("scale", F.size("f")), lambda v, s: v * s).alias("f"))
    cases.write_case(data, out, float32=True)
    back = cases.read_case(spark, out).where("step in (4, 5)")
    return back.groupBy(F.col("step").cast("long").alias("step")).agg(rounded(F.min(F.array_min("f")), 4).alias("lo"), rounded(F.max(F.array_max("f")), 4).alias("hi"))


@plan("series_ranges_stored", f"WITH {STEPS_SQL}, {nodes_sql()}, s AS (SELECT step, (SELECT count(*) FROM embeddings) AS nelv, min(f * scale) AS lo, max(f * scale) AS hi, min(f) AS lo2, max(f) AS hi2 FROM nd, st GROUP BY step) SELECT step, step * 0.5 AS time, nelv, 'f' AS field, round(lo, 4) + 0.0 AS lo, round(hi, 4) + 0.0 AS hi FROM s UNION ALL SELECT step, step * 0.5, nelv, 'g', round(-hi2, 4) + 0.0, round(-lo2, 4) + 0.0 FROM s")
def series_ranges_stored(spark, folder):
    """Times and ranges of every step of a stored case, answered from the table written beside it."""
    out = _scratch(spark, "case")
    data = each_day(cell_mesh(spark, folder).select("case", "elem", "f"), day_steps(spark, folder), "elem")
    data = data.select("case", "step", "time", "elem", F.zip_with("f", F.array_repeat("scale", F.size("f")), lambda v, s: v * s).alias("f"), F.transform("f", lambda v: -v).alias("g"))
    cases.write_case(data, out, float32=True, ranges=True)
    r = cases.series_ranges(spark, out)
    return r.select(F.col("step").cast("long").alias("step"), "time", "nelv", "field", rounded("lo", 4).alias("lo"), rounded("hi", 4).alias("hi"))


@plan("case_summary", f"WITH {STEPS_SQL}, {nodes_sql(True)} SELECT count(DISTINCT elem) AS nelv, 7 AS \"order\", (SELECT count(*) FROM st) AS steps, round(min(x), 6) + 0.0 AS xmin, round(max(x), 6) AS xmax, round(min(y), 6) + 0.0 AS ymin, round(max(y), 6) AS ymax FROM nd")
def case_summary(spark, folder):
    mesh = cell_mesh(spark, folder, WAVE)
    fields = each_day(mesh.select("case", "elem", "f"), day_steps(spark, folder), "elem").select("case", "step", "time", "elem", "f")
    info, _ = cases.describe_case(fields, mesh)
    return info.select("nelv", "order", "steps", *[rounded(k).alias(k) for k in ("xmin", "xmax", "ymin", "ymax")])


def _save_sets(docs, out):
    """A file for each document, all in one folder; tasks put their files in place themselves, the driver moves none."""
    docs.write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(out)


@plan("saved_probes", f"""WITH h AS (SELECT {HEIGHT_SQL} AS h), ln AS (SELECT s_suppkey, k, 0.0113 * (s_suppkey % 50) + k * 0.5003 AS x0, h * 0.1371 AS y0, 1.9171 AS x1, h * 0.8329 AS y1, NOT (k = 1 AND s_suppkey % 2 = 1) AS visible FROM supplier, h, (SELECT unnest([0, 1]) AS k)),
p AS (SELECT *, idx / 20.0 AS t FROM ln, (SELECT unnest(range(21)) AS idx) WHERE visible)
SELECT s_suppkey AS supplier, k + 1 AS line, count(*) AS points, round(avg((x0 + t * (x1 - x0)) * (x0 + t * (x1 - x0)) + 3 * (y0 + t * (y1 - y0))), 6) AS mean_q FROM p GROUP BY 1, 2""")
def saved_probes(spark, folder):
    """A saved set of two lines per supplier (one hidden for odd keys), read back and sampled."""
    out = _scratch(spark, "sets")
    k = F.col("s_suppkey")
    h = height(spark, folder)
    line = lambda n: F.struct(F.lit(n + 1).alias("id"), (0.0113 * (k % 50) + n * 0.5003).alias("x0"), (h * 0.1371).alias("y0"), F.lit(1.9171).alias("x1"), (h * 0.8329).alias("y1"), F.when((F.lit(n) == 1) & (k % 2 == 1), F.lit(False)).alias("visible"))
    doc = F.struct(F.lit(1).alias("probe_session"), F.struct(F.concat(F.lit("case"), k.cast("string")).alias("path")).alias("dataset"), F.array(line(0), line(1)).alias("lines"))
    _save_sets(spread(table(spark, folder, "supplier"), "s_suppkey").select(F.to_json(doc).alias("value")), out)
    sets = checkpointed(probe_sets.read_probe_sets(spark, out))  # the files are opened once
    lines = probe_sets.probe_lines(sets).where("visible")
    lines = lines.select(F.lit(CASE).alias("case"), F.concat(F.regexp_extract("dataset", r"case(\d+)$", 1), F.lit(":"), "line").alias("line"), "x0", "y0", "x1", "y1")
    s = sample_lines(lines, poly_mesh(spark, folder), None, ["q"], 21)
    rows = exports.line_rows(s, "q")
    part = F.split("line", ":")
    return rows.groupBy(F.get(part, F.lit(0)).cast("long").alias("supplier"), F.get(part, F.lit(1)).cast("long").alias("line")).agg(F.count(F.lit(1)).alias("points"), rounded(F.avg("q")).alias("mean_q"))


@plan("series_energy", f"WITH {STEPS_SQL}, {nodes_sql()} SELECT step, round(avg(f * f * scale * scale), 6) AS energy FROM nd, st GROUP BY step")
def series_energy(spark, folder):
    nd = to_nodes(cell_mesh(spark, folder).select("case", "elem", "f"), ["f"])
    e = nd.groupBy("case").agg(F.sum(F.col("f") * F.col("f")).alias("s"), F.count(F.lit(1)).alias("n"))
    days = day_steps(spark, folder).withColumn("case", F.lit(CASE))
    return days.join(e, "case").select("step", rounded(F.col("s") / F.col("n") * F.col("scale") * F.col("scale")).alias("energy"))


@plan("saved_sets", """SELECT s_suppkey AS supplier, 2 AS defs, CASE WHEN s_suppkey % 2 = 1 THEN 'v * 2' ELSE 'u + 1' END AS last_expr, 3 AS edges, round(3 * s_suppkey + 3.0, 3) AS elems,
CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(0.25 * s_suppkey, 3) END AS pinned_x, 1 + s_suppkey % 2 AS requests FROM supplier""")
def saved_sets(spark, folder):
    """Definitions, boundaries, pinned probes and force requests of a saved set per supplier, read back as tables."""
    out = _scratch(spark, "sets")
    k = F.col("s_suppkey")
    defs = F.array(F.struct(F.lit("a").alias("name"), F.lit("u").alias("expr")), F.struct(F.lit("b").alias("name"), F.when(k % 2 == 1, "v * 2").otherwise("u + 1").alias("expr")))
    edges = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda q: F.array(k + q, q.cast("long")))
    pinned = F.when(k % 3 != 0, F.struct((0.25 * k).alias("x"), F.lit(0.5).alias("y")))
    doc = F.struct(
        F.lit(1).alias("probe_session"), F.struct(F.concat(F.lit("case"), k.cast("string")).alias("path")).alias("dataset"), F.struct(defs.alias("defs")).alias("calc"),
        F.array(F.struct(F.lit("B1").alias("name"), F.lit(True).alias("closed"), edges.alias("edges"))).alias("boundaries"),
        F.struct(F.when(k % 2 == 1, F.array(F.lit("B1"), F.lit("B2"))).otherwise(F.array(F.lit("B1"))).alias("selection"), F.create_map(F.lit("mu"), F.lit("0.1")).alias("config")).alias("forces"),
        F.struct(pinned.alias("pinned")).alias("probe"),
    )
    _save_sets(spread(table(spark, folder, "supplier"), "s_suppkey").select(F.to_json(doc).alias("value")), out)
    sets = checkpointed(probe_sets.read_probe_sets(spark, out))  # the files are opened once
    one = sets.select("set", F.regexp_extract("dataset", r"case(\d+)$", 1).cast("long").alias("supplier"))
    d = probe_sets.definitions(sets).groupBy("set").agg(F.count(F.lit(1)).alias("defs"), F.max_by("expr", "seq").alias("last_expr"))
    b = probe_sets.probe_boundaries(sets).where("closed and boundary = 'B1'").groupBy("set").agg(F.count(F.lit(1)).alias("edges"), rounded(F.sum("elem").cast("double"), 3).alias("elems"))
    p = probe_sets.pinned_probes(sets).select("set", rounded("x", 3).alias("pinned_x"))
    f = probe_sets.force_settings(sets).where("config['mu'] = '0.1'").groupBy("set").agg(F.count(F.lit(1)).alias("requests"))
    return one.join(d, "set").join(b, "set").join(f, "set").join(p, "set", "left").drop("set")
