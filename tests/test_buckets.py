import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadfield.operators import locate
from quadfield.operators.scans import checkpointed
from quadfield.sources import cases
from quadfield.sources import generators as gen


@pytest.fixture(scope="module")
def box(spark):
    return checkpointed(gen.analytic_field(gen.box(spark, 6, 5, 4, (0, 6), (0, 5), case="b"), "q", lambda x, y: x + 10 * y))


def steps_of(box, steps=(0, 1, 2)):
    rows = box.select("case", F.explode(F.array(*[F.lit(k) for k in steps])).alias("step"), "elem", "q")
    return rows.withColumns({"time": F.col("step") * 0.5, "q": F.zip_with("q", F.array_repeat("step", F.size("q")), lambda v, s: v * (s + 1))})


def points_in(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([("b", k, float(rng.uniform(-0.5, 6.5)), float(rng.uniform(0, 5))) for k in range(n)], "case string, pid long, x double, y double")


@pytest.fixture(scope="module")
def bucketed(spark, box, tmp_path_factory):
    name = f"t_{uuid.uuid4().hex}"
    yield cases.write_by_element(steps_of(box), name, str(tmp_path_factory.mktemp("steps") / "t"), 6)
    spark.sql(f"DROP TABLE {name}")


def test_arrays_are_not_shuffled(spark, box, bucketed):
    """The packed points go to the buckets; between the scan of the stored arrays and the join there is no exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1",):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            loc = locate.locate(points_in(spark), box, ["pid"])
            out = locate.sample_located(loc, bucketed, ["q"], ["pid"])
            plan = out._jdf.queryExecution().executedPlan().toString()
            at = plan.index("Join")
            sides = re.split(r"(?m)^(?=[ :|]*[+:]- )", plan[at:])
            scan = next(k for k, line in enumerate(sides) if "q#" in line and "FileScan parquet" in line)
            depth = re.search(r"[+:]- ", sides[scan]).start()
            above = []
            for line in reversed(sides[:scan]):
                m = re.search(r"[+:]- ", line)
                if m and m.start() < depth:
                    depth = m.start()
                    above.append(line)
            assert "Bucketed: true" in sides[scan] and not any("Exchange" in line for line in above)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_same_values_as_unbucketed(spark, box, bucketed):
    points = points_in(spark)
    got, want = ({(r.pid, r.step): (r.elem, r.q) for r in locate.sample(points, box, f, ["q"], fill=None).collect()} for f in (bucketed, steps_of(box)))
    assert len(got) == 1200 and got == want
    assert any(q is None for _, q in got.values())


def test_gaps_of_some_elements(spark, box):
    """Elements that miss a step, or all of them, give nulls there; doubled rows of another step don't hide it."""
    fields = steps_of(box).where("not (elem = 3 and step = 1) and elem <> 7 and not (elem = 9 and step > 0)")
    points = spark.createDataFrame([("b", e, e % 6 + 0.5, e // 6 + 0.5) for e in range(30)], "case string, pid long, x double, y double")
    got = {(r.pid, r.step): r.q for r in locate.sample(points, box, fields, ["q"], fill=None).collect()}
    assert len(got) == 90
    missing = {(3, 1), *((7, s) for s in range(3)), (9, 1), (9, 2)}
    assert {k for k, v in got.items() if v is None} == missing
    assert all(got[p, s] == pytest.approx((p % 6 + 0.5 + 10 * (p // 6 + 0.5)) * (s + 1)) for p in range(30) for s in range(3) if (p, s) not in missing)


def test_one_element_holds_most_points(spark, box):
    """Nine tenths of the points in one element, adaptive execution off: they are packed into bounded rows."""
    rows = [("b", k, 2.0 + (k % 89) / 90, 1.0 + (k % 97) / 98) if k % 10 else ("b", k, 0.3 + k % 5, 3.3) for k in range(6000)]
    points = spark.createDataFrame(rows, "case string, pid long, x double, y double").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = locate.sample(points, box, steps_of(box), ["q"], fill=None)
        assert got.where("q is null").count() == 0 and got.count() == 18000
        error = F.abs(F.col("q") - (F.col("x0") + 10 * F.col("y0")) * (F.col("step") + 1))
        at = points.select("pid", F.col("x").alias("x0"), F.col("y").alias("y0"))
        assert got.join(at, "pid").agg(F.max(error)).first()[0] < 1e-9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_element_is_dealt_into_shares(spark, box):
    """Nine tenths of the points in one element, adaptive execution off, no broadcasts: no task holds more than a few shares."""
    rows = [("b", k, 2.005 + (k % 89) / 90, 1.005 + (k % 97) / 98) if k % 10 else ("b", k, 0.3 + k % 5, 3.3) for k in range(6000)]
    points = spark.createDataFrame(rows, "case string, pid long, x double, y double").repartition(12)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        located = locate.locate(points, box, ["pid"])
        largest, values = {}, {}
        for share in (256, 1 << 15):
            got = locate.sample_located(located, steps_of(box), ["q"], ["pid"], share=share)
            got = got.select("pid", "step", "q", F.spark_partition_id().alias("task")).collect()
            tasks = {}
            for r in got:
                tasks[r.task] = tasks.get(r.task, 0) + 1
            largest[share] = max(tasks.values())
            values[share] = sorted((r.pid, r.step, r.q) for r in got)
            assert len(got) == 18000
        assert values[256] == values[1 << 15]
        assert largest[1 << 15] >= 16200 and largest[256] <= 7000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
