import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadfield.operators import clustering
from quadfield.operators.layout import with_bbox, with_metric
from quadfield.sources import cases
from quadfield.sources import generators as gen


def test_curve_visits_neighbours(spark):
    """Every cell once, and each step goes to a cell beside the last."""
    bits = 4
    cells = spark.range(1 << 2 * bits).select((F.col("id") % (1 << bits)).alias("x"), F.floor(F.col("id") / (1 << bits)).alias("y"))
    rows = cells.select("x", "y", clustering.curve(F.col("x"), F.col("y"), bits).alias("d")).orderBy("d").collect()
    assert [r.d for r in rows] == list(range(1 << 2 * bits)) and (rows[0].x, rows[0].y) == (0, 0)
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_odd_places(spark):
    rows = [(1, 0.0, 0.0), (2, 5.0, 1.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, float("inf"), 0.0)]
    got = {r.k: r._curve for r in clustering.with_curve(spark.createDataFrame(rows, "k int, x double, y double"), "x", "y").collect()}
    assert got[3] == got[4] == got[5] == -1 and got[1] == 0 and got[2] > 0
    flat = clustering.with_curve(spark.createDataFrame([(1, 2.0, 3.0)], "k int, x double, y double"), "x", "y").first()
    assert flat._curve == 0
    assert clustering.with_curve(spark.createDataFrame([], "k int, x double, y double"), "x", "y").count() == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The same mesh stored along the curve and in another order."""
    mesh = gen.box(spark, 64, 64, 4, (0, 4), (0, 4), case="m")
    root = tmp_path_factory.mktemp("mesh")
    cases.write_mesh(mesh, str(root / "curve"), group_bytes=64 << 10, partitions=4)
    mixed = with_metric(with_bbox(mesh)).repartition(4, "elem").sortWithinPartitions(F.xxhash64("elem"))
    cases._sized(mixed.write, 64 << 10).partitionBy("case").parquet(str(root / "mixed"))
    return str(root / "curve"), str(root / "mixed")


WINDOW = (1.01, 1.49), (2.01, 2.24)


def groups_met(path, xlim, ylim):
    met = total = 0
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        names = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stat = {k: meta.row_group(g).column(names[k]).statistics for k in ("xmin", "xmax", "ymin", "ymax")}
            total += 1
            met += stat["xmax"].max >= xlim[0] and stat["xmin"].min <= xlim[1] and stat["ymax"].max >= ylim[0] and stat["ymin"].min <= ylim[1]
    return met, total


def test_window_meets_few_row_groups(spark, stored):
    curve, mixed = (groups_met(p, *WINDOW) for p in stored)
    assert curve[1] >= 16 and mixed[0] == mixed[1]
    assert curve[0] <= curve[1] / 4


def scanned(df):
    """Rows that leave the scan, after row groups were skipped."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    leaf = leaves.apply(0)
    if "AdaptiveSparkPlan" in leaf.getClass().getName():
        leaf = leaf.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_filter_reaches_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    seen = cases.read_window(spark, stored[0], *WINDOW, ["elem"])
    plan = seen._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") : plan.index("ReadSchema")]
    assert all(f"{op}({c}," in pushed for op, c in (("GreaterThanOrEqual", "xmax"), ("LessThanOrEqual", "xmin"), ("GreaterThanOrEqual", "ymax"), ("LessThanOrEqual", "ymin")))
    assert "x:array" not in plan[plan.index("ReadSchema") :]
    other = cases.read_window(spark, stored[1], *WINDOW, ["elem"])
    want = {ex + 64 * ey for ex in range(16, 24) for ey in range(32, 36)}
    assert {r.elem for r in seen.collect()} == want == {r.elem for r in other.collect()}
    assert scanned(seen) <= 64 * 64 / 4 < scanned(other)


def test_window_in_shares_of_the_domain(spark, stored):
    assert cases.window_of(spark, stored[0], (0.25, 0.5), (0.5, 1.0)) == ((1.0, 2.0), (2.0, 4.0))
