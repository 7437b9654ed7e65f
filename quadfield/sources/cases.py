"""Stored cases: Parquet tables of meshes, fields and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadfield.operators.clustering import clustered
from quadfield.operators.fields import domain_bounds, field_range, finite_ends
from quadfield.operators.layout import KEYS, field_names, visible, with_bbox, with_metric

#: target size of a Parquet row group of a stored mesh
GROUP_BYTES = 8 << 20
#: columns of the finite ends of an element's field, and the folder of a step's ranges beside the data (readers of the data skip it)
ENDS = ("_lo_", "_hi_")
RANGES = "_ranges"


def ordered_columns(df: DataFrame) -> list[str]:
    """Keys, geometry, then ``u``, ``v``, then the other fields."""
    names = field_names(df)
    lead = [k for k in ("u", "v") if k in names]
    rest = [c for c in df.columns if c in KEYS or c not in names]
    return rest + lead + [k for k in names if k not in lead]


def write_case(df: DataFrame, path: str, float32: bool = False, mode: str = "overwrite", ranges: bool = False) -> None:
    """Element rows to Parquet, partitioned by case and step so that a step is one folder.

    ``ranges`` stores with each element the finite ends of its fields, and beside the data a small table of every step's ranges,
    made from these ends without reading an array again.
    """
    kinds, names = dict(df.dtypes), field_names(df)
    cols = [F.col(c).cast("array<float>").alias(c) if float32 and kinds[c] == "array<double>" else F.col(c) for c in ordered_columns(df)]
    parts = [k for k in ("case", "step") if k in df.columns]
    rows = df.select(*cols)
    if ranges:
        rows = rows.withColumns({f"{end}{k}": f for k in names if kinds[k].startswith("array") for end, f in zip(ENDS, finite_ends(k))})
    rows.write.mode(mode).partitionBy(*parts).parquet(path)
    if ranges:
        write_ranges(df.sparkSession, path)


def write_by_element(df: DataFrame, name: str, path: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """Element rows as a table ``name`` (data in ``path``) in buckets by (case, elem), each sorted by them; returns the table.

    All steps of an element are in one bucket: mesh, fields and located points that are bucketed alike meet without a shuffle, and
    anything else is shuffled to the buckets, never the stored arrays.  ``buckets`` should be a multiple of the cores, with files of
    some hundred megabytes.  Written through one shuffle, so a bucket is one file.
    """
    spread = df.select(*[F.col(c) for c in ordered_columns(df)]).repartition(buckets, "case", "elem")
    spread.write.mode(mode).option("path", path).bucketBy(buckets, "case", "elem").sortBy("case", "elem").saveAsTable(name)
    return df.sparkSession.table(name)


def write_ranges(spark: SparkSession, path: str) -> None:
    """(Re)writes the table of ranges of a case that was written with ``ranges``; reads narrow columns only."""
    df, c = spark.read.parquet(path), F.col
    names = [k.removeprefix(ENDS[0]) for k in df.columns if k.startswith(ENDS[0])]
    keys = [k for k in ("case", "step") if k in df.columns]
    when = [F.min("time").alias("time")] if "time" in df.columns else []
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("nelv"), *when, *[f(f"{end}{k}").alias(f"{end}{k}") for k in names for f, end in zip((F.min, F.max), ENDS)])
    fields = F.array(*[F.struct(F.lit(k).alias("field"), c(f"{ENDS[0]}{k}").cast("double").alias("lo"), c(f"{ENDS[1]}{k}").cast("double").alias("hi")) for k in names])
    sums.select(*keys, "nelv", *(["time"] if when else []), F.inline(fields)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{RANGES}")


def series_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(case, step, [time], nelv, field, lo, hi) of a stored case, without a scan of its fields; (0, 1) where nothing is finite.

    Needs a case that was written with ``ranges``.
    """
    found = spark.read.parquet(f"{path.rstrip('/')}/{RANGES}")
    return found.withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(1.0))})


def write_mesh(mesh: DataFrame, path: str, mode: str = "overwrite", group_bytes: int = GROUP_BYTES, partitions: int | None = None) -> None:
    """Mesh with bounding boxes and metric stored once, elements along a space-filling curve.

    Neighbours lie in one row group, so the boxes' statistics let :func:`read_window` skip the groups outside a window.
    """
    boxed = with_bbox(mesh)
    rows = clustered(boxed, (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2, ["case"], partitions)
    _sized(with_metric(rows).write, group_bytes).mode(mode).partitionBy("case").parquet(path)


def _sized(writer, group_bytes: int):
    # the writer looks at the size of a group every so many rows: a wide row must not wait for the default of 100
    return writer.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 8).option("parquet.page.size", group_bytes // 4)


def read_window(spark: SparkSession, path: str, xlim: tuple[float, float], ylim: tuple[float, float], columns: list[str] | None = None) -> DataFrame:
    """Stored elements whose box overlaps the window; row groups and columns outside are not read."""
    found = visible(read_case(spark, path, float64=False), xlim, ylim)
    return found.select(*columns) if columns else found


def window_of(spark: SparkSession, path: str, across: tuple[float, float], up: tuple[float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """A window in data units from shares of the stored domain (0 to 1 in both directions); reads the boxes only."""
    box = spark.read.parquet(path).agg(F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.min("ymin").alias("y0"), F.max("ymax").alias("y1")).first()
    if box.x0 is None:
        return (0.0, 0.0), (0.0, 0.0)
    at = lambda lo, hi, share: lo + (hi - lo) * share
    return tuple(at(box.x0, box.x1, s) for s in across), tuple(at(box.y0, box.y1, s) for s in up)


def read_case(spark: SparkSession, path: str, float64: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.drop(*[k for k in df.columns if k.startswith(ENDS)])
    if not float64:
        return df
    return df.select(*[F.col(c).cast("array<double>").alias(c) if t == "array<float>" else F.col(c) for c, t in df.dtypes])


def describe_case(df: DataFrame, mesh: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per case its elements, order, steps, times and bounds; per (case, step, field) its finite range."""
    c = F.col
    geo = df if mesh is None else mesh
    sizes = geo.groupBy("case").agg(F.count_distinct("elem").alias("nelv"), (F.max(F.sqrt(F.size("x"))).cast("int") - 1).alias("order"))
    info = sizes.join(domain_bounds(geo), "case")
    if "step" in df.columns:
        when = [F.min("time").alias("first_time"), F.max("time").alias("last_time")] if "time" in df.columns else []
        info = info.join(df.groupBy("case").agg(F.count_distinct("step").alias("steps"), *when), "case")
    names = field_names(df)
    info = info.withColumn("fields", F.array(*[F.lit(k) for k in names]))
    return info.select("case", *[k for k in info.columns if k != "case"]), field_range(df.select(*[k for k in ("case", "step") if k in df.columns], *[c(k) for k in names]), names)
