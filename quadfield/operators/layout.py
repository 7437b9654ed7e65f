"""Element layout <-> node layout, and small per-row geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadfield.functions import ieee, kernels

#: columns that identify a row or describe the geometry; everything else is a field
KEYS = ("case", "step", "time", "elem", "gid", "n")
GEOMETRY = ("x", "y", "xmin", "xmax", "ymin", "ymax") + kernels.METRIC


def field_names(df: DataFrame) -> list[str]:
    """Stored and defined fields, in column order."""
    return [c for c in df.columns if c not in KEYS and c not in GEOMETRY]


def keys_of(df: DataFrame, wanted=("case", "step")) -> list[str]:
    return [c for c in wanted if c in df.columns]


def with_bbox(df: DataFrame, margin: float = 0.0) -> DataFrame:
    """Element bounding boxes ``xmin xmax ymin ymax``, widened by ``margin`` of their size."""
    lo_x, hi_x, lo_y, hi_y = F.array_min("x"), F.array_max("x"), F.array_min("y"), F.array_max("y")
    if not margin:
        return df.withColumns({"xmin": lo_x, "xmax": hi_x, "ymin": lo_y, "ymax": hi_y})
    px, py = margin * (hi_x - lo_x), margin * (hi_y - lo_y)
    return df.withColumns({"xmin": lo_x - px, "xmax": hi_x + px, "ymin": lo_y - py, "ymax": hi_y + py})


def with_metric(df: DataFrame) -> DataFrame:
    """Geometric factors as columns; compute once and store with the mesh."""
    rest = [c for c in df.columns if c not in kernels.METRIC]
    return df.select(*rest, kernels.metric().alias("_m")).select(*rest, "_m.*")


def to_nodes(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per node: keys, ``j``, ``i`` and the chosen arrays as scalars."""
    arrays = [c for c, t in df.dtypes if t.startswith("array")]
    names = arrays if names is None else list(names)
    keys = [c for c in df.columns if c not in arrays]
    side = F.sqrt(F.size(names[0])).cast("int")
    return (
        df.select(*keys, side.alias("_n"), F.posexplode(F.arrays_zip(*names)).alias("_p", "_v"))
        .select(*keys, F.expr("_p div _n").cast("int").alias("j"), (F.col("_p") % F.col("_n")).alias("i"), *[F.col(f"_v.{c}").alias(c) for c in names])
    )


def to_elements(nodes: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Back to arrays of length ``n * n``; a group is one element."""
    packed = F.sort_array(F.collect_list(F.struct("j", "i", *names)))
    return nodes.groupBy(*keys).agg(packed.alias("_a")).select(*keys, *[F.col(f"_a.{c}").alias(c) for c in names])


def corners(df: DataFrame) -> DataFrame:
    """Corner coordinates in the order (-,-), (+,-), (-,+), (+,+)."""
    m = F.size("x")
    n = F.sqrt(m).cast("int")
    at = (F.lit(0), n - 1, m - n, m - 1)
    keys = [c for c in KEYS if c in df.columns]
    return df.select(*keys, *[F.get(c, p).alias(f"{c}{k}") for k, p in enumerate(at) for c in ("x", "y")])


def centroid(name: str) -> Column:
    """Mean of an element's node values."""
    return F.aggregate(name, F.lit(0.0), lambda a, v: a + v) / F.size(name)


def visible(df: DataFrame, xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    """Elements whose bounding box overlaps the window (inclusive).

    Needs the stored columns of :func:`with_bbox`; as plain comparisons on scalar
    columns they reach the Parquet row-group statistics.
    """
    c = F.col
    return df.where((c("xmax") >= xlim[0]) & (c("xmin") <= xlim[1]) & (c("ymax") >= ylim[0]) & (c("ymin") <= ylim[1]))


def nodes_in_window(nodes: DataFrame, name: str, xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    """Nodes inside the window (inclusive) whose value is finite."""
    c = F.col
    return nodes.where(c("x").between(*xlim) & c("y").between(*ylim) & ieee.is_finite(c(name)))
