"""CSV exports: line samples, force tables, wall distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_rows(samples: DataFrame, field: str, mesh: DataFrame | None = None) -> DataFrame:
    """``line, distance, x, y, element, <field>`` of the samples inside the mesh; ``element`` is the global id."""
    inside = samples.where(F.col("elem").isNotNull() & ~F.isnan(field))
    gid = F.col("elem") + 1
    if mesh is not None and "gid" in mesh.columns:
        inside, gid = inside.join(mesh.select("case", "elem", "gid"), ["case", "elem"]), F.col("gid")
    return inside.select("line", "distance", "x", "y", gid.cast("long").alias("element"), field)


def force_rows(table: DataFrame) -> DataFrame:
    """``boundary, length, axis, dir_x, dir_y, pressure, viscous, total, coefficient`` (keys of the step lead)."""
    lead = [k for k in ("case", "step") if k in table.columns]
    return table.select(*lead, "boundary", "length", "axis", F.col("ax").alias("dir_x"), F.col("ay").alias("dir_y"), "pressure", "viscous", "total", "coefficient")


def distribution_rows(dist: DataFrame, mesh: DataFrame | None = None) -> DataFrame:
    """``boundary, s, x, y, element, nx, ny, p, cp, tau_w, cf`` (keys of the step lead)."""
    gid = F.col("elem") + 1
    if mesh is not None and "gid" in mesh.columns:
        dist, gid = dist.join(mesh.select("case", "elem", "gid"), ["case", "elem"]), F.col("gid")
    lead = [k for k in ("case", "step") if k in dist.columns]
    return dist.select(*lead, "boundary", "s", "x", "y", gid.cast("long").alias("element"), "nx", "ny", "p", "cp", F.col("tau").alias("tau_w"), "cf")


def write_csv(df: DataFrame, path: str, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header; non-finite values are left empty.  ``sort`` orders rows across the files."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    out = df.select(*clean)
    (out.orderBy(*sort) if sort else out).write.mode(mode).option("header", True).csv(path)
