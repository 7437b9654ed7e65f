"""Structured test meshes of any size, one row per element.

Element ``ey * nx + ex`` covers the square ``(ex, ey)`` of an ``nx x ny`` grid on
``[0, 1]^2``; a mapping of Columns bends it.  ``place`` is the same operation on the
rows of an existing table, so meshes can grow with any data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadfield import basis


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def unit_arrays(ex, ey, nx, ny, n: int) -> tuple[Column, Column]:
    """Node coordinates of grid cell ``(ex, ey)`` in the unit square, as arrays."""
    half = F.array(*[F.lit(float((g + 1.0) / 2.0)) for g in basis.nodes(n)])
    ex, ey, nx, ny = _c(ex), _c(ey), _c(nx), _c(ny)
    flat = F.sequence(F.lit(0), F.lit(n * n - 1))
    xi = F.transform(flat, lambda p: (ex + F.get(half, p % n)) / nx)
    eta = F.transform(flat, lambda p: (ey + F.get(half, F.floor(p / n).cast("int"))) / ny)
    return xi, eta


def place(cells: DataFrame, nx, ny, n: int, mapping, keep: list[str]) -> DataFrame:
    """Mesh from rows with ``ex`` and ``ey``; ``mapping(xi, eta) -> (x, y)`` on scalar Columns."""
    xi, eta = unit_arrays(F.col("ex"), F.col("ey"), nx, ny, n)
    unit = cells.select(*keep, F.lit(n).alias("n"), xi.alias("_xi"), eta.alias("_eta"))
    fx = F.zip_with("_xi", "_eta", lambda a, b: mapping(a, b)[0])
    fy = F.zip_with("_xi", "_eta", lambda a, b: mapping(a, b)[1])
    return unit.select(*keep, "n", fx.alias("x"), fy.alias("y"))


def structured(spark: SparkSession, nx: int, ny: int, n: int, mapping, case: str) -> DataFrame:
    cells = spark.range(nx * ny).select(
        F.lit(case).alias("case"), F.col("id").alias("elem"), (F.col("id") + 1).cast("int").alias("gid"),
        (F.col("id") % nx).alias("ex"), F.floor(F.col("id") / nx).alias("ey"),
    )
    return place(cells, nx, ny, n, mapping, ["case", "elem", "gid"])


def box_map(xlim=(0.0, 2.0), ylim=(0.0, 1.0)):
    return lambda a, b: (xlim[0] + a * (xlim[1] - xlim[0]), ylim[0] + b * (ylim[1] - ylim[0]))


def annulus_map(r_in=0.5, r_out=1.5, theta=(0.0, 2 * math.pi)):
    def mapping(a, b):
        r, t = r_in + a * (r_out - r_in), theta[0] + b * (theta[1] - theta[0])
        return r * F.cos(t), r * F.sin(t)

    return mapping


def wavy_map(amplitude=0.08):
    def mapping(a, b):
        bump = lambda p, q: amplitude * F.sin(2 * math.pi * p) * F.sin(math.pi * q)
        return 2.0 * a + bump(b, a), b + bump(a, b)

    return mapping


def box(spark, nx=8, ny=6, n=8, xlim=(0.0, 2.0), ylim=(0.0, 1.0), case="box") -> DataFrame:
    """Straight-sided rectangles."""
    return structured(spark, nx, ny, n, box_map(xlim, ylim), case)


def annulus(spark, nr=4, ntheta=24, n=8, r_in=0.5, r_out=1.5, theta=(0.0, 2 * math.pi), case="annulus") -> DataFrame:
    """An annulus or a sector of one."""
    return structured(spark, nr, ntheta, n, annulus_map(r_in, r_out, theta), case)


def wavy_box(spark, nx=10, ny=5, n=7, amplitude=0.08, case="wavy") -> DataFrame:
    """A box in which all element edges are curved."""
    return structured(spark, nx, ny, n, wavy_map(amplitude), case)


def analytic_field(df: DataFrame, name: str, func) -> DataFrame:
    """Field ``func(x, y)`` at the nodes; ``func`` maps scalar Columns to a Column."""
    return df.withColumn(name, F.zip_with("x", "y", lambda a, b: func(a, b) + F.lit(0.0)))


def taylor_green(df: DataFrame, k: float = math.pi) -> DataFrame:
    """Velocity ``u``, ``v`` and pressure ``p`` of a periodic vortex array."""
    df = analytic_field(df, "u", lambda x, y: F.sin(k * x) * F.cos(k * y))
    df = analytic_field(df, "v", lambda x, y: -F.cos(k * x) * F.sin(k * y))
    return analytic_field(df, "p", lambda x, y: 0.25 * (F.cos(2 * k * x) + F.cos(2 * k * y)))
