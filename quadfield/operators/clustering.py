"""Order of elements along a space-filling curve, for storage and for partitions of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def curve(ix: Column, iy: Column, bits: int = BITS) -> Column:
    """Place of a cell ``(ix, iy)`` of a ``2 ** bits`` square grid on the Hilbert curve.

    From the highest bit down: the quadrant adds two bits, and the cells of the lower quadrants are turned into the
    orientation of the curve there.
    """
    last = (1 << bits) - 1

    def step(s, b):
        x, y = s["x"], s["y"]
        right, up = (F.call_function("shiftright", v, b).bitwiseAND(F.lit(1).cast("long")) for v in (x, y))
        d = s["d"] * 4 + (right * 3).bitwiseXOR(up)
        flip = right == 1
        turned = F.struct(F.when(flip, last - y).otherwise(y).alias("x"), F.when(flip, last - x).otherwise(x).alias("y"), d.alias("d"))
        return F.when(up == 0, turned).otherwise(F.struct(x.alias("x"), y.alias("y"), d.alias("d")))

    start = F.struct(ix.cast("long").alias("x"), iy.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["d"])


def with_curve(df: DataFrame, x: str | Column, y: str | Column, name: str = "_curve", bits: int = BITS) -> DataFrame:
    """Adds the place of ``(x, y)`` on the curve over the extent of the whole table; a place that is null or not finite comes first.

    The extent is one aggregate over the table, run here: four numbers, however many cases there are.
    """
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    fine = lambda v: F.when(F.abs(v) < float("inf"), v)
    ends = df.select(fine(x).alias("x"), fine(y).alias("y")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    cells = (1 << bits) - 1

    def cell(v, lo, hi):
        at = F.floor((v - lo) / (hi - lo) * cells) if hi is not None and hi > lo else F.when(v.isNotNull(), F.lit(0))
        return at.cast("long")

    place = curve(cell(fine(x), ends.x0, ends.x1), cell(fine(y), ends.y0, ends.y1), bits)
    return df.withColumn(name, F.coalesce(place, F.lit(-1).cast("long")))


def clustered(df: DataFrame, x: str | Column, y: str | Column, first: list[str] = (), partitions: int | None = None) -> DataFrame:
    """Rows dealt and sorted by ``first`` and their place on the curve: neighbours share partitions, files and row groups."""
    keyed = with_curve(df, x, y)
    order = [*first, "_curve"]
    parted = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    return parted.sortWithinPartitions(*order).drop("_curve")
