"""Point-in-box candidate join on a multi-level grid.

Boxes of very different size (wall elements next to far-field ones) share one
table, so each box is registered in the cells of its own level, the power of two
nearest to its size; a box touches only a few cells however large it is.  Points
probe the cells of every level that occurs.  The set of levels is a scalar
subquery: it holds at most the ~2,100 exponents of a double (in practice a few), so
points are never shuffled or joined just to learn the grid.

Points are packed before the join: a batch-local sort turns the points of one cell
into one row of arrays (at most ``CHUNK`` points each).  The wide element arrays
then travel once per chunk instead of once per point, the join sees far fewer
rows, and a cell holding a third of all points is many bounded rows, not one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 512          # points per packed row
BUFFER = 1 << 17     # points sorted together

CELL = ("_lvl", "_cx", "_cy")


def box_level(dx: Column, dy: Column) -> Column:
    """Exponent of the cell size of a box: half its geometric mean side, but never so
    small that the box would touch more than ~64 cells along its longer side.

    Half a side keeps the candidates of a point near 4 on a regular mesh (9 with a
    full side), at the price of more cells per box; points outnumber boxes.
    """
    side = F.greatest(0.5 * F.sqrt(dx * dy), F.greatest(dx, dy) / 64.0, F.lit(1e-290))
    return F.round(F.log2(side)).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def register_boxes(boxes: DataFrame, x0, x1, y0, y1) -> DataFrame:
    """One row per (box, touched cell); adds the columns of ``CELL``."""
    x0, x1, y0, y1 = (F.col(c) for c in (x0, x1, y0, y1))
    lvl = F.col("_lvl")
    return (
        boxes.withColumn("_lvl", box_level(x1 - x0, y1 - y0))
        .withColumn("_cx", F.explode(F.sequence(_cell(x0, lvl), _cell(x1, lvl))))
        .withColumn("_cy", F.explode(F.sequence(_cell(y0, lvl), _cell(y1, lvl))))
    )


def probe_points(points: DataFrame, registered: DataFrame) -> DataFrame:
    """Points repeated for every level in use, with their cell; non-finite points are dropped."""
    levels = registered.agg(F.collect_set("_lvl")).scalar()
    finite = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    lvl = F.col("_lvl")
    return finite.withColumn("_lvl", F.explode(levels)).withColumns({"_cx": _cell(F.col("x"), lvl), "_cy": _cell(F.col("y"), lvl)})


def _codes(col: pa.Array) -> np.ndarray:
    """Integer codes that are equal exactly where the values are."""
    if pa.types.is_integer(col.type) and col.null_count == 0:
        return col.to_numpy(zero_copy_only=False)
    return col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def pack(df: DataFrame, by: list[str], lists: list[str], chunk: int = CHUNK) -> DataFrame:
    """Collect the ``lists`` columns of rows with equal ``by`` into arrays, batch-locally.

    No shuffle: rows of one key may end up in several packed rows, each of at most
    ``chunk`` entries.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(c, fields[c]) for c in by] + [T.StructField(c, T.ArrayType(fields[c])) for c in lists])

    def emit(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        rows = table.num_rows
        column = lambda c: table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type)
        codes = [_codes(column(c)) for c in by]
        order = np.lexsort(codes[::-1])
        new = np.zeros(rows, dtype=bool)
        new[0] = True
        for c in codes:
            v = c[order]
            new[1:] |= v[1:] != v[:-1]
        first = np.nonzero(new)[0]
        run = np.diff(np.append(first, rows))
        pieces = -(-run // chunk)  # split long runs
        start = np.repeat(first, pieces) + chunk * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        offsets = pa.array(np.append(start, rows).astype(np.int32))
        head, take = pa.array(order[start]), pa.array(order)
        cols = [column(c).take(head) for c in by] + [pa.ListArray.from_arrays(offsets, column(c).take(take)) for c in lists]
        return pa.RecordBatch.from_arrays(cols, names=by + lists)

    def run_pack(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= BUFFER:
                yield emit(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield emit(pa.Table.from_batches(held))

    return df.select(*by, *lists).mapInArrow(run_pack, schema)


def join_in_shares(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, spread: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which the rows of ``many`` under a hot key are dealt into shares.

    ``hot`` has the columns ``keys`` and ``shares``, one row per hot key, or is None; ``spread`` names columns of ``many`` whose
    hash deals its rows.  The rows of ``one`` under a hot key are there once for each share.  All other keys meet as in a plain
    join, so a bucketed or otherwise partitioned ``one`` keeps its layout.  Doesn't rely on adaptive execution.
    """
    if hot is None:
        return many.join(one, keys)
    cold = many.join(hot, keys, "left_anti").join(one, keys)
    dealt = many.join(hot, keys).withColumn("_share", F.pmod(F.xxhash64(*spread), F.col("shares"))).drop("shares")
    copies = one.join(hot, keys).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    return cold.unionByName(dealt.join(copies, [*keys, "_share"]).drop("_share"))


def repeat_index(list_col: pa.Array) -> np.ndarray:
    """Row number of every entry of a list column."""
    size = np.diff(list_col.offsets.to_numpy(zero_copy_only=False))
    return np.repeat(np.arange(len(list_col)), size)
