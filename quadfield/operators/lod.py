"""Level-of-detail tables: oversampled vertices, triangles and element outlines of a view."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadfield import basis
from quadfield.functions import kernels
from quadfield.functions.arrow_lists import row_groups
from quadfield.operators.boundary import side_values
from quadfield.operators.layout import keys_of, visible, with_bbox

#: power-of-two levels of an interactive view (fixed values)
LEVELS = (2, 4, 8, 16, 32, 64)
#: size of the vertex batches that leave a task's kernel
BATCH_BYTES = 8 << 20


def _extent(sx: float, sy: float) -> Column:
    return F.greatest((F.col("xmax") - F.col("xmin")) * sx, (F.col("ymax") - F.col("ymin")) * sy)


def lod_level(px_per_unit: tuple[float, float], px_per_cell: float = 3.0, largest: int = 64, smallest: int = 2, fixed: int | None = None) -> Column:
    """Sub-cells per element side from its size on screen (columns of ``with_bbox``)."""
    m = F.lit(int(fixed)) if fixed is not None else F.least(F.lit(largest), F.greatest(F.lit(2), F.ceil(_extent(*px_per_unit) / px_per_cell).cast("int")))
    return F.greatest(m, F.lit(smallest))


def contour_level(px_per_unit: tuple[float, float], px_per_cell: float = 3.0, largest: int = 64) -> Column:
    """Contours use cells of half the size and at least 4 per side."""
    return lod_level(px_per_unit, px_per_cell / 2, largest, 4)


def lod_power(scale: float, px_per_cell: float = 6.0) -> Column:
    """Power-of-two level 2..64 of an interactive view."""
    px = _extent(scale, scale) / px_per_cell
    k = F.ceil(F.log2(F.greatest(px, F.lit(1.0)))).cast("int") - 1
    return F.get(F.array(*[F.lit(v) for v in LEVELS]), F.least(F.lit(len(LEVELS) - 1), F.greatest(F.lit(0), k)))


def lod_elements(df: DataFrame, xlim, ylim, level: Column) -> DataFrame:
    """Visible elements with their level ``m``."""
    out = df if "xmin" in df.columns else with_bbox(df)
    return visible(out, xlim, ylim).withColumn("m", level)


def lod_vertices(elements: DataFrame, names: list[str], batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Vertex table ``(case, [step], elem, m, a, x, y, values)`` on ``(m + 1)^2`` points per element.

    An element at a high level is hundreds of times its stored size, so vertices leave the kernel in batches of about
    ``batch_bytes`` (one element at least), whatever the levels: no row ever holds an oversampled array.
    """
    keys = keys_of(elements, ("case", "step", "elem"))
    cols = ["x", "y", *[k for k in names if k not in ("x", "y")]]
    source = elements.where("m is not null").select(*keys, "m", *cols)
    kinds = {f.name: f.dataType for f in source.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in [*keys, "m"]] + [T.StructField("a", T.IntegerType())] + [T.StructField(k, T.DoubleType()) for k in cols])

    def run(batches):
        for b in batches:
            col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
            levels = col["m"].to_numpy(zero_copy_only=False)
            for rows, mats in row_groups([col[k] for k in cols]):
                rows = np.arange(b.num_rows) if rows is None else rows
                n = int(round(mats[0].shape[1] ** 0.5))
                for m in np.unique(levels[rows]).tolist():
                    own = np.flatnonzero(levels[rows] == m)
                    size, fine = (m + 1) ** 2, basis.resample_matrix(n, m + 1, "uniform")
                    per = max(1, batch_bytes // (8 * (len(keys) + 2 + len(cols)) * size))
                    for at in range(0, len(own), per):
                        part = own[at : at + per]
                        take = pa.array(np.repeat(rows[part], size))
                        values = [pa.array((fine @ mat[part].reshape(-1, n, n) @ fine.T).ravel()) for mat in mats]
                        place = pa.array(np.tile(np.arange(size, dtype=np.int32), len(part)))
                        yield pa.RecordBatch.from_arrays([*[col[k].take(take) for k in [*keys, "m"]], place, *values], names=[*keys, "m", "a", *cols])

    return source.mapInArrow(run, schema)


def lod_triangles(elements: DataFrame) -> DataFrame:
    """Two triangles per sub-cell as vertex numbers within the element: ``tri, v0, v1, v2``."""
    c = F.col
    keys = keys_of(elements, ("case", "step", "elem"))
    t = elements.select(*keys, "m", F.explode(F.sequence(F.lit(0), 2 * c("m") * c("m") - 1)).alias("tri"))
    cell = F.floor(c("tri") / 2).cast("int")
    a = F.floor(cell / c("m")).cast("int") * (c("m") + 1) + cell % c("m")
    d = a + c("m") + 2
    lower = c("tri") % 2 == 0
    return t.select(*keys, "m", "tri", a.alias("v0"), F.when(lower, a + 1).otherwise(d).alias("v1"), F.when(lower, d).otherwise(a + c("m") + 1).alias("v2"))


def edge_polylines(elements: DataFrame, points: int = 9) -> DataFrame:
    """The four curved sides of each element on uniform points: ``(elem, side, k, x, y)``."""
    keys = keys_of(elements, ("case", "step", "elem"))
    sides = elements.select(*keys, "x", "y", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("side"))
    fine = sides.select(*keys, "side", *[kernels.resample_edge(side_values(k, "side"), points).alias(k) for k in ("x", "y")])
    return fine.select(*keys, "side", F.posexplode(F.arrays_zip("x", "y")).alias("k", "_p")).select(*keys, "side", "k", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def level_targets(m: int) -> list[float]:
    """Reference coordinates of the vertices of a level, for checks."""
    return basis.uniform_points(m + 1).tolist()
