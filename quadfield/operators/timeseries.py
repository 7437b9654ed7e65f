"""Steps in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TAIL = -9999
_TAIL_PARTS = 64


def step_number(steps: DataFrame, k: int) -> int:
    """Step index for ``k``; negative counts from the end.  Runs one aggregate over ``steps``."""
    count = steps.agg(F.max("step")).first()[0]
    count = 0 if count is None else count + 1
    at = k + count if k < 0 else k
    if not 0 <= at < count:
        raise IndexError(k)
    return at


def pick_step(fields: DataFrame, k: int, steps: DataFrame | None = None) -> DataFrame:
    """Rows of one step; a filter on the partition column."""
    return fields.where(F.col("step") == step_number(fields.select("step") if steps is None else steps, k))


def step_at_time(queries: DataFrame, steps: DataFrame, time: str = "time") -> DataFrame:
    """Nearest step of each query row ``(case, <time>, ...)``; the earlier one on a tie.

    Every step owns the times closer to it than to its neighbours.  These intervals are
    hashed into cells of their own size, so a query finds its step by an equi-join:
    no cross join, and no window over the queries.  The two open intervals at the ends of
    a case are the same for all its queries: they are repeated in a fixed number of cells
    and a query row picks one by its hash, so no cell holds all of a case.  ``steps`` is
    metadata (a row per file); only its neighbours are found with a window.
    """
    c = F.col
    one = steps.groupBy("case", c("time").alias("_t")).agg(F.min("step").alias("step"))
    w = Window.partitionBy("case").orderBy("_t")
    own = one.withColumns({"_p": F.lag("_t").over(w), "_n": F.lead("_t").over(w)})
    lo, hi = (c("_p") + c("_t")) / 2, (c("_n") + c("_t")) / 2
    slack = 1e-9 * (F.abs("_t") + F.abs(F.coalesce("_p", "_t")) + F.abs(F.coalesce("_n", "_t")))
    width = F.greatest(hi - lo, F.lit(1e-290))
    own = own.withColumn("_lvl", F.when(c("_p").isNull() | c("_n").isNull(), F.lit(_TAIL)).otherwise(F.ceil(F.log2(width)).cast("int")))
    tail = c("_lvl") == _TAIL
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.greatest(c("_lvl"), F.lit(-960)))).cast("long")
    parts = F.sequence(F.lit(0).cast("long"), F.lit(_TAIL_PARTS - 1).cast("long"))
    cells = own.withColumn("_cell", F.explode(F.when(tail, parts).otherwise(F.sequence(cell(lo - slack), cell(hi + slack)))))
    levels = own.agg(F.collect_set("_lvl")).scalar()
    probes = queries.withColumn("_q", c(time).cast("double")).withColumn("_lvl", F.explode(levels))
    spread = F.pmod(F.xxhash64(*queries.columns), F.lit(_TAIL_PARTS))
    probes = probes.withColumn("_cell", F.when(tail, spread).otherwise(cell(c("_q"))))
    gap = lambda t: F.abs(c("_q") - t)
    nearest = (c("_p").isNull() | (gap(c("_t")) < gap(c("_p")))) & (c("_n").isNull() | (gap(c("_t")) <= gap(c("_n"))))
    return probes.join(cells, ["case", "_lvl", "_cell"]).where(nearest).select(*queries.columns, "step", c("_t").alias("step_time"))


def with_mesh(fields: DataFrame, mesh: DataFrame, step_mesh: DataFrame | None = None) -> DataFrame:
    """Field rows with coordinates; a step's own mesh ``(case, step, elem, x, y)`` wins over the shared one."""
    shared = [k for k in mesh.columns if k not in ("case", "elem")]
    out = fields.join(mesh, ["case", "elem"], "left" if step_mesh is not None else "inner")
    if step_mesh is None:
        return out
    own = step_mesh.select("case", "step", "elem", *[F.col(k).alias(f"_own_{k}") for k in shared if k in step_mesh.columns])
    out = out.join(own, ["case", "step", "elem"], "left")
    return out.withColumns({k: F.coalesce(f"_own_{k}", k) for k in shared if k in step_mesh.columns}).drop(*[f"_own_{k}" for k in shared])


def shared_mesh(step_mesh: DataFrame) -> DataFrame:
    """The mesh of each case: that of its first step with coordinates."""
    first = step_mesh.groupBy("case").agg(F.min("step").alias("step"))
    return step_mesh.join(first, ["case", "step"], "left_semi").drop("step")
