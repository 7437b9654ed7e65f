"""Nearest point of a wall to query points.

:func:`nearest_wall` looks within a distance; :func:`nearest_wall_any` has no limit.  The latter descends a pyramid of grid cells:
edges are counted into the cells of every level above their size, each cell with the box of what it holds.  Groups of neighbouring
points go down from the coarsest level and only follow cells that may still hold the nearest edge of one of their points: a cell whose smallest
distance exceeds another cell's largest one is left.  Bounds are minima of doubles, so each level is one join and one hash
aggregation over narrow rows; points and curves meet once, at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadfield import basis
from quadfield.functions.arrow_lists import row_groups
from quadfield.functions import kernels
from quadfield.operators.locate import SLICE
from quadfield.operators.scans import checkpointed
from quadfield.operators.spatial import CELL, pack, probe_points, register_boxes, repeat_index

# fixed values of the search: coarse points per edge, refinement rounds and steps
COARSE, ROUNDS, STEPS = 16, 3, 24
ON_END = 1e-9  # a foot so near to a line's end, in segments, is on it


def _segment_distance(px, py, x, y):
    """Distance of each point to its polyline ``(pairs, m)``, and whether its foot lies past the line's ends (or on its first point)."""
    ax, ay, bx, by = x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:]
    ux, uy = bx - ax, by - ay
    sq = ux * ux + uy * uy
    along = ((px[:, None] - ax) * ux + (py[:, None] - ay) * uy) / np.where(sq > 0, sq, 1.0)
    t = np.clip(along, 0.0, 1.0)
    dist = np.hypot(px[:, None] - ax - t * ux, py[:, None] - ay - t * uy)
    k, rows = dist.argmin(axis=1), np.arange(len(px))
    past = ((k == 0) & (along[rows, k] <= ON_END)) | ((k == dist.shape[1] - 1) & (along[rows, k] > 1 + ON_END))
    return dist[rows, k], past


def _closest(px, py, xe, ye):
    """Parameter of the closest point on each edge curve: coarse vertex, then refined brackets."""
    n = xe.shape[1]
    coarse = basis.resample_matrix(n, COARSE, "uniform")
    k = np.hypot(px[:, None] - xe @ coarse.T, py[:, None] - ye @ coarse.T).argmin(axis=1)
    width = 2.0 / (COARSE - 1)
    lo, hi = -1.0 + width * np.maximum(k - 1, 0), -1.0 + width * np.minimum(k + 1, COARSE - 1)
    rows = np.arange(len(px))
    for _ in range(ROUNDS):
        t = lo[:, None] + (hi - lo)[:, None] * np.linspace(0.0, 1.0, STEPS + 1)
        b = basis.lagrange(n, t)
        d = np.hypot(px[:, None] - np.einsum("pqi,pi->pq", b, xe), py[:, None] - np.einsum("pqi,pi->pq", b, ye))
        q = d.argmin(axis=1)
        best, dist, step = t[rows, q], d[rows, q], (hi - lo) / STEPS
        lo, hi = np.maximum(-1.0, best - step), np.minimum(1.0, best + step)
    return best, dist


def _points_on(qx, qy, X, Y, NX, NY, node):
    """``t``, distance and ``(wx, wy, nx, ny)`` on the edge of each point: the exact curve, or the given nodes."""
    n = X.shape[1]
    gll, d_mat, rows = basis.nodes(n), basis.derivative_matrix(n), np.arange(len(qx))
    if node is not None:
        wx, wy = X[rows, node], Y[rows, node]
        return gll[node], np.hypot(qx - wx, qy - wy), (wx, wy, NX[rows, node], NY[rows, node])
    t, dist = _closest(qx, qy, X, Y)
    L = basis.lagrange(n, t)
    on = lambda m: np.einsum("pi,pi->p", m, L)
    tx, ty = on(X @ d_mat.T), on(Y @ d_mat.T)
    size = np.maximum(np.hypot(tx, ty), 1e-300)
    nx, ny = ty / size, -tx / size
    k = np.abs(gll[None, :] - t[:, None]).argmin(axis=1)
    turn = np.where(nx * NX[rows, k] + ny * NY[rows, k] < 0, -1.0, 1.0)
    return t, dist, (on(X), on(Y), nx * turn, ny * turn)


def _solve(batches, keys, snap, limit):
    for b in batches:
        col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
        for rows, (X, Y, NX, NY) in row_groups([col["_ex"], col["_ey"], col["_nx"], col["_ny"]]):
            take = pa.array(np.arange(b.num_rows) if rows is None else rows)
            part = {c: col[c].take(take) for c in ["case", "elem", "side", "_px", "_py", *[f"_k_{k}" for k in keys]]}
            n = X.shape[1]
            sketch = basis.resample_matrix(n, COARSE, "uniform")
            row = repeat_index(part["_px"])
            px, py = (part[c].flatten().to_numpy(zero_copy_only=False) for c in ("_px", "_py"))
            payload = {k: part[f"_k_{k}"].flatten() for k in keys}
            for a in range(0, len(row), SLICE):
                e, qx, qy = row[a : a + SLICE], px[a : a + SLICE], py[a : a + SLICE]
                if snap:
                    every = np.hypot(qx[:, None] - X[e], qy[:, None] - Y[e])
                    node = every.argmin(axis=1)
                    rank, past = every[np.arange(len(e)), node], np.zeros(len(e), bool)
                else:
                    rank, past = _segment_distance(qx, qy, X[e] @ sketch.T, Y[e] @ sketch.T)
                near = np.nonzero(rank < limit)[0]
                if not len(near):
                    continue
                e, qx, qy, rank, past = e[near], qx[near], qy[near], rank[near], past[near]
                node = node[near] if snap else None
                t, dist, at = _points_on(qx, qy, X[e], Y[e], NX[e], NY[e], node)
                node = np.full(len(e), -1) if node is None else node
                at_row = pa.array(e)
                sel = pa.array(a + near)
                out = [part["case"].take(at_row)] + [payload[k].take(sel) for k in keys] + [part["elem"].take(at_row), part["side"].take(at_row), pa.array(node.astype(np.int32)), pa.array(t)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(v) for v in (*at, dist, rank, past)], names=["case", *keys, "elem", "side", "node", "t", "wx", "wy", "nx", "ny", "dist", "_rank", "_past"])


def _wall_curves(edges: DataFrame, mesh: DataFrame) -> DataFrame:
    """``case elem side`` with the nodes ``_ex _ey`` and normals ``_nx _ny`` of each edge."""
    c = F.col
    walls = edges.select("case", "elem", "side").join(mesh.select("case", "elem", "x", "y"), ["case", "elem"])
    walls = walls.select("case", "elem", "side", kernels.edge_frame("x", "y", "side", traversal=False).alias("_f"))
    return walls.select("case", c("elem").cast("long").alias("elem"), c("side").cast("int").alias("side"), *[c(f"_f.{k}").alias(v) for k, v in (("x", "_ex"), ("y", "_ey"), ("nx", "_nx"), ("ny", "_ny"))])


def nearest_wall(points: DataFrame, edges: DataFrame, mesh: DataFrame, max_dist: float, keys: list[str] | None = None, snap: bool = False) -> DataFrame:
    """Closest wall point within ``max_dist`` of each point ``(case, x, y, <keys>)``.

    ``edges(case, elem, side)`` are the allowed edges.  The nearest edge is found on its
    16-point polyline and the point then refined on the exact curve; of edges equally near to
    12 digits that takes the one which has the point's foot between its first point and its last
    (last included), then the lowest.  ``snap`` takes the nearest node instead.  Result: ``elem side node t wx wy nx ny dist``, ``node`` -1
    unless snapping, ``t`` in the index order of the side.  Points farther away are left out;
    rows that agree in keys and place stay as many rows as they were.
    """
    given = list(keys or ["pid"])
    keys = given + [f"_at_{k}" for k in ("x", "y") if k not in given]
    points = points.withColumns({"_at_x": F.col("x"), "_at_y": F.col("y")})
    c = F.col
    walls = _wall_curves(edges, mesh)
    lo = lambda k: F.array_min(k) - max_dist
    hi = lambda k: F.array_max(k) + max_dist
    boxes = register_boxes(walls.select("*", lo("_ex").alias("_x0"), hi("_ex").alias("_x1"), lo("_ey").alias("_y0"), hi("_ey").alias("_y1")), "_x0", "_x1", "_y0", "_y1").drop("_x0", "_x1", "_y0", "_y1")
    probes = probe_points(points, boxes).select("case", *CELL, c("x").alias("_px"), c("y").alias("_py"), *[c(k).alias(f"_k_{k}") for k in keys])
    packed = pack(probes, ["case", *CELL], ["_px", "_py", *[f"_k_{k}" for k in keys]])
    kinds = {f.name: f.dataType for f in points.schema.fields}
    num = T.DoubleType()
    schema = T.StructType(
        [T.StructField("case", kinds["case"])] + [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField("elem", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("node", T.IntegerType())]
        + [T.StructField(k, num) for k in ("t", "wx", "wy", "nx", "ny", "dist", "_rank")] + [T.StructField("_past", T.BooleanType())]
    )
    found = packed.join(boxes, ["case", *CELL]).drop(*CELL).mapInArrow(lambda it: _solve(it, keys, snap, float(max_dist)), schema)
    # distance first, then the edge that holds the foot, then the lowest edge
    order = F.when(c("_times") == 0, F.struct(F.round("_rank", 12), "_past", c("elem") * 4 + c("side")))
    picked = ["elem", "side", "node", "t", "wx", "wy", "nx", "ny", "dist"]
    # a blank row for each point counts the rows that agree in keys and place
    both = found.withColumn("_times", F.lit(0)).unionByName(points.select("case", *keys, F.lit(1).alias("_times")), allowMissingColumns=True)
    best = both.groupBy("case", *keys).agg(F.min_by(F.struct(*picked), order).alias("_b"), F.sum("_times").alias("_times")).where("_b.elem is not null")
    best = best.select("case", *given, *[c(f"_b.{k}").alias(k) for k in picked], "_times")
    once = F.explode(F.when(c("_times") > 1, F.sequence(F.lit(1).cast("long"), "_times")).otherwise(F.array(F.lit(1).cast("long"))))
    return best.select("case", *given, *picked, once.alias("_k")).drop("_k")


#: cells of a level are so many powers of two wider than those of the level below
STRIDE = 2
_SALTS = 16


def _spans(a0, a1, b0, b1):
    """Smallest and largest distance between a point of ``[a0, a1]`` and one of ``[b0, b1]``."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1), F.greatest(b1 - a0, a1 - b0)


def _with_bounds(df: DataFrame) -> DataFrame:
    """Adds ``_low`` and ``_up``: bounds of the distance from any point of the group's box to the nearest thing in the other box."""
    c = F.col
    lx, ux = _spans(c("_gx0"), c("_gx1"), c("_x0"), c("_x1"))
    ly, uy = _spans(c("_gy0"), c("_gy1"), c("_y0"), c("_y1"))
    return df.withColumns({"_low": F.hypot(lx, ly), "_up": F.hypot(ux, uy)})


def _pyramid(walls: DataFrame, bottom: int, top: int) -> DataFrame:
    """Entries ``(case, plvl, pcx, pcy, lvl, cx, cy, box, wall)``: cells and edges with the cell that holds them.

    Cells of the top level have ``plvl`` NULL; ``wall`` is NULL for cells.  An edge hangs on the cell of its own size.
    """
    c = F.col
    cell = lambda v, l: F.floor(v / F.pow(F.lit(2.0), l)).cast("long")
    box = ["_x0", "_x1", "_y0", "_y1"]
    own = walls.select("case", "wall", *box, c("own").alias("lvl"), ((c("_x0") + c("_x1")) / 2).alias("_mx"), ((c("_y0") + c("_y1")) / 2).alias("_my"))
    leaves = own.select("case", c("lvl").alias("plvl"), cell(c("_mx"), c("lvl")).alias("pcx"), cell(c("_my"), c("lvl")).alias("pcy"), F.lit(None).cast("int").alias("lvl"), F.lit(None).cast("long").alias("cx"), F.lit(None).cast("long").alias("cy"), *box, "wall")
    every = own.withColumn("lvl", F.explode(F.expr(f"sequence(lvl, {top}, {STRIDE})"))).withColumns({"cx": cell(c("_mx"), c("lvl")), "cy": cell(c("_my"), c("lvl"))})
    cells = every.groupBy("case", "lvl", "cx", "cy").agg(F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"))
    below = c("lvl") < top
    up = lambda k: F.when(below, F.shiftright(k, STRIDE))
    cells = cells.select("case", F.when(below, c("lvl") + STRIDE).alias("plvl"), up("cx").alias("pcx"), up("cy").alias("pcy"), "lvl", "cx", "cy", *box, F.lit(None).cast("long").alias("wall"))
    return cells.unionByName(leaves)


def _pruned(found: DataFrame) -> DataFrame:
    """Entries that may hold the nearest edge of a point of their group."""
    least = found.groupBy("_g").agg(F.min("_up").alias("_least"))
    return found.join(least, "_g").where(F.col("_low") <= F.col("_least") * (1 + 1e-12)).drop("_least", "_low", "_up")


def _nearest_stream(batches, keys, snap):
    """One row per point: a group's points come first, then its candidate edges in any number of batches."""
    names = ["case", *keys, "elem", "side", "node", "t", "wx", "wy", "nx", "ny", "dist"]
    held = None  # the running group: its points, and for each the best rank, whether its foot is past the ends, edge id, and place among the edges seen

    done, waiting = [], 0  # settled points of many groups, refined together

    def settle():
        nonlocal waiting
        g = held
        for pool in np.unique(g["pool"]):
            at = np.flatnonzero(g["pool"] == pool)
            if pool >= 0:
                row = pa.array(at)
                done.append((g["x"][at], g["y"][at], g["id"][at], [m[g["row"][at]] for m in g["seen"][pool]], [pa.repeat(g["case"], len(at)), *[g["payload"][k].take(row) for k in keys]]))
                waiting += len(at)

    def refine():
        nonlocal waiting
        for n in sorted({d[3][0].shape[1] for d in done}):
            own = [d for d in done if d[3][0].shape[1] == n]
            qx, qy, ids = (np.concatenate([d[k] for d in own]) for k in range(3))
            X, Y, NX, NY = (np.concatenate([d[3][k] for d in own]) for k in range(4))
            pick = np.hypot(qx[:, None] - X, qy[:, None] - Y).argmin(axis=1) if snap else None
            t, dist, place = _points_on(qx, qy, X, Y, NX, NY, pick)
            node = np.full(len(ids), -1) if pick is None else pick
            given = [pa.concat_arrays([d[4][k] for d in own]) for k in range(1 + len(keys))]
            yield pa.RecordBatch.from_arrays(given + [pa.array(ids >> 2), pa.array((ids & 3).astype(np.int32)), pa.array(node.astype(np.int32))] + [pa.array(v) for v in (t, *place, dist)], names=names)
        done.clear()
        waiting = 0

    def meet(ids, mats):
        """Edges against all points of the group, a bounded number of pairs at a time."""
        g, points = held, len(held["x"])
        every = np.argsort(ids)
        sketch = basis.resample_matrix(mats[0].shape[1], COARSE, "uniform")
        for lo in range(0, len(ids), max(1, SLICE // points)):
            order = every[lo : lo + max(1, SLICE // points)]
            part = [m[order] for m in mats]
            px, py = np.tile(g["x"], len(order)), np.tile(g["y"], len(order))
            u, v = (np.repeat(m if snap else m @ sketch.T, points, axis=0) for m in part[:2])
            rank, past = (np.hypot(px[:, None] - u, py[:, None] - v).min(axis=1), np.zeros(len(px), bool)) if snap else _segment_distance(px, py, u, v)
            rank, past = np.round(rank, 12).reshape(len(order), points), past.reshape(len(order), points)
            # equally near: the edge that holds the foot, then the lowest
            best = np.where(rank == rank.min(axis=0), past, 2).argmin(axis=0)
            at = np.arange(points)
            low, out, own = rank[best, at], past[best, at], ids[order][best]
            better = (low < g["rank"]) | ((low == g["rank"]) & ((out < g["past"]) | ((out == g["past"]) & (own < g["id"]))))
            if better.any():
                g["rank"][better], g["past"][better], g["id"][better], g["row"][better], g["pool"][better] = low[better], out[better], own[better], best[better], len(g["seen"])
                g["seen"].append(part)

    for b in batches:
        col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
        group, wall = col["_g"].to_numpy(), col["wall"]
        points = np.flatnonzero(np.asarray(wall.is_null()))
        cuts = np.unique(np.concatenate([[0, b.num_rows], points, points + 1, np.flatnonzero(np.diff(group)) + 1])).astype(int)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if not wall[lo].is_valid:
                if held is not None:
                    settle()
                if waiting >= SLICE:
                    yield from refine()
                x, y = (np.array(col[k][lo].values.to_numpy(zero_copy_only=False), float) for k in ("_px", "_py"))
                held = {
                    "case": col["case"][lo], "x": x, "y": y, "rank": np.full(len(x), np.inf), "past": np.ones(len(x), bool), "seen": [], **{k: np.full(len(x), -1, np.int64) for k in ("id", "row", "pool")},
                    "payload": {k: col[f"_k_{k}"][lo].values for k in keys},
                }
                continue
            take = pa.array(np.arange(lo, hi))
            ids = wall.slice(lo, hi - lo).to_numpy()
            for rows, mats in row_groups([col[k].take(take) for k in ("_ex", "_ey", "_nx", "_ny")]):
                meet(ids if rows is None else ids[rows], mats)
    if held is not None:
        settle()
    yield from refine()


def nearest_wall_any(points: DataFrame, edges: DataFrame, mesh: DataFrame, keys: list[str] | None = None, snap: bool = False) -> DataFrame:
    """Closest wall point of each point ``(case, x, y, <keys>)``, however far away; columns as in :func:`nearest_wall`.

    Points of a case without edges and points with a coordinate that is not finite are left out; repeated rows stay.  An
    edge's curve is taken to stay within its nodes' box and a tenth of its size around it.
    """
    keys, c = list(keys or ["pid"]), F.col
    span = F.greatest(F.array_max("_ex") - F.array_min("_ex"), F.array_max("_ey") - F.array_min("_ey"))
    walls = _wall_curves(edges, mesh).withColumns({"_pad": 0.1 * span + 1e-12 * F.array_max(F.transform("_ex", lambda v: F.abs(v))), "wall": c("elem") * 4 + c("side")})
    walls = walls.withColumns({"_x0": F.array_min("_ex") - c("_pad"), "_x1": F.array_max("_ex") + c("_pad"), "_y0": F.array_min("_ey") - c("_pad"), "_y1": F.array_max("_ey") + c("_pad")})
    size = F.greatest(c("_x1") - c("_x0"), c("_y1") - c("_y0"), F.lit(1e-290))
    walls = checkpointed(walls.withColumn("own", (F.ceil(F.log2(size) / STRIDE) * STRIDE).cast("int")).drop("_pad"))
    ends = walls.agg(F.min("own"), F.max("own"), F.avg("own"), *[F.log2(F.greatest(F.max(b) - F.min(a), F.lit(1e-290))) for a, b in (("_x0", "_x1"), ("_y0", "_y1"))]).first()
    finite = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    kinds = {f.name: f.dataType for f in points.schema.fields}
    num = T.DoubleType()
    schema = T.StructType(
        [T.StructField("case", kinds["case"])] + [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField("elem", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("node", T.IntegerType())] + [T.StructField(k, num) for k in ("t", "wx", "wy", "nx", "ny", "dist")]
    )
    if ends[0] is None:
        return points.sparkSession.createDataFrame([], schema)
    bottom, most, usual = int(ends[0]), int(ends[1]), round(ends[2])
    top = max(most, STRIDE * -int(-max(ends[3], ends[4]) // STRIDE))
    entries = checkpointed(_pyramid(walls, bottom, top))

    # groups of at most CHUNK points of one cell about as wide as a usual edge
    width = 2.0 ** (usual - 1)
    cells = finite.select("case", F.floor(c("x") / width).cast("long").alias("_cx"), F.floor(c("y") / width).cast("long").alias("_cy"), c("x").alias("_px"), c("y").alias("_py"), *[c(k).alias(f"_k_{k}") for k in keys])
    # points of a cell come together first: full groups are few, and all that is written on the way down is by group
    cells = cells.hint("rebalance", "case", "_cx", "_cy").sortWithinPartitions("case", "_cx", "_cy")
    packs = pack(cells, ["case", "_cx", "_cy"], ["_px", "_py", *[f"_k_{k}" for k in keys]]).drop("_cx", "_cy")
    packs = checkpointed(packs.withColumn("_g", F.monotonically_increasing_id()))
    group = packs.select("case", "_g", F.array_min("_px").alias("_gx0"), F.array_max("_px").alias("_gx1"), F.array_min("_py").alias("_gy0"), F.array_max("_py").alias("_gy1"))

    picked = ["case", "_g", "_gx0", "_gx1", "_gy0", "_gy1", "lvl", "cx", "cy", "wall"]
    roots = entries.where("plvl is null").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    found = group.withColumn("_salt", F.pmod(F.xxhash64("_g"), F.lit(_SALTS)).cast("int")).join(roots, ["case", "_salt"])
    open_ = checkpointed(_pruned(_with_bounds(found)).select(*picked, "_x0", "_x1", "_y0", "_y1"))
    while open_.where("wall is null").limit(1).count():
        down = open_.where("wall is null").select(*picked[:6], c("lvl").alias("plvl"), c("cx").alias("pcx"), c("cy").alias("pcy"))
        down = down.join(entries.where("plvl is not null"), ["case", "plvl", "pcx", "pcy"])
        both = down.select(*picked, "_x0", "_x1", "_y0", "_y1").unionByName(open_.where("wall is not null"))
        open_ = checkpointed(_pruned(_with_bounds(both)).select(*picked, "_x0", "_x1", "_y0", "_y1"))

    curves = open_.select("case", "_g", "wall").join(walls.select("case", "wall", "_ex", "_ey", "_nx", "_ny"), ["case", "wall"])
    rows = packs.withColumn("wall", F.lit(None).cast("long")).unionByName(curves, allowMissingColumns=True)
    rows = rows.repartition("_g").sortWithinPartitions("_g", c("wall").asc_nulls_first())
    return rows.mapInArrow(lambda it: _nearest_stream(it, keys, snap), schema)
