"""Boundaries: external edges, chains, corners and wall geometry.

Sides run counter-clockwise: 0 bottom (j=0), 1 right (i=n-1), 2 top (j=n-1, i
decreasing), 3 left (i=0, j decreasing).  Edges are keyed by ``eid = 4 * elem + side``
and oriented so that the domain lies on their left (mirrored elements reversed).

Vertices are matched with a tolerance relative to the edge lengths, so both joins
bucket on a grid whose cell follows the tolerance of the edge: a bucket holds only
edges that nearly coincide, whatever the grading of the mesh.

All tables here grow with the mesh, and coordinates of regular meshes shrink to a hundredth
in files and exchanges, by which Spark chooses what to broadcast: the joins ask for a merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadfield.functions import kernels
from quadfield.operators.clustering import with_curve
from quadfield.operators.scans import checkpointed, running_sum

# fixed values of the vertex matching
REL, FLOOR, CAP = 1e-3, 1e-6, 0.2
ANGLE_TOL = 0.5  # degrees
SIDE_NAMES = ("bottom", "right", "top", "left")

_GEOM = ("x0", "y0", "x1", "y1", "tx0", "ty0", "tx1", "ty1")


def match_tolerance(chord: Column, magnitude: Column) -> Column:
    """Distance within which two vertices are the same mesh point (``chord``: the smaller one)."""
    return F.least(CAP * chord, F.greatest(REL * chord, FLOOR * (1.0 + magnitude)))


def _tau(chord: Column, magnitude: Column, tol: float | None) -> Column:
    return F.lit(float(tol)) if tol is not None else match_tolerance(chord, magnitude)


def edge_table(mesh: DataFrame) -> DataFrame:
    """All four sides of every element with oriented end points and end tangents (one narrow pass)."""
    ends = mesh.select("case", "elem", kernels.edge_ends().alias("_e"))  # once per element, then four rows
    ends = ends.select("case", "elem", "_e", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("side"))
    return ends.select("case", "elem", "side", (F.col("elem") * 4 + F.col("side")).alias("eid"), F.col("_e.mirrored").alias("mirrored"), *[F.get(F.col(f"_e.{c}"), F.col("side")).alias(c) for c in _GEOM])


def _pow2(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _cell(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("long")


def external_edges(mesh: DataFrame, tol: float | None = None) -> DataFrame:
    """Edges that no other element shares, as rows of :func:`edge_table`.

    1. Edges whose end points fall into the same cells, a quarter of the tolerance
       wide, certainly match: one ``groupBy`` settles nearly all shared edges and leaves
       one representative per cell pair, however many copies there are.
    2. The single ones are anti-joined with the representatives in neighbouring cells
       under the exact tolerance; no pairs are produced.
    """
    c = F.col

    def measured(df):
        df = df.withColumns({"mx": 0.5 * (c("x0") + c("x1")), "my": 0.5 * (c("y0") + c("y1")), "chord": F.hypot(c("x1") - c("x0"), c("y1") - c("y0"))})
        df = df.withColumn("mag", F.hypot("mx", "my"))
        return df.withColumn("tau", _tau(c("chord"), c("mag"), tol))

    smallest = F.lit(2.0 ** -40) * (1.0 + c("mag"))  # collapsed edges have no tolerance of their own
    e = measured(edge_table(mesh)).withColumn("lvl", F.floor(F.log2(F.greatest(c("tau"), smallest))).cast("int"))
    e = e.where(c("case").isNotNull() & c("lvl").isNotNull())
    fine = _pow2(c("lvl") - 2)
    a = F.struct(_cell(c("x0"), fine).alias("u"), _cell(c("y0"), fine).alias("v"))
    b = F.struct(_cell(c("x1"), fine).alias("u"), _cell(c("y1"), fine).alias("v"))
    exact = F.when(c("tau") < smallest, F.xxhash64("x0", "y0", "x1", "y1")).otherwise(F.lit(0))
    e = e.select("*", a.alias("_a"), b.alias("_b"), exact.alias("_x"))
    e = e.withColumns({"_k": F.least("_a", "_b"), "_l": F.greatest("_a", "_b")})
    by = ["case", "lvl", c("_k.u").alias("_1"), c("_k.v").alias("_2"), c("_l.u").alias("_3"), c("_l.v").alias("_4"), "_x"]
    reps = e.groupBy(*by).agg(F.count(F.lit(1)).alias("copies"), F.min("eid").alias("eid"), *[F.min_by(k, "eid").alias(k) for k in ("mirrored", *_GEOM)])
    reps = checkpointed(measured(reps.drop("_1", "_2", "_3", "_4", "_x")))  # read twice, with different columns

    size = lambda L: _pow2(L + 4)
    single = reps.where("copies = 1").withColumns({"_cx": _cell(c("mx"), size(c("lvl"))), "_cy": _cell(c("my"), size(c("lvl")))})
    # the tolerance of a partner is within a factor 1.5, so it sits on this level or a neighbour
    eff = F.greatest(c("tau"), smallest)
    probe = reps.withColumn("lvl", F.explode(F.sequence(F.floor(F.log2(eff / 1.5)).cast("int"), F.floor(F.log2(eff * 1.5)).cast("int"))))
    reach = _pow2(c("lvl") + 1)
    probe = probe.withColumn("_cx", F.explode(F.sequence(_cell(c("mx") - reach, size(c("lvl"))), _cell(c("mx") + reach, size(c("lvl"))))))
    probe = probe.withColumn("_cy", F.explode(F.sequence(_cell(c("my") - reach, size(c("lvl"))), _cell(c("my") + reach, size(c("lvl"))))))
    p = probe.select("case", "lvl", "_cx", "_cy", *[c(k).alias(f"p_{k}") for k in ("eid", "x0", "y0", "x1", "y1", "mx", "my", "chord", "mag")])

    pair = _tau(F.least("chord", "p_chord"), F.greatest("mag", "p_mag"), tol)
    near = lambda u, v: F.hypot(c(f"x{u}") - c(f"p_x{v}"), c(f"y{u}") - c(f"p_y{v}")) <= pair
    theta = (c("eid") != c("p_eid")) & (F.hypot(c("mx") - c("p_mx"), c("my") - c("p_my")) <= pair) & ((near(0, 1) & near(1, 0)) | (near(0, 0) & near(1, 1)))
    # Spark's estimates leave out the copies for neighbouring cells: neither side is broadcast
    s, q = single.alias("s"), p.hint("merge").alias("q")
    keys = [c(f"s.{k}") == c(f"q.{k}") for k in ("case", "lvl", "_cx", "_cy")]
    on = keys[0] & keys[1] & keys[2] & keys[3] & theta
    return s.join(q, on, "left_anti").select("case", F.floor(c("eid") / 4).alias("elem"), (c("eid") % 4).cast("int").alias("side"), "eid", "mirrored", *_GEOM)


def turn_degrees(tx, ty, ux, uy) -> Column:
    """Angle between an incoming direction ``t`` and an outgoing one ``u``, 0..180."""
    return F.degrees(F.abs(F.atan2(tx * uy - ty * ux, tx * ux + ty * uy)))


def successors(edges: DataFrame, tol: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Links ``(keys, prev, eid, turn)``: edge ``eid`` continues edge ``prev``.

    The start of the next edge lies at the end of the previous one; where several do,
    the straightest continuation wins, and if two edges want the same continuation, the
    one that turns less gets it (then the smaller id).
    """
    keys = list(keys or ["case"])
    c = F.col
    e = edges.withColumn("chord", F.hypot(c("x1") - c("x0"), c("y1") - c("y0")))
    tiny = F.lit(2.0 ** -40)

    def level(x, y):
        m = F.hypot(x, y)
        return F.floor(F.log2(F.greatest(_tau(c("chord"), m, tol), tiny * (1.0 + m)))).cast("int")

    size = lambda L: _pow2(L + 2)
    starts = e.withColumn("lvl", level(c("x0"), c("y0")))
    starts = starts.select(
        *keys, "lvl", _cell(c("x0"), size(c("lvl"))).alias("_cx"), _cell(c("y0"), size(c("lvl"))).alias("_cy"),
        c("eid").alias("n_eid"), c("x0").alias("n_x"), c("y0").alias("n_y"), c("tx0").alias("n_tx"), c("ty0").alias("n_ty"), c("chord").alias("n_chord"),
    )
    levels = starts.agg(F.collect_set("lvl")).scalar()
    # the pair tolerance is at most that of either edge: look around the end point by the smaller one
    own = F.greatest(_tau(c("chord"), F.hypot("x1", "y1"), tol), tiny * (1.0 + F.hypot("x1", "y1")))
    ends = e.withColumn("lvl", F.explode(levels)).withColumn("_w", F.least(own, _pow2(c("lvl") + 1)))
    ends = ends.withColumn("_cx", F.explode(F.sequence(_cell(c("x1") - c("_w"), size(c("lvl"))), _cell(c("x1") + c("_w"), size(c("lvl"))))))
    ends = ends.withColumn("_cy", F.explode(F.sequence(_cell(c("y1") - c("_w"), size(c("lvl"))), _cell(c("y1") + c("_w"), size(c("lvl"))))))
    ends = ends.select(*keys, "lvl", "_cx", "_cy", "eid", "x1", "y1", "tx1", "ty1", "chord")
    gap = F.hypot(c("x1") - c("n_x"), c("y1") - c("n_y"))
    # Spark's estimates leave out the copies for neighbouring cells: neither side is broadcast
    pairs = ends.hint("merge").join(starts, [*keys, "lvl", "_cx", "_cy"]).where((c("eid") != c("n_eid")) & (gap <= _tau(F.least("chord", "n_chord"), F.hypot("x1", "y1"), tol)))
    pairs = pairs.select(*keys, "eid", "n_eid", turn_degrees(c("tx1"), c("ty1"), c("n_tx"), c("n_ty")).alias("turn"), gap.alias("gap"))
    chosen = pairs.groupBy(*keys, "eid").agg(F.min(F.struct("turn", "gap", "n_eid")).alias("_m"))
    return (
        chosen.select(*keys, c("_m.n_eid").alias("n_eid"), c("_m.turn").alias("turn"), "eid")
        .groupBy(*keys, "n_eid").agg(F.min(F.struct("turn", "eid")).alias("_m"))
        .select(*keys, c("_m.eid").alias("prev"), c("n_eid").alias("eid"), c("_m.turn").alias("turn"))
    )


def _local_lists(batches, keys: list[str]):
    """Contracts the chains of a partition: every edge gets the local list it is in.

    A list runs as far as predecessors are in the partition.  Columns: first edge ``h`` and its predecessor elsewhere ``prev``, place
    ``off`` and length ``n``, smallest edge ``low`` and its place ``low_off``.  A loop that lies in the partition is a list from its
    smallest edge on, with ``loop`` set.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    columns = {k: table.column(k).chunk(0) for k in table.column_names}
    total = table.num_rows
    eid = columns["eid"].to_numpy(zero_copy_only=False)
    none = np.asarray(columns["prev"].is_null())
    prev = np.where(none, -1, columns["prev"].fill_null(-1).to_numpy(zero_copy_only=False))
    group = np.zeros(total, np.int64)
    for k in keys:
        code = columns[k].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.unique(group * (code.max() + 1) + code, return_inverse=True)[1]
    number = np.unique(np.concatenate([eid, prev]), return_inverse=True)[1].astype(np.int64)
    wide = number.max() + 1
    own, wanted = group * wide + number[:total], group * wide + number[total:]
    order = np.argsort(own)
    at = np.minimum(np.searchsorted(own[order], wanted), total - 1)
    back = np.where(~none & (own[order][at] == wanted), order[at], -1)

    # pointer jumping inside the task
    me = np.arange(total)
    jump, off = np.where(back >= 0, back, me), (back >= 0).astype(np.int64)
    low, low_at, span = me.copy(), np.zeros(total, np.int64), 1
    hop = jump.copy()
    for _ in range(max(1, int(total).bit_length())):
        smaller = eid[low[hop]] < eid[low]
        low, low_at = np.where(smaller, low[hop], low), np.where(smaller, low_at[hop] + span, low_at)
        off, hop = off + off[hop], hop[hop]
        span *= 2
    loop = back[hop] >= 0
    head, place = np.where(loop, low, hop), np.where(loop, low_at, off)
    n = np.bincount(head, minlength=total)
    first = np.lexsort((eid, head))
    starts = np.flatnonzero(np.r_[True, head[first][1:] != head[first][:-1]])
    least = np.zeros(total, np.int64)
    least[head[first][starts]] = first[starts]
    least = least[head]
    out = [columns[k] for k in keys] + [
        columns["eid"], pa.array(eid[head]), pa.array(place), pa.array(n[head]), pa.array(prev[head], mask=none[head] | loop), pa.array(eid[least]), pa.array(place[least]), pa.array(loop),
    ]
    yield pa.RecordBatch.from_arrays(out, names=[*keys, "eid", "h", "off", "n", "prev", "low", "low_off", "loop"])


def rank_chains(edges: DataFrame, links: DataFrame, keys: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Position of every edge in its chain: ``(keys, eid, head, pos, closed)``.

    Edges are dealt along a space-filling curve of their start points, so most of a chain lies in few partitions.  Each
    partition contracts what it holds of a chain to one list; pointer doubling then runs over the lists that began elsewhere, about
    log2(lists of a chain) rounds of narrow joins, and none if no chain leaves its partition.  No chain is ever collected in one
    place.  An open chain is headed by its first edge, a loop by its smallest edge.
    """
    keys = list(keys or ["case"])
    c = F.col
    rows = edges.select(*keys, "eid", *[k for k in ("x0", "y0") if k in edges.columns]).join(links.select(*keys, "eid", "prev").hint("merge"), [*keys, "eid"], "left")
    rows = with_curve(rows, "x0", "y0") if "x0" in edges.columns else rows.withColumn("_curve", c("eid"))
    rows = rows.select(*keys, "eid", "prev", "_curve")
    rows = rows if partitions == 1 else checkpointed(rows)  # dealing by ranges reads them twice
    order = [*keys, "_curve"]
    dealt = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).select(*keys, c("eid").cast("long").alias("eid"), c("prev").cast("long").alias("prev"))
    kinds = {f.name: f.dataType for f in dealt.schema.fields}
    schema = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys] + [T.StructField(k, T.LongType()) for k in ("eid", "h", "off", "n", "prev", "low", "low_off")] + [T.StructField("loop", T.BooleanType())]
    )
    local = checkpointed(dealt.mapInArrow(lambda it: _local_lists(it, keys), schema))
    done = local.where("prev is null").select(*keys, "eid", c("h").alias("head"), c("off").alias("pos"), c("loop").alias("closed"))
    if local.where("prev is not null").isEmpty():
        return done
    return done.unionByName(_ranked_lists(local, keys))


def _ranked_lists(local: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of the edges whose list began elsewhere, by pointer doubling over lists.

    Of a list: ``ptr`` the list 2^k steps back, NULL once the walk fell off the start, ``back`` the edges from there to here; ``head``,
    ``dist`` the start of an open chain; ``low``, ``low_dist`` the list with the smallest edge seen so far.
    """
    c = F.col
    lists = local.where("off = 0 and not loop")
    tails = local.where("off = n - 1 and not loop").select(*keys, c("eid").alias("prev"), c("h").alias("ptr"), c("n").alias("back"))
    zero = F.lit(0).cast("long")
    state = lists.join(tails.hint("merge"), [*keys, "prev"], "left").select(
        *keys, "h", "n", c("low").alias("own_low"), "low_off", "ptr", "back", F.when(c("ptr").isNull(), c("h")).alias("head"), zero.alias("dist"), "low", zero.alias("low_dist"), F.lit(True).alias("changed"),
    )

    def double(state: DataFrame) -> DataFrame:
        far = state.select(*keys, c("h").alias("ptr"), *[c(k).alias(f"f_{k}") for k in ("ptr", "back", "head", "dist", "low", "low_dist")])
        moved = c("ptr").isNotNull()
        fell = moved & c("f_ptr").isNull()
        lower = moved & (c("f_low") < c("low"))
        return state.join(far.hint("merge"), [*keys, "ptr"], "left").select(
            *keys, "h", "n", "own_low", "low_off", F.when(moved, c("f_ptr")).alias("ptr"), F.when(moved & ~fell, c("back") + c("f_back")).otherwise(c("back")).alias("back"),
            F.when(fell, c("f_head")).otherwise(c("head")).alias("head"), F.when(fell, c("back") + c("f_dist")).otherwise(c("dist")).alias("dist"),
            F.when(lower, c("f_low")).otherwise(c("low")).alias("low"), F.when(lower, c("back") + c("f_low_dist")).otherwise(c("low_dist")).alias("low_dist"), (fell | lower).alias("changed"),
        )

    state = checkpointed(state)
    while True:
        state = checkpointed(double(state))
        if state.where("changed").isEmpty():
            break
    around = state.where("ptr is not null").groupBy(*keys, "low").agg(F.sum("n").alias("length"), F.max(F.when(c("own_low") == c("low"), c("low_off"))).alias("first"))
    ranked = state.join(around.hint("merge"), [*keys, "low"], "left")
    rest = local.where("prev is not null").select(*keys, "eid", "h", "off").join(ranked.select(*keys, "h", "ptr", "head", "dist", "low", "low_dist", "length", "first").hint("merge"), [*keys, "h"])
    loop = c("ptr").isNotNull()
    return rest.select(
        *keys, "eid", F.when(loop, c("low")).otherwise(c("head")).alias("head"),
        F.when(loop, F.pmod(c("low_dist") + c("off") - c("first"), c("length"))).otherwise(c("dist") + c("off")).alias("pos"), loop.alias("closed"),
    )


def chain_edges(edges: DataFrame, tol: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Edges (rows of :func:`edge_table`) in traversal order: adds ``head``, ``pos``, ``closed``, ``turn``.

    ``turn`` is the angle to the following edge in degrees, NULL at the end of an open chain.
    Runs jobs: the links, the ranking and the result are checkpointed.
    """
    keys = list(keys or ["case"])
    links = checkpointed(successors(edges, tol, keys))
    ranked = rank_chains(edges, links, keys)
    after = links.select(*keys, F.col("prev").alias("eid"), "turn")
    return checkpointed(edges.join(ranked.hint("merge"), [*keys, "eid"]).join(after.hint("merge"), [*keys, "eid"], "left"))


_LOOPS_LAST = 1 << 60


def split_chains(chains: DataFrame, angle: float = 90.0, prefix: str = "B") -> DataFrame:
    """Cut chains where they turn by ``angle`` degrees or more, and number the pieces.

    Open chains come first, by their first edge, then loops by their smallest edge.
    A loop with corners starts right after its last corner and yields open pieces; a
    smooth loop stays closed.  Output: ``boundary_edges`` with ``boundary`` (name),
    ``number``, ``seq`` and ``pos`` (0-based, in traversal order) and ``chain`` 0.
    """
    c = F.col
    cut = c("turn").isNull() | (c("turn") >= angle - ANGLE_TOL)
    e = chains.withColumn("_cut", cut.cast("long"))
    per = e.groupBy("case", "head").agg(F.count(F.lit(1)).alias("_len"), F.max(F.when(cut, c("pos"))).alias("_last"), F.max("_cut").alias("_any"), F.first("closed").alias("_loop"))
    e = e.join(per.drop("_loop").hint("merge"), ["case", "head"]).withColumn(
        "_at", F.when(c("closed") & (c("_any") == 1), F.pmod(c("pos") - c("_last") - 1, c("_len"))).otherwise(c("pos"))
    )
    e = checkpointed(running_sum(e, ["case", "head"], "_at", "_cut", "_g"))
    first = e.groupBy("case", "head", "_g").agg(F.min("_at").alias("_start"))
    count = first.groupBy("case", "head").agg(F.count(F.lit(1)).alias("_pieces"))
    order = per.join(count.hint("merge"), ["case", "head"]).withColumn("_order", c("head") + F.when(c("_loop"), F.lit(_LOOPS_LAST)).otherwise(F.lit(0)))
    offset = running_sum(order, ["case"], "_order", "_pieces", "_before").select("case", "head", "_before")
    named = first.join(offset.hint("merge"), ["case", "head"]).withColumn("number", (c("_before") + c("_g") + 1).cast("int"))
    return e.join(named.hint("merge"), ["case", "head", "_g"]).select(
        "case", F.concat(F.lit(prefix), c("number").cast("string")).alias("boundary"), "number", F.lit(0).alias("chain"),
        (c("_at") - c("_start")).alias("seq"), (c("_at") - c("_start")).alias("pos"), "elem", "side", "eid", (c("closed") & (c("_any") == 0)).alias("closed"),
        F.when(c("mirrored"), F.lit(-1)).otherwise(F.lit(1)).alias("orient"),
    )


def detect_boundaries(mesh: DataFrame, angle: float = 90.0, tol: float | None = None, prefix: str = "B") -> DataFrame:
    """``boundary_edges`` of every case at a feature angle (persist the result with the mesh)."""
    edges = checkpointed(external_edges(mesh, tol))
    return split_chains(chain_edges(edges, tol), angle, prefix)


def boundary_from_edges(mesh: DataFrame, picks: DataFrame, tol: float | None = None) -> DataFrame:
    """Hand-made boundaries from ``picks(case, boundary, elem, side, [seq])``.

    ``seq`` of the result walks along the chains of a boundary, open ones first;
    ``chain`` numbers them and ``pos`` counts within one.  ``given`` keeps the order of
    the picks (their ``seq``, else the edge id).  ``closed`` holds for a single loop.
    """
    c = F.col
    keys = ["case", "boundary"]
    given = c("seq") if "seq" in picks.columns else c("elem") * 4 + c("side")
    wanted = picks.select(*keys, "elem", "side", given.cast("long").alias("given"))
    touched = mesh.join(wanted.select("case", "elem").distinct().hint("merge"), ["case", "elem"], "left_semi")
    edges = checkpointed(edge_table(touched).join(wanted.hint("merge"), ["case", "elem", "side"]))
    chains = chain_edges(edges, tol, keys)
    per = chains.groupBy(*keys, "head").agg(F.count(F.lit(1)).alias("_len"), F.first("closed").alias("_loop"))
    per = per.withColumns({"_order": c("head") + F.when(c("_loop"), F.lit(_LOOPS_LAST)).otherwise(F.lit(0)), "_one": F.lit(1)})
    per = running_sum(running_sum(per, keys, "_order", "_len", "_before"), keys, "_order", "_one", "chain")
    several = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("_chains"))
    return chains.join(per.select(*keys, "head", "_before", "chain").hint("merge"), [*keys, "head"]).join(several.hint("merge"), keys).select(
        *keys, c("chain").cast("int").alias("chain"), (c("_before") + c("pos")).alias("seq"), "pos", "given", "elem", "side", "eid",
        (c("closed") & (c("_chains") == 1)).alias("closed"), F.when(c("mirrored"), F.lit(-1)).otherwise(F.lit(1)).alias("orient"),
    )


def edit_boundary(boundary_edges: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """Edge set ``(case, boundary, elem, side)`` after adding and removing edges."""
    cols = ["case", "boundary", "elem", "side"]
    out = boundary_edges.select(*cols)
    if remove is not None:
        out = out.join(remove.select(*cols).hint("merge"), cols, "left_anti")
    if add is not None:
        out = out.unionByName(add.select(*cols))
    return out.distinct()


def runs_with_edges(boundary_edges: DataFrame, picked: DataFrame) -> DataFrame:
    """All edges of the boundaries that contain one of the ``picked(case, elem, side)`` edges."""
    hit = boundary_edges.join(picked.select("case", "elem", "side").hint("merge"), ["case", "elem", "side"], "left_semi").select("case", "boundary").distinct()
    return boundary_edges.join(hit.hint("merge"), ["case", "boundary"], "left_semi")


def boundary_census(boundary_edges: DataFrame) -> DataFrame:
    """Edges per boundary, in total and per side, and whether it is closed."""
    return boundary_edges.groupBy("case", "boundary").agg(
        F.count(F.lit(1)).alias("edges"), F.first("closed").alias("closed"),
        *[F.count_if(F.col("side") == k).alias(name) for k, name in enumerate(SIDE_NAMES)],
    )


def side_values(f: str | Column, side: str | Column = "side", orient: Column | None = None) -> Column:
    """Node values along a side (index order; reversed where ``orient`` is -1), all native."""
    f = F.col(f) if isinstance(f, str) else f
    side = F.col(side) if isinstance(side, str) else side
    n = F.sqrt(F.size(f)).cast("int")
    pick = lambda k: F.when(side == 0, k).when(side == 1, k * n + n - 1).when(side == 2, n * n - 1 - k).otherwise(n * (n - 1 - k))
    out = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(f, pick(k)))
    return out if orient is None else F.when(orient < 0, F.reverse(out)).otherwise(out)


def wall_elements(boundary_edges: DataFrame, mesh: DataFrame, columns: list[str]) -> DataFrame:
    """Boundary edges with columns of their element; only those elements are kept of the mesh."""
    return boundary_edges.join(mesh.select("case", "elem", *columns).hint("merge"), ["case", "elem"])


def boundary_nodes(boundary_edges: DataFrame, mesh: DataFrame, names: list[str] = (), merge: bool = False) -> DataFrame:
    """Nodes, outward normals, weights and field values along boundaries in traversal order.

    ``merge=True`` keeps a vertex shared by consecutive edges once.
    """
    c = F.col
    e = wall_elements(boundary_edges, mesh, ["x", "y", *[k for k in names if k not in ("x", "y")]])
    keys = ["case", "boundary", "seq", "pos", "elem", "side"]
    e = e.select(*keys, kernels.edge_frame("x", "y", "side").alias("_f"), *[side_values(k, "side", c("orient")).alias(f"v_{k}") for k in names])
    rows = e.select(*keys, F.posexplode(F.arrays_zip(*[c(f"_f.{k}").alias(k) for k in ("x", "y", "nx", "ny", "w")], *[c(f"v_{k}") for k in names])).alias("node", "_z"))
    out = rows.select(*keys, "node", *[c(f"_z.{k}").alias(k) for k in ("x", "y", "nx", "ny", "w")], *[c(f"_z.v_{k}").alias(k) for k in names if k not in ("x", "y")])
    return out.where("pos = 0 or node > 0") if merge else out


def boundary_length(boundary_edges: DataFrame, mesh: DataFrame) -> DataFrame:
    """Length by quadrature of the exact tangents."""
    e = wall_elements(boundary_edges, mesh, ["x", "y"]).select("case", "boundary", kernels.edge_frame("x", "y", "side").getField("w").alias("_w"))
    return e.groupBy("case", "boundary").agg(F.sum(F.aggregate("_w", F.lit(0.0), lambda a, v: a + v)).alias("length"))


def boundary_polyline(boundary_edges: DataFrame, mesh: DataFrame, m: int) -> DataFrame:
    """``m`` uniform points per edge, shared vertices once, closed loops repeating the first point.

    ``(case, boundary, seq, k, x, y)``; a vertex is dropped when the previous edge of the boundary
    ends there (relative 1e-5, absolute 1e-8).
    """
    c = F.col
    e = wall_elements(boundary_edges, mesh, ["x", "y"]).select("case", "boundary", "seq", "closed", kernels.edge_frame("x", "y", "side").alias("_f"))
    e = e.select("case", "boundary", "seq", "closed", kernels.resample_edge(c("_f.x"), m).alias("px"), kernels.resample_edge(c("_f.y"), m).alias("py"))
    tail = e.select("case", "boundary", (c("seq") + 1).alias("seq"), F.get("px", F.lit(m - 1)).alias("_ex"), F.get("py", F.lit(m - 1)).alias("_ey"))
    close = lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
    j = e.join(tail.hint("merge"), ["case", "boundary", "seq"], "left")
    same = F.coalesce(close(F.get("px", F.lit(0)), c("_ex")) & close(F.get("py", F.lit(0)), c("_ey")), F.lit(False))
    pts = j.withColumn("_same", same).select("case", "boundary", "seq", "_same", F.posexplode(F.arrays_zip("px", "py")).alias("k", "_p"))
    pts = pts.where("not _same or k > 0").select("case", "boundary", "seq", "k", c("_p.px").alias("x"), c("_p.py").alias("y"))
    ends = e.groupBy("case", "boundary").agg(
        F.max("seq").alias("seq"), F.first("closed").alias("closed"),
        *[F.min_by(F.get(p, F.lit(0)), "seq").alias(f"_s{p}") for p in ("px", "py")], *[F.max_by(F.get(p, F.lit(m - 1)), "seq").alias(f"_e{p}") for p in ("px", "py")],
    )
    again = ends.where(c("closed") & ~(close(c("_spx"), c("_epx")) & close(c("_spy"), c("_epy"))))
    return pts.unionByName(again.select("case", "boundary", "seq", F.lit(m).alias("k"), c("_spx").alias("x"), c("_spy").alias("y")))


def default_normal_length(mesh: DataFrame) -> DataFrame:
    """Per case a tenth of the smaller extent, to three significant digits."""
    ext = mesh.groupBy("case").agg((F.max(F.array_max("x")) - F.min(F.array_min("x"))).alias("_w"), (F.max(F.array_max("y")) - F.min(F.array_min("y"))).alias("_h"))
    v = 0.1 * F.least("_w", "_h")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(v)) - 2)
    return ext.select("case", (F.rint(v / unit) * unit).alias("length"))


def normal_segments(seeds: DataFrame, mesh: DataFrame, traversal: bool = False) -> DataFrame:
    """Wall-normal segments from ``seeds(case, elem, side, node or t, length, ...)``: adds x0 y0 x1 y1.

    A positive length goes into the domain.  ``node`` and ``t`` (-1..1) count along the
    index order of the side, or along the traversal of the boundary when
    ``traversal`` is true (they differ on mirrored elements).
    """
    c = F.col
    s = seeds.join(mesh.select("case", "elem", c("x").alias("_x"), c("y").alias("_y")).hint("merge"), ["case", "elem"])
    if "t" in seeds.columns:
        t = c("t")
        if traversal:
            s = s.withColumn("_flip", kernels.edge_ends("_x", "_y").getField("mirrored"))
            t = F.when(c("_flip"), -c("t")).otherwise(c("t"))
        s = s.withColumn("_p", kernels.edge_point("_x", "_y", "side", t))
        at = {k: c(f"_p.{k}") for k in ("px", "py", "nx", "ny")}
    else:
        s = s.withColumn("_p", kernels.edge_frame("_x", "_y", "side", traversal))
        at = {k: F.get(c(f"_p.{v}"), c("node")) for k, v in (("px", "x"), ("py", "y"), ("nx", "nx"), ("ny", "ny"))}
    s = s.withColumns({"x0": at["px"], "y0": at["py"], "x1": at["px"] - c("length") * at["nx"], "y1": at["py"] - c("length") * at["ny"]})
    return s.select(*seeds.columns, "x0", "y0", "x1", "y1")
