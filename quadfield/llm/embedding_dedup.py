"""Near-duplicate embeddings by sorted projection passes.

In a pass, vectors are ordered by the signs of their projections on random directions, joined to one number and read from its first bit
on; vectors that point the same way stand close together.  Each is compared with its neighbours in a window of ``WINDOW`` places.  Passes
differ in their directions; what they find is united.

* **Balls.**  A window can't hold a large group of copies, so groups are taken out of the passes first.  Two sorted rounds go over the
  vectors and let a leader absorb what lies within half the linking angle of it: all members of such a ball link with each other, by
  the triangle inequality, and none of these pairs has to be looked at.  A round is a stream over sorted partitions that remembers
  ``LEADERS`` leaders a task; a group that makes up a third of the table is simply spread over tasks and has a leader in each.
* **Passes** compare leaders.  With the angle between two leaders and the radii of their balls a pair of balls links as a whole, or not at all, or
  is open.  Open pairs are settled vector by vector, in blocks of both balls.  Single vectors are balls of radius 0 and never open.
* **Each pair counts once.**  Leaders carry their places in all passes; a pair is counted by the first pass whose window holds it.  Tasks return
  sums for each leader and a spanning forest of the links they saw, never the pairs.
* A pass cuts the order into pieces of ``PIECE`` places; the last ``WINDOW`` rows of a piece are copied to the next one.  Rows move once a pass.

Vectors link only if labels are equal and not null and lengths are equal.  Null or empty vectors, zero vectors and those with null or
non-finite components link with nothing.  Repeated rows are other vectors like any: they link.  A null vec_id is never the smallest of a
component; a component without ids has a null component_id and all of its rows are kept.  Rows that share the smallest vec_id are all
kept.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadfield.llm.common import staged
from quadfield.llm.components import components

COSINE = 0.93
BITS = 62
ROUNDS = 2
PASSES = 8
WINDOW = 512
PIECE = 4096
LEADERS = 128
STEP = 1024
#: allowance for the rounding of an angle taken from a cosine near 1
SLACK = 1e-6
SALTS = 16
BLOCK = 1024


@lru_cache(maxsize=16)
def directions(dim: int, seeds: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([np.random.default_rng([dim, s]).standard_normal((dim, BITS)) for s in seeds], axis=1)


def codes(units: np.ndarray, seeds: tuple[int, ...]) -> np.ndarray:
    """(rows, seeds): the signs of the projections of each seed as one number, the first in the highest bit."""
    signs = (units @ directions(units.shape[1], seeds) > 0).reshape(len(units), len(seeds), BITS)
    return signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as unit rows in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def segments(*columns: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows that agree in all columns."""
    n = len(columns[0])
    if not n:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        v = c.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    cuts = [*np.flatnonzero(new), n]
    return list(zip(cuts[:-1], cuts[1:]))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _coded(seeds: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            dims, vec = batch.column("dim").to_numpy(), batch.column("vec")
            out = np.zeros((batch.num_rows, len(seeds)), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                out[at] = codes(unit_rows(vec.take(pa.array(at)), int(d)), seeds)
            extra = [pa.array(out[:, k]) for k in range(len(seeds))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *[f"code{k}" for k in range(len(seeds))]])

    return run


def with_codes(df: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    schema = StructType(list(df.schema))
    for k in range(len(seeds)):
        schema = schema.add(f"code{k}", "long")
    return df.mapInArrow(_coded(seeds), schema)


class _Leaders:
    """Leaders of the running (label, length) segment: unit vectors, ids, weights, radii."""

    def __init__(self, half: float):
        self.half, self.key = half, None
        self.clear()

    def clear(self):
        self.unit, self.rows, self.n, self.r = None, [], np.zeros(0, np.int64), np.zeros(0)

    def absorb(self, units: np.ndarray, ids: np.ndarray, n: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Leader (place in ``rows``) of each row; rows without one become leaders.  ``rows`` holds ids."""
        m, old = len(ids), len(self.rows)
        to = np.full(m, -1)
        if old:
            reach = angles(units, self.unit) + r[:, None] + SLACK
            best = reach.argmin(axis=1)
            ok = reach[np.arange(m), best] <= self.half
            to[ok] = best[ok]
            np.add.at(self.n, best[ok], n[ok])
            np.maximum.at(self.r, best[ok], reach[np.arange(m), best][ok])
        rest = np.flatnonzero(to < 0)
        reach = angles(units[rest], units[rest]) + r[rest][None, :] + SLACK
        near = reach <= self.half
        np.fill_diagonal(near, True)
        free = np.ones(len(rest), bool)
        lead = []
        alone = near.sum(axis=1) == 1
        for i in range(len(rest)):
            if not free[i]:
                continue
            if alone[i]:
                got = np.array([i])
            else:
                got = np.flatnonzero(near[i] & free)
            free[got] = False
            to[rest[got]] = old + len(lead)
            others = got[got != i]
            lead.append((rest[i], n[rest[got]].sum(), max(r[rest[i]], reach[i, others].max(initial=0.0))))
        if lead:
            at = np.array([x[0] for x in lead])
            self.unit = units[at] if self.unit is None else np.concatenate([self.unit, units[at]])
            self.rows += [ids[k] for k in at]
            self.n = np.concatenate([self.n, [x[1] for x in lead]]).astype(np.int64)
            self.r = np.concatenate([self.r, [x[2] for x in lead]])
        return to

    def spare(self, most: int) -> np.ndarray:
        """Places of the leaders to let go: all but the ``most`` heaviest, later ones first among equals."""
        if len(self.rows) <= most:
            return np.zeros(0, np.int64)
        order = np.lexsort((-np.arange(len(self.rows)), -self.n))
        return np.sort(order[most:])

    def drop(self, gone: np.ndarray):
        keep = np.setdiff1d(np.arange(len(self.rows)), gone)
        self.unit, self.n, self.r = self.unit[keep], self.n[keep], self.r[keep]
        self.rows = [self.rows[k] for k in keep]


def _absorb(half: float, most: int):
    def run(batches):
        state = _Leaders(half)

        def leaders(places):
            return pa.RecordBatch.from_arrays(
                [pa.array([state.rows[k] for k in places], pa.int64()), pa.array([state.rows[k] for k in places], pa.int64()), pa.array(state.n[places]), pa.array(state.r[places])],
                ["uid", "leader", "n", "radius"],
            )

        for batch in batches:
            for a, b in segments(batch.column("lab"), batch.column("dim")):
                key = (batch.column("lab")[a].as_py(), batch.column("dim")[a].as_py())
                if key != state.key:
                    if state.rows:
                        yield leaders(np.arange(len(state.rows)))
                    state.clear()
                    state.key = key
                for s in range(a, b, STEP):
                    part = batch.slice(s, min(STEP, b - s))
                    ids, n = part.column("uid").to_numpy(), part.column("n").to_numpy()
                    to = state.absorb(unit_rows(part.column("vec"), key[1]), ids, n, part.column("radius").to_numpy())
                    lead = np.array(state.rows)[to]
                    gone = lead != ids
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[gone]), pa.array(lead[gone]), pa.array(n[gone]), pa.nulls(int(gone.sum()), pa.float64())], ["uid", "leader", "n", "radius"]
                    )
                    let = state.spare(most)
                    if len(let):
                        yield leaders(let)
                        state.drop(let)
        if state.rows:
            yield leaders(np.arange(len(state.rows)))

    return run


def absorbed(balls: DataFrame, seed: int, cosine: float = COSINE, most: int = LEADERS) -> DataFrame:
    """One round: (uid, leader, n, radius); n and radius are those of the leader's ball; an absorbed row has its own n and no radius.

    ``balls``: uid, lab, dim, vec, n, radius, where a radius is at most half the linking angle.
    """
    half = (acos(cosine) - 10 * SLACK) / 2
    order = ["lab", "dim", "code0", "uid"]
    ordered = with_codes(balls.select("uid", "lab", "dim", "vec", "n", "radius"), (1000 + seed,)).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(_absorb(half, most), "uid long, leader long, n long, radius double")


def _numbered(batches):
    """Adds the place of a row in its partition."""
    n = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + batch.num_rows))], [*batch.schema.names, "i"])
        n += batch.num_rows


def places(balls: DataFrame, passes: int) -> DataFrame:
    """(uid, place): for each ball its places in all passes.  Only ids and codes move; the orders of all passes are made in one sort."""
    coded = with_codes(balls.select("uid", "lab", "dim", "vec"), tuple(range(passes)))
    rows = coded.select("uid", "lab", "dim", F.posexplode(F.array(*[f"code{k}" for k in range(passes)])).alias("pass", "code"))
    order = ["pass", "lab", "dim", "code", "uid"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "pass", F.spark_partition_id().alias("part"))
    numbered = staged(ordered.mapInArrow(_numbered, "uid long, pass int, part int, i long"))
    # partitions are as many as shuffle tasks, whatever the rows; a pass is apart from the next by far more than a window
    ends = sorted((r.part, r.n) for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, table = 0, []
    for part, n in ends:
        table.append((part, before))
        before += n
    starts = numbered.sparkSession.createDataFrame(table, "part int, before long")
    at = numbered.join(F.broadcast(starts), "part").select("uid", F.struct("pass", (F.col("before") + F.col("i")).alias("place")).alias("p"))
    return at.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["place"]).alias("place"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == was).all():
            break
        on = root[a] != root[b]
        a, b = a[on], b[on]
    while (root[root] != root).any():
        root = root[root]
    return root


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> bool:
    """The test of one pair of vectors, with exactly rounded sums."""
    x, y = x.tolist(), y.tolist()
    return fsum(p * q for p, q in zip(x, y)) >= cosine * sqrt(fsum(p * p for p in x)) * sqrt(fsum(q * q for q in y))


def single_links(a: np.ndarray, b: np.ndarray, dots: np.ndarray, cosine: float) -> np.ndarray:
    """Where unit rows a x b link; cosines within rounding of the threshold are tested pair by pair."""
    on = dots >= cosine
    for i, j in np.argwhere(np.abs(dots - cosine) < 1e-13):
        on[i, j] = linked(a[i], b[j], cosine)
    return on


FOUND = "kind string, a long, b long, n long"


def _found(kind: str, a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["kind", "a", "b", "n"])


def compare(table: pa.Table, number: int, cosine: float, window: int) -> list[pa.RecordBatch]:
    """Links of the balls of one piece of pass ``number``; rows in order of place, copied rows first.

    kind "count": ``n`` members of other balls link with every member of ball a; "edge": a and b belong together; "open": a pair of balls
    that has to be settled vector by vector.
    """
    theta = acos(cosine)
    at = np.array(table.column("place").combine_chunks().flatten().to_numpy()).reshape(table.num_rows, -1)
    table = table.take(pa.array(np.argsort(at[:, number], kind="stable")))
    at = at[np.argsort(at[:, number], kind="stable")]
    uid, n, r = (table.column(c).to_numpy() for c in ("uid", "n", "radius"))
    own = table.column("own").to_numpy(zero_copy_only=False)
    lab, dim, vec = (table.column(c).combine_chunks() for c in ("lab", "dim", "vec"))
    counts = np.zeros(len(uid), np.int64)
    ends_a, ends_b, opens = [], [], []
    for lo, hi in segments(lab, dim):
        u = unit_rows(vec.slice(lo, hi - lo), dim[lo].as_py())
        for s in range(lo, hi, window):
            e, f = min(s + window, hi), min(s + 2 * window, hi)
            dots = u[s - lo : e - lo] @ u[s - lo : f - lo].T
            reach = np.minimum(theta + r[s:e, None] + r[None, s:f] + SLACK, np.pi)
            i, j = np.nonzero(dots >= np.cos(reach) - 1e-12)
            i, j = i + s, j + s
            gap = at[j, number] - at[i, number]
            on = (gap > 0) & (gap <= window) & own[j]
            for q in range(number):
                on &= np.abs(at[j, q] - at[i, q]) > window
            i, j = i[on], j[on]
            d = dots[i - s, j - s]
            lone = (r[i] == 0) & (r[j] == 0)
            whole = lone & (d >= cosine)
            for k in np.flatnonzero(lone & (np.abs(d - cosine) < 1e-13)):
                whole[k] = linked(u[i[k] - lo], u[j[k] - lo], cosine)
            phi, both = np.arccos(np.clip(d, -1, 1)), r[i] + r[j]
            whole |= ~lone & (phi + both + SLACK <= theta)
            undecided = ~lone & ~whole & (phi - both - SLACK <= theta)
            np.add.at(counts, i[whole], n[j[whole]])
            np.add.at(counts, j[whole], n[i[whole]])
            ends_a.append(i[whole])
            ends_b.append(j[whole])
            opens.append((uid[i[undecided]], uid[j[undecided]], n[i[undecided]], n[j[undecided]]))
    out = []
    if ends_a:
        root = forest(len(uid), np.concatenate(ends_a), np.concatenate(ends_b))
        child = np.flatnonzero(root != np.arange(len(uid)))
        out.append(_found("edge", uid[child], uid[root[child]], np.zeros(len(child), np.int64)))
        on = np.flatnonzero(counts)
        out.append(_found("count", uid[on], uid[on], counts[on]))
        a, b, na, nb = (np.concatenate(x) for x in zip(*opens))
        out.append(_found("open", a, b, na))
    return out


def one_pass(placed: DataFrame, number: int, cosine: float, window: int, piece: int) -> DataFrame:
    """Counts, edges and open pairs of one pass."""
    place = F.col("place")[number]
    home = F.expr(f"place[{number}] div {piece}")
    tail = F.when(F.pmod(place, F.lit(piece)) >= piece - window, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    rows = placed.withColumn("own", F.explode(tail)).select("uid", "lab", "dim", "vec", "n", "radius", "place", "own", (home + F.when(F.col("own"), 0).otherwise(1)).alias("piece"))

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(compare(table, number, cosine, window), schema=_found("", [], [], []).schema)

    return rows.groupBy("piece").applyInArrow(run, FOUND)


def _settled(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """One block of ball a against one block of ball b."""
        left = table.column("left").to_numpy(zero_copy_only=False)
        rows, dim = np.arange(table.num_rows), table.column("dim")[0].as_py()
        vec, uid = table.column("vec").combine_chunks(), table.column("uid").to_numpy()
        sides = [rows[left], rows[~left]]
        if not len(sides[0]) or not len(sides[1]):
            return pa.Table.from_batches([_found("edge", [], [], [])])
        x, y = (unit_rows(vec.take(pa.array(s)), dim) for s in sides)
        on = single_links(x, y, x @ y.T, cosine)
        out = [_found("member", uid[s], uid[s], on.sum(axis=1 - k)) for k, s in enumerate(sides)]
        if on.any():
            out.append(_found("edge", [table.column("a")[0].as_py()], [table.column("b")[0].as_py()], [0]))
        return pa.Table.from_batches(out)

    return run


def settle(opens: DataFrame, members: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """Open pairs of balls, vector by vector: (kind "member": ``n`` links of vector a) and edges between the balls.

    ``opens``: a, b; ``members``: uid, ball, n_ball, dim, vec.  Both balls are cut into blocks, so a task holds two blocks whatever the balls' sizes.
    """
    ball = members.select("uid", "ball", "dim", "vec", F.ceil(F.col("n_ball") / block).alias("cuts"))
    sizes = members.groupBy("ball").agg(F.ceil(F.max("n_ball") / block).alias("cuts"))
    pairs = opens.select("a", "b").join(sizes.select(F.col("ball").alias("a"), F.col("cuts").alias("cut_a")), "a").join(sizes.select(F.col("ball").alias("b"), F.col("cuts").alias("cut_b")), "b")
    own = F.pmod(F.xxhash64("uid"), F.col("cuts"))

    def side(key: str, left: bool) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut_b" if left else "cut_a") - 1))
        got = pairs.join(ball, F.col(key) == F.col("ball")).withColumn("own", own).withColumn("other", other)
        i, j = ("own", "other") if left else ("other", "own")
        return got.select("a", "b", F.col(i).alias("i"), F.col(j).alias("j"), "uid", "dim", "vec", F.lit(left).alias("left"))

    return side("a", True).unionByName(side("b", False)).groupBy("a", "b", "i", "j").applyInArrow(_settled(cosine), FOUND)


def usable(vec, label):
    return F.coalesce(
        label.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False)
    )


def mark(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, piece: int = PIECE, most: int = LEADERS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept; see the module's description for each case."""
    source = vectors.select("vec_id", F.col("embedding").alias("vec"), F.col("label").cast("string").alias("lab"))
    on = usable(F.col("vec"), F.col("lab"))
    out = source.filter(~on).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = staged(source.filter(on).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", "lab", F.size("vec").alias("dim"), "vec", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("radius"),
    ))

    # rounds of balls: a chain of narrow tables (uid, leader)
    balls, owner = rows, None
    for k in range(ROUNDS):
        got = staged(absorbed(balls, k, cosine, most))
        lead = got.filter(F.col("uid") == F.col("leader"))
        balls = staged(balls.select("uid", "lab", "dim", "vec").join(lead.select("uid", "n", "radius"), "uid"))
        if owner is None:
            owner = got.select("uid", "leader")
        else:
            step = _salted(got.select(F.col("uid").alias("mid"), "leader", "n")).drop("n")
            owner = staged(owner.select("uid", F.col("leader").alias("mid"), _salt("leader").alias("salt")).join(step, ["mid", "salt"]).select("uid", "leader"))

    placed = staged(balls.join(places(balls, passes), "uid"))
    found = None
    for number in range(passes):
        new = staged(one_pass(placed, number, cosine, window, piece))
        found = new if found is None else found.unionByName(new)
    opens = found.filter(F.col("kind") == "open")
    if opens.limit(1).count():
        heavy = opens.select(F.explode(F.array("a", "b")).alias("ball")).distinct().join(balls.select(F.col("uid").alias("ball"), F.col("n").alias("n_ball")), "ball")
        members = owner.withColumnRenamed("leader", "ball").join(heavy, "ball").join(rows.select("uid", "dim", "vec"), "uid")
        found = found.unionByName(staged(settle(opens, members, cosine)))
    links = found.filter(F.col("kind") == "count").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("more"))
    extra = found.filter(F.col("kind") == "member").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("extra"))
    group = components(found.filter(F.col("kind") == "edge").select("a", "b"))

    named = owner.join(rows.select("uid", "vec_id"), "uid")
    least = named.groupBy(F.col("leader").alias("uid")).agg(F.min("vec_id").alias("least"))
    per_ball = staged(
        balls.select("uid", "n").join(least, "uid").join(links, "uid", "left").join(group.withColumnRenamed("node", "uid"), "uid", "left")
        .select("uid", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "uid").alias("root"), "least")
    )
    smallest = per_ball.groupBy("root").agg(F.min("least").alias("component_id"))
    of_ball = per_ball.join(smallest, "root").select(F.col("uid").alias("leader"), "n", "n_links", "component_id")
    linked_rows = (
        named.withColumn("salt", _salt("leader")).join(_salted(of_ball), ["leader", "salt"]).join(extra, "uid", "left")
        .select("vec_id", (F.col("n_links") + F.coalesce("extra", F.lit(0))).alias("n_links"), "component_id")
    )
    both = linked_rows.unionByName(out)
    return both.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _salt(leader: str):
    """Leaders meet their own row under salt 0, absorbed vectors under one of ``SALTS`` others: a huge ball is never one join key."""
    return F.when(F.col("uid") == F.col(leader), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64("uid"), F.lit(SALTS)))


def _salted(table: DataFrame) -> DataFrame:
    """Copies for all salts of the balls of more than one vector."""
    last = F.when(F.col("n") > 1, F.lit(SALTS)).otherwise(F.lit(0)).cast("long")
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
