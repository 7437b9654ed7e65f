"""Approximate nearest neighbours by a forest of random-projection trees.

* Vectors that are null, zero or hold null or non-finite components take no part.  Each length of vectors is a space of its own: a
  query meets the vectors of its length.  Equal vectors are one entry with its smallest ids (one more than asked for), which is all
  that a list of nearest ids can use, so a vector that makes up a third of all rows is one entry.
* Forest: ``TREES`` trees over a bounded sample of about ``SAMPLE`` entries; each node splits at the median along the direction
  between two centres of some of its members.  The trees are bounded by the sample and travel with the tasks.  A length that the
  sample doesn't hold has one tree of one leaf, that is an exact search.
* Index: every entry is routed to its leaf of every tree.  A leaf is dealt into chunks of about ``CHUNK`` entries by a hash, so no
  task holds a leaf of unbounded size.
* Search: one priority queue over all trees, ordered by the smallest distance to a split that a path has crossed, hands out leaves
  until they hold ``BUDGET`` of the sample.  Each visited chunk returns its best entries for the query, measured in double
  precision on the original vectors; the best of all chunks follow by a grouped top-k.

The budget is a share of the entries, because vectors without low-dimensional structure need one for a recall of 0.9; with
structured vectors a smaller share will do.  Queries with equal vectors are searched once.  Repeated ids count once for equal
vectors.  Ties go to the smaller id.  Fewer candidates than asked for give shorter lists; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadfield.llm.common import staged

TREES, SAMPLE, LEAF, BUDGET, CHUNK, SEED = 8, 16_384, 32, 0.9, 8192, 29
TOP = 10


def entries(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """(gid, v, ids): distinct usable vectors, the smallest id, and the ``top + 1`` smallest ids."""
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    least = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("k", F.dense_rank().over(least)).filter(F.col("k") <= top + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("gid"), "v", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Tree:
    """Arrays of a tree: split direction and place, children (leaves: -1 - leaf number), sample entries by leaf."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.w: list[np.ndarray] = []
        self.at: list[float] = []
        self.child: list[list[int]] = []
        self.held: list[int] = []
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)

    def _grow(self, x, own, leaf, rng) -> int:
        if len(own) > leaf:
            some = x[rng.choice(own, min(len(own), 128), replace=False)]
            a, b = some[0], some[1]
            for _ in range(6):
                near = ((some - a) ** 2).sum(axis=1) < ((some - b) ** 2).sum(axis=1)
                if not near.any() or near.all():
                    break
                a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
            w = a - b
            w = w / (np.linalg.norm(w) or 1.0)
            side = x[own] @ w
            at = float(np.median(side))
            left = side <= at
            if left.any() and not left.all():
                me = len(self.w)
                self.w.append(w.astype(np.float32))
                self.at.append(at)
                self.child.append([0, 0])
                self.child[me] = [self._grow(x, own[left], leaf, rng), self._grow(x, own[~left], leaf, rng)]
                return me
        self.held.append(len(own))
        return -len(self.held)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                left = x[own] @ self.w[node] <= self.at[node]
                todo += [(self.child[node][0], own[left]), (self.child[node][1], own[~left])]
        return out


def search(forest: list[Tree], x: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs for one query, from one priority queue over all trees."""
    queue = [(0.0, t, tree.root) for t, tree in enumerate(forest)]
    out, held = [], 0
    sides = {}
    while queue and held < enough:
        far, t, node = heapq.heappop(queue)
        tree = forest[t]
        while node >= 0:
            if t not in sides:
                sides[t] = np.asarray(tree.w) @ x - np.asarray(tree.at) if len(tree.w) else np.zeros(0)
            side = sides[t][node]
            near, other = tree.child[node] if side <= 0 else tree.child[node][::-1]
            heapq.heappush(queue, (max(far, abs(side)), t, other))
            node = near
        out.append((t, -1 - node))
        held += tree.held[-1 - node]
    return out


def by_length(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out.append((int(n), at, _matrix(column.take(pa.array(at)))))
    return out


def plant(found: DataFrame, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF) -> dict[int, list[Tree]]:
    """A forest for each length, grown on a bounded sample of the entries taken by a hash of the smallest id."""
    share = min(1.0, sample / max(1, found.count()))
    drawn = found.filter(F.pmod(F.xxhash64("gid", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))).select("gid", "v").toArrow().sort_by("gid")
    rng = np.random.default_rng(SEED)
    column = drawn.column("v").combine_chunks()
    return {n: [Tree(x, leaf, rng) for _ in range(trees)] for n, _, x in by_length(column)}


def _forest(forests: dict[int, list[Tree]], n: int) -> list[Tree]:
    return forests.get(n) or [Tree(np.zeros((0, n)), 1, None)]


def _routed(found: DataFrame, asked: DataFrame, forests: dict[int, list[Tree]], budget: float, chunks: int) -> DataFrame:
    """(tree, leaf, chunk, asks, gid, v): entries in their leaves, queries in every chunk of the leaves that they visit.

    A leaf's number holds the length of its vectors in the upper half.
    """
    def rows(trees, leaves, chunk, asks, gid, v):
        n = len(leaves)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(trees, n).astype(np.int32)), pa.array(leaves), pa.array(chunk), pa.array(np.full(n, asks)), gid, v], names=names)

    def place(batches):
        for b in batches:
            for n, at, x in by_length(b.column(1)):
                gid, v = b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))
                chunk = (gid.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks
                for t, tree in enumerate(_forest(forests, n)):
                    yield rows(t, tree.leaves(x) | n << 32, chunk, False, gid, v)

    def visit(batches):
        for b in batches:
            for n, at, vectors in by_length(b.column(1)):
                forest = _forest(forests, n)
                enough = budget * max(1, sum(forest[0].held))
                for k, x in zip(at, vectors):
                    t, leaf, c = (np.array(p) for p in zip(*[(t, leaf, c) for t, leaf in search(forest, x, enough) for c in range(chunks)]))
                    m = len(t)
                    yield rows(t, leaf.astype(np.int64) | n << 32, c.astype(np.int64), True, pa.array([b.column(0)[k].as_py()] * m, pa.int64()), pa.array([x.tolist()] * m, pa.list_(pa.float64())))

    names = ["tree", "leaf", "chunk", "asks", "gid", "v"]
    schema = "tree int, leaf long, chunk long, asks boolean, gid long, v array<double>"
    return found.select("gid", "v").mapInArrow(place, schema).unionByName(asked.select("gid", "v").mapInArrow(visit, schema))


def closest(q: np.ndarray, c: np.ndarray, cc: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of the ``top + 1`` nearest of each query, ties to smaller ids.

    Distances by products only choose; whatever lies within their rounding of the last place is measured exactly.
    """
    qq, n = (q * q).sum(axis=1), len(ids)
    d = qq[:, None] + cc[None] - 2 * q @ c.T
    k = min(top + 8, n)
    some = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(q), 1))
    out = []
    if k < n:
        got = np.sort(np.take_along_axis(d, some, 1), axis=1)
        slack = 1e-13 * q.shape[1] * (qq + cc.max())
        tight = got[:, -1] <= got[:, top] + 2 * slack
        for i in np.flatnonzero(tight):
            at = np.flatnonzero(d[i] <= got[i, top] + 2 * slack[i])
            exact = np.sqrt(((q[i] - c[at]) ** 2).sum(axis=1))
            first = np.lexsort((ids[at], exact))[: top + 1]
            out.append((np.full(len(first), i), ids[at][first], exact[first]))
        plain = np.flatnonzero(~tight)
    else:
        plain = np.arange(len(q))
    exact = np.sqrt(((q[plain, None, :] - c[some[plain]]) ** 2).sum(axis=2))
    found = ids[some[plain]]
    order = np.lexsort((found, exact))[:, : top + 1]
    out.append((np.repeat(plain, order.shape[1]), np.take_along_axis(found, order, 1).ravel(), np.take_along_axis(exact, order, 1).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(top: int):
    """Best entries of each chunk for each query in it; entries of a chunk come before its queries."""
    def run(batches):
        key, own, ids, rest = None, [], [], None
        for b in batches:
            t, leaf, chunk, asks, gid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (leaf[1:] != leaf[:-1]) | (chunk[1:] != chunk[:-1]) | (asks[1:] != asks[:-1])][: len(t)])
            for lo, hi in zip(new, np.r_[new[1:], len(t)]):
                now = (t[lo], leaf[lo], chunk[lo])
                if now != key:
                    key, own, ids, rest = now, [], [], None
                x = _matrix(b.column(5).slice(lo, hi - lo))
                if not asks[lo]:
                    own.append(x)
                    ids.append(gid[lo:hi])
                    rest = None
                    continue
                if not own:
                    continue
                if rest is None:
                    c, ci = np.concatenate(own), np.concatenate(ids)
                    rest = c, ci, (c * c).sum(axis=1)
                c, ci, cc = rest
                for at in range(0, hi - lo, 256):
                    query, near, exact = closest(x[at : at + 256], c, cc, ci, top)
                    yield pa.RecordBatch.from_arrays([pa.array(gid[lo + at + query]), pa.array(near), pa.array(exact)], names=["query", "gid", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, top: int = TOP, budget: float = BUDGET, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of every row for which ``queries`` holds, itself excluded."""
    found = staged(entries(vectors, top))
    forests = plant(found, sample, trees, leaf)
    usable = vectors.filter(queries).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v")).filter(F.col("query_id").isNotNull())
    wanted = staged(usable.distinct().join(found.select("v", "gid", "ids"), "v").select("query_id", "gid", "v", "ids"))
    asked = wanted.select("gid", "v").dropDuplicates(["gid"])
    leaves = max(1, min((len(t.held) for f in forests.values() for t in f), default=1))
    chunks = max(1, -(-found.count() // (leaves * chunk)))
    routed = _routed(found, asked, forests, budget, chunks)
    sorted_ = routed.repartition("tree", "leaf", "chunk").sortWithinPartitions("tree", "leaf", "chunk", "asks")
    near = sorted_.mapInArrow(_best(top), "query long, gid long, score double").dropDuplicates(["query", "gid"])
    # an entry stands for its ids; one more than asked for, as the query's own id may be among them
    first = Window.partitionBy("query").orderBy("score", "gid")
    near = near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= top + 1)
    lists = near.join(found.select("gid", "ids"), "gid").select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("query").orderBy("score", "vec_id")
    lists = lists.withColumn("k", F.row_number().over(ranked)).filter(F.col("k") <= top + 1)
    lists = staged(lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best")))
    each = wanted.select("query_id", "gid").join(lists, F.col("gid") == F.col("query"))
    each = each.select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, top)).alias("pos", "b"))
    return each.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def digest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 100 == 0)
