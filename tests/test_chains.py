import random

import pytest
from pyspark.sql import functions as F

from quadfield.operators import boundary as bd


def ranked(spark, chains, partitions=None, places=True):
    """``chains``: (case, [edge ids in order], closed).  Compares every edge's head, position and loop flag."""
    edges, links, want = [], [], {}
    for case, ids, closed in chains:
        low = ids.index(min(ids))
        for k, e in enumerate(ids):
            edges.append((case, e, float(k % 300), float(k // 300)) if places else (case, e))
            if k or closed:
                links.append((case, e, ids[k - 1]))
            want[case, e] = (min(ids), (k - low) % len(ids), True) if closed else (ids[0], k, False)
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "case string, eid long" + (", x0 double, y0 double" if places else "")).repartition(5)
    ln = spark.createDataFrame(links, "case string, eid long, prev long").repartition(3) if links else spark.createDataFrame([], "case string, eid long, prev long")
    got = {(r.case, r.eid): (r.head, r.pos, r.closed) for r in bd.rank_chains(df, ln, partitions=partitions).collect()}
    assert got == want


def ids(n, seed, least=0):
    return random.Random(seed).sample(range(least, least + 20 * n), n)


@pytest.mark.parametrize("partitions", [1, 7, None])
def test_long_chains(spark, partitions):
    """100,000 edges in one chain and 30,000 in a loop, with ids in no order, in one or many partitions."""
    ranked(spark, [("a", ids(100_000, 2), False), ("b", ids(30_000, 3), True)], partitions)


def test_many_chains(spark):
    chains = [(f"c{k % 4}", ids(n, 10 + k, 1000 * k), k % 3 == 0) for k, n in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 1, 2])]
    for partitions in (1, 3, 16):
        ranked(spark, chains, partitions)
    ranked(spark, chains, 6, places=False)


def test_single_edge_loop_and_nothing(spark):
    ranked(spark, [("a", [7], True), ("a", [9], False)], 4)
    none = spark.createDataFrame([], "case string, eid long, x0 double, y0 double")
    assert bd.rank_chains(none, spark.createDataFrame([], "case string, eid long, prev long")).count() == 0


def test_alternating_partitions(spark):
    """Worst case: neighbours in the chain never share a partition, so every edge is a list of its own."""
    n = 500
    order = [k // 2 + (k % 2) * 10_000 for k in range(n)]
    df = spark.createDataFrame([("a", e) for e in order], "case string, eid long")
    ln = spark.createDataFrame([("a", order[k], order[k - 1]) for k in range(1, n)], "case string, eid long, prev long")
    got = {r.eid: (r.head, r.pos, r.closed) for r in bd.rank_chains(df, ln, partitions=2).collect()}
    assert got == {e: (0, k, False) for k, e in enumerate(order)}


def test_rounds_follow_lists_not_edges(spark, monkeypatch):
    written = []
    real = bd.checkpointed
    monkeypatch.setattr(bd, "checkpointed", lambda df: written.append(1) or real(df))
    ranked(spark, [("a", ids(5000, 5), False)], 1)
    assert len(written) == 1
    written.clear()
    ranked(spark, [("a", list(range(5000)), False)], 4)
    # a raster of 17 lines in 4 partitions: some 30 lists, so 5 or 6 doublings, where edges would need 13
    assert len(written) <= 10
