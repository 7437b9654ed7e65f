import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadfield.llm import nearest_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, gid string, v string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, q, top=10):
    own = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    d = sorted((float(np.sqrt(((own[q] - x) ** 2).sum())), i) for i, x in own.items() if i != q and len(x) == len(own[q]))
    return d[:top]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = np.float32(rng.normal(size=(1500, 12)))
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(2000 + i, x[7].tolist()) for i in range(700)]  # one very common vector, queries among them
    return out + [(5000, None), (5100, [0.0] * 12), (5200, [float("nan")] + [1.0] * 11), (5300, [None] + [1.0] * 11), (5400, [float("inf")] * 12), (5500, [1.0, 2.0])]


def test_recall_and_lists(spark, rows):
    got = {}
    for r in nearest_vectors.digest(frame(spark, rows).repartition(4)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    queries = [i for i, _ in rows if i % 100 == 0 and i < 5000]
    assert sorted(got) == queries
    hits = []
    for q in queries:
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own) and q not in {x[2] for x in own}
        want = brute(rows, q)
        hits.append(len({i for _, i in want} & {x[2] for x in own}) / 10)
        if q >= 2000:
            assert [x[2] for x in own] == [i for _, i in want] and own[0][1] == 0
    assert np.mean(hits) >= 0.9


def test_whole_budget_is_exact(spark, rows):
    few = rows[:300]
    got = nearest_vectors.nearest(frame(spark, few), F.col("vec_id") % 50 == 0, budget=9.0, sample=128, leaf=16, chunk=8).collect()
    for q in range(0, 300, 50):
        own = sorted((r["rank"], r.score, r.vec_id) for r in got if r.query_id == q)
        want = brute(few, q)
        assert [x[2] for x in own] == [i for _, i in want] and np.allclose([x[1] for x in own], [d for d, _ in want], rtol=0, atol=1e-15)


def test_few_and_none(spark):
    assert nearest_vectors.digest(frame(spark, [])).count() == 0
    assert nearest_vectors.digest(frame(spark, [(100, [1.0, 2.0])])).count() == 0
    got = nearest_vectors.digest(frame(spark, [(100, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [4.0, 6.0]), (None, [1.0, 1.0]), (2, [4.0, 6.0])])).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 0.0), (2, 2, 5.0)]


def test_lengths_are_spaces_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=2 + k % 3).astype(np.float32).tolist()) for k in range(600)] + [(k, rng.normal(size=9).astype(np.float32).tolist()) for k in (1000, 1100, 1101)]
    for sample in (300, 16):
        got = nearest_vectors.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, budget=9.0, sample=sample, leaf=16, chunk=64).collect()
        for q in [*range(0, 600, 100), 1000, 1100]:
            own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
            assert [i for _, i in own] == [i for _, i in brute(rows, q)]


def test_ties_between_different_vectors(spark):
    """Far more candidates at one distance than the list is long: the smaller ids, whatever rounding says."""
    rng = np.random.default_rng(5)
    rows = [(0, [1.0] * 24)] + [(1 + k, v.tolist()) for k, v in enumerate(np.float32(rng.permuted(np.tile([0.0] * 3 + [1.0] * 21, (400, 1)), axis=1)))]
    got = nearest_vectors.nearest(frame(spark, rows), F.col("vec_id") == 0, budget=9.0, sample=512, leaf=512, chunk=4096).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in brute(rows, 0)] == list(range(1, 11))


def test_near_copies_beyond_rounding():
    """Distances below the rounding of products are measured."""
    rng = np.random.default_rng(6)
    q = np.full((1, 8), 1000.0)
    c = q + 1e-9 * rng.normal(size=(300, 8))
    ids = rng.permutation(300)
    _, near, exact = nearest_vectors.closest(q, c, (c * c).sum(axis=1), ids, 10)
    want = sorted(zip(np.sqrt(((q - c) ** 2).sum(axis=1)), ids))[:11]
    assert list(zip(exact, near)) == want
