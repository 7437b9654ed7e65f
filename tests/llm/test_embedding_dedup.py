import math

import numpy as np
import pytest

from quadfield.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def usable(v, label):
    return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows):
    """(vec_id, n_links, component_id) of every row, sorted."""
    on = [k for k, (_, v, lab) in enumerate(rows) if usable(v, lab)]
    root, links = {k: k for k in on}, dict.fromkeys(range(len(rows)), 0)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    unit = {}
    for k in on:
        x = np.array(rows[k][1], float)
        x = x / np.abs(x).max()
        unit[k] = x / np.linalg.norm(x)
    for n, i in enumerate(on):
        for j in on[n + 1 :]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for k in on:
        if rows[k][0] is not None:
            least[top(k)] = min(least.get(top(k), rows[k][0]), rows[k][0])
    return sorted(((r[0], links[k], least.get(top(k)) if k in root else r[0]) for k, r in enumerate(rows)), key=str)


def result(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", uid string, n int").repartition(6)
    got = embedding_dedup.mark(df, **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def around(rng, center, count, noise):
    return [(center + noise * rng.standard_normal(len(center)) / math.sqrt(len(center))).tolist() for _ in range(count)]


SMALL = {"window": 128, "piece": 256, "most": 4, "passes": 2}


def test_groups_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    vectors = []
    for size, noise in ((300, 0.1), (60, 0.12), (40, 0.0), (25, 0.33), (10, 0.36), (2, 0.2)):
        c = rng.standard_normal(32)
        vectors += around(rng, c / np.linalg.norm(c), size, noise)
    vectors += rng.standard_normal((100, 32)).tolist()
    order = rng.permutation(len(vectors))
    rows = [(int(i) * 3 - 50, vectors[k], int(k % 2)) for i, k in enumerate(order)]
    # at most a window's worth of leaders a label, so nothing may be missed
    assert result(spark, rows, **SMALL) == brute(rows)


def test_arc_needs_open_pairs(spark):
    """Vectors on an arc: balls overlap within the linking angle and are settled vector by vector."""
    rng = np.random.default_rng(2)
    rows = [(k, [math.cos(a), math.sin(a), 0.01 * rng.standard_normal()], 1) for k, a in enumerate(rng.uniform(0, 2.2, 400))]
    assert result(spark, rows, **SMALL) == brute(rows)


def test_settle_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = {u: [math.cos(a), math.sin(a)] for u, a in enumerate(rng.uniform(0, 0.6, 90))}
    members = spark.createDataFrame([(u, int(u >= 40), 40 if u < 40 else 50, 2, v) for u, v in x.items()], "uid long, ball long, n_ball long, dim int, vec array<double>")
    got = embedding_dedup.settle(spark.createDataFrame([(0, 1)], "a long, b long"), members, 0.93, block=7).collect()
    want = {u: sum(np.dot(x[u], x[w]) >= 0.93 for w in x if (w < 40) != (u < 40)) for u in x}
    seen = dict.fromkeys(x, 0)
    for r in got:
        if r.kind == "member":
            seen[r.a] += r.n
    assert seen == want and any(r.kind == "edge" for r in got)


def test_each_ball_has_one_leader():
    """Balls of different radii: one may absorb another that couldn't absorb it; none is leader and absorbed at once."""
    rng = np.random.default_rng(9)
    for most in (2, 50):
        state = embedding_dedup._Leaders((math.acos(0.93) - 1e-5) / 2)
        seen, weight = {}, 0
        for step in range(6):
            x = np.concatenate([around(rng, np.eye(6)[k], 40, 0.12) for k in range(3)])
            x /= np.linalg.norm(x, axis=1)[:, None]
            ids, n, r = np.arange(len(x)) + 1000 * step, rng.integers(1, 9, len(x)), rng.choice([0.0, 0.02, 0.08, 0.15], len(x))
            to = state.absorb(x, ids, n, r)
            assert (to >= 0).all()
            seen.update(zip(ids.tolist(), np.array(state.rows)[to].tolist()))
            weight += n.sum()
            gone = state.spare(most)
            weight -= state.n[gone].sum()
            state.drop(gone)
        assert all(seen[lead] == lead for lead in seen.values()) and weight == state.n.sum()


def test_narrow_windows_count_each_pair_once(spark):
    """With windows far smaller than a label, links may be missed but none is invented or counted twice."""
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((500, 16)).tolist()
    for k in range(200):
        vectors += around(rng, np.array(vectors[k]) / np.linalg.norm(vectors[k]), 1, 0.15)
    rows = [(k, v, 0) for k, v in enumerate(vectors)]
    got, want = (dict((r[0], r[1:]) for r in x) for x in (result(spark, rows, window=16, piece=64, most=2, passes=6), brute(rows)))
    assert all(got[k][0] <= want[k][0] for k in got)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())


def test_odd_rows(spark):
    e = [1.0, 2.0, 2.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 2.0], 0), (5, [1.0, float("nan"), 2.0], 0), (6, [1.0, float("inf"), 2.0], 0), (7, e, None), (8, e, 0), (9, e, 1),
        (10, [1e-300 * x for x in e], 0), (11, [1e300 * x for x in e], 0), (12, [*e, 0.0], 0), (13, [*e, 0.0], 0), (8, e, 0), (None, e, 0), (None, [0.0, 1.0], 5), (None, None, None), (-3, [0.0, 2.0], 6), (14, [-1.0, -2.0, -2.0], 0),
        (15, [3.0], 7), (16, [4.0], 7), (17, [-4.0], 7),
    ]
    assert result(spark, rows, passes=2) == brute(rows)


def test_threshold(spark):
    """A pair with a cosine of exactly 0.93 links, one just below it doesn't."""
    s = math.sqrt(1 - 0.93**2)
    rows = [(1, [1.0, 0.0], 0), (2, [0.93 + 1e-12, s], 0), (3, [1.0, 0.0], 1), (4, [0.93 - 1e-9, s], 1), (5, [100.0, 0.0, 0.0, 0.0, 0.0], 2), (6, [93.0, 36.0, 7.0, 2.0, math.sqrt(2.0)], 2)]
    got = {r[0]: r[1] for r in result(spark, rows, passes=1)}
    assert got[1] == got[2] == 1 and got[3] == got[4] == 0


def test_same_vector_many_times(spark):
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else np.random.default_rng(k).standard_normal(3).tolist(), 0) for k in range(900)]
    got = {r[0]: r for r in result(spark, rows, window=64, piece=128, most=2)}
    want = {r[0]: r for r in brute(rows)}
    assert all(got[k][1] <= want[k][1] for k in got) and all(got[k][1] >= 299 for k in range(0, 900, 3))
    assert sum(r[1] for r in got.values()) >= 0.9 * sum(r[1] for r in want.values())


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    rows = [(7, [1.0, 2.0], 3)][:n]
    assert result(spark, rows, passes=2) == brute(rows)


def test_recall_on_the_tables(spark):
    folder = "/root/testdata/sf0.1/embeddings.parquet"
    rng = np.random.default_rng(0)
    try:
        rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(folder).collect()]
    except Exception:  # noqa: BLE001
        pytest.skip("no tables")
    base = max(i for i, _, _ in rows) + 1
    for k in range(1500):
        i, v, lab = rows[k]
        rows.append((base + k, (np.array(v) + 0.28 * rng.standard_normal(64) / 8).tolist(), lab))
    got, want = result(spark, rows), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.9 * there <= found <= there and there > 2000
