import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintmill.llm import ball_kmeans, hard_negatives


def lloyd(rows, k, rounds):
    import hashlib

    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, hashlib.sha256(f"3:{rows[n][0]}".encode()).hexdigest() if rows[n][0] is not None else "", rows[n][1]))
    centroids = [list(rows[n][1]) for n in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in rows]
        if r == rounds:
            return centroids, [(j, d) for d, j in own]
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(rows, own) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_balls_are_exact(spark, monkeypatch, rounds):
    monkeypatch.setattr(ball_kmeans, "BLOCK", 50)
    draw = random.Random(rounds)
    rows = [(k if k % 40 else None, [draw.randrange(-3, 4) for _ in range(3)]) for k in range(400)] + [(7, [0, 1, 1])] * 60
    got = ball_kmeans.ball_kmeans(spark.createDataFrame(rows, "vec_id long, v array<int>"), 6, rounds, dims=3).collect()
    centroids, own = lloyd(rows, 6, rounds)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), j, d) for (i, _), (j, d) in zip(rows, own))
    assert {r.inertia for r in got} == {sum(d for _, d in own)}
    for r in got:
        assert r.cluster_inertia == sum(d for j, d in own if j == r.cluster)


def test_stable_members_are_not_compared():
    draw = np.random.default_rng(1)
    centroids = np.array([[0, 0], [1000, 0], [0, 1000], [5000, 5000]])
    own = draw.integers(0, 4, 4000)
    x = centroids[own] + draw.integers(-90, 91, (4000, 2))
    out, far, made = ball_kmeans.compared(x, own, centroids)
    assert (out == own).all() and made == 4000 and (far == ((x - centroids[own]) ** 2).sum(axis=1)).all()
    out, _, made = ball_kmeans.compared(x, np.zeros(4000, int), centroids)  # from a wrong start it is as exact
    assert (out == own).all() and made < 4 * 4000


def test_fewer_vectors_than_centroids(spark):
    got = ball_kmeans.ball_kmeans(spark.createDataFrame([(1, [1, 2]), (2, [1, 2])], "vec_id long, v array<int>"), dims=2).collect()
    assert {r.cluster for r in got} == {0} and {r.distance for r in got} == {0}


def plain(rows, k=5):
    """Brute force over (vec_id, label, v)."""
    out = []
    width = max(len(r[2]) for r in rows)
    rows = [(i, lab, [*v, *[0] * (width - len(v))]) for i, lab, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, lab, v in rows:
        if a % 10 == 0:
            scored = sorted((-dot(v, w), b, other == lab) for b, other, w in rows if b != a)
            for s, p, _ in [x for x in scored if x[2]][:k]:
                fits = [(t, b) for t, b, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:k]
                out += [(a, p, n + 1, b, -s, -t) for n, (t, b) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 40])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, spread):
    """Ties, copies, a hot list of several blocks, vectors of unlike length, negative scores; waves of two."""
    for name, value in (("BLOCK", 20), ("WAVE", 2), ("GROWTH", 2), ("SAMPLE", 150)):
        monkeypatch.setattr(hard_negatives, name, value)
    draw = random.Random(spread)
    rows = [(k, k % 3, [draw.randrange(-spread, spread + 1) for _ in range(4 if k % 9 else 3)]) for k in range(260)]
    rows += [(300 + k, k % 2, [spread, spread, 0, 1]) for k in range(130)]
    table = spark.createDataFrame([*rows, *rows[:40]], "vec_id long, label long, v array<int>").distinct()
    got = sorted(tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") % 10 == 0).collect())
    assert got == plain(rows)


def test_bounds_hold_and_skip(spark):
    draw = np.random.default_rng(9)
    middles = draw.integers(-400, 400, (12, 8))
    x = middles[draw.integers(0, 12, 900)] + draw.integers(-9, 10, (900, 8))
    rows = spark.createDataFrame([(k, 0, v) for k, v in enumerate(x.tolist())], "vec_id long, label long, v array<int>")
    index = hard_negatives.Index(rows)
    lists = {r["vec_id"]: r["list"] for r in index.rows.collect()}
    high, low = index.bounds(x.astype(np.int32))
    scores = x @ x.T
    own = np.array([lists[k] for k in range(900)])
    assert (scores <= high[:, own]).all() and (scores >= low[:, own]).all()
    kth = np.sort(scores, axis=1)[:, -5]
    assert (high >= kth[:, None]).mean() < 0.5  # most lists are never visited


def test_rows_that_take_no_part(spark):
    rows = [(1, 1, [0.5]), (None, 1, [0.5]), (2, None, [0.5]), (3, 1, None), (4, 1, [None]), (5, 1, [float("nan")]), (6, 1, [float("-inf")]), (7, 1, []), (8, 2, [-0.001]), (8, 1, [0.25]), (8, 1, [0.125]), (1, 1, [0.5])]
    got = sorted(tuple(r) for r in hard_negatives.prepared(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect())
    assert got == [(1, 1, [128]), (7, 1, []), (8, 1, [32])]


def test_components_beyond_exact_products_are_an_error(spark):
    rows = spark.createDataFrame([(1, 1, [1e30])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        hard_negatives.prepared(rows).collect()
