import random
from collections import Counter
from fractions import Fraction

import numpy as np

from xmlframe.llm import embed_dedup


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    return near


def roots(near):
    root = np.arange(len(near))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(root)).min(axis=1))
        if (low == root).all():
            return root
        root = low


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(700, 16))
    near = base[:120] + 0.25 * rng.normal(size=(120, 16))
    dense = base[0] + 0.1 * rng.normal(size=(400, 16))  # more than one block of one cell
    copies = np.repeat(base[5:6], 60, axis=0)
    x = np.concatenate((base, near, dense, copies)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 7) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in embed_dedup.near_duplicates(df, per_cell=32).collect()}
    truth = brute(x.astype(np.float64))
    degree, root = truth.sum(axis=1), roots(truth)
    got = np.array([out[i].n_links for i in range(len(x))])
    assert (got <= degree).all() and got.sum() >= 0.95 * degree.sum()
    found = np.array([out[i].component_id for i in range(len(x))])
    assert (found >= root).all() and (found == root).mean() > 0.95
    assert all(out[i].kept == (i == found[i]) for i in range(len(x)))
    assert {out[5].component_id, *(out[i].component_id for i in range(1220, 1280))} == {out[5].component_id}


def test_walk_is_the_sorted_sum_of_distances():
    rng = np.random.default_rng(1)
    index = embed_dedup.Index(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    d = index.distances(rng.normal(size=(3, 8)))
    for a, b in zip(*d):
        every = (a[:, None] + b[None, :]).ravel()
        for reach in (0.0, float(np.median(every)) + 1e-9, float(every.max()) + 1e-9):  # off the exact sums, which rounding may tip
            assert sorted(index.walk(a, b, reach)) == sorted(np.flatnonzero(every <= reach))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (None, [0.0, -2.0]), (None, None), (1, [1.0, 0.0]), (10, [0.0, 1.0])]
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    want = [(1, 3, 1, True), (2, 3, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)), (None, 3, 1, False), (None, 0, None, True), (None, 0, None, True), (1, 3, 1, True), (10, 0, 10, True)]
    assert got == Counter(want)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_ids_widths_and_extreme_sizes(spark):
    """Brute force by plain Python over vectors of one to three components, tiny and huge ones, and ids with several vectors."""
    rng = random.Random(3)
    rows = [(i % 60, [rng.choice((-1, 1)) * 10.0 ** rng.choice((-300, -200, 0, 1, 200, 300)) * x for x in own]) for i in range(150) for own in [[rng.gauss(0, 1) for _ in range(1 + i % 3)]]]
    rows += [(5, [1.0, 2.0]), (5, [1.0, 2.01]), (5, [-2.0, 1.0]), (None, [3.0, 6.0])]

    def cosine(a, b):
        a, b = ([Fraction(x) for x in v] for v in (a, b))
        dot, square = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(x * x for x in b)
        return dot > 0 and dot * dot / square >= Fraction(81, 100)

    n = len(rows)
    near = [[i != j and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) for j in range(n)] for i in range(n)]
    want = Counter()
    for i, (own, _) in enumerate(rows):
        group, todo = {i}, [i]
        while todo:
            k = todo.pop()
            more = [j for j in range(n) if near[k][j] and j not in group]
            group.update(more), todo.extend(more)
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        want[own, sum(near[i]), low, own == low] += 1
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == want


def test_planted_links_with_defaults(spark):
    rng = np.random.default_rng(8)
    base = embed_dedup.unit(rng.normal(size=(6000, 64)))
    side = rng.normal(size=(1500, 64))
    side = embed_dedup.unit(side - (side * base[:1500]).sum(axis=1, keepdims=True) * base[:1500])
    cosines = rng.uniform(0.9, 0.94, 1500)[:, None]
    x = np.concatenate((base, cosines * base[:1500] + np.sqrt(1 - cosines**2) * side))
    truth = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    got = np.array([out[i] for i in range(len(x))])
    assert (got <= truth.sum(axis=1)).all() and got.sum() >= 0.98 * truth.sum()


def test_production_recall_near_a_subspace(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 64)) + 0.05 * rng.normal(size=(n, 64))
    u = embed_dedup.unit(x.astype(np.float32))
    degree = np.concatenate([(u[at : at + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for at in range(0, n, 1000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    out = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    got = np.array([out[i] for i in range(n)])
    assert (got <= degree).all() and got.sum() >= 0.98 * degree.sum()
