import heapq
import math

import numpy as np

from paperloom.llm.neighbours import Tree, calibrate, fit_tree, grown, nearest, pack, pairs, rounding, unpack

SCHEMA = "vec_id long, vector array<float>, model string, dim int, a int, b string"


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.2 * rng.standard_normal((n, dim))).astype(np.float32)


def brute(rows, k):
    out = {}
    for i, v, m, d in rows:
        sims = []
        for j, w, m2, d2 in rows:
            if j != i and m2 == m and d2 == d:
                sims.append((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j))
        out[i] = [j for _, j in sorted(sims)[:k]]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], m, d, 0, "x") for i, v, m, d in rows], SCHEMA)
    return nearest(df, "vec_id", "vector", "model", "dim", **more).collect()


def test_recall_against_brute_force(spark):
    rows = [(i, v, "m", 16) for i, v in enumerate(clustered(900, 16, 1))] + [(1000 + i, v, "n", 16) for i, v in enumerate(clustered(300, 16, 2))] + [(2000 + i, v, "n", 24) for i, v in enumerate(clustered(200, 24, 3))]
    got = {}
    for r in run(spark, rows, k=5, leaf_rows=64, recall=0.95):
        got.setdefault(r.a, []).append(r.b)
    want = brute(rows, 5)
    hits = sum(len(set(got.get(i, [])) & set(want[i])) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(v) <= 5 for v in got.values())


def test_copies_ties_and_unusable_rows(spark):
    base = np.arange(1, 9, dtype=np.float32)
    rows = [(i, base, "m", 8) for i in range(10)] + [(50, base * 2, "m", 8), (51, -base, "m", 8)]
    rows += [(60, None, "m", 8), (61, base[:5], "m", 8), (62, [math.nan] * 8, "m", 8), (63, [0.0] * 8, "m", 8), (64, [None] * 8, "m", 8), (65, [math.inf] + [1.0] * 7, "m", 8), (66, [0.0] * 8, "m", 8), (67, base, None, 8), (68, base, None, 8)]
    got = {}
    for r in run(spark, rows, k=5):
        got.setdefault(r.a, {})[r.place] = (r.b, round(r.similarity, 2))
    assert [got[9][p][0] for p in range(1, 6)] == [0, 1, 2, 3, 4] and [got[0][p][0] for p in range(1, 6)] == [1, 2, 3, 4, 5]
    assert [got[50][p][0] for p in range(1, 6)] == [0, 1, 2, 3, 4] and got[50][1][1] == 1.0
    assert got[67] == {1: (68, 1.0)} and not set(range(60, 67)) & set(got)
    found = {(r.vec_id_a, r.vec_id_b) for r in pairs(nearest(spark.createDataFrame([(i, [float(x) for x in v], m, d, 0, "") for i, v, m, d in rows[:12]], SCHEMA), "vec_id", "vector", "model", "dim", least=0.9)).collect()}
    assert (0, 9) in found and (3, 51) not in found and (50, 51) not in found
    assert len(run(spark, [], k=5)) == 0


def test_visits_pop_the_best_leaf_first():
    x = clustered(2000, 8, 4)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = fit_tree(x, len(x), leaf_rows=100)
    assert isinstance(tree, Tree) and tree.leaves > 8
    seen = tree.visit(x[:50], tree.leaves)
    assert (np.sort(seen, axis=1) == np.arange(tree.leaves)).all()
    assert (tree.visit(x[:50], 3) == seen[:, :3]).all()
    near = x[:50] @ x.T
    near[np.arange(50), np.arange(50)] = -2
    wanted = tree.visit(x, 1)[:, 0][np.argsort(-near, axis=1)[:, :5]]
    few, many = calibrate(tree, x[:50], wanted, 0.5), calibrate(tree, x[:50], wanted, 0.99)
    assert 1 <= few <= many < tree.leaves


def test_best_bin_first_is_that_of_a_plain_queue():
    x = clustered(3000, 8, 5)
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = fit_tree(x, len(x), leaf_rows=30)
    for row, seen in zip(x[:20], tree.visit(x[:20], 12)):
        queue, popped = [(-1.0, 0)], []
        while len(popped) < 12:
            _, node = heapq.heappop(queue)
            if tree.children[node] == 0:
                popped.append(tree.leaf[node])
            for kid in range(tree.child[node], tree.child[node] + tree.children[node]):
                heapq.heappush(queue, (-float(row @ tree.centres[kid]), kid))
        assert popped == list(seen)


def test_leaves_grow_with_the_rows(spark):
    x = clustered(6000, 8, 6)
    x /= np.linalg.norm(x, axis=1)[:, None]
    own = spark.createDataFrame([(i, "m", 8, [float(a) for a in v]) for i, v in enumerate(x)], "_id long, _model string, _dim int, _v array<float>")
    for rows in (1500, 6000):
        first = {("m", 8): fit_tree(x[: min(rows, 256)], rows, leaf_rows=20)}
        tree = grown(own.where(f"_id < {rows}"), first, {("m", 8): rows}, leaf_rows=20, fit_rows=256)["m", 8]
        counts = np.bincount(tree.visit(x[:rows], 1)[:, 0], minlength=tree.leaves)
        assert first["m", 8].leaves <= 16 and rows / 80 <= tree.leaves <= rows / 5 and counts.max() < 160
        assert (np.sort(tree.visit(x[:5], tree.leaves), axis=1) == np.arange(tree.leaves)).all() and abs(tree.share.sum() - 1) < 1e-6


def test_rounding_does_not_decide(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(48)
    rows = [(i, (base + 0.05 * rng.standard_normal(48)).astype(np.float32), "m", 48) for i in range(60)]
    want = brute([(i, v.astype(np.float64), m, d) for i, v, m, d in rows], 5)
    got = {}
    for r in run(spark, rows, k=5):
        got.setdefault(r.a, set()).add(r.b)
    same = sum(got[i] == set(want[i]) for i in want)
    assert same == 60


def test_packing():
    x = np.random.default_rng(1).standard_normal((100, 30)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert np.abs(unpack(pack(x)) @ unpack(pack(x)).T - x @ x.T).max() < rounding(30)
