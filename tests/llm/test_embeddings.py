import itertools
import math

import numpy as np

from corvane.llm import embed_dedup


def test_plan_grows_with_the_table():
    plans = [embed_dedup.plan(n, 0.9, 0.999) for n in (10**3, 10**4, 10**5, 10**7)]
    tables, bits, _, least, _ = zip(*plans, strict=True)
    assert list(bits) == sorted(set(bits)) and list(tables) == sorted(set(tables)) and min(least) >= 2
    # tables as n to the power 0.224, give or take a step
    assert tables[3] / tables[0] < (10**4) ** 0.3
    agree, inside = 1 - math.acos(0.9) / math.pi, math.erf(1.3 / math.sqrt(2))
    for t, b, _, k, differ in plans:
        assert embed_dedup._missed(t, inside * agree**b, k) <= 0.001 and embed_dedup._missed(128, 1 - agree, differ + 1) > 1 - 1e-5


def test_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(5)
    n, dim = 1500, 48
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, dim))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.92, (n, 1))
    pairs = np.vstack([x, c * x + np.sqrt(1 - c * c) * y])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(pairs)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(frame).collect()}
    u = pairs / np.linalg.norm(pairs, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    found, there = sum(got[k][0] for k in range(2 * n)), int(want.sum())
    assert there >= 2 * n * 0.99 and found <= there and found >= 0.998 * there


def test_odd_vectors_and_columns(spark):
    inf = float("inf")
    base = [1.0, 2.0, 3.0]
    rows = [(1, base), (2, [2.0, 4.0, 6.0]), (3, base), (4, [inf, 1.0, 1.0]), (5, [None, 1.0, 1.0]), (6, [1.0, 2.0]), (7, [0.0, -0.0, 0.0]), (8, []), (9, None), (None, base), (10, [1e-300, 2e-300, 3e-300]), (11, [1e300, 2e300, 3e300]), (12, [-1.0, -2.0, -3.0]), (1, base)]
    frame = spark.createDataFrame([(*r, 5, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, id int, h string, u double")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(frame).collect()}
    same = {1, 2, 3, 10, 11}
    want = {(k, 4, 1, k == 1) for k in same} | {(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 12)} | {(None, 0, None, None)}
    assert got == want and embed_dedup.near_vectors(frame).count() == len(rows)
    assert embed_dedup.near_vectors(frame.where("false")).count() == 0


def test_chains_are_one_component(spark):
    step = math.acos(0.93)
    rows = [(k, [math.cos(k * step), math.sin(k * step)]) for k in range(8)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    links = {k: sum(math.cos((k - j) * step) >= 0.9 for j in range(8) if j != k) for k in range(8)}
    assert got == {k: (links[k], 0) for k in range(8)} and all(v == w for v, w in itertools.pairwise([g[1] for g in got.values()]))
