"""Pairs of blocks against brute force, with blocks so small that every point meets many of them."""

import numpy as np
import pytest

from meridio.operators import cluster


def test_blocked_pairs_send_a_row_once_a_block(spark):
    x = np.random.default_rng(5).normal(size=(700, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")

    def reduce(ids, a, _, others, b, __):
        import pandas as pd

        return pd.DataFrame({"id": ids, "n": len(others), "s": (a @ b.T).sum(1)})

    rows = cluster.blocked_pairs(points, reduce, "id bigint, n bigint, s double", block=300).collect()
    got = {}
    for r in rows:
        n, s, k = got.get(r.id, (0, 0.0, 0))
        got[r.id] = (n + r.n, s + r.s, k + 1)
    assert len(got) == 700 and {v[0] for v in got.values()} == {700}
    assert {v[2] for v in got.values()} == {3}  # one row for each block of the other side, not one for each 1024 points
    want = (x @ x.T).sum(1)
    assert all(got[i][1] == pytest.approx(want[i], abs=1e-6) for i in got)


@pytest.mark.parametrize("dim", [1, 2, 5])
def test_dbscan_in_many_blocks_is_dbscan(spark, dim, monkeypatch):
    x = np.round(np.random.default_rng(dim).normal(size=(600, dim)), 2)
    eps, least = {1: 0.01, 2: 0.12, 5: 0.9}[dim], 4
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    inner = cluster._within_eps
    monkeypatch.setattr(cluster, "_within_eps", lambda *a, **k: inner(*a, **{"block": 64} | k))
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(600, -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, mine = [i], label.max() + 1
            while todo:
                k = todo.pop()
                if label[k] < 0:
                    label[k] = mine
                    todo.extend(np.flatnonzero(near[k] & core))
    for i in np.flatnonzero(~core):
        if (near[i] & core).any():
            label[i] = label[near[i] & core].min()
    got = {r.id: (r.is_core, r.cluster) for r in cluster.dbscan(points, eps, least).collect()}
    assert got == {i: (bool(core[i]), int(label[i])) for i in range(600)}


def test_sweep_shares_distances_and_shuffles_no_sums(spark, monkeypatch):
    calls, inner = [], cluster.against_all
    monkeypatch.setattr(cluster, "against_all", lambda *a, **k: calls.append(1) or inner(*a, **k | {"block": 100}))
    x = np.random.default_rng(3).normal(size=(700, 4)) + np.repeat(np.eye(4) * 5, 175, 0)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<float>")
    got = cluster.k_sweep(points, [2, 3, 5]).collect()
    assert len(calls) == 1  # all pairs are met once, not once for each k
    x = x.astype(np.float32).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    first = cluster.plus_plus_many(points, 5, [42])[42]
    for r in got:
        centres, history = cluster.lloyd(points, [first[: r.k]])[0]
        label = cluster.distances2(x, centres).argmin(1)
        n = np.bincount(label, minlength=r.k)
        mean = np.stack([d[:, label == c].sum(1) for c in range(r.k)], 1)
        a, own = mean[np.arange(700), label] / (n[label] - 1), np.arange(r.k)[None] == label[:, None]
        b = np.where(own, np.inf, mean / n).min(1)
        assert r.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean())
        assert (r.iterations, r.smallest, r.largest) == (len(history), n.min(), n.max()) and r.sse == pytest.approx(r.sse_per_point * 700)
        assert r.sse == pytest.approx(((x - centres[label]) ** 2).sum())


def test_silhouettes_of_a_sample_noise_and_a_single_point(spark):
    x, label = [0.0, 1.0, 5.0, 7.0, 20.0, 100.0], [0, 0, 3, 3, 9, -1]
    points = spark.createDataFrame([(i, [v], c) for i, (v, c) in enumerate(zip(x, label))], "id bigint, x array<double>, cluster int")
    got = {r.id: (r.cluster, r.s) for r in cluster.silhouette(points).collect()}
    want = {0: (0, 5 / 6), 1: (0, 4 / 5), 2: (3, 1 - 2 / 4.5), 3: (3, 1 - 2 / 6.5), 4: (9, 1.0)}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)
    part = cluster.silhouette(points, points.where("id in (1, 4)")).collect()
    assert {r.id: r.s for r in part} == pytest.approx({1: 4 / 5, 4: 1.0})
    assert cluster.silhouette(points.where("cluster = 0")).count() == 0
