"""Operators that SQL can't state, on inputs whose answers are known by hand or by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridio.operators import cluster, dimred, graph, sketch

TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


@pytest.fixture(scope="module")
def bridge(spark):
    return spark.createDataFrame([(a, b, 1.0) for a, b in TRIANGLES], "src bigint, dst bigint, w double")


def test_betweenness_of_a_bridge(bridge):
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(bridge).collect()}
    assert got == pytest.approx({(2, 3): 9, (0, 2): 4, (1, 2): 4, (3, 4): 4, (3, 5): 4, (0, 1): 1, (4, 5): 1})


@pytest.mark.parametrize("method", ["girvan_newman", "greedy"])
def test_communities_of_two_triangles(bridge, method):
    labels = graph.communities(bridge, method)
    assert {r.id: r.label for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert graph.modularity(bridge, labels).first().q == pytest.approx(5 / 14)


def test_ranks_do_not_depend_on_how_edges_are_joined(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 2), (1, 2), (1, 3), (1, 3), (3, 4)], "src bigint, dst bigint")
    rows = []
    for most in (100_000, 0):
        monkeypatch.setattr(graph, "SMALL_NODES", most)
        rows.append(({r.id: r.rank for r in graph.pagerank(edges, eps=1e-12).collect()}, {r.id: (r.hub, r.auth) for r in graph.hits(edges, eps=1e-12).collect()}))
    (a, h), (b, g) = rows
    assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(1.0)
    assert all(h[i] == pytest.approx(g[i]) for i in h)
    assert h[3][1] > h[2][1] and sum(x * x for _, x in h.values()) == pytest.approx(1.0)


def test_dgim_stays_within_half(spark):
    bits = (np.random.default_rng(42).random(500) < 0.35).astype(int)
    s = sketch.Dgim(64)
    for t, b in enumerate(bits.tolist()):
        s.update(t, b)
        exact = bits[max(0, t - 63) : t + 1].sum()
        assert s.valid() and abs(s.estimate() - exact) <= max(exact / 2, 0.5), t


def test_bfr_finds_separated_groups(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [30, 0, 0], [0, 30, 0]])
    truth = rng.integers(0, 3, 600)
    x = centres[truth] + rng.normal(size=(600, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    got = {r.id: r.cluster for r in cluster.bfr(points, 3, chunk=200).collect()}
    assert len(got) == 600
    names = {k: {int(truth[i]) for i, c in got.items() if c == k} for k in set(got.values()) - {-1}}
    assert len(names) == 3 and all(len(v) == 1 for v in names.values())
    assert sum(c == -1 for c in got.values()) <= 30


def test_pca_by_hand(spark):
    points = spark.createDataFrame([(i, list(p)) for i, p in enumerate([(2.0, 0.0), (0.0, 1.0), (-2.0, 0.0), (0.0, -1.0)])], "id bigint, x array<double>")
    p = dimred.fit_pca(points)
    assert p.variances == pytest.approx([8 / 3, 2 / 3]) and p.ratio == pytest.approx([0.8, 0.2]) and p.k_for(0.7) == 1 and p.k_for(0.9) == 2
    y = {r.id: np.array(r.y) for r in p.transform(points, 2).collect()}
    back = p.inverse(np.array([y[i] for i in range(4)]))
    assert np.abs(back - [[2, 0], [0, 1], [-2, 0], [0, -1]]).max() < 1e-12
    assert np.abs(p.components @ p.components.T - np.eye(2)).max() < 1e-12
    assert dimred.relative_error(np.zeros(2), np.zeros(2)) == 0.0 and dimred.relative_error(np.zeros(2), np.ones(2)) == float("inf")
    with pytest.raises(ValueError):
        dimred.fit_pca(points.limit(1))


def test_svd_of_a_low_rank_matrix(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 20))
    a[np.abs(a) < 0.3] = 0.0
    rows = [(i, j, float(a[i, j])) for i in range(30) for j in range(20) if a[i, j]]
    sigma, u, v = dimred.randomised_svd(spark.createDataFrame(rows, "row bigint, col bigint, value double"), 3, oversample=10, powers=4)
    assert sigma == pytest.approx(np.linalg.svd(a)[1][:3], rel=1e-6)
    um, vm = np.zeros((30, 3)), np.zeros((20, 3))
    for m, frame, c in ((um, u, "row"), (vm, v, "col")):
        for r in frame.collect():
            m[r[c]] = r.v
    best = np.linalg.svd(a)
    assert np.abs(um * sigma @ vm.T - best[0][:, :3] * best[1][:3] @ best[2][:3]).max() < 1e-5


def test_sweep_against_brute_force(spark):
    x = np.array([1.0, 2, 3, 10, 11, 12])
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "id bigint, x array<double>").repartition(3)
    got = {r.k: r for r in cluster.k_sweep(points, [2, 3]).collect()}
    label, d = np.array([0, 0, 0, 1, 1, 1]), np.abs(x[:, None] - x[None, :])
    s = []
    for i in range(6):
        own, other = d[i][label == label[i]].sum() / 2, d[i][label != label[i]].mean()
        s.append((other - own) / max(other, own))
    assert got[2].sse == pytest.approx(4.0) and got[2].silhouette == pytest.approx(np.mean(s)) and (got[2].smallest, got[2].largest) == (3, 3)
    assert got[3].sse < 4.0 and got[2].iterations >= 1


def test_plus_plus_draws_different_points(spark):
    points = spark.createDataFrame([(i, [float(i % 4), 0.0]) for i in range(40)], "id bigint, x array<double>").repartition(4)
    got = cluster.plus_plus_many(points, 6, [1, 2])
    for c in got.values():  # four places only
        assert sorted(c[:, 0].tolist()) == [0.0, 1.0, 2.0, 3.0]


@pytest.mark.parametrize("eps", [0.0, 0.4, 3.0])
def test_neighbours_on_the_grid_against_all_pairs(spark, eps):
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(150, 3)), np.zeros((30, 3)), np.full((30, 3), 0.4)))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    got = [(r.src, r.dst) for r in cluster.eps_pairs(points, eps, block=16).collect()]
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if ((x[i] - x[j]) ** 2).sum() <= eps * eps}
    assert len(got) == len(set(got)) and set(got) == want
    near = {r.id: r.d for r in cluster.k_distance(points, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert [near[i] for i in range(len(x))] == pytest.approx(np.sort(d, 1)[:, 4].tolist(), abs=1e-9)


def test_mahalanobis_prefers_the_wider_cluster(spark):
    labelled = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, [20.0], 1)], "id bigint, x array<double>, cluster int")
    got = cluster.mahalanobis_assign(spark.createDataFrame([(9, [5.0])], "id bigint, x array<double>"), cluster.summaries(labelled)).first()
    assert got.cluster == 1 and got.distance == pytest.approx(2.0)
    assert cluster.summaries(labelled).where("cluster = 0").select(F.round("var", 6)).first()[0] == 0.25
