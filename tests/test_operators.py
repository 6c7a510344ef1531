"""Operators of the engine on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from meridio.operators import audit, cluster, components, dimred, graph, recommend, relational, sketch, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pagerank_without_teleport(spark):
    edges = frame(spark, [(0, 0), (0, 1), (1, 0), (1, 2), (2, 1)], "src bigint, dst bigint")
    got = {r.id: r.rank for r in graph.pagerank(edges, beta=1.0, eps=1e-12, iterations=200).collect()}
    assert got == pytest.approx({0: 0.4, 1: 0.4, 2: 0.2}, abs=1e-6)


def test_modularity_of_two_edges(spark):
    edges = frame(spark, [(0, 1, 1.0), (2, 3, 1.0)], "src bigint, dst bigint, w double")
    labels = frame(spark, [(0, 0), (1, 0), (2, 1), (3, 1)], "id bigint, label bigint")
    assert graph.modularity(edges, labels).first().q == pytest.approx(0.5)


def test_spearman_with_ties(spark):
    df = frame(spark, [(1.0, 1.0), (1.0, 2.0), (2.0, 3.0)], "x double, y double")
    row = graph.spearman(df, "x", "y").first()
    assert any(abs(float(x) - 0.75**0.5) < 1e-6 for x in row if x is not None)


def test_components(spark):
    edges = frame(spark, [(1, 2), (2, 3), (9, 8), (5, 5), (None, 1)], "src bigint, dst bigint")
    got = {r.id: r.component for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_kmeans_in_one_dimension(spark):
    points = frame(spark, [(i, [float(v)]) for i, v in enumerate([1, 2, 3, 10, 11, 12])], "id bigint, x array<double>")
    start = frame(spark, [(0, [1.0]), (1, [12.0])], "cluster int, c array<double>")
    assigned, centres, _ = cluster.kmeans(points, start)
    assert sorted(round(r.c[0], 9) for r in centres.collect()) == [2.0, 11.0]
    assert float(cluster.sse(assigned).first()[0]) == pytest.approx(4.0)


def test_dbscan_finds_two_groups_and_noise(spark):
    xy = [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1), (5.0, 5.0), (5.1, 5.0), (5.0, 5.1), (12.0, 12.0)]
    points = frame(spark, [(i, list(p)) for i, p in enumerate(xy)], "id bigint, x array<double>")
    rows = {r.id: r for r in cluster.dbscan(points, 0.25, 3).collect()}
    labels = [rows[i].cluster for i in range(7)]
    assert len({labels[0], labels[1], labels[2]}) == 1 and len({labels[3], labels[4], labels[5]}) == 1
    assert labels[0] != labels[3] and labels[6] == -1


def test_gini_and_top_share(spark):
    assert audit.gini(frame(spark, [(1.0,)] * 3, "x double"), "x").first().gini == pytest.approx(0.0, abs=1e-9)
    assert audit.top_share(frame(spark, [(1.0,), (2.0,), (7.0,)], "x double"), "x", 1 / 3).first().share == pytest.approx(0.7)


def test_count_min_never_underestimates(spark):
    events = frame(spark, [(c,) for c in (0, 1, 0, 2, 0, 1, 3, 0)], "code bigint")
    codes = events.distinct()
    est = sketch.cms_estimate(sketch.count_min(events, "code", 5, 2), codes, "code", 5, 2)
    truth = {0: 4, 1: 2, 2: 1, 3: 1}
    assert all(r.estimate >= truth[r.code] for r in est.collect())


def test_covariance(spark):
    points = frame(spark, [(i, list(p)) for i, p in enumerate([(2.0, 0.0), (0.0, 1.0), (-2.0, 0.0), (0.0, -1.0)])], "id bigint, x array<double>")
    got = {(r.i, r.j): r["cov"] for r in dimred.covariance(points).collect()}
    assert sorted(got.values()) == pytest.approx([0.0, 2 / 3, 8 / 3])


def test_average_ranks_and_top_per_group(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 1.0)], "k string, v double")
    ranks = sorted(r.rank for r in relational.average_ranks(df.where("k = 'a'"), "v", "rank").collect())
    assert ranks == [1.5, 1.5, 3.0]
    best = relational.top_per_group(df, ["k"], [F.desc("v")], 1).collect()
    assert sorted((r.k or "", r.v) for r in best) == [("", 1.0), ("a", 2.0), ("b", 5.0)]


def test_sliding_totals(spark):
    df = frame(spark, [("a", i, float(i + 1), i) for i in range(5)], "k string, t bigint, v double, n bigint")
    rows = windows.sliding(df, ["k"], "t", "v", 4, ["n"]).orderBy("t").collect()
    assert [(r["total"], r["count"]) for r in rows] == [(1.0, 1), (3.0, 2), (6.0, 3), (10.0, 4), (14.0, 4)]


def test_item_similarity_needs_common_users(spark):
    rows = [(u, i, r) for u, rs in enumerate(((5, 5, 1), (4, 4, 2), (1, 1, 5))) for i, r in enumerate(rs)]
    df = frame(spark, [(u, i, float(r), 0) for u, i, r in rows], "u bigint, i bigint, r double, d bigint")
    got = {(r.i, r.j): r.s for r in recommend.item_similarity(df, least=2, damp=0.0).collect()}
    assert got[0, 1] > 0.9 and got[0, 2] < 0
    assert recommend.item_similarity(df.limit(1), least=2, damp=0.0).count() == 0
