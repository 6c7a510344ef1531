"""PageRank and HITS over packed edges, against dense algebra."""

import numpy as np
import pytest

from meridio.operators import graph


def test_pagerank_with_dead_ends_lone_nodes_and_strangers(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 30, (120, 2)) if a % 5]  # every fifth node has no way out
    nodes = [*range(28), 77]  # 28 and 29 are strangers
    m, deg = np.zeros((29, 29)), np.zeros(29)
    for a, b in pairs:
        if a < 28:
            deg[a] += 1
            if b < 28:
                m[b, a] += 1
    r = np.full(29, 1 / 29)
    for _ in range(20):
        r = 0.85 * (m @ (r / np.where(deg > 0, deg, np.inf)) + r[deg == 0].sum() / 29) + 0.15 / 29
    frames = spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.createDataFrame([(i,) for i in nodes], "id bigint")
    for held in (graph.HELD_NODES, 0):  # through the driver and as frames
        with pytest.MonkeyPatch.context() as m_:
            m_.setattr(graph, "HELD_NODES", held)
            got = {x.id: x["rank"] for x in graph.pagerank(*frames, iterations=20, eps=None).collect()}
        assert got == pytest.approx(dict(zip(nodes, r)))


def test_hits_over_packed_edges(spark):
    pairs = [(1, 10), (1, 11), (2, 10), (3, 12), (1, 10)]
    a = np.zeros((3, 3))
    for s, d in pairs:
        a[s - 1, d - 10] += 1
    h = np.ones(3)
    for _ in range(7):
        x = a.T @ h
        h = a @ x / np.linalg.norm(a @ x)
    got = {r.id: (r.hub, r.auth) for r in graph.hits(spark.createDataFrame(pairs, "src bigint, dst bigint"), iterations=7, eps=None).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == pytest.approx(h.tolist()) and [got[i][1] for i in (10, 11, 12)] == pytest.approx((x / np.linalg.norm(x)).tolist())
