"""Totals over intervals against brute force."""

import numpy as np
import pytest

from meridio.operators import joins


def test_totals_by_prefix_sums(spark):
    rng = np.random.default_rng(2)
    points = [(int(t), float(v)) for t, v in zip(rng.integers(0, 60, 300), rng.normal(size=300).round(3))] + [(3, None), (None, 1.0), (500, None)]
    spans = [(k, int(a), int(a + w)) for k, (a, w) in enumerate(zip(rng.integers(-5, 70, 80), rng.integers(-1, 12, 80)))] + [(7, 10, 12), (7, 10, 12), (90, 500, 501)]
    rows = joins.interval_totals(spark.createDataFrame(points, "at bigint, v double"), spark.createDataFrame(spans, "k bigint, a bigint, b bigint"), "at", "v", "a", "b").collect()
    want = []
    for k, a, b in spans:
        inside = [v for t, v in points if t is not None and a <= t < b]
        if inside:
            known = [v for v in inside if v is not None]
            want.append((k, a, b, len(inside), round(sum(known), 6) if known else None))
    assert sorted((r.k, r.a, r.b, r.n, None if r.total is None else round(r.total, 6) + 0.0) for r in rows) == sorted(want)
