"""Bounded-memory summaries of streams: Count-Min and DGIM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 4294967311
A5 = [3324115928, 1884968552, 3687649999, 2995172888, 404488631]
B5 = [4190266108, 3269070139, 3376120495, 550243864, 1934392880]


def hash_constants(depth: int) -> tuple[list[int], list[int]]:
    """Multipliers and offsets of the rows; beyond five they come from a digest, so they are the same everywhere."""
    more = [[int.from_bytes(hashlib.sha256(f"{name}{k}".encode()).digest()[:8], "big") % (PRIME - 1) + 1 for k in range(5, depth)] for name in "ab"]
    return (A5 + more[0])[:depth], (B5 + more[1])[:depth]


def cms_cells(code: Column, width: int, depth: int) -> Column:
    """The cell of a code from 0 to 2**31 - 2 in every row; a negative code is an error."""
    a, b = hash_constants(depth)
    safe = F.when(code >= 0, code.cast("bigint")).otherwise(F.raise_error(F.lit("codes must not be negative")).cast("bigint"))
    return F.array(*(F.struct(F.lit(i).alias("row"), F.pmod(F.pmod(F.lit(a[i]) * (safe + 1) + F.lit(b[i]), F.lit(PRIME)), F.lit(width)).alias("col")) for i in range(depth)))


def count_min(events: DataFrame, code: str, width: int, depth: int, count: str | None = None) -> DataFrame:
    """(row, col, n): the sketch. Counts are added per code first, so a row of the input costs one partial aggregate; sketches of parts add up by row and col."""
    n = F.sum(count) if count else F.count(F.lit(1))
    codes = events.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(n.alias("k"))
    cells = codes.select("k", F.explode(cms_cells(F.col("code"), width, depth)).alias("x"))
    return cells.groupBy("x.row", "x.col").agg(F.sum("k").alias("n"))


def cms_estimate(sketch: DataFrame, codes: DataFrame, code: str, width: int, depth: int) -> DataFrame:
    """(code, estimate): the least cell of each code over the first `depth` rows."""
    asked = codes.select(code, F.explode(cms_cells(F.col(code), width, depth)).alias("x")).select(code, "x.row", "x.col")
    return asked.join(sketch, ["row", "col"], "left").groupBy(code).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def cms_evaluation(events: DataFrame, code: str, width: int, depth: int, top: int = 20) -> DataFrame:
    """One row: errors of the sketch against exact counts, and how many of the top codes agree."""
    exact = events.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("exact"))
    both = exact.join(cms_estimate(count_min(events, code, width, depth), exact, code, width, depth), code).withColumn("error", F.col("estimate") - F.col("exact"))
    n = exact.agg(F.sum("exact").alias("total"))
    stats = both.crossJoin(F.broadcast(n)).agg(
        F.round(F.avg("error"), 6).alias("mean_error"), F.round(F.percentile("error", 0.95), 6).alias("p95_error"), F.max("error").alias("max_error"),
        F.round(F.avg((F.col("error") == 0).cast("double")), 6).alias("exact_share"), F.round(F.avg((F.col("error") <= F.col("total") / width).cast("double")), 6).alias("within_bound"), F.count_if(F.col("error") < 0).alias("underestimates"),
    )
    tops = [both.orderBy(F.desc(c), code).limit(top).select(code) for c in ("exact", "estimate")]
    agree = tops[0].join(tops[1], code, "left_semi").agg(F.count(F.lit(1)).alias("top_overlap"))
    return stats.crossJoin(agree).select(F.lit(width).alias("width"), F.lit(depth).alias("depth"), *stats.columns, "top_overlap")


class Dgim:
    """Approximate number of ones among the last `window` bits: at most two buckets of each size, error at most half."""

    def __init__(self, window: int, buckets: list | None = None, last: int | None = None):
        self.window, self.buckets, self.last = window, [list(b) for b in buckets or []], last  # newest first: [time of its newest one, size]

    def update(self, t: int, bit: int) -> None:
        if self.last is not None and t <= self.last:
            raise ValueError("times must grow")
        self.last = t
        while self.buckets and self.buckets[-1][0] < t - self.window + 1:
            self.buckets.pop()
        if not bit:
            return
        self.buckets.insert(0, [t, 1])
        at = 0
        while at + 2 < len(self.buckets) and self.buckets[at][1] == self.buckets[at + 1][1] == self.buckets[at + 2][1]:
            self.buckets[at + 1 : at + 3] = [[self.buckets[at + 1][0], self.buckets[at + 1][1] * 2]]
            at += 1

    def estimate(self, k: int | None = None) -> float:
        """Ones among the last k bits (the whole window by default)."""
        since = (self.last or 0) - (k or self.window) + 1
        live = [s for t, s in self.buckets if t >= since]
        return sum(live[:-1]) + (live[-1] / 2 if live[-1] > 1 else 1.0) if live else 0.0

    def valid(self) -> bool:
        """No more than two buckets of a size, sizes are powers of two and don't fall with age."""
        sizes = [s for _, s in self.buckets]
        return all(sizes.count(s) <= 2 and s & (s - 1) == 0 for s in sizes) and sizes == sorted(sizes)
