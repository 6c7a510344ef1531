"""Covariance, PCA and randomised SVD: sums over the rows in Spark, d-by-d or w-by-w algebra on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..sources.shared import remove, written

#: Columns up to which a number for each of them is sent to tasks and to the driver.
SMALL_COLUMNS = 50_000


def covariance(points: DataFrame) -> DataFrame:
    """(i, j, cov): the sample covariance matrix of (id, x), upper triangle; from one pass of centred products."""
    mean = points.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("_m"))
    centred = points.crossJoin(F.broadcast(mean)).select(F.zip_with("x", "_m", lambda a, b: a - b).alias("z"))

    def products(batches):
        gram, n = None, 0
        for b in batches:
            if len(b):
                z = np.vstack(b["z"])
                gram = z.T @ z if gram is None else gram + z.T @ z
                n += len(z)
        if n:
            i, j = np.triu_indices(len(gram))
            yield pd.DataFrame({"i": i, "j": j, "g": gram[i, j], "n": n})

    parts = centred.mapInPandas(products, "i int, j int, g double, n bigint")  # d squared numbers a task
    return parts.groupBy("i", "j").agg(F.try_divide(F.sum("g"), F.sum("n") - 1).alias("cov"))  # null for a single row


class Pca:
    """Components in rows by falling variance, the largest loading of each positive."""

    def __init__(self, mean, variances, components):
        self.mean, self.variances, self.components = mean, variances, components

    @property
    def ratio(self):
        total = self.variances.sum()
        return self.variances / total if total > 0 else np.zeros_like(self.variances)

    def k_for(self, target: float) -> int:
        """How many components reach the share of variance; one more than there are, if rounding keeps all of them below it."""
        return int(np.searchsorted(np.cumsum(self.ratio), target) + 1)

    def transform(self, points: DataFrame, k: int) -> DataFrame:
        """(id, y): coordinates on the first k components; the points are centred first."""
        mean, comps = F.array(*(F.lit(float(v)) for v in self.mean)), [F.array(*(F.lit(float(v)) for v in row)) for row in self.components[:k]]
        z = F.zip_with("x", mean, lambda a, b: a - b)
        dot = [F.aggregate(F.zip_with(z, c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for c in comps]
        return points.select("id", F.array(*dot).alias("y"))

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return y @ self.components[: y.shape[1]] + self.mean


def fit_pca(points: DataFrame) -> Pca:
    """Eigenvectors of the covariance matrix; raises for fewer than two rows or non-finite values."""
    mean = [r.m for r in points.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()]
    cells = covariance(points).collect()
    c = np.zeros((len(mean), len(mean)))
    for r in cells:
        c[r.i, r.j] = c[r.j, r.i] = np.nan if r.cov is None else r.cov
    if not len(mean) or not np.isfinite(c).all():
        raise ValueError("PCA needs two rows or more and finite values")
    values, vectors = np.linalg.eigh(c)
    by = np.argsort(values)[::-1]
    comps = vectors[:, by].T
    sign = np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)])
    return Pca(np.array(mean), np.clip(values[by], 0, None), comps * np.where(sign == 0, 1, sign)[:, None])


def relative_error(a: np.ndarray, b: np.ndarray) -> float:
    """Relative Frobenius error of b for a; 0 of nothing is 0, something for nothing is infinite."""
    size, diff = np.linalg.norm(a), np.linalg.norm(a - b)
    return float(diff / size) if size else (0.0 if not diff else float("inf"))


def multiply(matrix: DataFrame, dense: DataFrame, row: str, col: str, value: str, key: str) -> DataFrame:
    """(row, v): sparse (row, col, value) times dense rows (key, v ARRAY), joined on col = key and added up by row."""
    product = matrix.join(dense.select(F.col(key).alias(col), "v"), col).select(F.col(row).alias("_r"), F.posexplode(F.transform("v", lambda x: x * F.col(value))).alias("k", "p"))
    sums = product.groupBy("_r", "k").agg(F.sum("p").alias("p"))
    return sums.groupBy("_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias("v")).withColumnRenamed("_r", row)


def _gram(rows: DataFrame) -> np.ndarray:
    def run(batches):
        g = None
        for b in batches:
            if len(b):
                y = np.vstack(b["v"])
                g = y.T @ y if g is None else g + y.T @ y
        if g is not None:
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": g.ravel()})

    cells = rows.select("v").mapInPandas(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    n = int(cells["i"].max()) + 1 if len(cells) else 0
    out = np.zeros((n, n))
    out[cells["i"], cells["j"]] = cells["g"]
    return out


def _times(rows: DataFrame, m: np.ndarray) -> DataFrame:
    columns = F.array(*(F.array(*(F.lit(float(x)) for x in m[:, j])) for j in range(m.shape[1])))
    return rows.withColumn("v", F.transform(columns, lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def _orthonormal(rows: DataFrame) -> DataFrame:
    """The rows' columns made orthonormal by their Gram matrix, twice over for accuracy."""
    for _ in range(2):
        rows = written(rows, "svd")
        values, vectors = np.linalg.eigh(_gram(rows))
        keep = values > max(values.max(), 1e-300) * 1e-12
        rows = _times(rows, vectors[:, keep] / np.sqrt(values[keep]))
    return written(rows, "svd")


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())


class RowMatrix:
    """A sparse matrix by rows: a table (row, at ARRAY<INT>, x ARRAY<DOUBLE>) in the shared folder; at has places in `names`, an Arrow array of the columns in order."""

    def __init__(self, rows: DataFrame, names: pa.Array):
        # a task sends a sum for each column, so there are only so many tasks
        self.rows, self.names = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism), names

    def size(self) -> tuple[float, int, int]:
        """The sum of squares, the number of rows and the number of entries."""
        r = self.rows.agg(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), F.count(F.lit(1)), F.sum(F.size("x"))).first()
        return r[0] or 0.0, r[1], r[2] or 0

    def products(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the matrix A: A transposed times A z, and A z transposed times A z, in one pass over the rows."""
        (n, w), zt = z.shape, np.ascontiguousarray(z.T)

        def run(batches):
            m, g = np.zeros((w, n)), np.zeros((w, w))
            for b in batches:
                if b.num_rows:
                    of, at, x = _entries(b.column(0), b.column(1))
                    y = np.stack([np.bincount(of, x * zt[j][at], minlength=b.num_rows) for j in range(w)])
                    for j in range(w):
                        m[j] += np.bincount(at, x * y[j][of], minlength=n)
                    g += y @ y.T
            seen = np.flatnonzero(m.any(0))
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((seen, np.arange(n, n + w))).astype(np.int32)), _lists(np.concatenate((m[:, seen].T, g)))], names=["k", "v"])

        parts = self.rows.select("at", "x").mapInArrow(run, "k int, v array<double>")
        sums = parts.groupBy("k").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(w))).alias("v")).toArrow()
        out = np.zeros((n + w, w))
        if sums.num_rows:
            out[sums["k"].to_numpy()] = sums["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
        return out[:n], out[n:]

    def times(self, z: np.ndarray) -> DataFrame:
        """(row, v): the matrix times z."""
        zt, row = np.ascontiguousarray(z.T), self.rows.schema[0]

        def run(batches):
            for b in batches:
                if b.num_rows:
                    of, at, x = _entries(b.column(1), b.column(2))
                    y = np.stack([np.bincount(of, x * c[at], minlength=b.num_rows) for c in zt], 1)
                    yield pa.RecordBatch.from_arrays([b.column(0), _lists(y)], names=[row.name, "v"])

        return self.rows.mapInArrow(run, StructType([row]).add("v", ArrayType(DoubleType())))


def _entries(at: pa.Array, x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each entry of a batch of rows, its column and its value."""
    lengths = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(len(at)), lengths), at.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)


def row_matrix(matrix: DataFrame, row: str, col: str, value: str, most: int = SMALL_COLUMNS) -> RowMatrix | DataFrame:
    """A sparse (row, col, value) by rows; as a table of its entries, if there are more than `most` columns. The input is read once."""
    spark = matrix.sparkSession
    entries = written(matrix.groupBy(row).agg(F.collect_list(F.struct(F.col(col).alias("col"), F.col(value).cast("double").alias("value"))).alias("entries")), "svd")
    names = entries.select(F.explode("entries.col").alias("col")).distinct().limit(most + 1).toArrow()["col"].combine_chunks()
    if len(names) > most:
        return entries.select(row, F.explode("entries").alias("e")).select(row, F.col("e.col").alias(col), F.col("e.value").alias(value))
    names = names.take(pc.sort_indices(names))

    def numbered(batches):
        for b in batches:
            lists = b.column(1)
            ends = pc.subtract(lists.offsets, lists.offsets[0])
            at = pa.ListArray.from_arrays(ends, pc.index_in(lists.flatten(), value_set=names))
            yield pa.RecordBatch.from_arrays([b.column(0), at, b.column(2)], names=[row, "at", "x"])

    schema = StructType([entries.schema[0]]).add("at", ArrayType(IntegerType())).add("x", ArrayType(DoubleType()))
    rows = written(entries.select(row, "entries.col", "entries.value").mapInArrow(numbered, schema), "svd")
    remove(spark, entries)
    return RowMatrix(rows, names)


def _noise(col: str, w: int, seed: int) -> list:
    return [(F.sqrt(-2 * F.ln((F.pmod(F.xxhash64(F.col(col), F.lit(2 * j + seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1))) * F.cos(2 * np.pi * F.pmod(F.xxhash64(F.col(col), F.lit(2 * j + seed + 1)), F.lit(1 << 40)) / float(1 << 40))) for j in range(w)]


def randomised_svd(matrix: DataFrame | RowMatrix, k: int, *, oversample: int = 12, powers: int = 2, seed: int = 42, row: str = "row", col: str = "col", value: str = "value") -> tuple[np.ndarray, DataFrame, DataFrame]:
    """(singular values, U rows (row, v), V rows (col, v)) of a sparse matrix, the largest entry of each V column positive.

    A random projection of k + oversample columns, `powers` power iterations with orthonormalisation, and an exact small
    problem. Needs k below both sides' lengths. With up to SMALL_COLUMNS columns, a pass over the rows sends k + oversample
    numbers for each column to the driver, and nothing else is shuffled; with more, the products are shuffled by entries and
    only (k + oversample)-squared numbers reach the driver.
    """
    if isinstance(matrix, DataFrame):
        matrix = row_matrix(matrix, row, col, value)
    if isinstance(matrix, DataFrame):
        return _svd_by_entries(matrix, k, k + oversample, powers, seed, row, col, value)
    spark = matrix.rows.sparkSession
    columns = spark.createDataFrame(pa.table({col: matrix.names}))
    z = np.array(columns.select(col, F.array(*_noise(col, k + oversample, seed)).alias("v")).orderBy(col).toArrow()["v"].to_pylist(), float).reshape(len(matrix.names), -1)
    for _ in range(powers):
        z = np.linalg.qr(matrix.products(np.linalg.qr(z)[0])[0])[0]
    for _ in range(2):  # the columns of A z made orthonormal by their Gram matrix, twice over for accuracy
        b, gram = matrix.products(z)
        values, vectors = np.linalg.eigh(gram)
        keep = values > max(values.max(initial=0), 1e-300) * 1e-12
        t = vectors[:, keep] / np.sqrt(values[keep])
        z, b = z @ t, b @ t
    values, vectors = np.linalg.eigh(b.T @ b)
    by = np.argsort(values)[::-1][:k]
    sigma = np.sqrt(np.clip(values[by], 0, None))
    v = b @ vectors[:, by] / np.where(sigma > 0, sigma, 1)
    sign = np.where(v[np.abs(v).argmax(0), np.arange(len(by))] >= 0, 1.0, -1.0) if len(v) else np.ones(len(by))
    return sigma, matrix.times(z @ vectors[:, by] * sign), spark.createDataFrame(pa.table({col: matrix.names, "v": _lists(v * sign)}))


def _svd_by_entries(matrix: DataFrame, k: int, w: int, powers: int, seed: int, row: str, col: str, value: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    cols = matrix.select(col).distinct()
    q = _orthonormal(multiply(matrix, cols.select(col, F.array(*_noise(col, w, seed)).alias("v")), row, col, value, col))
    for _ in range(powers):
        z = _orthonormal(multiply(matrix, q, col, row, value, row))
        q = _orthonormal(multiply(matrix, z, row, col, value, col))
    b = written(multiply(matrix, q, col, row, value, row), "svd")  # rows of A transposed times Q
    values, vectors = np.linalg.eigh(_gram(b))
    by = np.argsort(values)[::-1][:k]
    sigma = np.sqrt(np.clip(values[by], 0, None))
    v = _times(b, vectors[:, by] / np.where(sigma > 0, sigma, 1))
    peaks = v.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.max_by("x", F.abs("x")).alias("x")).orderBy("k").collect()
    sign = np.array([1.0 if r.x >= 0 else -1.0 for r in peaks])
    return sigma, _times(q, vectors[:, by] * sign), _times(v, np.diag(sign))
