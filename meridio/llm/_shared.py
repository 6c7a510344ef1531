"""What the operators of this subpackage share: tables in the shared folder, size-checked joins, column guards."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, remove, shared_dir, written

__all__ = ["BROADCAST_ROWS", "free_name", "local_path", "new_path", "qualified", "remove", "shared_dir", "sized", "table", "written"]

#: Rows of a key-only side up to which it is broadcast (one or two 8-byte numbers: about 40 MB as a hash relation), as the other side
#: mostly has texts; above it the join shuffles.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most `limit` rows; beyond that the planner shuffles it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("shuffle_hash") if n <= 50 * limit else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't use, whatever extra columns it has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Hadoop's names of object stores and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority as the session's Hadoop configuration completes it, so that tasks resolve it alike."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def local_path(uri: str):
    """A pyarrow filesystem and the path in it, for reading shared tables inside tasks; a path without a scheme is a local one.

    Stores that pyarrow doesn't know by themselves are opened by fsspec if that is installed.
    """
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return fs.LocalFileSystem(), uri
    if scheme in ("abfs", "abfss"):  # container@account.host/path
        where, _, path = rest.partition("/")
        container, _, host = where.partition("@")
        return fs.AzureFileSystem(account_name=host.partition(".")[0]), f"{container}/{path}"
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except (pa.ArrowInvalid, NotImplementedError) as e:
        try:
            import fsspec
        except ImportError:
            raise ValueError(f"no reader for {scheme}:// inside tasks: {e}") from e
        return fs.PyFileSystem(fs.FSSpecHandler(fsspec.filesystem(scheme))), rest
