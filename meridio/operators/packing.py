"""Rows packed into compressed blocks, which are cheap to send to several tasks, and tasks that work on whole blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a packed block at most.
BLOCK_ROWS = 500_000


def _blob(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in pa.Table.from_batches(batches).combine_chunks().to_batches():
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def packed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, blob): the rows of each key, an int, in blocks of their other columns; order makes equal values neighbours, which compresses them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, n = [], None, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([_blob(held)], pa.binary())], names=[key, "blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for a, e in zip(cuts[:-1], cuts[1:]):
                if held and (of != k[a] or n >= BLOCK_ROWS):
                    yield block()
                    held, n = [], 0
                of = int(k[a])
                held.append(batch.slice(a, e - a).select(list(range(1, batch.num_columns))))
                n += e - a
        if held:
            yield block()

    others = [c for c in rows.columns if c != key]
    ordered = rows.select(F.col(key).cast("int").alias(key), *others).repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(run, f"{key} int, blob binary")


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray] | None:
    """The columns of blocks, one after the other; nulls of doubles become NaN."""
    if not blobs:
        return None
    table = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])
    return {c: _values(table.column(c).combine_chunks()) for c in table.column_names}


def _values(column: pa.Array) -> np.ndarray:
    """Lists, which are of one length, become the rows of a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def on_parts(sides: list[DataFrame], parts: int, work: Callable[[list[dict | None]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(the columns of each side) for each of the parts, in a task of its own; sides have (part, blob)."""
    every, count = None, len(sides)
    for k, side in enumerate(sides):
        one = side.select("part", F.lit(k).alias("side"), "blob")
        every = one if every is None else every.unionAll(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in range(count)]
        for batch in batches:
            for k, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held[k].append(blob)
        if any(held):
            columns = []
            while held:
                columns.append(unpacked(held.pop(0)))
            yield from work(columns)

    return every.repartitionById(parts, F.col("part").cast("int")).mapInArrow(run, schema)


def spread(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists given by start and length: the number of the list and the place of each of their entries."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return of, np.arange(len(of)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes add up to `most` or less; a larger one stands alone."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        e = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, e
        a = e
