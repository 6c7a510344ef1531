"""Exact deduplication by content sort.

Sampled splitters range-partition the rows on their normalised bytes, an external sort inside each partition puts equal
contents next to each other, smallest identifier first, and a streaming pass compares neighbours in full. All copies of a
content fall between the same two splitters, so no comparison crosses a partition. The pass holds one Arrow batch at a time.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name

WHITE = "[ \\t\\n\\r\\f\\x0B]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space, none is left at either end; letters keep their case."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def _sorted(docs: DataFrame, text_col: str, id_col: str, carry: list[str], key: str) -> DataFrame:
    """The rows in content order, with the normalised content last; rows with a null text are left out."""
    rows = docs.where(F.col(text_col).isNotNull()).select(*carry, *([] if id_col in carry else [id_col]), normalised(F.col(text_col)).alias(key))
    # splitters are sampled from the first characters and a hash, so that the driver never holds whole texts; equal contents
    # still fall between the same two, and everything after compares whole contents
    return rows.repartitionByRange(F.substring(key, 1, 32), F.xxhash64(key)).sortWithinPartitions(F.col(key), F.col(id_col).asc_nulls_last())


def _runs(batches, at: int):
    """(batch, whether each row's content differs from the row before)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(at)
        first = own[0].as_buffer()
        new = pa.array([last is None or not first.equals(last)])
        if batch.num_rows > 1:
            new = pa.concat_arrays([new, pc.not_equal(own.slice(1), own.slice(0, batch.num_rows - 1))])
        yield batch, new
        last = pa.py_buffer(own[batch.num_rows - 1].as_buffer().to_pybytes())


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without those whose normalised text equals that of a row with a smaller identifier; columns as they came.

    Defined cases: of equal contents the row with the smallest identifier stays, a null identifier counting as the largest;
    rows that tie on content and identifier (repeated rows) leave one; empty texts and texts of white space only are equal to
    each other; a null text is equal to nothing, so such rows all stay; an empty table gives an empty one; texts of any length
    are compared in full; extra columns pass through whatever their names.
    """
    key = free_name(docs, "content")
    schema = docs.schema
    whole = len(docs.columns)

    def run(batches):
        for batch, new in _runs(batches, whole):
            kept = batch.filter(new)
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays(kept.columns[:whole], names=schema.names)

    kept = _sorted(docs, text_col, id_col, docs.columns, key).mapInArrow(run, schema)
    return kept.unionAll(docs.where(F.col(text_col).isNull()))


def exact_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(identifier, n_copies) of the rows that drop_exact_duplicates keeps, with the number of rows of that content; defined cases as there, a row with a null text has n_copies 1."""
    key = free_name(docs, "content")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_copies", T.LongType())])

    def run(batches):
        held, n = None, 0
        for batch, new in _runs(batches, 1):
            starts = pc.indices_nonzero(new).to_pylist()
            bounds = [*starts, batch.num_rows]
            n += bounds[0] if starts else batch.num_rows
            ids, counts = [], []
            for k in range(len(starts)):
                if held is not None:
                    ids.append(held.as_py())
                    counts.append(n)
                held, n = batch.column(0)[starts[k]], bounds[k + 1] - starts[k]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(counts, pa.int64())], names=schema.names)
            kind = batch.schema.field(0).type
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.as_py()], kind), pa.array([n], pa.int64())], names=schema.names)

    groups = _sorted(docs, text_col, id_col, [id_col], key).mapInArrow(run, schema)
    return groups.unionAll(docs.where(F.col(text_col).isNull()).select(F.col(id_col), F.lit(1).cast("bigint").alias("n_copies")))
