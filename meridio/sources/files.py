"""Readers and writers of JSON lines, delimited text and Parquet. All scans are Spark's own and split large files by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_json_lines(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, keep_corrupt: bool = False) -> DataFrame:
    """One row a line. With a schema files are read once, without one a first pass infers it.

    Fields that a line lacks or that don't fit are null. Lines that are no JSON give a row of nulls, with their text in the
    column `_corrupt` if keep_corrupt is set (a schema is needed then).
    """
    reader = spark.read.option("mode", "PERMISSIVE")
    if schema is not None:
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if keep_corrupt:
            kind = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        reader = reader.schema(kind)
    return reader.json(list(paths))


def read_delimited(
    spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, nulls: str = "",
    date_format: str = "yyyy-MM-dd", timestamp_format: str | None = None, strict: bool = False,
) -> DataFrame:
    """All files of all paths on end. Values that don't fit the schema are null, or an error if strict; without a schema all are text."""
    reader = spark.read.option("sep", sep).option("header", header).option("nullValue", nulls).option("dateFormat", date_format).option("multiLine", False)
    reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("escape", '"')
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    return (reader.schema(schema) if schema is not None else reader).csv(list(paths))


def concatenated(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column that a frame lacks is null in its rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def view(spark: SparkSession, name: str, pattern: str) -> DataFrame:
    """Parquet files that match a pattern as a SQL view."""
    rows = spark.read.parquet(pattern)
    rows.createOrReplaceTempView(name)
    return rows


def save(df: DataFrame, path: str, *, mode: str = "overwrite", by: list[str] | None = None, rows_per_file: int | None = None, kind: str = "parquet", **options: str) -> DataFrame:
    """Write a final table and return it as read back. `mode` "ignore" leaves a table that is there as it is.

    With `by` the rows go to a folder a value; they are shuffled by those columns and a hash of the rest, so that a folder gets a
    few files and a frequent value isn't one task's work.
    """
    if by:
        rest = [c for c in df.columns if c not in by]
        parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
        df = df.repartition(*by, F.pmod(F.xxhash64(*rest), F.lit(parts))) if rest else df.repartition(*by)
    writer = df.write.mode(mode).options(**options)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if by:
        writer = writer.partitionBy(*by)
    writer.format(kind).save(path)
    return df.sparkSession.read.format(kind).options(**options).load(path)


def expanded(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column as columns of their own, in its place; those whose names are taken get the column's name in front."""
    others = {c for c in df.columns if c != column}
    fields = [F.col(column)[f].alias(f if f not in others else f"{column}_{f}") for f in df.schema[column].dataType.names]
    return df.select(*(x for c in df.columns for x in (fields if c == column else [F.col(c)])))
