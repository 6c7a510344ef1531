"""WARC source and sink.

Reading is by boundary-chain verification. Files are cut into ranges; each task emits, for every place in its range where a
record could begin, the offset of the record that would follow, and shortens these pointers to where the chain leaves the
range. Jumping along the pointers from the start of each file, twice as far every round, finds the true entry of each range;
look-alike records inside payloads are never reached. Tasks then read their range's records from its entry. A range is all a
task holds, besides the one record that crosses its end.

Where a chain breaks, its last pointer leads to a place where no record begins. Such places are nodes of the chain too, with a
pointer to the next place where a record could begin; those that are reached from the start of a file are its damages.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import local_path, new_path, qualified, remove, table, written

RANGE = 8 << 20
STEP = 1 << 16  # bytes by which a header is read until it ends, however long it is
MAGIC, GZIP = re.compile(rb"WARC/\d+\.\d+\r\n"), re.compile(rb"\x1f\x8b\x08")
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.I)
#: A header's lines up to a break: a name and a colon, or a continuation of the line before.
LINES = re.compile(rb"WARC/\d+\.\d+\r\n(?:(?:[!#-'*+.0-9A-Z^-z|~-]+[ \t]*:|[ \t])[^\r\n]*\r\n)*")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Characters that a header line can't hold as they are, with those that escaping uses.
UNSAFE = re.compile(r"[%+\x00-\x20\x7f]")

RECORD = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("block", T.BinaryType()),
    T.StructField("recovered", T.BooleanType()),
])


def _escaped(name: str, value: str | None) -> list[tuple[str, str]]:
    """The header for a value; one with control characters or spaces is percent-encoded, and a second header tells so."""
    if value is None:
        return []
    safe = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", value)
    plain = re.sub("[%+]", "", value)
    return [(name, value)] if not UNSAFE.search(plain) else [(name, safe), (f"X-Escaped-{name}", "1")]


def write_pages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", gzip: bool = False) -> DataFrame:
    """Write one response record a row into `folder`, a file a partition; (file, records, bytes) of what was written.

    Names come from the partition's number and a file appears under its name only when it is whole, so a repeated task replaces
    its own file. A null identifier, address or page leaves out its header or marks the record; control characters and spaces in
    identifiers and addresses are percent-encoded and marked, and read_pages decodes them; extra columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    folder = qualified(pages.sparkSession, folder)

    def run(batches):
        filesystem, path = local_path(folder)
        filesystem.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc" + (".gz" if gzip else "")
        part, n, size = f"{path}/_{name}.{uuid.uuid4().hex}", 0, 0
        with filesystem.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    block = HTTP + (html or "").encode("utf-8", "surrogatepass")
                    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{n}')}>")]
                    fields += _escaped("WARC-Target-URI", url) + _escaped("X-Row-ID", key)
                    fields += [("X-Null-Payload", "1")] if html is None else []
                    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
                    data = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
                    if gzip:
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = z.compress(data) + z.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
        filesystem.move(part, f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]})

    return written(rows.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-files")


class Source:
    """Random access to a file, with its range held in memory."""

    def __init__(self, handle, size: int, start: int, end: int):
        self.handle, self.size, self.start = handle, size, start
        self.data = handle.read_at(min(size, end + STEP) - start, start)

    def bytes(self, a: int, n: int) -> bytes:
        n = min(n, self.size - a)
        if self.start <= a and a + n <= self.start + len(self.data):
            return self.data[a - self.start : a - self.start + n]
        return self.handle.read_at(max(n, 0), a)

    def header(self, a: int) -> tuple[int, int] | None:
        """As header(), for the record that would begin at a; reads on until the header ends or a line can't belong to one."""
        n = STEP
        while True:
            data = self.bytes(a, n)
            if data.find(b"\r\n\r\n") >= 0 or a + len(data) >= self.size:
                return header(data)
            lines = LINES.match(data)
            if not lines or data.find(b"\r\n", lines.end()) >= 0:  # a whole line that is none of a header
                return None
            n *= 2

    def member(self, a: int) -> tuple[bytes, int] | None:
        """A gzip member's content and the offset behind it, or None."""
        z, out, at = zlib.decompressobj(31), [], a
        try:
            while at < self.size and not z.eof:
                part = self.bytes(at, 1 << 20)
                out.append(z.decompress(part))
                if not out[0].startswith(b"WARC/"[: len(out[0])]):
                    return None
                at += len(part) - len(z.unused_data)
        except zlib.error:
            return None
        return (b"".join(out), at) if z.eof else None


def header(data: bytes) -> tuple[int, int] | None:
    """The header's length up to the block and the block's length, if a well-formed record begins with the data."""
    lines = LINES.match(data)
    if not lines or data[lines.end() : lines.end() + 2] != b"\r\n":
        return None
    found = LENGTH.search(data, 0, lines.end())
    return (lines.end() + 2, int(found[1])) if found else None


def successor(source: Source, a: int, packed: bool) -> int | None:
    """The offset behind the record that would begin at a, or None if none can."""
    if packed:
        found = source.member(a)
        sizes = header(found[0]) if found else None
        return found[1] if sizes and sum(sizes) <= len(found[0]) else None
    found = source.header(a)
    if not found or a + sum(found) > source.size:
        return None
    # the last record's closing line ends may be missing
    return min(a + sum(found) + 4, source.size)


def _candidates(batches):
    for batch in batches:
        out: dict[str, list] = {"file": [], "part": [], "a": [], "b": []}
        for file, size, part, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            filesystem, path = local_path(file)
            packed = file.endswith(".gz")
            with filesystem.open_input_file(path) as f:
                source = Source(f, size, start, end)
                pattern = GZIP if packed else MAGIC
                places = [start + m.start() for m in pattern.finditer(source.data) if start + m.start() < end]
                after = {a: b for a in places if (b := successor(source, a, packed)) is not None}
            for a in reversed(sorted(after)):  # successors inside the range are already shortened; one that is no candidate stays
                b = after[a]
                after[a] = after.get(b, b) if b < end else b
            out["file"] += [file] * len(after)
            out["part"] += [part] * len(after)
            out["a"] += after.keys()
            out["b"] += after.values()
        yield pa.RecordBatch.from_arrays([pa.array(out["file"], pa.string()), pa.array(out["part"], pa.int64()), pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64())], names=list(out))


def ranges(spark: SparkSession, folder: str, size: int = RANGE) -> DataFrame:
    """(file, length, part, a, b): the ranges of all files in the folder; only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select(F.col("path").alias("file"), "length").where("length > 0")
    parts = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size))))
    return parts.select("file", "length", "part", (F.col("part") * size).alias("a"), F.least(F.col("length"), (F.col("part") + 1) * size).alias("b"))


def _links(jump: DataFrame, files: DataFrame, size: int) -> DataFrame:
    """(file, part, a, b, broken): the pointers, and those from each place where a chain breaks to the next candidate or the end.

    Two levels, so that no window holds a file's candidates: the next one inside the range, else the first of a later range.
    """
    ends = jump.select("file", F.col("b").alias("a")).unionAll(files.select("file", F.lit(0).cast("bigint").alias("a"))).distinct()
    dead = ends.join(jump.select("file", "a").hint("merge"), ["file", "a"], "left_anti").join(files, "file").where("a < length")
    dead = dead.select("file", "length", F.floor(F.col("a") / size).alias("part"), "a")
    later = Window.partitionBy("file").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    firsts = jump.groupBy("file", "part").agg(F.min("a").alias("f")).unionAll(dead.select("file", "part", F.lit(None).cast("bigint")).distinct())
    firsts = firsts.groupBy("file", "part").agg(F.min("f").alias("f")).select("file", "part", F.min("f").over(later).alias("later"))
    inside = Window.partitionBy("file", "part").orderBy("a").rowsBetween(1, Window.unboundedFollowing)
    nodes = jump.select("file", "part", "a", F.col("a").alias("c"), F.lit(None).cast("bigint").alias("length"))
    nodes = nodes.unionAll(dead.select("file", "part", "a", F.lit(None).cast("bigint").alias("c"), "length"))
    after = nodes.withColumn("next", F.min("c").over(inside)).where("c is null").join(firsts, ["file", "part"])
    broken = after.select("file", "part", "a", F.coalesce("next", "later", "length").alias("b"), F.lit(True).alias("broken"))
    return jump.withColumn("broken", F.lit(False)).unionAll(broken)


def entries(parts: DataFrame, size: int = RANGE) -> DataFrame:
    """(file, part, a, b, broken): the places that the chain of each file reaches at the entry of a range, and those where it breaks.

    For a broken place b is where the chain goes on.
    """
    spark = parts.sparkSession
    spread = parts.repartition(spark.sparkContext.defaultParallelism * 4, "file", "part")
    found = written(spread.mapInArrow(_candidates, "file string, part bigint, a bigint, b bigint"), "chain")
    where = written(_links(found, parts.select("file", "length").distinct(), size), "links")
    reached, jump = where.where("a = 0").select("file", "a"), where.select("file", "a", "b")
    old, n, before = [], 0, -1
    while n != before:
        there = reached.join(jump.hint("merge"), ["file", "a"]).select("file", F.col("b").alias("a"))
        reached, before = written(reached.unionAll(there).distinct(), "reached"), n
        n = reached.count()
        jump = written(jump.join(jump.select("file", F.col("a").alias("b"), F.col("b").alias("c")).hint("merge"), ["file", "b"]).select("file", "a", F.col("c").alias("b")), "jumps")
        remove(spark, *old)
        old = [reached, jump]
    out = written(reached.join(where.hint("merge"), ["file", "a"]).select("file", "part", "a", "b", "broken"), "entries")
    remove(spark, *old, found, where)
    return out


def _records(batches):
    for batch in batches:
        rows, held = [], 0
        for file, size, start, end, entry, recovered in zip(*(c.to_pylist() for c in batch.columns)):
            filesystem, path = local_path(file)
            packed = file.endswith(".gz")
            with filesystem.open_input_file(path) as f:
                source, a = Source(f, size, start, end), entry
                while a is not None and a < end:
                    if packed:
                        found = source.member(a)
                        data, behind = found if found else (b"", None)
                    else:
                        found = source.header(a)
                        behind = a + sum(found) + 4 if found else None
                        data = source.bytes(a, sum(found)) if found and a + sum(found) <= size else b""
                    sizes = header(data) if data else None
                    if not sizes or len(data) < sum(sizes):
                        break  # an entry of its own leads past the damage
                    lines = re.sub(r"\r\n[ \t]+", " ", data[: sizes[0]].decode("utf-8", "replace")).split("\r\n")[1:]
                    fields = {k.strip(" \t"): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines if ":" in x)}
                    rows.append((file, a, fields.get("WARC-Type"), fields, data[sizes[0] : sum(sizes)], recovered))
                    held += len(data)
                    a = behind
                    if held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([list(r[i].items()) if i == 3 else r[i] for r in rows], k) for i, k in enumerate(kinds)], names=RECORD.names)


def damages(spark: SparkSession, folder: str, *, range_bytes: int = RANGE) -> DataFrame:
    """(file, offset, bytes_lost): the stretches of the folder's files that belong to no record of the chain; empty for sound files."""
    parts = written(ranges(spark, folder, range_bytes), "ranges")
    return _damages(entries(parts, range_bytes))


def _damages(found: DataFrame) -> DataFrame:
    return found.where("broken").select("file", F.col("a").alias("offset"), (F.col("b") - F.col("a")).alias("bytes_lost"))


def read_records(spark: SparkSession, folder: str, *, range_bytes: int = RANGE, damage: str = "fail") -> DataFrame:
    """(file, offset, type, headers, block, recovered): the records of all .warc and .warc.gz files (a gzip member a record) in a folder.

    Defined cases: a record is returned if the chain of record lengths from the start of its file reaches it; headers and
    payloads may have any length; empty files are fine; any version number is read; repeated header names keep the last, folded
    header lines are joined. Where the chain breaks (a damaged header, stray bytes, a length beyond the end of the file) the
    call fails and names the places, unless `damage` is "skip": then reading goes on at the next place where a record can
    begin, records behind a damage have `recovered` true, as nothing vouches that they aren't part of a payload, and damages()
    lists what was passed over.
    """
    if damage not in ("fail", "skip"):
        raise ValueError("damage must be 'fail' or 'skip'")
    parts = written(ranges(spark, folder, range_bytes), "ranges")
    chain = entries(parts, range_bytes)
    lost = _damages(chain)
    if damage == "fail" and (n := lost.count()):
        places = "; ".join(f"{r.file} at {r.offset}: {r.bytes_lost} bytes" for r in lost.orderBy("file", "offset").limit(10).collect())
        raise ValueError(f"{n} damaged stretches, read with damage='skip' to pass over them: {places}")
    first = lost.groupBy("file").agg(F.min("offset").alias("damaged"))
    found = parts.join(chain.where("not broken").select("file", "part", F.col("a").alias("entry")), ["file", "part"]).join(first, "file", "left")
    spread = found.select("file", "length", "a", "b", "entry", F.coalesce(F.col("entry") > F.col("damaged"), F.lit(False)).alias("recovered"))
    return spread.repartition(spark.sparkContext.defaultParallelism * 4, "file", "a").mapInArrow(_records, RECORD)


def read_pages(
    spark: SparkSession, folder: str, *, range_bytes: int = RANGE, damage: str = "fail", id_type: str = "string", id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(id, url, html) of the response records, as write_pages wrote them; the cases of read_records hold.

    Other records are left out, a record without an HTTP header has its whole block as page. `id_type` is what identifiers are
    cast to; one that can't be is an error.
    """
    records = read_records(spark, folder, range_bytes=range_bytes, damage=damage).where("type = 'response'")
    at = F.expr("instr(decode(block, 'ISO-8859-1'), '\r\n\r\n')")
    body = F.when((F.col("headers")["Content-Type"].startswith("application/http")) & (at > 0), F.expr("substring(block, 1)").substr(at + 4, F.length("block"))).otherwise(F.col("block"))
    html = F.when(F.col("headers")["X-Null-Payload"].isNull(), F.decode(body, "UTF-8"))

    def plain(name: str):
        value = F.col("headers")[name]
        return F.when(F.col("headers")[f"X-Escaped-{name}"].isNotNull(), F.url_decode(value)).otherwise(value)

    return records.select(plain("X-Row-ID").cast(id_type).alias(id_col), plain("WARC-Target-URI").alias(url_col), html.alias(html_col))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `pages` written as WARC files into the shared folder and read back."""
    folder, pages = new_path(spark, "warc"), table(spark, sf_dir, "pages")
    write_pages(pages, folder)
    return read_pages(spark, folder, id_type=pages.schema["page_id"].dataType.simpleString())
