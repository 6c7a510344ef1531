"""Near-duplicate removal: MinHash bands propose, sequential Bayesian verification prunes, exact Jaccard decides.

1. One pass hashes each text's words, takes the set of adjacent word pairs as shingles and computes its MinHash signature and
   the hashes of its bands. It is written once; texts with the same words share one node from here on.
2. Nodes that share a band form a bucket. A task pairs the nodes of each bucket that it holds with their smallest one, the hub,
   and only hubs are shuffled, whose smallest is paired with the others; so a group of thousands gives as many pairs as it has
   nodes, and no bucket is gathered. Signatures are compared batch by batch; after each batch a pair is dropped once the
   posterior probability that its similarity reaches the threshold falls below the miss probability.
3. Survivors are verified exactly on their shingle sets: first one near-certain pair a node, then those of the others whose ends
   the verified pairs don't connect already.
4. Buckets whose members aren't all connected by verified pairs are looked at again: all pairs between members of different
   components are compared, and the survivors verified. So no pair that shares a band is left out but those within a component,
   whichever pairs of the steps before have failed. Members of a bucket's largest component are compared with the others only,
   and all are split into blocks, so that no task holds a bucket.
5. Components of all verified pairs are the classes. Links are counted within classes by exact similarity, in blocks.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ._shared import free_name, remove, sized, written
from ._text import R, chunks, code_points, mix, spans, word_hashes

BANDS, ROWS, STEP = 40, 4, 32  # a pair at similarity 0.6 shares a band with probability 0.996
HASHES = BANDS * ROWS
BLOCK = 512  # nodes of a bucket, or texts of a class, that a task compares with each other or with another block
SPOKES = 2000  # pairs of a hub that one task verifies
PIECE = 750_000

_LUT: list[np.ndarray] = []


def _word_class() -> np.ndarray:
    """1 for characters of words, 2 for those that are words by themselves (scripts without spaces)."""
    if not _LUT:
        lut = np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(65536)), np.uint8, 65536)
        lut[(np.arange(65536) >= 0x3040) & (np.arange(65536) < 0xA000) & (lut == 1)] = 2
        _LUT.append(lut)
    return _LUT[0]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' lower-case words on end, and the number of words of each text."""
    flat, n = code_points([t.lower() for t in texts])
    begin = np.cumsum(n) - n
    lut = _word_class()
    kind = np.where(flat < 65536, lut[np.minimum(flat, 65535)], 2)
    own = np.flatnonzero(kind == 2)
    breaks = np.concatenate((begin[n > 0], own, own[own + 1 < len(flat)] + 1)) if len(own) else begin[n > 0]
    starts, ends = spans(kind > 0, breaks)
    return word_hashes(flat, starts, ends), np.bincount(np.searchsorted(begin, starts, "right") - 1, minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)


def shingles(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' adjacent word pairs on end (of the word, where it is the only one), and the number of each text's."""
    if not len(h):
        return h, n
    pair = np.empty(len(h), np.uint64)
    pair[:-1] = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    pair[-1] = 0
    last = np.cumsum(n)[n > 0] - 1
    lone = (np.cumsum(n) - n)[n == 1]
    pair[lone] = mix(h[lone])
    keep = np.ones(len(h), bool)
    keep[last] = False
    keep[lone] = True
    return pair[keep], np.where(n > 1, n - 1, n)


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240611))
    return rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def signatures(sh: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The MinHash signature of each text that has shingles, a row each."""
    a, b = _permutations()
    x = (sh >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(n) - n)[n > 0]
    sig = np.empty((HASHES, len(starts)), np.uint32)
    t = np.empty_like(x)
    for j in range(HASHES):
        np.multiply(x, a[j], out=t)
        t += b[j]
        t ^= t >> np.uint32(15)
        sig[j] = np.minimum.reduceat(t, starts)
    return np.ascontiguousarray(sig.T)


def content_hash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each text's sequence of words."""
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)
    return mix(np.add.reduceat(mix(h + mix(place + np.uint64(77))), (np.cumsum(n) - n)[n > 0]) + n[n > 0].astype(np.uint64)).view(np.int64)


def _features(batches, at: int, names: list[str]):
    for batch in batches:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        m = len(texts)
        node, sig = np.zeros(m, np.int64), np.zeros((m, HASHES), np.uint16)
        known = np.zeros(m, bool)
        for i, j in chunks([len(t) for t in texts], PIECE):
            h, n = words(texts[i:j])
            if not len(h):
                continue
            has = i + np.flatnonzero(n > 0)
            known[has] = True
            node[has] = content_hash(h, n)
            sig[has] = signatures(*shingles(h, n)).astype(np.uint16)
        rows = np.flatnonzero(known)
        width = HASHES * 2
        offsets = np.zeros(m + 1, np.int32)
        offsets[1:] = np.cumsum(known * width)
        binary = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets), pa.py_buffer(sig[rows].tobytes())])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, mask=~known), binary], names=names)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """The hash of each band of each signature, a row each; bands have their own hashes."""
    acc = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        acc = mix(acc * R + sig[:, r::ROWS])
    return acc.view(np.int64)


def _stars(band: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by band and node: which are the first of their band, and the place of each entry's first."""
    first = np.concatenate(([True], band[1:] != band[:-1])) if len(band) else np.empty(0, bool)
    return first, np.flatnonzero(first)[np.cumsum(first) - 1] if len(band) else np.empty(0, np.int64)


def _local_stars(batches):
    """Of each task's nodes: (band, hub, n) for members behind the hub, and (band, hub, null) for hubs."""
    names = ["band", "a", "b"]
    for batch in batches:
        for i in range(0, batch.num_rows, 16_384):
            part = batch.slice(i, 16_384)
            band = band_hashes(_matrix(part.column(1))).ravel()
            n = np.repeat(part.column(0).to_numpy(), BANDS)
            by = np.lexsort((n, band))
            band, n = band[by], n[by]
            first, at = _stars(band, n)
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(n[at]), pa.array(n, mask=first)], names=names)


def _hub_stars(batches):
    """Of hubs sorted by band and node: (band, hub, other hub)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        band, n = (batch.column(i).to_numpy() for i in (0, 1))
        if held is not None:
            band, n = np.concatenate((held[0], band)), np.concatenate((held[1], n))
        first, at = _stars(band, n)
        last = at[-1]
        held = band[last : last + 1].copy(), n[last : last + 1].copy()
        rest = ~first & (n != n[at])
        if rest.any():
            yield pa.RecordBatch.from_arrays([pa.array(band[rest]), pa.array(n[at][rest]), pa.array(n[rest])], names=["band", "a", "b"])


@cache
def bounds(threshold: float, miss: float) -> tuple[tuple[int, ...], int]:
    """After 32, 64, ... compared hashes the fewest that must agree, and how many of all make a pair near certain.

    With a uniform prior the posterior after m of n agreements is Beta(m + 1, n - m + 1), and the chance that the similarity
    reaches the threshold is the binomial tail P(X <= m), X of n + 1 trials.
    """

    def reach(m: int, n: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    least = tuple(next(m for m in range(n + 1) if reach(m, n) >= miss) for n in range(STEP, HASHES + 1, STEP))
    return least, next((m for m in range(HASHES + 1) if reach(m, HASHES) >= 1 - miss), HASHES)


def compare(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows of a and b can't be ruled out, and their agreeing hashes; a pair that is ruled out isn't compared further."""
    alive, agree = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        agree = agree + (a[alive, part] == b[alive, part]).sum(1)
        ok = agree >= m
        if not ok.all():
            alive, agree = alive[ok], agree[ok]
        if not len(alive):
            break
    return alive, agree


def by_group(batches, keys: int):
    """Whole groups of rows with equal values in the first `keys` columns, of input sorted by them; lists of groups as tables with bounds."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        for c in range(keys):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(new)
        if len(at):
            yield t.slice(0, at[-1]), np.concatenate(([0], at))
            t = t.slice(at[-1])
        held = t.combine_chunks()
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _matrix(column) -> np.ndarray:
    """Signatures of a binary column, a row each."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    first = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset] if len(flat) else 0
    return np.frombuffer(flat.buffers()[2], np.uint16, len(flat) * HASHES, first).reshape(-1, HASHES) if len(flat) else np.empty((0, HASHES), np.uint16)


def _screened(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b, sure): those of the pairs (a, b) that sequential verification doesn't rule out; sure ones are almost certainly similar."""
    least, sure = bounds(threshold, miss)

    def run(batches):
        for batch in batches:
            alive, agree = compare(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
            at = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(agree >= sure)], names=["a", "b", "sure"])

    hubs = sigs.join(sized(pairs.select(F.col("a").alias("n")).distinct()), "n", "left_semi").select(F.col("n").alias("a"), F.col("sig").alias("sa"))
    rows = pairs.join(sigs.select(F.col("n").alias("b"), F.col("sig").alias("sb")), "b").join(sized(hubs, limit=5_000), "a")
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, sure boolean")


def _across(threshold: float, miss: float):
    """Pairs of members of different components of each (bucket, i, j): between blocks i and j, or within the block where they are one."""
    least, _ = bounds(threshold, miss)

    def run(batches):
        for t, cut in by_group(batches, 3):
            n, comp, block, i, j = (t.column(c).to_numpy() for c in (3, 4, 5, 1, 2))
            sig = _matrix(t.column(6))
            out = [[], []]
            for a, b in zip(cut[:-1], cut[1:]):
                first = a + np.flatnonzero(block[a:b] == i[a])
                second = a + np.flatnonzero(block[a:b] != i[a])
                for k, x in enumerate(first):
                    y = second if i[a] != j[a] else first[k + 1 :]
                    y = y[comp[y] != comp[x]]
                    alive, _ = compare(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], least)
                    out[0].append(np.full(len(alive), n[x]))
                    out[1].append(n[y[alive]])
            if out[0]:
                x, y = np.concatenate(out[0]), np.concatenate(out[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _mixed_pairs(buckets: DataFrame, nodes: DataFrame, label: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b): pairs that share a band, are in different components and survive; buckets has (band, a, b), hubs and members."""
    a, b = (label.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    labelled = buckets.join(sized(a), "a", "left").join(sized(b), "b", "left")
    split = labelled.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("band").distinct()
    own = buckets.join(sized(written(split, "split")), "band", "left_semi")
    own = own.select("band", F.explode(F.array("a", "b")).alias("n")).distinct()
    rows = own.join(sized(label), own.n == F.col("id"), "left").select("band", "n", F.coalesce("component", "n").alias("comp"))
    sizes = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"))
    # of two members the one pair is the hub's, which has been looked at
    mixed = sizes.groupBy("band").agg(F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("big"), F.count(F.lit(1)).alias("comps")).where("comps > 1 and all > 2")
    mixed = mixed.select("band", F.col("big.comp").alias("big"), F.ceil((F.col("all") - F.col("big.k")) / BLOCK).alias("few"), F.ceil(F.col("big.k") / BLOCK).alias("many"))
    rows = rows.join(sized(written(mixed, "mixed")), "band")
    minor = F.col("comp") != F.col("big")
    h = F.xxhash64("n", "band")
    rows = rows.withColumn("block", F.when(minor, F.pmod(h, "few")).otherwise(F.col("few") + F.pmod(h, "many")))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(minor, F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))))
    rows = rows.select("band", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "n", "comp", "block")
    sigs = nodes.select("n", "sig").join(sized(written(own.select("n").distinct(), "mixed-nodes")), "n", "left_semi")
    rows = rows.join(sigs, "n").select("band", "i", "j", "n", "comp", "block", "sig")
    rows = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "n")
    return rows.mapInArrow(_across(threshold, miss), "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, feat: DataFrame, row: str, text: str, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have a Jaccard similarity of at least the threshold.

    A hub's pairs are spread over as many tasks as they need, each of which gets the hub's text once.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).alias("parts"))
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), nodes, feat, row, text)
    none = F.lit(None).cast("bigint")
    hubs = texts.join(sized(parts), F.col("n") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), none.alias("b"), "t")
    spokes = pairs.select("a", "b").join(sized(parts), "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    rows = hubs.unionAll(texts.withColumnRenamed("n", "b").join(sized(spokes), "b").select("a", "part", "b", "t"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        hub = None
        for batch in batches:
            b, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            a = batch.column(0).to_pylist()
            out = [[], []]
            for i, j in chunks([len(t) for t in texts], PIECE):
                sh, n = shingles(*words(texts[i:j]))
                at = np.concatenate(([0], np.cumsum(n)))
                for k in range(j - i):
                    own = np.unique(sh[at[k] : at[k + 1]])
                    if b[i + k] is None:
                        hub = own
                        continue
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    if both >= threshold * (len(hub) + len(own) - both):
                        out[0].append(a[i + k])
                        out[1].append(b[i + k])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _texts(ends: DataFrame, nodes: DataFrame, feat: DataFrame, row: str, text: str) -> DataFrame:
    """(n, t): one text of each of the nodes."""
    need = nodes.select("n", "r").join(sized(ends), "n", "left_semi")
    return feat.select(F.col(row).alias("r"), F.col(text).alias("t")).join(sized(need), "r").select("n", "t")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends aren't in one component."""
    a, b = (label.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    joined = pairs.join(sized(a), "a", "left").join(sized(b), "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def classes(feat: DataFrame, row: str, node: str, sig: str, text: str, threshold: float, miss: float) -> tuple[DataFrame, DataFrame]:
    """The nodes (n, r, sig), r being a row of each, and (id, component) of those that are linked to another."""
    spark = feat.sparkSession
    nodes = feat.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("n")).agg(F.min(row).alias("r"), F.first(sig).alias("sig"))
    nodes = written(nodes, "nodes")
    stars = nodes.select("n", "sig").mapInArrow(_local_stars, "band bigint, a bigint, b bigint")
    # a band has at most as many hubs as there are tasks and batches
    hubs = stars.where("b is null").select("band", "a").repartition("band").sortWithinPartitions("band", "a")
    buckets = written(hubs.mapInArrow(_hub_stars, "band bigint, a bigint, b bigint").unionAll(stars.where("b is not null")), "buckets")
    star = buckets.groupBy("a", "b").agg(F.count(F.lit(1))).select("a", "b")
    star = written(_screened(written(star, "stars"), nodes.select("n", "sig"), threshold, miss), "screened")
    one = written(star.where("sure").groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "chosen")
    sure = written(verified(one, nodes, feat, row, text, threshold), "verified")
    label = written(connected_components(sure, "a", "b"), "labels")
    rest = written(_apart(star.join(one, ["a", "b"], "left_anti"), label), "rest")
    edges = [sure]
    if not rest.isEmpty():
        edges.append(written(verified(rest, nodes, feat, row, text, threshold), "verified"))
        if not edges[-1].isEmpty():
            label = written(connected_components(edges[0].unionAll(edges[1]), "a", "b"), "labels")
    more = _mixed_pairs(buckets, nodes, label, threshold, miss).join(star.select("a", "b"), ["a", "b"], "left_anti")
    more = written(more, "mixed-pairs")
    if not more.isEmpty():
        edges.append(written(verified(more, nodes, feat, row, text, threshold), "verified"))
        if not edges[-1].isEmpty():
            links = edges[0]
            for x in edges[1:]:
                links = links.unionAll(x)
            label = written(connected_components(links, "a", "b"), "labels")
    remove(spark, buckets, star, one, rest, more, *edges)
    return nodes, label


def _assigned(docs: DataFrame, id_col: str, text_col: str, threshold: float, miss: float):
    """The written features and nodes, the labels, and (row, id, n, group) of each row; group is null where a text has no words."""
    row, node, sig = (free_name(docs, x) for x in ("row", "node", "sig"))
    start = docs.withColumn(row, F.monotonically_increasing_id())
    schema = T.StructType([*start.schema.fields, T.StructField(node, T.LongType()), T.StructField(sig, T.BinaryType())])
    at = docs.columns.index(text_col)
    feat = written(start.mapInArrow(lambda b: _features(b, at, schema.names), schema), "features")
    nodes, label = classes(feat, row, node, sig, text_col, threshold, miss)
    rows = feat.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(node).alias("n"))
    rows = rows.join(sized(label.select(F.col("id").alias("n"), "component")), "n", "left")
    return feat, row, nodes, label, rows.select("row", "id", "n", F.coalesce("component", "n").alias("group"))


def _links(threshold: float):
    """How many of the other texts of a class each text is linked to, by (class, i, j)."""

    def run(batches):
        for t, cut in by_group(batches, 3):
            n, block, i, j = (t.column(c).to_numpy() for c in (3, 4, 1, 2))
            texts = t.column(5).to_pylist()
            out = [[], []]
            for a, b in zip(cut[:-1], cut[1:]):
                sh, size = shingles(*words(texts[a:b]))
                doc = np.repeat(np.arange(b - a), size)
                by = np.lexsort((doc, sh))
                sh, doc = sh[by], doc[by]
                new = np.concatenate(([True], (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])))  # a shingle counts once a text
                sh, doc = sh[new], doc[new]
                size = np.bincount(doc, minlength=b - a)
                word = np.cumsum(np.concatenate(([False], sh[1:] != sh[:-1])))
                often = np.bincount(word)[word] > 1
                doc, word = doc[often], word[often]
                word = np.cumsum(np.concatenate(([False], word[1:] != word[:-1]))) if len(word) else word
                both = np.zeros((b - a, b - a))
                for first in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
                    part = slice(*np.searchsorted(word, (first, first + 4096)))
                    m = np.zeros((b - a, 4096), np.float32)
                    m[doc[part], word[part] - first] = 1
                    both += m @ m.T
                near = both >= threshold * (size[:, None] + size[None, :] - both)
                np.fill_diagonal(near, False)
                mine = block[a:b] == i[a]
                if i[a] != j[a]:  # only between the two blocks
                    near &= mine[:, None] != mine[None, :]
                out[0].append(n[a:b])
                out[1].append(near.sum(1))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["n", "links"])

    return run


def near_duplicate_classes(docs: DataFrame, *, threshold: float = 0.6, miss: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(identifier, class_id, n_links): a row for each row of the table that has a near-duplicate or copy; others have no class.

    Rows whose sets of adjacent lower-case word pairs have a Jaccard similarity of at least `threshold` are linked, classes are
    the connected components and named by their smallest identifier. n_links is the number of different other texts that a
    row's text is linked to; copies, which have the same words in the same order, aren't counted. A text of one word has that
    word as its only shingle. `miss` bounds the posterior probability of a pair that signatures rule out.

    Counting links costs the square of a class's different texts, in blocks spread over tasks; near_duplicate_groups and
    drop_near_duplicates don't need it.

    Defined cases: null, empty and other texts without words are never near-duplicates; a null identifier counts as the
    largest; repeated rows are members of one class; an empty table gives an empty one; texts of any length are used whole;
    extra columns don't matter here and pass through drop_near_duplicates.
    """
    feat, row, nodes, label, rows = _assigned(docs.select(id_col, text_col), id_col, text_col, threshold, miss)
    size = label.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    members = label.join(sized(size), "component").select("component", F.col("id").alias("n"), F.pmod(F.xxhash64("id"), "parts").alias("block"), "parts")
    texts = _texts(label.select(F.col("id").alias("n")), nodes, feat, row, text_col)
    members = texts.join(sized(written(members, "members")), "n").withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    members = members.select("component", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "n", "block", "t")
    members = members.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "n")
    links = written(members.mapInArrow(_links(threshold), "n bigint, links bigint").groupBy("n").agg(F.sum("links").alias("links")), "links")
    best = F.min(F.struct(F.col("id").isNull(), "id"))
    groups = rows.where("group is not null").groupBy("group").agg(best.alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1").select("group", "x.id", "k")
    found = rows.select("id", "n", "group").join(sized(groups.select("group", F.col("id").alias("class_id"))), "group").join(sized(links), "n", "left")
    found = written(found.select(F.col("id").alias(id_col), "class_id", F.coalesce("links", F.lit(0)).alias("n_links")), "classes")
    remove(docs.sparkSession, feat, nodes, label)
    return found


def near_duplicate_groups(docs: DataFrame, *, threshold: float = 0.6, miss: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(identifier, n_members): one row a class of near_duplicate_classes, and one for each row without a class; cases as there.

    The identifier is the smallest of the class; rows that tie on it leave one.
    """
    feat, _, nodes, label, rows = _assigned(docs.select(id_col, text_col), id_col, text_col, threshold, miss)
    best = F.min(F.struct(F.col("id").isNull(), "id"))
    groups = rows.where("group is not null").groupBy("group").agg(best.alias("x"), F.count(F.lit(1)).alias("n_members"))
    alone = rows.where("group is null").select(F.col("id").alias(id_col), F.lit(1).cast("bigint").alias("n_members"))
    found = written(groups.select(F.col("x.id").alias(id_col), "n_members").unionAll(alone), "groups")
    remove(docs.sparkSession, feat, nodes, label)
    return found


def drop_near_duplicates(docs: DataFrame, *, threshold: float = 0.6, miss: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without those that near_duplicate_groups counts behind a smaller identifier; columns as they came, cases as there."""
    feat, row, nodes, label, rows = _assigned(docs, id_col, text_col, threshold, miss)
    # by aggregation, not by a window, so that no task sorts a whole group
    best = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("x"), F.count(F.lit(1)).alias("k"))
    best = written(best.where("k > 1").select("group", F.col("x.row").alias("lead")), "leads")
    key = free_name(feat, "gone")
    gone = written(rows.join(sized(best), "group").where("row <> lead").select(F.col("row").alias(key)), "dropped")
    remove(docs.sparkSession, nodes, label, best)
    return feat.join(sized(gone), F.col(row) == F.col(key), "left_anti").select(*docs.columns)
