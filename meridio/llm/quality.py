"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, thresholded on perplexity.

The model is over words, unfolded as they stand between white space, with all words of all trusted text; its table grows with
that text. What it leaves to words never seen is spread by their spelling, under a Kneser-Ney model of characters
folded to 64 symbols (letters, one class for capitals, one for digits, punctuation, one symbol for a word that repeats the one
before it), whose n-grams of order five pack into 30 bits; that table alone is bounded by the alphabet. Tasks count locally, one
shuffle adds the counts. Continuation counts, discounts and interpolation weights are aggregates over the sharded tables.

To score, each task gathers the distinct words of a file split; they are shuffled to the shards of the word model,
joined there, and what was found goes to the shared folder, where the task that scores the split reads its own part. Characters'
shards are read whole. Neither the corpus nor its words pass through the driver or a broadcast.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._shared import free_name, local_path, new_path, remove, sized, written
from ._text import R, chunks, code_points, lookup, mix, spans, word_hashes

ORDER, BITS = 5, 6
PAD, SPACE, UPPER, DIGIT, REPEAT = 0, 1, 28, 29, 38
PIECE = 750_000  # characters handled at once in a task; a longer text is counted and scored in pieces of this size
#: Each language has a model for either half of the texts, trained on the trusted rows of the other half. Copies share a half.
HALVES = 2
#: Words are known by hashes of so many bits; the model has a shard for every SHARD_ROWS of them.
KEY_BITS, SHARD_ROWS = 56, 200_000
AGAIN = np.uint64(0xA6A12EA7)  # stands for a repeated word


def _symbols() -> np.ndarray:
    lut = np.empty(65536, np.uint8)
    fixed = {".": 30, ",": 31, "'": 32, "’": 32, "-": 33, '"': 34, "!": 36} | dict.fromkeys(":;?()", 35)
    accented = {c: 39 + i for i, c in enumerate("àáâäçèéêíîñóôöùúüß")}
    for cp in range(65536):
        c = chr(cp)
        if c in "\n\r":
            lut[cp] = PAD
        elif c.isspace():
            lut[cp] = SPACE
        elif "a" <= c <= "z":
            lut[cp] = 2 + cp - 97
        elif c in fixed or c in accented:
            lut[cp] = fixed.get(c) or accented[c]
        elif c.isupper():
            lut[cp] = UPPER
        elif c.isdigit():
            lut[cp] = DIGIT
        elif unicodedata.category(c)[0] in "LM":
            lut[cp] = 57 + cp % 7
        else:
            lut[cp] = 37
    return lut


_LUT: list[np.ndarray] = []


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all characters of all texts on end: the packed n-gram that ends there, and the number of each text's characters.

    A word equal to the word before it counts, with the space between them, as the one symbol REPEAT.
    """
    return _encode(texts)[:2]


def _read(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Symbols and lengths of all texts on end; starts and ends of words, whether each repeats the one before, a hash of it and its separator, its text.

    Words are told apart by the white space that ends them too, so that the probability of a word covers its separator. A word
    that is followed by its own repetition has none.
    """
    if not _LUT:
        _LUT.append(_symbols())
    flat, n = code_points(texts)
    begin = np.cumsum(n) - n
    sym = lookup(flat, _LUT[0], 63)
    starts, ends = spans(sym > SPACE, begin[n > 0])
    h = word_hashes(flat, starts, ends)
    doc = np.searchsorted(begin + n, starts, "right")
    again = np.zeros(len(starts), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    after = np.full(len(ends), 2, np.uint8)
    inside = ends < (begin + n)[doc]
    inside[:-1] &= ~again[1:]
    after[inside] = np.minimum(sym[ends[inside]], 2)
    return sym, n, starts, ends, again, after, mix(np.where(again, AGAIN, h) + R * (after + np.uint64(1))), doc


def _encode(texts: list[str]) -> tuple[np.ndarray, ...]:
    """What encode gives; the first symbol of each word, the one past it and its separator; a hash of the two; the word's text number."""
    sym, n, starts, ends, again, after, h, doc = _read(texts)
    begin = np.cumsum(n) - n
    if again.any():
        sym = sym.copy()
        s, e = starts[again], ends[again]
        sym[s] = REPEAT
        step = np.zeros(len(sym) + 2, np.int8)  # the space before the word goes too
        np.add.at(step, ends[:-1][again[1:]], 1)
        np.add.at(step, s, -1)
        np.add.at(step, s + 1, 1)
        np.add.at(step, e, -1)
        keep = np.cumsum(step[:-2], dtype=np.int8) == 0
        total = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
        n = total[begin + n] - total[begin]
        sym, begin = sym[keep], np.cumsum(n) - n
        starts, ends = total[starts], total[ends]
    ends = ends + (after <= SPACE)
    width = ORDER - 1
    padded = np.zeros(len(sym) + width * len(n), np.int32)
    at = np.arange(len(sym)) + np.repeat(width * np.arange(1, len(n) + 1), n)
    padded[at] = sym
    code = padded[at]
    for k in range(1, ORDER):
        code |= padded[at - k] << (BITS * k)
    return code.astype(np.int64), n, starts, ends, h, doc


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def _root(lang: str) -> int:
    """The key under which the model has what a language leaves to unseen words."""
    return int(mix(np.array([_salt(lang)]) + R)[0] >> np.uint64(64 - KEY_BITS))


def _pieces(texts: list[str]):
    """(index of text, piece of it), no piece longer than PIECE; words aren't cut if there is white space in reach."""
    for i, t in enumerate(texts):
        a = 0
        while len(t) - a > PIECE:
            e = a + PIECE
            e = next((j + 1 for j in range(e - 1, e - 10_000, -1) if t[j].isspace()), e)
            yield i, t[a:e]
            a = e
        yield i, t[a:] if a else t


def _chunks(lang: list, text: list):
    """Per chunk of a limited number of characters: its texts, the numbers of the rows they are of, the languages' names, each text's language's number and salt."""
    own = list(_pieces([x or "" for x in text]))
    for a, b in chunks([len(t) for _, t in own], PIECE):
        where = np.fromiter((i for i, _ in own[a:b]), np.int64, b - a)
        names = sorted({lang[i] or "" for i in where})
        number = {x: k for k, x in enumerate(names)}
        of = np.fromiter((number[lang[i] or ""] for i in where), np.int64, b - a)
        yield [t for _, t in own[a:b]], where, names, of, np.fromiter(map(_salt, names), np.uint64, len(names))


def _keys(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return (mix(h ^ salt) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _count(batches):
    total: dict[str, list] = {}

    def flush():
        for name, parts in total.items():
            code = np.concatenate([p[0] for p in parts])
            c = np.concatenate([p[1] for p in parts])
            u, inv = np.unique(code, return_inverse=True)
            yield pd.DataFrame({"lang": name, "code": u, "n": np.bincount(inv, c, len(u)).astype(np.int64)})
        total.clear()

    held = 0
    for batch in batches:
        for texts, _, names, of, _ in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            code, n, *_ = _encode(texts)
            u, c = np.unique(code | (np.repeat(of, n) << (BITS * ORDER)), return_counts=True)
            cut = np.searchsorted(u, np.arange(len(names) + 1) << (BITS * ORDER))
            for k, name in enumerate(names):
                total.setdefault(name, []).append((u[cut[k] : cut[k + 1]] & ((1 << BITS * ORDER) - 1), c[cut[k] : cut[k + 1]]))
            held += len(u)
            if held > 1_500_000:
                for x in flush():
                    yield pa.RecordBatch.from_pandas(x, preserve_index=False)
                held = 0
    for x in flush():
        yield pa.RecordBatch.from_pandas(x, preserve_index=False)


def ngram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, code, n): how often each n-gram of the highest order occurs in each language, over all rows."""
    part = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    return part.mapInArrow(_count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _count_words(batches):
    held: dict[str, list] = {}

    def flush():
        for name, parts in held.items():
            word, n = (np.concatenate(x) for x in zip(*parts))
            u, inv = np.unique(word, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(u), np.int64))), pa.array(u), pa.array(np.bincount(inv, n, len(u)).astype(np.int64))], names=["lang", "word", "n"])
        held.clear()

    size = 0
    for batch in batches:
        for texts, _, names, of, salt in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            *_, h, doc = _read(texts)
            key, own = _keys(h, salt[of[doc]]), of[doc]
            for k, name in enumerate(names):
                u, n = np.unique(key[own == k], return_counts=True)
                held.setdefault(name, []).append((u, n))
                size += len(u)
            if size > 1_000_000:
                yield from flush()
                size = 0
    yield from flush()


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, c): how often each word occurs in each language, over all rows."""
    part = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    rows = part.mapInArrow(_count_words, "lang string, word bigint, n bigint")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("c"))


def word_model(counts: DataFrame) -> DataFrame:
    """(key, v): the discounted probability of each word, and under the key of each language what it leaves to words never seen."""
    sizes = _discounts(counts.withColumn("ord", F.lit(1))).drop("ord")
    sizes = sizes.join(counts.groupBy("lang").agg(F.sum("c").alias("all")), "lang")  # a row a language
    rows = counts.join(F.broadcast(sizes), "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    named = F.udf(lambda x: _root(x), "bigint")
    root = rows.groupBy("lang").agg((F.sum("d") / F.sum("c")).alias("v")).select(named("lang").alias("key"), "v")
    return rows.select(F.col("word").alias("key"), ((F.col("c") - F.col("d")) / F.col("all")).alias("v")).unionByName(root)


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, ord, d1, d2, d3) from the counts of counts; one row a language and order."""
    n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int, default: float):
        d = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        ok = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0)
        return F.when(ok, F.least(F.greatest(F.when(ok, d), F.lit(0.05)), F.lit(float(i)))).otherwise(default)

    return grams.groupBy("lang", "ord").agg(*n).select("lang", "ord", discount(1, 0.5).alias("d1"), discount(2, 1.0).alias("d2"), discount(3, 1.5).alias("d3"))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences in as few bytes as the largest needs."""
    step = np.diff(keys, prepend=0)
    width = max(1, (int(step[1:].max(initial=0)).bit_length() + 7) // 8)
    return step[:1].tobytes() + bytes([width]) + step[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    width = b[8]
    step = np.zeros(((len(b) - 9) // width + 1, 8), np.uint8)
    step[0] = np.frombuffer(b, np.uint8, 8)
    step[1:, :width] = np.frombuffer(b, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(step.view(np.int64).ravel())


def _asked(bits: int):
    """Of each split the distinct keys of its words and languages, a row for each shard."""

    def rows(split: int, parts: list):
        u = np.unique(np.concatenate(parts))
        cut = np.searchsorted(u, np.arange((1 << bits) + 1, dtype=np.int64) << (KEY_BITS - bits))
        return [(int(shard), split, _packed(u[cut[shard] : cut[shard + 1]])) for shard in np.flatnonzero(np.diff(cut))]

    def pack(held):
        for split, parts in held.items():
            out = rows(split, parts)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["shard", "split", "keys"])

    def run(batches):
        held: dict[int, list] = {}
        total = 0
        for batch in batches:
            langs, texts, splits = (batch.column(i).to_pylist() for i in range(3))
            for split in set(splits):
                at = [i for i, x in enumerate(splits) if x == split]
                for own, _, names, of, salt in _chunks([langs[i] for i in at], [texts[i] for i in at]):
                    *_, h, doc = _read(own)
                    u = np.unique(np.concatenate([_keys(h, salt[of[doc]]), np.array([_root(x) for x in names], np.int64)]))
                    held.setdefault(split, []).append(u)
                    total += len(u)
            if total > 1_000_000:
                yield from pack(held)
                held, total = {}, 0
        yield from pack(held)

    return run


def _found(asked: pa.Table, model: pa.Table) -> pa.Table:
    key = model.column("key").to_numpy()
    by = np.argsort(key)
    key, v = key[by], model.column("v").to_numpy()[by].astype(np.float32)
    out = []
    for split, packed in zip(asked.column("split").to_pylist(), asked.column("keys").to_pylist()) if len(key) else ():
        want = _unpacked(packed)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want
        if hit.any():
            out.append((split, _packed(want[hit]), v[at[hit]].tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 3, (pa.int64(), pa.binary(), pa.binary()))], names=["split", "keys", "found"])


def look_up(docs: DataFrame, model: DataFrame, rows: int, uri: str, lang: str, text: str, split: str) -> None:
    """Write, by split, what the word model has for the words of the texts; neither side is broadcast."""
    bits = min(20, max(2, (rows // SHARD_ROWS).bit_length()))
    asked = docs.select(lang, text, split).where(F.length(text) > 0).mapInArrow(_asked(bits), "shard int, split bigint, keys binary")
    sharded = model.select("key", F.col("v").cast("float").alias("v")).withColumn("shard", F.shiftright("key", KEY_BITS - bits).cast("int"))
    found = asked.groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(_found, "split bigint, keys binary, found binary")
    # small row groups sorted by split, of which a reader skips all but its own
    found.sortWithinPartitions("split").write.option("parquet.block.size", 1 << 20).parquet(uri)


class Words:
    """What the word model has for one split, sorted by key, read from the shared folder."""

    def __init__(self, uri: str, split: int):
        import pyarrow.dataset as ds

        filesystem, path = local_path(uri)
        t = ds.dataset(path, filesystem=filesystem, format="parquet", schema=pa.schema([("split", pa.int64()), *((c, pa.binary()) for c in ("keys", "found"))])).to_table(filter=ds.field("split") == split)
        key = np.concatenate([np.empty(0, np.int64), *(_unpacked(b) for b in t.column("keys").to_pylist())])
        v = np.frombuffer(b"".join(t.column("found").to_pylist()), np.float32)
        by = np.argsort(key)
        self.key, self.v = key[by], v[by]

    def _get(self, key: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), missing)
        u, inv = np.unique(key, return_inverse=True)  # sorted keys are searched much faster
        at = np.minimum(np.searchsorted(self.key, u), len(self.key) - 1)
        return np.where(self.key[at] == u, self.v[at], missing)[inv]

    def logp(self, word: np.ndarray, root: int, spelling: np.ndarray) -> np.ndarray:
        """Natural logarithm of the interpolated probability of each word, given that of its spelling."""
        p = self._get(word, 0.0) + self._get(np.array([root]), 1.0) * np.exp(spelling)
        return np.where(p > 1e-300, np.log(np.maximum(p, 1e-300)), spelling)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, ord, kind, code, v): kind 0 has the discounted probability of each seen n-gram, kind 1 each history's weight of the lower order.

    The highest order uses counts; each lower one the number of distinct symbols seen before the n-gram. The three discounts
    D1, D2, D3+ come from the counts of counts of each order and language (Chen and Goodman); where those are too thin for the
    estimate, 0.5, 1 and 1.5 stand in.
    """
    levels, level = [], counts.select("lang", "code", F.col("n").cast("bigint").alias("c"))
    for k in range(ORDER, 0, -1):
        levels.append(level.select("lang", F.lit(k).alias("ord"), "code", "c"))
        if k > 1:
            level = level.groupBy("lang", F.col("code").bitwiseAND((1 << BITS * (k - 1)) - 1).alias("code")).agg(F.count(F.lit(1)).alias("c"))
    grams = levels[0]
    for x in levels[1:]:
        grams = grams.unionByName(x)
    # one row a language and order: bounded by the number of languages
    sizes = _discounts(grams)
    history = Window.partitionBy("lang", "ord", "h")
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = (
        grams.join(F.broadcast(sizes), ["lang", "ord"])
        .withColumns({"h": F.shiftright("code", BITS), "d": d})
        .withColumns({"tot": F.sum("c").over(history), "back": F.sum("d").over(history), "first": F.row_number().over(history.orderBy("code")) == 1})
    )
    seen = F.struct(F.lit(0).alias("kind"), F.col("code").alias("code"), ((F.col("c") - F.col("d")) / F.col("tot")).alias("v"))
    rest = F.struct(F.lit(1).alias("kind"), F.col("h").alias("code"), (F.col("back") / F.col("tot")).alias("v"))
    both = F.when(F.col("first"), F.array(seen, rest)).otherwise(F.array(seen))
    return rows.select("lang", "ord", F.explode(both).alias("x")).select("lang", "ord", "x.kind", "x.code", "x.v")


class Shards:
    """One language's finished tables, sorted by code, read from the shared folder."""

    def __init__(self, uri: str, lang: str):
        import pyarrow.dataset as ds

        filesystem, path = local_path(uri)
        t = ds.dataset(path, filesystem=filesystem, format="parquet").to_table(columns=["ord", "kind", "code", "v"], filter=ds.field("lang") == lang)
        o, kind, code, v = (t.column(c).to_numpy() for c in ("ord", "kind", "code", "v"))
        self.at = {}
        for k in range(1, ORDER + 1):
            for j in (0, 1):
                m = (o == k) & (kind == j)
                by = np.argsort(code[m])
                self.at[k, j] = code[m][by].astype(np.int32), v[m][by].astype(np.float32)
        self.empty = not len(code)

    def _get(self, k: int, kind: int, code: np.ndarray, missing: float) -> np.ndarray:
        keys, v = self.at[k, kind]
        if not len(keys):
            return np.full(len(code), missing)
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        return np.where(keys[at] == code, v[at], missing)

    def logp(self, code: np.ndarray) -> np.ndarray:
        """Natural logarithm of the interpolated probability of each n-gram's last symbol."""
        p = np.full(len(code), 1.0 / (1 << BITS))
        for k in range(1, ORDER + 1):
            g = (code & ((1 << BITS * k) - 1)).astype(np.int32)
            p = self._get(k, 0, g, 0.0) + self._get(k, 1, g >> BITS, 1.0) * p
        return np.log(p)


_MODELS: dict[tuple[str, str], Shards] = {}
_WORDS: dict[tuple[str, int], Words] = {}


def _shards(uri: str, lang: str) -> Shards:
    if (uri, lang) not in _MODELS:
        while len(_MODELS) >= 8:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[uri, lang] = Shards(uri, lang)
    return _MODELS[uri, lang]


def _words(uri: str, split: int) -> Words:
    if (uri, split) not in _WORDS:
        _WORDS.clear()
        _WORDS[uri, split] = Words(uri, split)
    return _WORDS[uri, split]


def score(docs: DataFrame, uri: str, word_uri: str, lang: str, text: str, split: str, logp: str, chars: str) -> DataFrame:
    """The rows with the sum of log probabilities of their symbols (null without a model of the language) and the number of symbols."""
    schema = T.StructType([*docs.schema.fields, T.StructField(logp, T.DoubleType()), T.StructField(chars, T.LongType())])
    li, ti, si = (docs.columns.index(c) for c in (lang, text, split))

    def run(batches):
        for batch in batches:
            langs, texts, splits = (batch.column(i).to_pylist() for i in (li, ti, si))
            total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for s in dict.fromkeys(splits):
                rows = np.fromiter((i for i, x in enumerate(splits) if x == s), np.int64)
                for own, where, names, of, salt in _chunks([langs[i] for i in rows], [texts[i] for i in rows]):
                    code, size, starts, ends, h, doc = _encode(own)
                    code |= np.repeat(of, size) << (BITS * ORDER)
                    u, inv = np.unique(code, return_inverse=True)
                    lp = np.zeros(len(u))
                    cut = np.searchsorted(u, np.arange(len(names) + 1) << (BITS * ORDER))
                    for k, name in enumerate(names):
                        part = slice(cut[k], cut[k + 1])
                        model = _shards(uri, name)
                        lp[part] = np.nan if model.empty else model.logp(u[part] & ((1 << BITS * ORDER) - 1))
                    lp = lp[inv]
                    # the symbols of a word count by the word model, all others for themselves
                    sums = np.concatenate(([0.0], np.cumsum(np.nan_to_num(lp))))
                    spelling = sums[ends] - sums[starts]
                    mine, key, lang_of = np.zeros(len(starts)), _keys(h, salt[of[doc]]), of[doc]
                    for k, name in enumerate(names):
                        m = lang_of == k
                        if m.any():
                            mine[m] = _words(word_uri, s).logp(key[m], _root(name), spelling[m])
                    row_of = rows[where]
                    total += np.bincount(np.repeat(row_of, size), lp, len(texts)) + np.bincount(row_of[doc], mine - spelling, len(texts))
                    n += np.bincount(row_of, size, len(texts)).astype(np.int64)
            known = ~np.isnan(total) & (n > 0)
            columns = [*batch.columns, pa.array(np.where(known, total, 0.0), pa.float64(), mask=~known), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        _WORDS.clear()

    return docs.mapInArrow(run, schema)


def quality_scores(
    docs: DataFrame, trusted_ids: DataFrame, *, low: float = 0.0, high: float = 0.998, prior_chars: float = 40.0,
    id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """The rows with `perplexity` and `kept`: whether the perplexity lies within language-specific quantiles of trusted text.

    trusted_ids has the ids of trusted rows in its column `id_col`. Every text, trusted or not, is scored by the model trained on
    the trusted rows of the other half of texts (by a hash of the text), so that at every size the quantiles cover all trusted
    rows and no row is judged by a model that has seen it. A document of n symbols has perplexity
    exp(-(sum of log p + prior_chars * m) / (n + prior_chars)), m being the language's mean log p a symbol over the
    trusted rows, which keeps very short texts near their language's centre.

    Defined cases: null and empty texts are not kept and have perplexity null; a null language counts as the language "";
    documents of a language without trusted text in the other half are kept with perplexity null, for nothing speaks against them; repeated rows
    are judged one by one and count as often as they occur; null ids are never trusted; an empty table gives an empty one.
    `carry` names the columns to return (all by default); new columns that clash with them have underscores appended.
    """
    carry = docs.columns if carry is None else carry
    names = ("sum_logp", "n_symbols", "trusted", "perplexity", "kept", "trusted_id", "split", "model", "mean_logp", "quantiles")
    lp, n, tr, ppl, kept, tid, split, name, centre, quantiles = (free_name(docs, x) for x in names)
    ids = trusted_ids.select(F.col(id_col).alias(tid)).where(F.col(tid).isNotNull()).distinct()
    # 8 bytes an id: broadcast if there are few enough, else shuffled
    # the split of a row is the same whenever its file is read; rows that come from no file are one split
    block = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    try:
        docs = docs.withColumn(split, block)
    except AnalysisException:  # more than one source
        docs = written(docs, "documents").withColumn(split, block)
    marked = docs.join(sized(ids), F.col(id_col) == F.col(tid), "left")
    half = F.pmod(F.xxhash64(F.col(text_col)), F.lit(HALVES))
    named = lambda h: F.concat_ws("\x1f", F.coalesce(F.col(lang_col), F.lit("")), h.cast("string"))
    marked = marked.withColumns({tr: F.col(tid).isNotNull(), name: named(half)}).drop(tid)
    training = marked.where(F.col(tr)).withColumn(name, named(HALVES - 1 - half))
    uri = new_path(docs.sparkSession, "kneser-ney")
    counts = written(ngram_counts(training, name, text_col), "ngrams")
    model = kneser_ney(counts).repartition("lang", F.shiftright("code", 12)).sortWithinPartitions("lang", "ord", "kind", "code")
    model.write.parquet(uri)
    words = written(word_counts(training, name, text_col), "words")
    word_uri = new_path(docs.sparkSession, "looked-up")
    look_up(marked, word_model(words), words.count(), word_uri, name, text_col, split)
    remove(docs.sparkSession, words, counts)
    scored = score(marked, uri, word_uri, name, text_col, split, lp, n)
    scored = written(scored.select(*carry, F.coalesce(F.col(lang_col), F.lit("")).alias(tid), tr, lp, n), "scored")
    remove(docs.sparkSession, uri, word_uri)
    # a row a language from here on: bounded by the number of languages, so broadcast
    known = scored.where(F.col(lp).isNotNull() & F.col(tr))
    mean = known.groupBy(tid).agg((F.sum(lp) / F.sum(n)).alias(centre))

    def perplexity():
        return F.exp(-(F.col(lp) + prior_chars * F.col(centre)) / (F.col(n) + prior_chars))

    bounds = known.join(F.broadcast(mean), tid).groupBy(tid).agg(
        F.percentile_approx(perplexity(), F.array(F.lit(low), F.lit(high)), 10_000).alias(quantiles), F.first(centre).alias(centre)
    )
    p = scored.join(F.broadcast(bounds), tid, "left").withColumn(ppl, F.when(F.col(lp).isNotNull(), perplexity()))
    inside = (F.col(ppl) <= F.col(quantiles)[1]) & ((F.col(ppl) >= F.col(quantiles)[0]) if low > 0 else F.lit(True))
    return p.withColumn(kept, F.when(F.col(n) == 0, False).otherwise(F.coalesce(inside, F.lit(True)))).select(*carry, ppl, kept)


def quality_filter(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The documents that quality_scores keeps, with the columns they came with; its options and defined cases hold."""
    scores = quality_scores(docs, trusted_ids, **options)
    return scores.where(F.col(scores.columns[-1])).select(*scores.columns[:-2])
