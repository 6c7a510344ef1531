"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's distinct words are laid out as one flat array of symbols. Each round finds every neighbouring pair's rank by binary
search over the sorted pair keys, takes the lowest rank of each word and merges it; words without a pair left drop out. A
merged pair can't create one of a lower rank except for a few tokens that the vocabulary itself reveals; for those only the
leftmost occurrence is merged in a round, so the ids are those of the sequential algorithm.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name
from ._text import chunks

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 24
NONE = np.int64(1) << 40
CACHE_WORDS = 200_000  # words whose ids a worker remembers; beyond that it starts afresh
PIECE = 1_500_000


class Vocabulary:
    """A file of base64 tokens and ranks, as sorted pair keys and as flat bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        pairs = [
            (self.ranks[t[:i]] << SHIFT | self.ranks[t[i:]], r)
            for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.merged = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        self.calm = np.ones(size + 1, bool)
        for part in (self.keys >> SHIFT, self.keys & ((1 << SHIFT) - 1)):
            self.calm[part[self.merged < part]] = False
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.length = np.fromiter(map(len, tokens), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and how many each word has."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), n)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = sym[:-1] << SHIFT | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NONE)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.merged[at[hit]]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            going = np.repeat(best < NONE, size)
            if not going.all():
                done.append((word[~going], sym[~going]))
                sym, word, rank = sym[going], word[going], rank[going]
                size, best = size[best < NONE], best[best < NONE]
                if not len(sym):
                    break
            take = np.flatnonzero(rank == np.repeat(best, size))
            wild = ~self.calm[rank[take]]
            if wild.any():  # only the leftmost in its word
                lead = np.concatenate(([True], word[take][1:] != word[take][:-1]))
                take = take[~wild | lead]
            run = np.flatnonzero(np.concatenate(([True], np.diff(take) != 1)))
            step = np.arange(len(take)) - np.repeat(run, np.diff(np.append(run, len(take))))
            take = take[step % 2 == 0]  # of overlapping occurrences every other one
            sym[take] = rank[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        w, s = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        by = np.argsort(w, kind="stable")
        return s[by].astype(np.int32), np.bincount(w, minlength=len(words))


class Auto(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def gather(flat: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[offset : offset + length] on end."""
    ends = np.cumsum(length)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offset - (ends - length), length)]


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        self.vocabulary, self.words = Vocabulary(path), regex.compile(pattern).findall
        self.clear()

    def clear(self):
        self.known, self.ids = Auto(), np.empty(0, np.int32)
        self.length, self.offset = np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each text has."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        number = self.known.__getitem__
        before = len(self.known)
        index = [np.array(list(map(number, self.words(t))), np.int64) for t in texts]
        if len(self.known) > before:
            ranks = self.vocabulary.ranks
            fresh = [w.encode("utf-8", "surrogatepass") for w in list(self.known)[before:]]
            whole = np.fromiter((ranks.get(w, -1) for w in fresh), np.int64, len(fresh))
            ids, n = self.vocabulary.merge([w if r < 0 else b"" for w, r in zip(fresh, whole)])
            single = np.flatnonzero(whole >= 0)
            n[single] = 1
            offset = np.cumsum(n) - n
            all_ids = np.empty(n.sum(), np.int32)
            mask = np.ones(len(all_ids), bool)
            mask[offset[single]] = False
            all_ids[offset[single]], all_ids[mask] = whole[single], ids
            self.offset = np.concatenate((self.offset, offset + len(self.ids)))
            self.length = np.concatenate((self.length, n))
            self.ids = np.concatenate((self.ids, all_ids))
        flat = np.concatenate(index) if index else np.empty(0, np.int64)
        length = self.length[flat]
        ends = np.concatenate(([0], np.cumsum(length)))
        cut = np.concatenate(([0], np.cumsum([len(i) for i in index]))).astype(np.int64)
        return gather(self.ids, self.offset[flat], length), np.diff(ends[cut])

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all token lists on end, and how many each list has."""
        v = self.vocabulary
        length = v.length[ids]
        ends = np.concatenate(([0], np.cumsum(length)))
        cut = np.concatenate(([0], np.cumsum(n)))
        return gather(v.flat, v.offset[ids], length), np.diff(ends[cut])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, *, vocab: str = VOCAB, text_col: str = "text", ids_col: str = "token_ids", check_col: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The rows with their text's token ids; `check_col` names a boolean column to add: whether decoding gives back the text's bytes.

    Defined cases: a null text has null ids and a null check, an empty text an empty list; texts and single words of any length
    are encoded whole; repeated rows each get their ids; extra columns pass through, and new columns that clash with them have
    underscores appended; an empty table gives an empty one. Special tokens in a text are ordinary text. `carry` names the columns
    to return besides the new ones.
    """
    carry = docs.columns if carry is None else carry
    ids_col = free_name(docs, ids_col)
    rows = docs.select(*carry, F.col(text_col).alias(free_name(docs, "encoded")))
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(free_name(docs, check_col), T.BooleanType())] if check_col else [])
    schema = T.StructType([*(docs.schema[c] for c in carry), *new])
    at = len(carry)

    def run(batches):
        coder = encoder(vocab)
        for batch in batches:
            column = batch.column(at)
            texts = column.to_pylist()
            null = np.fromiter((t is None for t in texts), bool, len(texts))
            texts = [t or "" for t in texts]
            parts, counts, same = [np.empty(0, np.int32)], [np.empty(0, np.int64)], []
            for i, j in chunks([len(t) for t in texts], PIECE):
                ids, n = coder.encode(texts[i:j])
                parts.append(ids)
                counts.append(n)
                if check_col:
                    flat, size = coder.decode(ids, n)
                    data = flat.tobytes()
                    ends = np.cumsum(size).tolist()
                    same.extend(data[e - s : e] == t.encode("utf-8", "surrogatepass") for e, s, t in zip(ends, size.tolist(), texts[i:j]))
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(np.concatenate(parts), pa.int32()))
            columns = [*batch.columns[:at], lists, *([pa.array(np.array(same, bool), mask=null)] if check_col else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, *, vocab: str = VOCAB, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their token ids in a new column (underscores appended if it clashes); null ids give a null text, an empty list an empty one.

    Bytes that are no valid UTF-8, as lists cut inside a character can have, become the replacement character; ids that the
    vocabulary lacks raise an error.
    """
    name = free_name(rows, text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    at = rows.columns.index(ids_col)

    def run(batches):
        coder = encoder(vocab)
        for batch in batches:
            lists = batch.column(at)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, size = coder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            data, ends = flat.tobytes(), np.cumsum(size).tolist()
            texts = [data[e - s : e].decode("utf-8", "replace") if ok else None for e, s, ok in zip(ends, size.tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
