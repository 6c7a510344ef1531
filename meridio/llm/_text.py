"""Vectorised text: code points, words and their hashes of many documents in flat numpy arrays."""

from __future__ import annotations

import sys

import numpy as np

R = np.uint64(0x9E3779B97F4A7C15)
RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if "r" not in _POWERS or len(_POWERS["r"]) < n:
        m = max(n, 1 << 16)
        for name, base in (("r", R), ("inv", RINV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["r"][:n], _POWERS["inv"][:n]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on end, and each text's length."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    return flat, np.fromiter(map(len, texts), np.int64, len(texts))


def lookup(flat: np.ndarray, lut: np.ndarray, beyond: int) -> np.ndarray:
    """lut[code point], or `beyond` for those past the table."""
    if flat.size and int(flat.max()) >= len(lut):
        return np.where(flat < len(lut), lut[np.minimum(flat, len(lut) - 1)], lut.dtype.type(beyond))
    return lut[flat]


def spans(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True; a run never crosses a position in `breaks`."""
    edge = np.empty(len(inside) + 1, bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[breaks] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = inside[starts]
    return starts[keep], ends[keep]


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, alike wherever the span stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    r, inv = powers(len(flat) + 1)
    c = np.empty(len(flat) + 1, np.uint64)
    c[0] = 0
    np.cumsum(mix(flat.astype(np.uint64) + np.uint64(0x632BE5AB)) * r[:-1], dtype=np.uint64, out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def chunks(lengths: list[int], most: int):
    """Ranges of neighbouring texts with at most `most` characters, one text at least."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)
