"""Words of many texts at once: places and 64-bit hashes in numpy, without a Python object per word.

A word is a run of bytes other than space and 0x09 to 0x0D.  Hashes are polynomials
modulo 2**64 over random byte values, taken from one running sum, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, _MASK, 256, np.uint64, endpoint=True)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[65:91] = _VALUES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of an odd base and of its inverse, kept as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def forget() -> None:
    """Let go of the powers that are kept."""
    for own in (_BYTES, _WORDS):
        own.up = own.down = np.ones(1, np.uint64)


@dataclass
class Words:
    """All words of a column of texts: ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray



def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text starts, with the end as last entry.  Null is empty."""
    n = len(texts)
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1, texts.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(texts: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR) -> Words:
    """Find and hash the words of every text; ``lower`` hashes A-Z as a-z, ``separator`` marks the bytes between words."""
    raw, at = text_bytes(texts)
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64))
    inside = ~separator[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = at[(at > 0) & (at < n)]
    begins[cuts] |= inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _BYTES.upto(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER_VALUES if lower else _VALUES)[raw] * up[:n], out=sums[1:], dtype=np.uint64)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(raw, starts, ends, np.searchsorted(starts, at), hashes)


def runs_hash(hashes: np.ndarray, starts: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``length`` consecutive entries from each of ``starts``."""
    up, down = _WORDS.upto(len(hashes) + 1)
    values = hashes if not salt else mix(hashes + np.uint64(salt))
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(hashes)], out=sums[1:], dtype=np.uint64)
    return mix((sums[starts + length] - sums[starts]) * down[starts] + np.uint64(salt))


def spans_hash(hashes: np.ndarray, first: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the whole sequence of entries of each text."""
    up, down = _WORDS.upto(len(hashes) + 1)
    values = hashes if not salt else mix(hashes + np.uint64(salt))
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(hashes)], out=sums[1:], dtype=np.uint64)
    n = first[1:] - first[:-1]
    return mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + n.astype(np.uint64) * np.uint64(_BASE) + np.uint64(salt))


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of ``length`` entries inside one text, and the windows' bounds per text."""
    n = np.maximum(0, first[1:] - first[:-1] - length + 1)
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    starts = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n)
    return starts, bounds


def joined(found: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """Words (those of ``keep``) of each text joined by one space; text ``i`` is ``raw[at[i]:at[i + 1] - 1]``."""
    starts, sizes = found.starts, found.ends - found.starts
    kept_before = np.arange(len(starts) + 1) if keep is None else np.concatenate([[0], np.cumsum(keep)])
    if keep is not None:
        starts, sizes = starts[keep], sizes[keep]
    ends = np.cumsum(sizes + 1)
    out = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(ends - sizes - 1, sizes) + places] = found.data[np.repeat(starts, sizes) + places]
    return out.tobytes(), np.concatenate([[0], ends])[kept_before[found.first]]


def digests(found: Words, keep: np.ndarray | None = None) -> list[str]:
    """Lowercase hex SHA-256 of each text's words (those of ``keep``) joined by one space."""
    from hashlib import sha256

    raw, at = joined(found, keep)
    view = memoryview(raw)
    return [sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
