"""Counting quotient filters of packed n-grams that lose nothing.

An n-gram of word ids is packed into ``bits`` bits, held in lanes of 64.  An invertible
permutation of those bits spreads the n-grams evenly; its top bits name the shard, the
next ones are the quotient, and all others are kept as the remainder.  A filter stores the
length of each quotient's run, the remainders in order, and the counts, each as narrow as
its largest value allows: a few bytes per n-gram.  Since remainders are whole and the
permutation can be undone, a filter gives back every n-gram with its exact count, and
filters of one shard merge in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_ODD = 0xD6E8FEB86659FD93
#: Entries of one filter that share a quotient, on average.
RUN = 2
#: Entries that are sorted at once where runs are put together.
RANGE = 1 << 18
Lanes = list[np.ndarray]
FIELDS = "shard int, entries int, quotient int, runs binary, remainders binary, counts binary"


def pack(ids: Lanes, width: int) -> Lanes:
    """Word ids of ``width`` bits, one array per place, as lanes of 64 bits; the last lane has what is left over."""
    lanes = [np.zeros(len(ids[0]), np.uint64) for _ in range(-(-len(ids) * width // 64))]
    for k, own in enumerate(ids):
        lane, shift = divmod(k * width, 64)
        lanes[lane] |= own << np.uint64(shift)
        if shift + width > 64:
            lanes[lane + 1] |= own >> np.uint64(64 - shift)
    return lanes


def unpack(lanes: Lanes, width: int, n: int) -> Lanes:
    """The ``n`` word ids of each packed n-gram."""
    mask, out = np.uint64((1 << width) - 1), []
    for k in range(n):
        lane, shift = divmod(k * width, 64)
        own = lanes[lane] >> np.uint64(shift)
        if shift + width > 64:
            own = own | lanes[lane + 1] << np.uint64(64 - shift)
        out.append(own & mask)
    return out


class Permutation:
    """A permutation of numbers of ``bits`` bits, of which the first lane has the low 64."""

    def __init__(self, bits: int):
        self.first = min(64, bits)
        self.mask = np.uint64((1 << self.first) - 1)
        self.half = np.uint64((self.first + 1) // 2)
        self.odd = np.uint64(_ODD) & self.mask
        self.inverse = np.uint64(pow(_ODD, -1, 1 << self.first))

    def _others(self, lanes: Lanes) -> np.ndarray:
        total = np.zeros(len(lanes[0]), np.uint64)
        for k, lane in enumerate(lanes[1:]):
            x = (lane + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD)
            total += x ^ (x >> np.uint64(32))
        return total

    def there(self, lanes: Lanes) -> Lanes:
        x = (lanes[0] + self._others(lanes)) & self.mask
        for _ in range(2):
            x = ((x ^ (x >> self.half)) * self.odd) & self.mask
        return [x ^ (x >> self.half), *lanes[1:]]

    def back(self, lanes: Lanes) -> Lanes:
        x = lanes[0] ^ (lanes[0] >> self.half)
        for _ in range(2):
            x = (x * self.inverse) & self.mask
            x ^= x >> self.half
        return [(x - self._others(lanes)) & self.mask, *lanes[1:]]


def counted(lanes: Lanes, counts: np.ndarray | None = None) -> tuple[Lanes, np.ndarray]:
    """Distinct keys in order (by the first lane, then the others) with the sum of their counts."""
    if not len(lanes[0]):
        return lanes, np.zeros(0, np.int64)
    # Sorted runs one after the other, as merged filters are, are merged by the stable sort.
    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    lanes = [lane[order] for lane in lanes]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([lane[1:] != lane[:-1] for lane in lanes])
    starts = np.flatnonzero(new)
    sums = np.diff(np.append(starts, len(order))) if counts is None else np.add.reduceat(counts[order], starts)
    return [lane[starts] for lane in lanes], sums


def _narrow(values: np.ndarray) -> bytes:
    """The values in the smallest unsigned type that holds them, after a byte that says which."""
    top = int(values.max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if top < 1 << 8 * s)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _wide(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    size = raw[at]
    return np.frombuffer(raw, f"<u{size}", n, at + 1).astype(np.uint64), at + 1 + n * size


@dataclass
class Filter:
    """One shard's n-grams (permuted, distinct, in order) with their counts."""

    shard: int
    lanes: Lanes
    counts: np.ndarray

    def row(self, bits: int, shard_bits: int) -> tuple:
        """As ``FIELDS``."""
        room = min(64, bits) - shard_bits
        quotient = min(room, max(0, (len(self.counts) // RUN).bit_length()))
        low = np.uint64(room - quotient)
        own = self.lanes[0] & np.uint64((1 << room) - 1)
        runs = np.bincount((own >> low).astype(np.int64) if room > 0 else np.zeros(len(own), np.int64), minlength=1 << quotient)
        rest = own & np.uint64((1 << int(low)) - 1)
        return self.shard, len(self.counts), quotient, _narrow(runs), b"".join(map(_narrow, [rest, *self.lanes[1:]])), _narrow(self.counts)

    @classmethod
    def of(cls, row: tuple, bits: int, shard_bits: int) -> Filter:
        shard, entries, quotient, runs, remainders, counts = row
        room = min(64, bits) - shard_bits
        lengths, _ = _wide(runs, 1 << quotient)
        first = np.repeat(np.arange(1 << quotient, dtype=np.uint64), lengths.astype(np.int64))
        top = np.uint64(shard << room) if room < 64 else np.uint64(0)
        lanes, at = [], 0
        for _ in range(-(-bits // 64)):
            lane, at = _wide(remainders, entries, at)
            lanes.append(lane)
        if room > quotient:
            first = first << np.uint64(room - quotient)
        lanes[0] = lanes[0] | first | top
        size = counts[0]
        return cls(shard, lanes, np.frombuffer(counts, f"<u{size}", entries, 1))


def ranges(runs: list[tuple[Lanes, np.ndarray]]) -> Iterator[tuple[Lanes, np.ndarray]]:
    """Sorted runs (keys, counts) as one, range by range of the first lane with about ``RANGE`` entries: only a range is held twice."""
    total = sum(len(c) for _, c in runs)
    longest = max((lanes[0] for lanes, _ in runs), key=len)
    parts = max(1, -(-total // RANGE))
    bounds = longest[np.arange(1, parts) * len(longest) // parts] if len(longest) else longest
    cuts = [np.concatenate([[0], np.searchsorted(lanes[0], bounds), [len(c)]]).astype(np.int64) for lanes, c in runs]
    for i in range(len(bounds) + 1):
        own = [([lane[at[i] : at[i + 1]] for lane in lanes], c[at[i] : at[i + 1]].astype(np.int64)) for (lanes, c), at in zip(runs, cuts)]
        yield counted([np.concatenate(x) for x in zip(*(lanes for lanes, _ in own))], np.concatenate([c for _, c in own]))


def merged(filters: list[Filter]) -> Filter:
    """Filters of one shard as one."""
    found = list(ranges([(f.lanes, f.counts) for f in filters]))
    return Filter(filters[0].shard, [np.concatenate(x) for x in zip(*(lanes for lanes, _ in found))], np.concatenate([c for _, c in found]))


def sharded(lanes: Lanes, counts: np.ndarray, bits: int, shard_bits: int) -> list[Filter]:
    """Distinct keys in order cut into the filters of their shards."""
    if not shard_bits:
        return [Filter(0, lanes, counts)] if len(counts) else []
    shard = (lanes[0] >> np.uint64(min(64, bits) - shard_bits)).astype(np.int64)
    names, starts = np.unique(shard, return_index=True)
    ends = np.append(starts[1:], len(shard))
    return [Filter(int(s), [lane[a:b] for lane in lanes], counts[a:b]) for s, a, b in zip(names, starts, ends)]
