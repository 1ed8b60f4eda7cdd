"""Best-fit packing by patterns of few documents, fitted with non-negative least squares.

Documents become pieces of at most ``capacity`` tokens.  The histogram of piece lengths
(``capacity`` numbers, whatever the data) goes to the driver, which

1. lists the patterns of one to three present lengths that fill a sequence exactly,
2. fits how often each is used by non-negative least squares against the histogram,
3. rounds the counts within what is there, fitting what is left again, and
4. packs the rest best-fit in decreasing order, on counts and not on single pieces; the
   patterns taken last are packed with it where that saves sequences.

The plan is a list of slot runs: the k-th piece of a length goes to the k-th slot of that
length.  Its size depends on ``capacity`` alone.  Pieces are numbered within a length in
chunks, so no task sorts all pieces of one length.

A null text is an empty document (its end id remains).  Repeated rows are packed each for
itself; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.llm import shared, tokens

CAPACITY = 2048
END_ID = 0
ROUNDS = 100
#: Fits of what is left, at most, and the share of whole repeats below which counts are rounded up.
FITS, LEAST_WHOLE = 6, 0.05
CHUNK_ROWS = 100_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, copy (tells rows with one doc_id apart), piece, start, length, ids_crc32 and, if asked for, ids.

    Only documents over ``capacity`` tokens are cut; their first piece takes the remainder.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.slices(batch, 2 << 20):
                raw = [x + end for x in tokens.encode_all(tokenizer, part.column(1))]
                n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                cuts = np.maximum(1, -(-n // capacity))
                doc = np.repeat(np.arange(len(raw)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first = n - (cuts - 1) * capacity
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[doc])
                own = raw
                if len(doc) > len(raw):
                    own = [raw[d][4 * a : 4 * (a + m)] for d, a, m in zip(doc.tolist(), start.tolist(), length.tolist())]
                crc = np.fromiter(map(zlib.crc32, own), np.int64, len(own))
                at = pa.array(doc)
                columns = [part.column(0).take(at), part.column(2).take(at), *map(pa.array, (piece.astype(np.int32), start, length, crc))]
                names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("copy")).mapInArrow(shared.trimmed(run, encodes=True), schema)


def patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three present lengths, 0 for none, that add up to ``capacity``."""
    there = np.flatnonzero(counts[: capacity + 1])
    have = np.zeros(capacity + 1, bool)
    have[there] = True
    have[0] = False
    out = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    low = there[(there > 0) & (there <= capacity // 2)]
    two = low[have[capacity - low]]
    out.append(np.stack([capacity - two, two, np.zeros_like(two)], 1))
    for a in there[(there > 0) & (there <= capacity // 3)].tolist():
        b = there[(there >= a) & (there <= (capacity - a) // 2)]
        b = b[have[capacity - a - b]]
        out.append(np.stack([capacity - a - b, b, np.full_like(b, a)], 1))
    return np.concatenate(out).astype(np.int64)


def fitted(found: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat count of each pattern: least squares against ``counts`` with no count below 0.

    Accelerated projected gradient; the matrix of patterns is only ever gathered and summed.
    """
    used = found > 0
    flat, row = found[used], np.nonzero(used)[0]
    n, size = len(found), len(counts)

    def up(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, x[row], size)

    def down(y: np.ndarray) -> np.ndarray:
        return np.bincount(row, y[flat], n)

    probe = np.ones(n)
    for _ in range(12):
        probe = down(up(probe))
        step = np.linalg.norm(probe)
        probe /= step
    target = counts.astype(float)
    x = ahead = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, ahead - down(up(ahead) - target) / (1.02 * step))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


@dataclass
class Plan:
    """Slot runs sorted by length and first rank: run i takes ranks first[i] .. first[i] + repeat - 1 of its length.

    ``patterned`` of the ``sequences`` are repeats of fitted patterns.
    """

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    patterned: int


#: Items of a sequence as (length, times), and how many such sequences.
Kind = tuple[list[tuple[int, int]], int]


def _best_fit(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Best fit in decreasing order on counts: (items as (length, times), repeats) for each kind of sequence."""
    kinds: dict[int, list[Kind]] = {}
    room = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fit = length + int(np.argmax(room[length:])) if room[length:].any() else 0
            if not fit:
                times = min(left, capacity // length)
                repeat = left // times
                left -= repeat * times
                kind, free = ([(length, times)], repeat), capacity - length * times
            else:
                items, repeat = kinds[fit].pop()
                room[fit] = bool(kinds[fit])
                times = min(left, fit // length)
                many = min(repeat, left // times)
                if many < repeat:
                    kinds[fit].append((items, repeat - many))
                    room[fit] = True
                left -= many * times
                kind, free = ([*items, (length, times)], many), fit - length * times
            kinds.setdefault(free, []).append(kind)
            room[free] = free > 0
    return [k for own in kinds.values() for k in own]


def _from_patterns(left: np.ndarray, capacity: int) -> list[Kind]:
    """Kinds of sequences from fitted patterns; their pieces are taken out of ``left``.

    Counts are rounded down while that gives whole sequences, and what is left is fitted
    again.  Then they are rounded up, the largest first, while there are pieces for them.
    """
    kinds: list[Kind] = []
    up = False
    for _ in range(FITS):
        found = patterns(left, capacity)
        if not len(found):
            break
        repeats = fitted(found, left)
        total, used = float(repeats.sum()), 0
        up = up or np.floor(repeats).sum() < LEAST_WHOLE * total
        for k in np.argsort(-repeats, kind="stable").tolist():
            want = int(np.ceil(repeats[k] - 1e-9) if up else repeats[k])
            if want < 1 or used >= total:
                break
            own, times = np.unique(found[k][found[k] > 0], return_counts=True)
            many = min(want, int((left[own] // times).min()))
            if many:
                left[own] -= many * times
                kinds.append((list(zip(own.tolist()[::-1], times.tolist()[::-1])), many))
                used += many
        if up and not used:
            break
        up = up or used < LEAST_WHOLE * total
    return kinds


def _with_rest(kinds: list[Kind], left: np.ndarray, capacity: int) -> tuple[list[Kind], list[Kind]]:
    """``kinds`` and best fit for what is left; the kinds taken last are packed with it as long as that saves sequences.

    What patterns leave may be too alike to fit together.  Twice as many are given back
    each time, to half of all, and the fewest sequences count.
    """

    def sequences(some: list[Kind]) -> int:
        return sum(k[1] for k in some)

    rest = _best_fit(left, capacity)
    tokens = int((left * np.arange(capacity + 1)).sum())
    least = -(-tokens // capacity) + sequences(kinds)
    best, found = sequences(kinds) + sequences(rest), (kinds, rest)
    kept, back, target, most = list(kinds), 0, max(1, sequences(rest)), sequences(kinds) // 2
    left = left.copy()
    while best > least and back < min(target, most) and len(kept) > 1:
        while len(kept) > 1 and back < target:
            items, repeat = kept.pop()
            for length, times in items:
                left[length] += repeat * times
            back += repeat
        rest = _best_fit(left, capacity)
        if (now := sequences(kept) + sequences(rest)) < best:
            best, found = now, (list(kept), rest)
        target *= 2
    return found


def planned(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Slots for a histogram; ``counts[n]`` pieces have n tokens."""
    left = counts.astype(np.int64).copy()
    full = [([(capacity, 1)], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    fits = _from_patterns(left, capacity)
    fits, rest = _with_rest(fits, left, capacity)
    kinds, patterned = full + fits + rest, sum(k[1] for k in fits)
    rows, given, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for items, repeat in kinds:
        offset = 0
        for length, times in items:
            for _ in range(times):
                rows.append((length, given[length], sequence, offset))
                given[length] += repeat
                offset += length
        sequence += repeat
    columns = np.array(rows, np.int64).reshape(-1, 4)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return Plan(*columns.T, sequence, patterned)


def ranked(found: DataFrame, total: int) -> DataFrame:
    """``rank`` from 0 within each length, numbered per (length, chunk) and put together from the chunks' counts."""
    chunks = max(1, -(-total // CHUNK_ROWS) * 4)
    chunked = found.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(chunks)).cast("int"))
    before = chunked.groupBy("length", "chunk").count()
    before = before.select("length", "chunk", (F.sum("count").over(W.partitionBy("length").orderBy("chunk")) - F.col("count")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "chunk").orderBy("doc_id", "copy", "piece")) - 1
    return chunked.withColumn("own", own).join(before, ["length", "chunk"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "chunk")


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id (from 0) and offset to a stored table of pieces (doc_id, copy, piece, length, ...).

    ``found`` is read twice, so it should be a stored table.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # one row per length, at most ``capacity``
        counts[length] = n
    plan = planned(counts, capacity)
    width = np.int64(counts.sum() + 1)
    keys, columns = plan.length * width + plan.first, found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * width + rank, "right") - 1
            extra = [plan.sequence[at] + rank - plan.first[at], plan.offset[at]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *map(pa.array, extra)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return ranked(found, int(counts.sum())).select(*columns, "rank").mapInArrow(shared.trimmed(run), schema)
