"""Quality classifier: a small byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it.  Learned filters slide over
each chunk; their inputs are the bytes (a learned embedding) and how steadily a place
repeats the bytes shortly before it.  The responses are max-pooled per chunk, then over
the chunks of a document (maximum and mean), and a logistic layer gives one probability.

The network is fitted on the driver on at most ``SAMPLE_ROWS`` labelled documents of each
label of at most ``SAMPLE_BYTES`` bytes, chosen by the hash of doc_id; scoring reads every
document whole.  Null and empty texts are scored as texts without any response.  Repeated
rows get equal scores, null labels and labels of other values are left out, an empty table
gives no rows, and with fewer than two labels every score is the share of label 1 (0.5 if
none).  Columns other than doc_id and text are never read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkline.llm import shared
from perkline.llm.words import text_bytes

SAMPLE_ROWS, SAMPLE_BYTES = 1000, 16_384
CHUNK, HOP, STRIDE, WIDTH = 512, 384, 4, 8
EMBED, FILTERS = 6, 12
LAGS, STEADY = range(2, 49), 12
EPOCHS, BATCH, RATE, DECAY = 10, 50, 0.02, 1e-4
THRESHOLD = 0.5


@dataclass
class Network:
    """Weights; ``constant`` is the score of every text where nothing could be fitted."""

    embed: np.ndarray
    filters: np.ndarray
    repeat: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    constant: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.repeat, self.bias, self.out]


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    return Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.25, (WIDTH, EMBED, FILTERS)).astype(np.float32),
        rng.normal(0, 0.5, FILTERS).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0,
    )


def places(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filter places of texts ``raw[at[i]:at[i + 1]]``.

    Gives the padded bytes, the places (start bytes) sorted by text and chunk, the first
    place of each chunk, and the first chunk of each text.  Every byte is under a filter.
    """
    sizes = np.diff(at)
    chunks = np.maximum(0, -(-np.maximum(sizes - (CHUNK - HOP), sizes > 0) // HOP))
    first_chunk = np.concatenate([[0], np.cumsum(chunks)])
    text = np.repeat(np.arange(len(sizes)), chunks)
    start = at[text] + (np.arange(first_chunk[-1]) - first_chunk[text]) * HOP
    length = np.minimum(CHUNK, at[text + 1] - start)
    count = -(-np.maximum(length - (WIDTH - STRIDE), 1) // STRIDE)
    first_place = np.concatenate([[0], np.cumsum(count)])
    spot = np.arange(first_place[-1]) - np.repeat(first_place[:-1], count)
    return np.concatenate([raw, np.zeros(WIDTH + CHUNK, np.uint8)]), np.repeat(start, count) + spot * STRIDE, first_place, first_chunk


def steadiness(padded: np.ndarray, spots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of the last places whose four bytes also stand a short way before, in the same text."""
    if not len(spots):
        return np.zeros(0, np.float32)
    four = padded[: len(padded) - 3].astype(np.uint32)
    for k in range(1, 4):
        four |= padded[k : len(padded) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    grid = np.arange(0, int(spots.max()) + 1)
    known = np.zeros(len(grid), bool)
    begin = at[np.searchsorted(at, grid, "right") - 1]
    own = four[: len(grid)]
    for lag in [k for k in LAGS if k < len(grid)]:
        same = own[lag:] == own[: len(grid) - lag]
        known[lag:] |= same & (grid[lag:] - lag >= begin[lag:])
    sums = np.concatenate([[0], np.cumsum(known)])
    span = STEADY * STRIDE
    low = np.maximum(spots - span, begin[spots])
    return ((sums[spots + 1] - sums[low]) / np.float32(span + 1)).astype(np.float32)


def responses(net: Network, padded: np.ndarray, spots: np.ndarray, steady: np.ndarray) -> np.ndarray:
    """Filter responses at each place, one table look-up per byte under the filter."""
    total = net.bias + steady[:, None] * net.repeat
    for k in range(WIDTH):
        total += (net.embed @ net.filters[k])[padded[spots + k]]
    return total


def pooled(net: Network, raw: np.ndarray, at: np.ndarray, with_places: bool = False):
    """Per text: for each filter the maximum over chunks and the mean of the chunks' maxima, both at least 0."""
    padded, spots, first_place, first_chunk = places(raw, at)
    steady = steadiness(padded, spots, at)
    texts, chunks = len(at) - 1, len(first_place) - 1
    out = np.zeros((texts, 2 * FILTERS), np.float32)
    if not chunks:
        return (out, None) if with_places else out
    found = responses(net, padded, spots, steady)
    top = np.maximum(np.maximum.reduceat(found, first_place[:-1], axis=0), 0)
    full = np.flatnonzero(np.diff(first_chunk))
    firsts = first_chunk[full]
    out[full, :FILTERS] = np.maximum.reduceat(top, firsts, axis=0)
    out[full, FILTERS:] = np.add.reduceat(top, firsts, axis=0) / np.diff(first_chunk)[full, None]
    if not with_places:
        return out
    return out, (padded, spots, steady, found, top, first_place, first_chunk)


def scores(net: Network, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(at) - 1, net.constant)
    return 1 / (1 + np.exp(-np.clip(pooled(net, raw, at).astype(float) @ net.out + net.out_bias, -30, 30)))


def _gradients(net: Network, raw: np.ndarray, at: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    features, held = pooled(net, raw, at, True)
    p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -30, 30)))
    error = ((p - label) / len(label)).astype(np.float32)
    zero = [np.zeros_like(x) for x in net.parts()]
    zero[4] = features.T @ error
    if held is None:
        return [*zero, error.sum()]
    padded, spots, steady, found, top, first_place, first_chunk = held
    counts = np.diff(first_chunk)
    text = np.repeat(np.arange(len(counts)), counts)
    back = error[:, None] * net.out
    grad = back[text, FILTERS:] / counts[text, None]
    grad += np.where(top == features[text, :FILTERS], back[text, :FILTERS], 0)
    grad *= top > 0
    chunk, which = np.nonzero(grad)
    if len(chunk):
        value = grad[chunk, which]
        inside = np.repeat(np.arange(len(first_place) - 1), np.diff(first_place))
        hit = found == top[inside]
        best = np.zeros(top.shape, np.int64)
        rows, cols = np.nonzero(hit)
        best[inside[rows][::-1], cols[::-1]] = rows[::-1]
        spot = best[chunk, which]
        zero[3] = np.bincount(which, value, FILTERS).astype(np.float32)
        zero[2] = np.bincount(which, value * steady[spot], FILTERS).astype(np.float32)
        for k in range(WIDTH):
            table = np.bincount(padded[spots[spot] + k].astype(np.int64) * FILTERS + which, value, 256 * FILTERS).reshape(256, FILTERS)
            zero[1][k] = net.embed.T @ table
            zero[0] += table.astype(np.float32) @ net.filters[k].T
    return [*zero, error.sum()]


def trained(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit by Adam on shuffled batches; the order and the start depend on ``seed`` only."""
    net, rng = new_network(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    first, second = ([np.zeros_like(x) for x in [*net.parts(), np.zeros(())]] for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            at = np.concatenate([[0], np.cumsum([len(texts[j]) for j in own])])
            raw = np.frombuffer(b"".join(texts[j] for j in own), np.uint8)
            step += 1
            for j, g in enumerate(_gradients(net, raw, at, labels[own])):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.99 * second[j] + 0.01 * g * g
                move = rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
                if j == 5:
                    net.out_bias -= float(move)
                else:
                    part = net.parts()[j]
                    part -= (move + rate * DECAY * part).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: Column | None = None, rows: int = SAMPLE_ROWS) -> Network:
    """Fit on a bounded sample of the labelled documents that ``held_out`` (on doc_id) leaves."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("l")).filter(F.col("l").isin(0, 1)).groupBy("l_id").agg(F.max("l").alias("l"))
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES))
    if held_out is not None:
        texts = texts.filter(~held_out)
    order = F.xxhash64(F.col("l_id").cast("string"))
    ids = [known.filter((F.col("l") == x) & ~_on(held_out, "l_id")).orderBy(order, "l_id").limit(rows * 2) for x in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # at most 4 * rows ids
    sample = texts.join(chosen, F.col("doc_id") == F.col("l_id"))
    got = [sample.filter(F.col("l") == x).orderBy(order, "doc_id", "text").limit(rows) for x in (0, 1)]
    table = got[0].unionByName(got[1]).select("text", "l").toArrow()
    return trained([t.encode() for t in table["text"].to_pylist()], np.array(table["l"].to_pylist(), float))


def _on(held_out: Column | None, key: str) -> Column:
    return F.lit(False) if held_out is None else fold(F.col(key), 3, 1)


def fold(doc_id: Column, parts: int, which: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder ``which``; a null doc_id never does."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == which, F.lit(False))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score (higher: label 1 likelier) and predicted (1 from 0.5 on) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = scores(sent.value, *text_bytes(pa.array(batch.column(1)).fill_null("")))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return shared.over_text(docs, ["doc_id", "text"], run, "doc_id long, score double, predicted int", 1 << 18)


def kept(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text is predicted to have label 1."""
    sent, names = docs.sparkSession.sparkContext.broadcast(net), docs.columns
    at_text = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = scores(sent.value, *text_bytes(pa.array(batch.column(at_text)).fill_null(""))) >= THRESHOLD
        return batch.filter(pa.array(good))

    return shared.over_text(docs, names, run, docs.schema, 1 << 18)
