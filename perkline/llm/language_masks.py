"""Language identification by a bit-sliced Bloom filter of letter trigrams.

Each slot of the filter holds one bit per language, so one look-up (the AND of a few
slots) gives all languages that hold a trigram.  A document's trigrams vote by popcount:
per language the hits, less the false hits that the filter's fill lets expect, as a share
of what texts of that language usually hit, decide.

A trigram belongs to a language if at least ``MIN_SHARE`` of the language's trigrams are
it and no language uses it more than ``MOST_TIMES`` as often.  So a language holds at
most 1 / MIN_SHARE trigrams, which bounds the filter and what reaches the driver, while
the counts cover every learning document.

Null lang or text teaches nothing.  A text that is null, empty or has no letter is
``und`` with score 0; if nothing was learned, every text is.  A text without any hit gets
the language with most learning trigrams and score 0.  Ties go to the first language by
name.  Repeated rows count again when learning; an empty table gives no rows; other
columns, lang and source included, are not read for a prediction.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.llm import shared
from perkline.llm.words import mix

MIN_SHARE, MOST_TIMES = 1e-5, 4.0
SLOTS_PER_GRAM, HASHES = 12, 3
UNKNOWN = "und"
#: The pipeline rejects a text if its best language's part of all votes is smaller.
MIN_SCORE = 0.35
_FLUSH = 1 << 21


@cache
def _letters() -> np.ndarray:
    """Code point -> its small letter, or a space for everything that is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of every text with at least two letters, the text of each, and which texts have a letter.

    Whatever stands between letters is one space; a text starts and ends with one.
    """
    joined = "".join(f"\n{t or ''}\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    sizes = np.fromiter((len(t) + 2 if t else 2 for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    low = _letters()[points]
    letter = low != 32
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    keep[np.cumsum(sizes) - sizes] = True
    low, text, letter = low[keep].astype(np.int64), text[keep], letter[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(texts), bool)
    grams = low[:-2] << 42 | low[1:-1] << 21 | low[2:]
    fine = (text[2:] == text[:-2]) & letter[1:-1] & (letter[:-2] | letter[2:])
    return grams[fine], text[:-2][fine], np.bincount(text, letter, len(texts)) > 0


def counted(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all ``docs`` with text and lang; summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush():
            for lang, parts in held.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for part in shared.slices(batch, 1 << 20):
                langs, texts = np.array(part.column(1).to_pylist(), object), part.column(0).to_pylist()
                for lang in sorted(set(langs)):
                    grams = trigrams([t for t, own in zip(texts, langs) if own == lang])[0]
                    held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                    if len(held[lang]) > 8:
                        held[lang] = [merged(held[lang])]
                size = sum(len(p[0]) for parts in held.values() for p in parts)
                if size > _FLUSH:
                    yield from flush()
                    held = {}
        yield from flush()

    rows = docs.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return rows.mapInArrow(shared.trimmed(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Masks:
    """The filter: ``slots`` of shape (slots, words of 64 languages)."""

    langs: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    hit_rate: np.ndarray
    common: int

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        """Language bits of each gram."""
        found = None
        for k in range(HASHES):
            own = self.slots[_place(grams, k, len(self.slots))]
            found = own if found is None else found & own
        return found


def _place(grams: np.ndarray, k: int, slots: int) -> np.ndarray:
    return (mix(grams.view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(slots - 1)).astype(np.int64)


def learned(docs: DataFrame, min_share: float = MIN_SHARE, most_times: float = MOST_TIMES) -> Masks:
    """Count trigrams of all ``docs`` per language and build the filter."""
    counts = shared.stored(counted(docs), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= min_share)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    chosen = shares.join(most, "gram").filter(F.col("share") * most_times >= F.col("most")).select("lang", "gram", "share").toArrow()
    sizes = {r.lang: r.total for r in totals.collect()}  # one row per language
    langs = sorted(sizes)
    at = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([at[x] for x in chosen["lang"].to_pylist()], np.int64)
    gram, share = (chosen[c].to_numpy() for c in ("gram", "share"))
    slots = 1 << max(10, int(len(set(gram.tolist())) * SLOTS_PER_GRAM - 1).bit_length())
    table = np.zeros((slots, max(1, -(-len(langs) // 64))), np.uint64)
    for i in range(len(langs)):
        for k in range(HASHES):
            table[_place(gram[lang == i], k, slots), i // 64] |= np.uint64(1 << i % 64)
    fill = np.array([(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))])
    hit = np.bincount(lang, share, len(langs)) if len(langs) else np.zeros(0)
    common = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)) if langs else 0
    return Masks(langs, table, fill**HASHES, np.maximum(hit, 1e-9), common)


def votes(masks: Masks, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Corrected share of hits per text and language, and which texts have a letter."""
    grams, text, letter = trigrams(texts)
    bits = masks.look_up(grams)
    n = np.bincount(text, minlength=len(texts))
    out = np.zeros((len(texts), len(masks.langs)))
    for i in range(len(masks.langs)):
        hits = np.bincount(text, bits[:, i // 64] >> np.uint64(i % 64) & np.uint64(1), len(texts))
        out[:, i] = np.maximum(0, hits - n * masks.false_rate[i]) / (1 - masks.false_rate[i]) / np.maximum(n, 1) / masks.hit_rate[i]
    return out, letter


def decided(masks: Masks, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is the best language's part of all votes, sharpened."""
    if not masks.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    found, letter = votes(masks, texts)
    best = np.where(found.max(1) > 0, found.argmax(1), masks.common)
    power = found**4
    score = np.where(letter, found.max(1) ** 4 / np.maximum(power.sum(1), 1e-300), 0.0)
    return [masks.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist())], np.clip(score, 0, 1)


def identified(docs: DataFrame, masks: Masks) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(masks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = decided(sent.value, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return shared.over_text(docs, ["doc_id", "text"], run, "doc_id long, lang_pred string, score double")


def kept(docs: DataFrame, masks: Masks, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all their columns, that are in a learned language by at least ``min_score``."""
    sent, names = docs.sparkSession.sparkContext.broadcast(masks), docs.columns
    at_text = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = decided(sent.value, batch.column(at_text).to_pylist())
        return batch.filter(pa.array([own != UNKNOWN and s >= min_score for own, s in zip(lang, score.tolist())], pa.bool_()))

    return shared.over_text(docs, names, run, docs.schema)
