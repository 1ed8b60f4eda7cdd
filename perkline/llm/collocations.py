"""Phrases whose words stand together more often than their parts foretell.

Texts become slices: a vocabulary of (language, word) with counts, and the words as places
in it.  Words seen often enough get ids.  Level by level, from two words to five, each task
packs the n-grams whose two shorter parts are frequent into counting quotient filters
(``quotient_filter``), which travel by shard and are merged in sorted order; what is
frequent is unpacked again.  Parts are looked up in a Bloom filter of a fixed size, whose
false hits only cost counting: every phrase that counts has its exact count.

Word ids are places in the sorted array of frequent words, which is sent out while it has
at most ``VOCABULARY`` entries; beyond that, the 64-bit hash of (language, word) is the id
and nothing is sent.  Both give the same result.

Scores, cuts and the phrases that stand inside a longer one with the same count are plain
joins on the frequent phrases.  A part of a candidate is at least as frequent as the
candidate, so a longer phrase with the same count goes through one of one word more.

Null text is empty and a null language is ``und``.  Repeated rows count each for itself.
An empty table gives no rows.  Columns other than text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.llm import quotient_filter as cqf
from perkline.llm import shared
from perkline.llm.words import mix, words

LONGEST = 5
LEAST = 100
TOP = 2000
NO_LANGUAGE = "und"
#: Frequent words that are sent out as a sorted array of 8 bytes each.
VOCABULARY = 1 << 23
#: Bits of the filter of frequent parts, whatever their number.
PART_BITS = 1 << 26
#: n-grams that a task holds before it merges them, and distinct ones before it sends them.
PENDING, HELD = 1 << 20, 1 << 22
#: Word occurrences for each shard of a level, up to 2**16 shards.
SHARD_WORDS = 1 << 22
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def _language_salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


def slices(docs: DataFrame) -> DataFrame:
    """vocabulary (key, lang, word, n of each distinct word of a slice of texts) and tokens (places in it from 1, 0 between pieces); stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column(1), lower=True, separator=_BETWEEN)
        langs = batch.column(0).to_pylist()
        salts = np.array([_language_salt(x) for x in langs], np.uint64) if langs else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(found.first))
        keys, at, place, n = np.unique(mix(found.hashes + salts[owner]), return_index=True, return_inverse=True, return_counts=True)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[found.data])])[found.starts] if len(owner) else owner
        new = np.zeros(len(owner), np.int64)
        new[1:] = (breaks[1:] != breaks[:-1]) | (owner[1:] != owner[:-1])
        tokens = np.zeros(len(owner) + int(new.sum()), np.uint32)
        tokens[np.arange(len(owner)) + np.cumsum(new)] = place + 1
        raw = _LOWER[found.data].tobytes()
        texts = [raw[a:b].decode() for a, b in zip(found.starts[at].tolist(), found.ends[at].tolist())]
        rows = pa.StructArray.from_arrays([pa.array(keys.view(np.int64)), pa.array([langs[i] for i in owner[at].tolist()], pa.string()), pa.array(texts, pa.string()), pa.array(n.astype(np.int64))], names=["key", "lang", "word", "n"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays([lists, pa.array([tokens.tobytes()], pa.binary())], names=["vocabulary", "tokens"])

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return shared.stored(shared.over_text(own, ["lang", "text"], run, "vocabulary array<struct<key: long, lang: string, word: string, n: long>>, tokens binary"), "phrase-slices")


def _part_places(lanes: cqf.Lanes) -> list[np.ndarray]:
    own = np.zeros(len(lanes[0]), np.uint64)
    for lane in lanes:
        own = mix(own * np.uint64(0x9E3779B97F4A7C15) + lane + np.uint64(1))
    return [(own >> np.uint64(s)) & np.uint64(PART_BITS - 1) for s in (0, 32)]


def _part_filter(frequent: DataFrame, width: int) -> np.ndarray:
    """Bits of the frequent n-grams (``p``, their word ids), put together on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(PART_BITS // 64, np.uint64)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
                for at in _part_places(cqf.pack(list(ids.T), width)):
                    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].view(np.int64))], names=["at", "bits"])

    rows = frequent.select("p").mapInArrow(shared.trimmed(run), "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(PART_BITS // 64, np.uint64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def level(cut: DataFrame, known: np.ndarray | None, parts: np.ndarray | None, n: int, width: int, shard_bits: int, least: int) -> DataFrame:
    """p (word ids), a (count) of the phrases of ``n`` words seen ``least`` times or more; stored.

    ``known`` are the frequent words' keys in order (none: keys are ids), ``parts`` the
    filter of the frequent phrases of one word less (none: all of frequent words are).
    """
    spark = cut.sparkSession
    bits = n * width
    shard_bits = min(shard_bits, bits - 1)
    turn = cqf.Permutation(bits)
    sent = spark.sparkContext.broadcast((known, parts))
    names = [c.split()[0] for c in cqf.FIELDS.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3

    def ngrams(keys: np.ndarray, tokens: np.ndarray) -> cqf.Lanes:
        known, parts = sent.value
        if known is None:
            ids, there = keys, np.ones(len(keys), bool)
        else:
            spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            there = known[spot] == keys
            ids = spot.astype(np.uint64)
        ids = np.concatenate([np.zeros(1, np.uint64), ids])[tokens]
        ok = np.concatenate([[False], there])[tokens]

        def lined(size: int) -> tuple[np.ndarray, list[np.ndarray]]:
            count = max(0, len(ids) - size + 1)
            return np.logical_and.reduce([ok[i : i + count] for i in range(size)]), [ids[i : i + count] for i in range(size)]

        good, own = lined(n)
        if parts is not None:
            short, columns = lined(n - 1)
            at = np.flatnonzero(short)
            bits = [parts[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1) for p in _part_places(cqf.pack([c[at] for c in columns], width))]
            frequent = np.zeros(len(short), bool)
            frequent[at] = (bits[0] & bits[1]).astype(bool)
            good &= frequent[: len(good)] & frequent[1 : len(good) + 1]
        return turn.there(cqf.pack([c[good] for c in own], width))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = [], 0

        def one() -> tuple[cqf.Lanes, np.ndarray]:
            # Ranges are put together one by one, and runs go as soon as they are: none is held twice as a whole.
            found = [(lanes, c.astype(np.uint32)) for lanes, c in cqf.ranges(held)]
            held.clear()
            return [np.concatenate(x) for x in zip(*(lanes for lanes, _ in found))], np.concatenate([c for _, c in found])

        def send(lanes: cqf.Lanes, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for f in cqf.sharded(lanes, counts, bits, shard_bits):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(f.row(bits, shard_bits), kinds)], names=names)

        for batch in batches:
            for keys, tokens in zip(batch.column(0), batch.column(1)):
                found, n_found = cqf.counted(ngrams(keys.values.to_numpy().view(np.uint64), np.frombuffer(tokens.as_buffer(), np.uint32)))
                held.append((found, n_found.astype(np.uint32)))
                pending += len(n_found)
                if pending > PENDING:
                    held = [one()]
                    if len(held[0][1]) > HELD:
                        yield from send(*held[0])
                        held = []
                    pending = 0
        if held:
            yield from send(*one())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[cqf.Filter] = []

        def done() -> Iterator[pa.RecordBatch]:
            # A shard's filters stay as they came; of their sum there is one range at a time, and its frequent phrases.
            for lanes, counts in cqf.ranges([(f.lanes, f.counts) for f in held]):
                often = counts >= least
                ids = cqf.unpack(turn.back([lane[often] for lane in lanes]), width, n)
                flat = pa.array(np.stack(ids, 1).reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([lists, pa.array(counts[often])], names=["p", "a"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in batch.columns)
                if held and held[0].shard != row[0]:
                    yield from done()
                    held = []
                held.append(cqf.Filter.of(row, bits, shard_bits))
        if held:
            yield from done()

    filters = cut.select("vocabulary.key", "tokens").mapInArrow(shared.trimmed(fill), cqf.FIELDS)
    spread = filters.repartition(shared.partitions_for(spark, min(1 << shard_bits, 1 << 12)), "shard").sortWithinPartitions("shard")
    return shared.stored(spread.mapInArrow(shared.trimmed(join), "p array<long>, a long"), "phrase-level")


def _with_ids(frequent: DataFrame, known: np.ndarray | None) -> DataFrame:
    """``frequent`` with the word's ``id``."""
    if known is None:
        return frequent.withColumn("id", F.col("key"))
    sent = frequent.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(sent.value, batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["key", "lang", "word", "n", "id"])

    return frequent.mapInArrow(shared.trimmed(run), "key long, lang string, word string, n long, id long")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, vocabulary: int = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (p, a), the words of their ids (id, lang, word), and the words of each language (lang, n)."""
    cut = slices(docs)
    entries = cut.select(F.inline("vocabulary"))
    totals = shared.stored(entries.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    frequent = shared.stored(entries.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase-words")
    known = None
    size = frequent.count()
    if size <= vocabulary:
        known = np.sort(frequent.select("key").toArrow()["key"].to_numpy().view(np.uint64))  # at most ``vocabulary`` keys
    if size and known is not None and (known[1:] == known[:-1]).any():
        raise ValueError("two words share a 64-bit key; change the base of words.py")
    width = 64 if known is None else max(1, (size - 1).bit_length())
    named = shared.stored(_with_ids(frequent, known), "phrase-ids")
    occurrences = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shard_bits = min(16, max(0, -(-occurrences // SHARD_WORDS) - 1).bit_length())
    levels = [named.select(F.array("id").alias("p"), F.col("n").alias("a"))]
    for n in range(2, longest + 1):
        if levels[-1].isEmpty():
            break
        parts = _part_filter(levels[-1], width) if n > 2 or known is None else None
        levels.append(level(cut, known, parts, n, width, shard_bits, least))
    return shared.stored(reduce(DataFrame.unionByName, levels), "phrase-counts"), named.select("id", "lang", "word"), totals


def scored(found: DataFrame, named: DataFrame, totals: DataFrame) -> DataFrame:
    """p, lang, a, l, r, n, score of every candidate, at its lowest-scoring cut; the smallest of equal ones."""
    long = found.filter(F.size("p") > 1)
    first = long.withColumn("id", F.col("p")[0]).join(named.select("id", "lang"), "id").join(totals, "lang")
    cuts = first.select("p", "lang", "a", "n", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", 1, F.col("k")), "right": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    both = cuts.join(found.select(F.col("p").alias("left"), F.col("a").alias("l")), "left").join(found.select(F.col("p").alias("right"), F.col("a").alias("r")), "right")
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "anlr"}
    score = F.expr(f"cast(1000 * {wide['a']} * {wide['n']} as decimal(38, 0)) div cast({wide['l']} * {wide['r']} as decimal(38, 0))")
    best = both.withColumn("score", score).groupBy("p").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("b"))
    return best.select("p", "b.lang", "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, vocabulary: int = VOCABULARY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` candidates that no longer one accounts for."""
    found, named, totals = phrases(docs, least, longest, vocabulary)
    long = found.filter(F.size("p") > 2)
    inside = long.select(F.explode(F.array(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1))).alias("p"), "a")
    inside = inside.groupBy("p").agg(F.max("a").alias("longer"))
    own = scored(found, named, totals).join(inside, "p", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    # First within parts of a language, so no task sorts all candidates of one.
    order = [F.desc("score"), F.desc("a")]
    salted = own.withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(64)))
    near = salted.withColumn("k", F.rank().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("k") <= top).drop("salt")
    near = near.withColumn("k", F.rank().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("k") <= top).drop("k")
    near = shared.stored(near, "phrase-best")
    spelled = near.select("p", F.posexplode("p").alias("at", "id")).join(named.select("id", "word"), "id")
    spelled = spelled.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))  # at most ``longest`` words
    text = spelled.select("p", F.concat_ws(" ", F.transform("w", lambda x: x["word"])).alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase"))
    return near.join(text, "p").withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
q AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS x FROM d)),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM q, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, ws[i:i + k - 1] AS p, k, count(*)::HUGEINT AS a FROM g GROUP BY lang, ws[i:i + k - 1], k),
t AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {LEAST}),
u AS (SELECT c.lang, c.p, c.a, t.n, j, x.a AS l, y.a AS r, (1000 * c.a * t.n) // (x.a * y.a) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN t USING (lang)
    JOIN f x ON x.lang = c.lang AND x.p = c.p[1:j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1:c.k]),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
w AS (SELECT lang, p[s:s + m - 1] AS p, max(a) AS longer FROM (SELECT lang, p, k, a, m, unnest(range(1, k - m + 2)) AS s
    FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k) GROUP BY lang, p[s:s + m - 1]),
o AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM b LEFT JOIN w ON w.lang = b.lang AND w.p = b.p WHERE w.longer IS NULL OR w.longer < b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= {TOP}
"""
