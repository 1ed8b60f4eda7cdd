"""JSON array files of any size, read by many tasks.

A file is cut into byte slices without looking at its content.  Whether a slice starts
inside a string, and how deeply nested, depends on all bytes before it, so it is found
in two passes: every slice first says how it changes the state under both assumptions
(outside and inside a string), running sums over these small rows give the state at
each start, and the second pass cuts the records that open in each slice.  A record
that runs past its slice is read on to its end, so a task holds one slice and one
record at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkline.operators import ordered

SLICE_BYTES = 8 << 20
LEAST_SLICE_BYTES = 4 << 10
LOOK_BACK = 4 << 10
SLICES_PER_CHUNK = 1 << 16

_ESCAPE = re.compile(rb"\\.", re.S)
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)
_QUOTE, _OPEN, _CLOSE = ord('"'), np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8)


def structure(data: bytes, in_string: bool, depth: int, escaped: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, int, bool]:
    """Brackets outside strings: places, bytes and the depth after each; then the state at the end.

    ``escaped`` says that a backslash before ``data`` takes its first byte.
    """
    if escaped and data:
        data = b"_" + data[1:]
    plain = _ESCAPE.sub(b"__", data)
    raw = np.frombuffer(plain, np.uint8)
    quotes = np.flatnonzero(raw == _QUOTE)
    places = np.flatnonzero(np.isin(raw, _OPEN) | np.isin(raw, _CLOSE))
    outside = (np.searchsorted(quotes, places) + in_string) % 2 == 0
    places = places[outside]
    kinds = raw[places]
    after = depth + np.cumsum(np.where(np.isin(kinds, _OPEN), 1, -1))
    end = int(after[-1]) if len(after) else depth
    return places, kinds, after, bool((len(quotes) + in_string) % 2), end, plain.endswith(b"\\")


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
    return system.open_input_file(name)


def _escaped(file, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd run of backslashes."""
    run, at = 0, start
    while at > 0:
        size = min(LOOK_BACK, at)
        part = file.read_at(size, at - size)
        here = len(part) - len(part.rstrip(b"\\"))
        run, at = run + here, at - size
        if here < len(part):
            break
    return run % 2 == 1


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: quotes modulo two, change of depth from outside and from inside a string, first byte that is not blank."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            with _open(r["path"]) as file:
                data = file.read_at(r["stop"] - r["start"], r["start"])
                escaped = _escaped(file, r["start"])
            _, _, _, flips, out, _ = structure(data, False, 0, escaped)
            inside = structure(data, True, 0, escaped)[4]
            head = data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1]
            rows.append({**r, "flips": int(flips), "from_outside": out, "from_inside": inside, "head": head.decode("latin-1") or None})
        yield pa.RecordBatch.from_pylist(rows, schema=_EFFECTS)


_SLICES = [("path", pa.string()), ("slice", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]
_EFFECTS = pa.schema([*_SLICES, ("flips", pa.int64()), ("from_outside", pa.int64()), ("from_inside", pa.int64()), ("head", pa.string())])
_EFFECTS_DDL = "path string, slice long, start long, stop long, flips long, from_outside long, from_inside long, head string"


def _key_before(file, at: int) -> bytes | None:
    """The object key whose value opens at byte ``at``."""
    size = LOOK_BACK
    while True:
        size = min(size, at)
        found = _KEY.search(file.read_at(size, at - size))
        if found:
            return found.group(1)
        if size == at:
            return None
        size *= 4


def _named_arrays(key: str):
    wanted = key.encode()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places where an array of the outer object named ``key`` opens, and where arrays of it close."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with _open(r["path"]) as file:
                    data = file.read_at(r["stop"] - r["start"], r["start"])
                    places, kinds, after, *_ = structure(data, r["in_string"], r["depth"], _escaped(file, r["start"]))
                    for p in places[(kinds == ord("[")) & (after == 2)]:
                        at = r["start"] + int(p)
                        if _key_before(file, at) == wanted:
                            rows.append({"path": r["path"], "opens": at, "closes": None})
                    rows += [{"path": r["path"], "opens": None, "closes": r["start"] + int(p)} for p in places[(kinds == ord("]")) & (after == 1)]]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("opens", pa.int64()), ("closes", pa.int64())]))

    return find


def _rest(file, at: int, in_string: bool, depth: int, escaped: bool, level: int, step: int) -> bytes:
    """Bytes from ``at`` up to the bracket that returns to ``level``; empty if the file ends before."""
    parts = []
    while data := file.read_at(step, at):
        places, _, after, in_string, depth, escaped = structure(data, in_string, depth, escaped)
        ends = places[after == level]
        if len(ends):
            return b"".join(parts) + data[: int(ends[0]) + 1]
        parts.append(data)
        at += len(data)
    return b""


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that open in each slice, with their place."""
    schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("record", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            level, start = r["level"], r["start"]
            paths, positions, texts = [], [], []
            with _open(r["path"]) as file:
                data = file.read_at(r["stop"] - start, start)
                places, kinds, after, in_string, depth, escaped = structure(data, r["in_string"], r["depth"], _escaped(file, start))
                at = places + start
                opens = places[(kinds == ord("{")) & (after == level + 1) & (at > r["lo"]) & (at < r["hi"])]
                ends = places[(kinds == ord("}")) & (after == level)]
                for p, e in zip(opens.tolist(), np.searchsorted(ends, opens).tolist()):
                    if e < len(ends):
                        text = data[p : int(ends[e]) + 1]
                    else:
                        rest = _rest(file, r["stop"], in_string, depth, escaped, level, LOOK_BACK * 16)
                        if not rest:
                            continue
                        text = data[p:] + rest
                    paths.append(r["path"])
                    positions.append(start + p)
                    texts.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(positions, pa.int64()), pa.array(texts, pa.string())], schema=schema)


def slices(spark: SparkSession, path: str, slice_bytes: int | None = None) -> DataFrame:
    """(path, slice, start, stop) of every file below ``path``; at most 8 MB each, and four or more for a file over 16 KB."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    size = F.least(F.lit(SLICE_BYTES), F.greatest(F.lit(LEAST_SLICE_BYTES), F.ceil(F.col("length") / 4))) if slice_bytes is None else F.lit(slice_bytes)
    d = listed.where("length > 0").withColumn("size", size.cast("long"))
    d = d.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / F.col("size")))))
    start = F.col("slice") * F.col("size")
    return d.select("path", "slice", start.alias("start"), F.least(start + F.col("size"), F.col("length")).alias("stop"))


def records(spark: SparkSession, path: str, key: str = "offers", slice_bytes: int | None = None) -> DataFrame:
    """(path, position, record): the text of every object in the array of each file.

    A file is a bare list of objects, or an object with such a list under ``key`` (the
    last one, where the key repeats).  Empty files, files without that list, elements that
    are no objects, and a last record that is cut off give no rows.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    effects = slices(spark, path, slice_bytes).repartition(n, "path", "slice").mapInArrow(_effects, _EFFECTS_DDL)
    chunk, order = F.floor(F.col("slice") / SLICES_PER_CHUNK), [F.col("slice")]
    d = ordered.running_before(effects, ["path"], chunk, order, F.col("flips"), "quotes")
    d = d.withColumn("in_string", F.coalesce("quotes", F.lit(0)) % 2 == 1)
    d = d.withColumn("change", F.when(F.col("in_string"), F.col("from_inside")).otherwise(F.col("from_outside")))
    d = ordered.running_before(d, ["path"], chunk, order, F.col("change"), "depth")
    d = d.withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long"))
    shape = effects.where("head IS NOT NULL").groupBy("path").agg(F.min_by("head", "slice").alias("shape"))
    d = d.select("path", "start", "stop", "in_string", "depth").join(shape, "path")

    bare = d.where("shape = '['").select(*_STATE, F.lit(1).cast("long").alias("level"), F.lit(-1).cast("long").alias("lo"), F.lit((1 << 63) - 1).alias("hi"))
    payload = d.where("shape = '{'").select(*_STATE)
    events = payload.repartition(n, "path", "start").mapInArrow(_named_arrays(key), "path string, opens long, closes long")
    lo = events.groupBy("path").agg(F.max("opens").alias("lo")).where("lo IS NOT NULL")
    hi = events.where("closes IS NOT NULL").join(lo, "path").where("closes > lo").groupBy("path", "lo").agg(F.min("closes").alias("hi"))
    bounds = lo.join(hi, ["path", "lo"], "left").select("path", F.lit(2).cast("long").alias("level"), "lo", F.coalesce("hi", F.lit((1 << 63) - 1)).alias("hi"))
    named = payload.join(bounds, "path").where("stop > lo AND start < hi")
    # Rows of slices are small and their work is not: a stated number keeps them from being coalesced.
    return bare.unionByName(named.select(bare.columns)).repartition(n, "path", "start").mapInArrow(_cut, "path string, position long, record string")


_STATE = ["path", "start", "stop", "in_string", "depth"]
