"""Token files of independent zstandard frames, with an index and a trailing seek table.

File layout, in order:

* data frames: ids (little-endian unsigned 32-bit) of whole documents, one after the other;
* a skippable frame with one entry per document: doc_id, whether it is null, frame, tokens;
* a skippable frame with the seek table of the zstandard seekable format: compressed
  size, plain size and checksum (low 32 bits of XXH64) of every frame before it.

A reader takes the last bytes first, finds the frames of the documents it wants, and
decompresses those only.  A document longer than a frame has a frame of its own.

Null text is an empty document (its end id remains).  Documents with one doc_id stay
together in the order of their text, a null doc_id comes first, an empty table writes no
file, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.llm import shared, tokens

END_ID = 0
FRAME_TOKENS = 1 << 18
LEVEL = 3
SKIPPABLE_INDEX, SKIPPABLE_TABLE, TABLE_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("tokens", "<u8")])
MANIFEST = "part int, path string, docs long, tokens long, bytes long, first_id long, last_id long"


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class Writer:
    """Writes one file; ``out`` is any object with ``write``."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS, level: int = LEVEL):
        import zstandard

        self.out, self.limit, self.packer = out, frame_tokens * 4, zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.frames, self.index = [], 0, [], []
        self.tokens = self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.limit:
            self.close_frame()
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), len(ids) // 4))

    def put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def close_frame(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            packed = self.packer.compress(plain)
            self.frames.append((len(packed), len(plain), _checksum(plain)))
            self.put(packed)
            self.held, self.size = [], 0

    def finish(self) -> None:
        self.close_frame()
        index = self.packer.compress(np.array(self.index, _ENTRY).tobytes())
        self.put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.frames.append((len(index) + 8, 0, _checksum(b"")))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.put(struct.pack("<II", SKIPPABLE_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), CHECKSUMS, TABLE_MAGIC))


@dataclass
class Reader:
    """Reads one file through ``read_at(offset, size)``."""

    read_at: object
    size: int

    def __post_init__(self):
        import zstandard

        self.unpacker = zstandard.ZstdDecompressor()
        count, flags, magic = struct.unpack("<IBI", self.read_at(self.size - 9, 9))
        if magic != TABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        rows = self.read_at(self.size - 9 - 12 * count, 12 * count)
        self.table = np.frombuffer(rows, "<u4").reshape(count, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        raw = self.read_at(int(self.at[count - 1]) + 8, int(self.table[-1, 0]) - 8)
        self.index = np.frombuffer(self.unpacker.decompress(raw), _ENTRY)

    def frame(self, k: int) -> bytes:
        packed, plain, checksum = self.table[k].tolist()
        out = self.unpacker.decompress(self.read_at(int(self.at[k]), packed), max_output_size=plain)
        if len(out) != plain or _checksum(out) != checksum:
            raise ValueError(f"frame {k} is damaged")
        return out

    def documents(self, only: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, tokens of the file before it, ids) in file order; frames without a wanted one stay packed."""
        ends = np.cumsum(self.index["tokens"].astype(np.int64))
        starts = ends - self.index["tokens"].astype(np.int64)
        wanted = np.ones(len(self.index), bool) if only is None else np.isin(self.index["doc_id"], list(only)) & (self.index["null"] == 0)
        firsts = np.concatenate([[0], np.cumsum(self.table[:-1, 1] // 4)])
        for k in np.unique(self.index["frame"][wanted]).tolist():
            plain = self.frame(k)
            for i in np.flatnonzero(wanted & (self.index["frame"] == k)).tolist():
                at = int(starts[i] - firsts[k]) * 4
                yield (None if self.index["null"][i] else int(self.index["doc_id"][i])), int(starts[i]), plain[at : at + int(self.index["tokens"][i]) * 4]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encode ``docs`` and write one file per range of doc_id below ``folder``; returns the stored manifest.

    Each attempt of a task writes a file of its own name and the manifest lists those of
    the attempts that counted, so lost executors leave no wrong file behind it.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, file = TaskContext.get().partitionId(), None, None
        first = last = None
        for batch in batches:
            for piece in shared.slices(batch, 4 << 20):
                ids = tokens.encode_all(tokenizer, piece.column(1))
                for doc_id, own in zip(piece.column(0).to_pylist(), ids):
                    if out is None:
                        system, place = _filesystem(folder)
                        system.create_dir(place, recursive=True)
                        path = f"{place}/part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
                        file = system.open_output_stream(path, compression=None)
                        out, first = Writer(file, frame_tokens), doc_id
                    out.add(doc_id, own + end)
                    last = doc_id
        if out is not None:
            out.finish()
            file.close()
            row = [part, f"{folder}/{path.rsplit('/', 1)[1]}", len(out.index), out.tokens, out.bytes, first, last]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    placed = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return shared.stored(placed.mapInArrow(run, MANIFEST), "token-manifest")


def read(manifest: DataFrame, only: set[int] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    ``only`` names the documents wanted; other frames are not decompressed.
    """
    files = manifest.withColumn("before", F.sum("tokens").over(W.orderBy("part")) - F.col("tokens"))
    if only is not None:
        files = files.filter(F.col("first_id").isNull() | ((F.col("last_id") >= min(only, default=0)) & (F.col("first_id") <= max(only, default=-1))))
    spread = files.repartition(shared.partitions_for(manifest.sparkSession, 1), "path").select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = _filesystem(path)
                with system.open_input_file(place) as file:
                    rows, size = [], 0
                    for doc_id, start, ids in Reader(lambda at, n, f=file: f.read_at(n, at), file.size()).documents(only):
                        rows.append((doc_id, before + start, len(ids) // 4, zlib.crc32(ids), ids))
                        size += len(ids) if with_ids else 64
                        if size > 8 << 20:
                            yield _rows(rows, with_ids)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows, with_ids)

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)
