"""WARC archives written and read as tables of chunks.

A payload travels as rows of (record, chunk number, at most ``CHUNK`` bytes), in order and
side by side within one task, so neither the writer nor the reader ever holds a whole
record: the writer streams chunks into one gzip member per record, the reader streams them
out of it.  Each chunk row carries the digest and the size of the payload up to its end;
the last one has those of the whole payload, which the reader holds against the header.

Of pages with equal payloads of at least ``least`` bytes, the one with the smallest
page_id is a ``response``; the others are ``revisit`` records (profile
identical-payload-digest) without the payload.  Which page is which is settled on digests
alone: payloads of pages that surely are responses are not shuffled.

A null html is an empty payload, a null url has no target URI.  A null page_id comes after
all others: it revisits, and is a response where its payload has no page with an id.  Rows
that repeat the smallest page_id with the same payload are all responses with one record
id.  An empty table writes no archive.  Columns other than page_id, url and html are not
read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.llm import shared

CHUNK = 1 << 20
LEAST_BYTES = 100
#: An archive is closed once it has this many bytes.
FILE_BYTES = 256 << 20
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = "path string, record long, record_type string, record_id string, target_uri string, page_id long, refers_to long, chunk int, last boolean, payload_bytes long, payload_digest string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_NULL_ID = -(1 << 63)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, body (bytes), bytes, digest (lower-case hex SHA-256) of every page."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    return own.withColumns({"bytes": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256)})


def revisits(own: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, bytes, digest, refers_to of the pages whose payload one with a smaller id has; stored."""
    keys = own.filter(F.col("bytes") >= least).select("page_id", "url", "bytes", "digest")
    firsts = keys.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("pages"))
    firsts = firsts.filter((F.col("pages") > 1) & F.col("refers_to").isNotNull()).drop("pages")
    later = keys.join(firsts, ["digest", "bytes"]).filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")))
    return shared.stored(later.select("page_id", "url", "bytes", "digest", "refers_to"), "warc-revisits")


def chunked(own: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of payloads: rows of a page stand together in the order of ``chunk``."""
    last = F.greatest(F.lit(0), F.ceil(F.col("bytes") / chunk).cast("int") - 1)
    rows = own.select("page_id", "url", "bytes", "digest", "body", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    data = F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk))
    return rows.select("page_id", "url", "bytes", "digest", F.lit(None).cast("long").alias("refers_to"), "chunk", data.alias("data"))


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so a revisit names its response without looking it up."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _lines(fields: dict[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()


class Writer:
    """Writes one archive to ``out``; a record is begun, gets its chunks, and is ended."""

    def __init__(self, out, date: str = DATE, level: int = LEVEL):
        self.out, self.date, self.level = out, date, level
        self.bytes = self.records = 0
        note = b"software: perkline\r\nformat: WARC File Format 1.1\r\n"
        self._open({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields", "Content-Length": len(note)})
        self._put(note)
        self._shut()

    def _open(self, fields: dict[str, object]) -> None:
        self.packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self._put(b"WARC/1.1\r\n" + _lines(fields) + b"\r\n")

    def _put(self, plain: bytes, end: bool = False) -> None:
        raw = self.packer.compress(plain) + (self.packer.flush() if end else b"")
        self.bytes += len(raw)
        self.out.write(raw)

    def _shut(self) -> None:
        self._put(b"\r\n\r\n", end=True)
        self.records += 1

    def begin(self, page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None = None) -> None:
        head = b"HTTP/1.1 200 OK\r\n" + _lines({"Content-Type": "text/html; charset=utf-8", "Content-Length": size}) + b"\r\n"
        again = refers_to is not None
        self.left, self.digest, self.seen = 0 if again else size, None if again else digest, sha256()
        self._open({
            "WARC-Type": "revisit" if again else "response",
            "WARC-Record-ID": record_id(page_id, digest),
            "WARC-Date": self.date,
            "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
            "WARC-Payload-Digest": f"sha256:{digest}",
            "WARC-Profile": REVISIT_PROFILE if again else None,
            "WARC-Refers-To": record_id(refers_to, digest) if again else None,
            "X-Page-ID": page_id,
            "X-Refers-To-Page-ID": refers_to,
            "Content-Type": "application/http;msgtype=response",
            "Content-Length": len(head) + self.left,
        })
        self._put(head)

    def chunk(self, data: bytes) -> None:
        self.left -= len(data)
        self.seen.update(data)
        self._put(data)

    def end(self) -> None:
        if self.left or self.digest not in (None, self.seen.hexdigest()):
            raise ValueError("the chunks are not the payload that the header names")
        self._shut()


class _Plain:
    """Bytes of an archive in plain, whether packed as gzip members or not, never more than ``most`` at once."""

    def __init__(self, file, most: int):
        self.file, self.most = file, most
        self.raw, self.held, self.unpacker = b"", b"", None

    def _more(self) -> bytes:
        """The next bytes, none at the end."""
        while True:
            if not self.raw:
                self.raw = self.file.read(self.most)
            if self.unpacker is None:
                if not self.raw:
                    return b""
                if self.raw[:2] != b"\x1f\x8b"[: len(self.raw)]:
                    out, self.raw = self.raw, b""
                    return out
                self.unpacker = zlib.decompressobj(31)
            starved = not self.raw
            out = self.unpacker.decompress(self.raw, self.most)
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, None
            else:
                self.raw = self.unpacker.unconsumed_tail
                if starved and not out:
                    raise ValueError("the archive ends inside a record")
            if out:
                return out

    def until(self, end: bytes, most: int = 1 << 20) -> bytes | None:
        """Bytes up to and with ``end``; none where the archive is over."""
        while (at := self.held.find(end)) < 0:
            if len(self.held) > most:
                raise ValueError("no end of a record's header")
            new = self._more()
            if not new:
                if self.held.strip():
                    raise ValueError("the archive ends inside a header")
                return None
            self.held += new
        out, self.held = self.held[: at + len(end)], self.held[at + len(end) :]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """``size`` bytes in pieces of ``most``."""
        while size:
            if not self.held and not (new := self._more()):
                raise ValueError("the archive ends inside a record")
            elif not self.held:
                self.held = new
            take = min(size, self.most)
            while len(self.held) < take:
                new = self._more()
                if not new:
                    raise ValueError("the archive ends inside a record")
                self.held += new
            out, self.held = self.held[:take], self.held[take:]
            size -= take
            yield out


def _fields(head: bytes) -> dict[str, str]:
    rows = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in rows}


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def chunk_rows(file, path: str, chunk: int = CHUNK) -> Iterator[dict[str, object]]:
    """The chunk table of one archive, in its order; raises where a record is not what its header says."""
    plain, record = _Plain(file, chunk), 0
    while (head := plain.until(b"\r\n\r\n")) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        left = int(fields["content-length"])
        row = {
            "path": path, "record": record, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
            "page_id": _number(fields.get("x-page-id")), "refers_to": _number(fields.get("x-refers-to-page-id")),
        }
        named = fields.get("warc-payload-digest", "").partition(":")
        http = {}
        if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
            inner = plain.until(b"\r\n\r\n")
            if inner is None or len(inner) > left:
                raise ValueError(f"record {record} of {path} has no HTTP header")
            left, http = left - len(inner), _fields(inner)
        if row["record_type"] == "revisit" and not left:
            yield row | {"chunk": 0, "last": True, "payload_bytes": _number(http.get("content-length")), "payload_digest": named[2] or None, "data": None}
        else:
            seen, size, number = sha256(), 0, 0
            for data in plain.pieces(left) if left else [b""]:
                seen.update(data)
                size += len(data)
                yield row | {"chunk": number, "last": size == left, "payload_bytes": size, "payload_digest": seen.hexdigest(), "data": data}
                number += 1
            if named[0] == "sha256" and named[2] != seen.hexdigest():
                raise ValueError(f"record {record} of {path} is damaged")
        record += 1
        if plain.until(b"\r\n\r\n") is None:
            raise ValueError(f"record {record} of {path} has no end")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES, chunk: int = CHUNK, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write a record per page to archives below ``folder``; returns the stored manifest of archives.

    Each attempt of a task writes archives of its own names and the manifest lists those of
    the attempts that counted.
    """
    own = payloads(pages)
    again = revisits(own, least)
    keyed = own.withColumn("key", F.coalesce("page_id", F.lit(_NULL_ID)))
    sure, maybe = shared.parted(keyed, again.select(F.coalesce("page_id", F.lit(_NULL_ID)).alias("key")), "key")
    other = again.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest")).distinct()
    first = maybe.join(other, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left_anti")
    later = again.select("page_id", "url", "bytes", "digest", "refers_to", F.lit(0).alias("chunk"), F.lit(None).cast("binary").alias("data"))
    rows = chunked(sure, chunk).unionByName(chunked(first, chunk)).unionByName(later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = file = path = None
        left = 0
        for batch in batches:
            for page_id, url, size, digest, refers_to, number, data in zip(*[c.to_pylist() for c in batch.columns]):
                if not number:
                    if out is not None and out.bytes >= file_bytes:
                        file.close()
                        yield _batch([(path, out.records, out.bytes)], MANIFEST)
                        out = None
                    if out is None:
                        system, place = _filesystem(folder)
                        system.create_dir(place, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, file = f"{folder}/{name}", system.open_output_stream(f"{place}/{name}", compression=None)
                        out = Writer(file, date)
                    out.begin(page_id, url, size, digest, refers_to)
                    left = 0 if refers_to is not None else size
                if data:
                    out.chunk(data)
                    left -= len(data)
                if not left:
                    out.end()
        if out is not None:
            file.close()
            yield _batch([(path, out.records, out.bytes)], MANIFEST)

    return shared.stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives: ``RECORDS`` and ``data``.

    ``payload_bytes`` and ``payload_digest`` are those of the payload up to the end of the
    chunk; a revisit has one row with those of the payload it refers to.
    """
    schema = RECORDS + ", data binary" * with_data
    names = [c.split()[0] for c in schema.split(", ")]
    spread = manifest.select("path").repartition(shared.partitions_for(manifest.sparkSession, 1), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _filesystem(path)
                with system.open_input_stream(place, compression=None) as file:
                    held, size = [], 0
                    for row in chunk_rows(file, path, chunk):
                        held.append(tuple(row[n] for n in names))
                        size += 64 + (len(row["data"] or b"") if with_data else 0)
                        if size > 4 << 20:
                            yield _batch(held, schema)
                            held, size = [], 0
                    if held:
                        yield _batch(held, schema)

    return spread.mapInArrow(run, schema)


def records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page's record, from its last chunk."""
    pages = chunks.filter(F.col("last") & F.col("record_type").isin("response", "revisit"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def dangling(chunks: DataFrame) -> DataFrame:
    """Revisit records whose response, with that payload, is not in the archives."""
    found = records(chunks)
    there = found.filter(F.col("record_type") == "response").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return found.filter(F.col("record_type") == "revisit").join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
g AS (SELECT *, payload_bytes >= {LEAST_BYTES} AND first_id IS NOT NULL AND (page_id IS NULL OR page_id > first_id) AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first_id END AS refers_to FROM g
"""
