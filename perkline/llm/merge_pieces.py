"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback.

A unit is a run of blanks with the characters after it.  No piece goes on over the end of
a unit, so units are merged one by one: an agenda ordered by score (then by place) gives
the adjacent pair to join next, until no pair is a piece.  Each new unit of an Arrow batch
is merged once per worker, and the ids are checked against the sentencepiece library in
the same batch; a difference raises.  Whole texts are put together from units.

A null or empty text gives the begin and end ids only.  Rows are independent: repeated
rows get equal results, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from perkline.llm import shared

BLANK = "▁"
MEMO_UNITS = 1_000_000
LONGEST_KEPT = 48
_UNITS = re.compile(rf"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


class Vocabulary:
    """Pieces and scores of one model, and the ids of units seen so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.vocab_size())
        self.special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i)}
        plain = [i for i in ids if i not in self.special and not lib.is_byte(i) and not lib.is_unused(i)]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.order = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        self.bytes = {int(lib.id_to_piece(i)[3:-1], 16): i for i in ids if lib.is_byte(i)}
        if len(self.bytes) < 256 or any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError(f"{path} has no byte fallback, or has pieces over the end of a unit")
        values = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()} | {i: b"" for i in self.special}
        self.values = [values.get(i, b"") for i in ids]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.kept: dict[str, list[int]] = {}

    def merged(self, unit: str) -> list[int]:
        """Ids of one unit: join the best-scored adjacent pair, the leftmost of equal ones, as long as there is one."""
        order, symbols = self.order, list(unit)
        last = len(symbols)
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        agenda = []
        for i in range(last - 1):
            both = symbols[i] + symbols[i + 1]
            if both in order:
                agenda.append((order[both], i, i + 1, both))
        heapify(agenda)
        while agenda:
            _, left, right, both = heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(both):
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = then = after[right]
            if then < last:
                before[then] = left
                wider = both + symbols[then]
                if wider in order:
                    heappush(agenda, (order[wider], left, then, wider))
            if (prior := before[left]) >= 0:
                wider = symbols[prior] + both
                if wider in order:
                    heappush(agenda, (order[wider], prior, left, wider))
        out = []
        for s in symbols:
            if s in self.ids:
                out.append(self.ids[s])
            elif s:
                out.extend(map(self.bytes.__getitem__, s.encode()))
        return out

    def learn(self, units: list[str]) -> dict[str, list[int]]:
        """Merge new units and hold them against the library, which gets each behind a line break."""
        found = {u: self.merged(u) for u in units}
        lead = [self.ids[BLANK], self.bytes[10]]
        for u, ids in zip(units, self.library.encode(["\n" + u.replace(BLANK, " ") for u in units], num_threads=1)):
            if ids != lead + found[u]:
                raise ValueError(f"the library gives other ids for {u!r}")
        return found

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text between the begin and end ids."""
        cut = [_UNITS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.kept)
        if len(self.kept) + len(new) > MEMO_UNITS:
            self.kept = {}
            new = set().union(*cut)
        self.kept.update(self.learn(list(new)))
        kept, out = self.kept, []
        for units in cut:
            ids = [self.begin]
            for u in units:
                ids += kept[u]
            ids.append(self.end)
            out.append(ids)
        for u in [u for u in new if len(u) > LONGEST_KEPT]:
            del kept[u]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of all pieces, blanks as spaces, without the space that encoding put in front."""
        text = b"".join(map(self.values.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array of int, with begin and end ids) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = vocabulary(model).encode_all(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return shared.over_text(docs, ["doc_id", "text"], run, "doc_id long, ids array<int>")


def decoded(found: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vocabulary(model)
            texts = [own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return found.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass, without the ids leaving the task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = vocabulary(model), batch.column(1).to_pylist()
        ids = own.encode_all(texts)
        back = [own.decode(x) for x in ids]
        longest = max(range(len(ids)), key=lambda i: -len(ids[i]) if len(ids[i]) > 50_000 else len(ids[i]), default=None)
        if longest is not None and (own.library.encode(texts[longest] or "", add_bos=True, add_eos=True) != ids[longest] or own.library.decode(ids[longest]) != back[longest]):
            raise ValueError(f"the library gives another result for document {batch.column(0)[longest]}")
        columns = [
            batch.column(0),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([sha256(x.encode()).hexdigest() for x in back], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return shared.over_text(docs, ["doc_id", "text"], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
