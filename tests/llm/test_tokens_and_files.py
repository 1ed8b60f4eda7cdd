"""Packing, token files and piece merging against the tokenizer libraries."""

from __future__ import annotations

import io
import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from perkline.llm import merge_pieces, packing, shared, token_files, tokens
from tests.llm.helpers import edge_docs, edge_texts, empty_docs, prose

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    return lambda text: np.array(own.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_those_of_whole_texts(library):
    rng = random.Random(1)
    odd = list("ab1!' \n\t\r\xa0\x1c\x85　é½́") + ["'s", "<|endoftext|>", "  ", "\n "]
    texts = [t for _, t in edge_texts()] + ["".join(rng.choices(odd, k=rng.randint(1, 12))) for _ in range(3000)]
    assert tokens.encode_all(BYTES, texts) == [library(t) for t in texts]


def test_file_round_trip_and_seek():
    out = io.BytesIO()
    writer = token_files.Writer(out, frame_tokens=16)
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 3, 40, 1, 9, 9, 0, 200)]
    for i, x in enumerate(ids):
        writer.add(None if i == 0 else i, x)
    writer.finish()
    raw, read = out.getvalue(), []

    def read_at(at, n):
        read.append(n)
        return raw[at : at + n]

    assert len(raw) == writer.bytes
    assert [d[2] for d in token_files.Reader(read_at, len(raw)).documents()] == ids
    read.clear()
    assert [d[:2] for d in token_files.Reader(read_at, len(raw)).documents({4})] == [(4, 44)]
    assert len(read) == 4  # footer, table, index, one frame
    damaged = bytearray(raw)
    damaged[12] ^= 1
    with pytest.raises(Exception):
        list(token_files.Reader(lambda at, n: bytes(damaged[at : at + n]), len(raw)).documents())


def test_token_files(spark, library):
    docs = edge_docs(spark)
    manifest = token_files.write(docs, BYTES, shared.new_folder(spark, "test-files"), frame_tokens=500)
    end = b"\0\0\0\0"
    want, at = [], 0
    for doc_id, text in sorted(edge_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library(text) + end
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = [tuple(r) for r in token_files.read(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    some = token_files.read(manifest, only={40, 62}, with_ids=True).collect()
    assert {r["doc_id"] for r in some} == {40, 62} and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in some)
    assert token_files.read(token_files.write(empty_docs(spark), BYTES, shared.new_folder(spark, "test-files"))).count() == 0


def test_packing_covers_every_token_without_gaps(spark, library):
    capacity = 256
    pieces = shared.stored(packing.pieces(edge_docs(spark), BYTES, capacity, with_ids=True), "test-pieces")
    rows = packing.packed(pieces, capacity).collect()
    assert len(rows) == pieces.count()
    sequences: dict[int, list] = {}
    whole: dict[tuple, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        whole.setdefault((r["doc_id"], r["copy"]), []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    texts = []
    for (doc_id, _), own in whole.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == capacity for r in own[1:])
        texts.append((doc_id, b"".join(r["ids"] for r in own)))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(texts, key=key) == sorted([(i, library(t) + b"\0\0\0\0") for i, t in edge_texts()], key=key)
    assert len(sequences) <= 1.06 * sum(r["length"] for r in rows) / capacity + 2


def test_packing_plans_are_valid_and_tight():
    rng = np.random.default_rng(3)
    for counts in (np.zeros(65, np.int64), np.eye(1, 65, 64, dtype=np.int64)[0] * 7, rng.integers(0, 50, 65), np.where(np.arange(65) == 40, 10**9, 0), np.r_[0, 5, np.zeros(63, np.int64)]):
        counts[0] = 0
        plan = packing.planned(counts, 64)
        slots = np.bincount(plan.length, minlength=65)
        assert all(slots[n] for n in np.flatnonzero(counts))
        assert plan.sequences >= -(-int((counts * np.arange(65)).sum()) // 64)
    full = rng.integers(50, 100, 65)
    full[0] = 0
    assert packing.planned(full, 64).sequences <= 1.01 * (full * np.arange(65)).sum() / 64 + 1


def test_a_full_memo_goes_on_with_the_pieces_at_hand(library, monkeypatch):
    texts = [t or "" for _, t in edge_texts()]
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 40)
    for at in range(0, len(texts), 3):
        own = texts[at : at + 3]
        assert tokens.encode_all(BYTES, own) == [library(t) for t in own]
        assert tokens.encode_all(BYTES, own[::-1]) == [library(t) for t in own[::-1]]


def fewest(lengths, capacity):
    """Fewest sequences by trying every place for every piece."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0] and i < len(lengths):
            return
        if i == len(lengths):
            best[0] = min(best[0], len(rooms))
            return
        for room in set(rooms):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_small_plans_against_search():
    rng = np.random.default_rng(11)
    exact = 0
    for _ in range(120):
        lengths = sorted(rng.integers(1, 21, rng.integers(1, 10)).tolist(), reverse=True)
        want, got = fewest(lengths, 20), packing.planned(np.bincount(lengths, minlength=21), 20).sequences
        assert want <= got <= want + 1
        exact += got == want
    assert exact >= 115


def test_most_mixed_sequences_come_from_patterns():
    """Also where each length is there once or twice, so that every fitted count is below one."""
    rng = np.random.default_rng(2)
    for scale in (1, 30):
        counts = np.bincount(np.minimum(512, (rng.pareto(1.2, 4000) * 60).astype(int) + 4), minlength=513) * scale
        plan, least = packing.planned(counts, 512), -(-int((counts * np.arange(513)).sum()) // 512)
        plain = sum(k[1] for k in packing._best_fit(counts.astype(np.int64), 512))
        assert plan.patterned > (plan.sequences - counts[512]) / 2
        assert least <= plan.sequences <= plain + 1


def test_empty_table_packs_to_nothing(spark):
    assert packing.packed(shared.stored(packing.pieces(empty_docs(spark), BYTES), "test-pieces")).count() == 0


def test_pieces_and_their_text_are_the_librarys(spark):
    rng = random.Random(2)
    own = merge_pieces.vocabulary(PIECES)
    odd = list("ab1.' \n\t\xa0▁é½ ́日") + ["<s>", "<0x0A>", "\x00", "\U0001f600", "  "]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 9))) for _ in range(2000)] + [prose(rng, 300)]
    ids = own.encode_all(texts)
    assert ids == own.library.encode(texts, add_bos=True, add_eos=True)
    assert [own.decode(x) for x in ids] == [own.library.decode(x) for x in ids]
    got = {(r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in merge_pieces.digests(edge_docs(spark), PIECES).collect()}
    want = set()
    for doc_id, text in edge_texts():
        x = own.library.encode(text or "", add_bos=True, add_eos=True)
        want.add((doc_id, sha256(np.array(x, "<u4").tobytes()).hexdigest(), sha256(own.library.decode(x).encode()).hexdigest(), len(x)))
    assert got == want
    both = merge_pieces.decoded(merge_pieces.encoded(edge_docs(spark), PIECES), PIECES).collect()
    assert {(r["doc_id"], r["text"]) for r in both} == {(i, own.library.decode(own.library.encode(t or ""))) for i, t in edge_texts()}
    assert merge_pieces.digests(empty_docs(spark), PIECES).count() == 0


def test_arrow_texts_are_encoded_by_their_different_pieces(library, monkeypatch):
    """Each different piece is looked up once a call, however often it stands there; slices of a column start anywhere."""
    texts = ["", None, "one", "\nOne two", "  two", "two, two\n\nTwo two"] + ["word other, word\nWord other, ß, élan x"] * 50
    column = pa.array(["cut off", *texts, None]).slice(1, len(texts))
    assert tokens.encode_all(BYTES, column) == [library(t) for t in texts]
    assert tokens.encode_all(BYTES, column.slice(0, 0)) == []
    looked_up = []

    class Kept(dict):
        def get(self, piece, other=None):
            looked_up.append(piece)
            return super().get(piece, other)

    own = tokens._encoder(BYTES)
    monkeypatch.setattr(own, "kept", Kept(own.kept))
    assert tokens.encode_all(BYTES, column) == [library(t) for t in texts]
    assert looked_up and len(looked_up) == len({*looked_up})


def test_workers_let_go_of_pieces_when_they_go_on_to_other_work(library):
    tokens.encode_all(BYTES, ["some words to keep"])
    assert list(shared.trimmed(iter, encodes=True)(iter([]))) == [] and tokens._encoder.cache_info().currsize == 1
    assert list(shared.trimmed(iter)(iter([]))) == [] and tokens._encoder.cache_info().currsize == 0
    assert tokens.encode_all(BYTES, ["some words to keep"]) == [library("some words to keep")]
