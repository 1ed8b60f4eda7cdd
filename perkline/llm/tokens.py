"""Byte-level token ids by the tokenizers library, with a memo per worker.

The library splits a text into pre-tokens and merges the bytes of each on their own.
A pre-token never goes on over white space, so the texts are cut at spaces here, the
pre-tokens of each new piece are found with the published pattern, and the library
merges the new ones of a slice of texts in one call.  The ids are those of encoding the
whole text; the tests hold them against that.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_ENTRIES = 600_000
LONGEST_KEPT = 40
#: Marks that often end a word.
MARKS = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 letter, or the next letter from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Encoder:
    """Merges pre-tokens with the library and keeps the ids of pieces between two spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = {k: v for k, v in json.load(file).items() if k in ("normalizer", "pre_tokenizer")}
        how = made["pre_tokenizer"] or {}
        if made["normalizer"] or how.get("type") != "ByteLevel" or how["add_prefix_space"] or not how.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.merge = Tokenizer(Tokenizer.from_file(path).model).encode
        self.letters, self.split = _byte_letters(), regex.compile(PATTERN).findall
        self.space, self.line = self.letters[32], self.letters[10]
        self.kept: dict[str, bytes | None] = {}
        self.marks = self.named({*MARKS})

    def written(self, token: str) -> str:
        return token.encode().decode("latin-1").translate(self.letters)

    def merged(self, tokens: list[str]) -> list[bytes]:
        """Ids of each of the pre-tokens, which are written in byte letters."""
        found = self.merge(tokens, is_pretokenized=True, add_special_tokens=False)
        cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(tokens) + 1)) * 4
        raw, cuts = np.array(found.ids, "<u4").tobytes(), cuts.tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def named(self, tokens: set[str]) -> dict[str, bytes]:
        own = [*tokens]
        return dict(zip(own, self.merged(own)))

    def learn(self, pieces: list[str]) -> None:
        """Add pieces; one with white space of another kind gets None, and its texts go the long way.

        Most are a word, or a word and a mark: two pre-tokens, of which the word is known or learned once.
        """
        plain, marked, other = {}, [], {}
        for p in pieces:
            if p.isalpha():
                plain[p] = self.space + p if p.isascii() else self.written(f" {p}")
            elif p[-1:] in self.marks and p[:-1].isalpha():
                marked.append(p)
                body = p[:-1]
                if body not in self.kept:
                    plain[body] = self.space + body if body.isascii() else self.written(f" {body}")
            elif p[:1] == "\n" and p[1:].isalpha():
                other[p] = [self.line, p[1:] if p.isascii() else self.written(p[1:])]
            else:
                line = p[:1] == "\n"
                body = p[1:] if line else p
                other[p] = [self.written(t) for t in self.split(p if line else f" {p}")] if body.split() == [body] else None
        kept = self.kept
        kept.update(zip(plain, self.merged([*plain.values()])))
        kept.update({p: kept[p[:-1]] + self.marks[p[-1]] for p in marked})
        ids = self.named({t for x in other.values() if x for t in x})
        kept.update({p: None if x is None else b"".join([ids[t] for t in x]) for p, x in other.items()})

    def first(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces that start a text."""
        cut = [[self.written(p)] if p.isalpha() else [self.written(t) for t in self.split(p)] if p.split() == [p] else None for p in pieces]
        ids = self.named({t for x in cut if x for t in x})
        return [None if x is None else b"".join([ids[t] for t in x]) for x in cut]

    def long_way(self, text: str) -> bytes:
        tokens = [self.written(t) for t in self.split(text)]
        return b"".join(map(self.named({*tokens}).__getitem__, tokens))


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def forget() -> None:
    """Let go of all encoders with what they keep."""
    _encoder.cache_clear()


def encode_all(path: str, texts: list[str | None] | pa.Array) -> list[bytes]:
    """Ids of each text (null: none) as little-endian unsigned 32-bit integers, no special tokens.

    Arrow cuts the texts and numbers the pieces, so that only different ones become Python strings.
    """
    own = _encoder(path)
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return []
    cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
    at = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    at, codes = at - at[0], coded.indices.to_numpy().astype(np.int64)
    pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    inside = np.ones(len(codes), bool)
    inside[at[:-1]] = False
    used = np.zeros(len(pieces), bool)
    used[codes[inside]] = True
    heads, codes[at[:-1]] = np.unique(codes[at[:-1]], return_inverse=True)
    codes[at[:-1]] += len(pieces)
    found = [own.kept.get(p, b"") if u else None for p, u in zip(pieces, used.tolist())]
    new = {i: pieces[i] for i, x in enumerate(found) if x == b""}  # no piece is without ids
    if len(own.kept) + len(new) > MEMO_ENTRIES:  # pieces of this slice are the ones most likely to come again
        own.kept = {p: x for i, (p, x, u) in enumerate(zip(pieces, found, used.tolist())) if u and i not in new}
    if new:
        own.learn([*new.values()])
        for i, p in new.items():
            found[i] = own.kept[p]
    found += own.first([pieces[h] for h in heads.tolist()])
    unknown = np.array([x is None for x in found])
    found = [x or b"" for x in found]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.cumsum(n)
    places = np.arange(ends[-1]) + np.repeat(starts[codes] - (ends - n), n)
    raw = np.frombuffer(b"".join(found), "<u4")[places].tobytes()
    cuts = (np.concatenate([[0], ends])[at] * 4).tolist()
    out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    for i in np.unique(np.searchsorted(at, np.flatnonzero(unknown[codes]), "right") - 1).tolist():
        out[i] = own.long_way(column[i].as_py())
    for p in [p for p in new.values() if len(p) > LONGEST_KEPT]:
        own.kept.pop(p, None)
    return out
