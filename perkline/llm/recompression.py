"""Consistent names for the parts of token sequences, by rounds of naming runs and pairs.

A round names every run of equal symbols, or every pair of a left and a right symbol (a
bit of the symbol's own name says which it is), by a hash of what it is made of.  So the
same text gets the same name wherever it stands, in every task, without a table.  What a
symbol's place in its round depends on is kept as an interval of words: the same words
over that interval give the same symbol, in any document.

A window of consecutive words is stood for by its anchors: the symbols of the highest
round whose intervals lie inside the window.  Every window has some, as single words are
symbols of round 0, and equal windows have equal anchors at equal places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from perkline.llm.words import mix

PAIR_ROUNDS = 8
RUN_BEFORE = (0,)
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass
class Anchors:
    """Anchor names with their text and the first and last window they stand for; windows are numbered by their first word.

    ``level`` is the round of an anchor and ``of_window`` the round that stands for a window (-1: no window starts there).
    """

    name: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    level: np.ndarray
    of_window: np.ndarray


def _runs(name, a, b, low, high, text, salt):
    same = (name[1:] == name[:-1]) & (text[1:] == text[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    count = np.diff(np.concatenate([head, [len(name)]]))
    last = head + count - 1
    new = np.where(count > 1, mix(name[head] * _A + count.astype(np.uint64) * _B + salt), name[head])
    # A run ends where its neighbours differ, so it depends on both of them.
    before, after = np.maximum(head - 1, 0), np.minimum(last + 1, len(name) - 1)
    left = np.where((head > 0) & (text[before] == text[head]), low[before], a[head] - 1)
    right = np.where((last + 1 < len(name)) & (text[after] == text[head]), high[after], b[last] + 1)
    return new, a[head], b[last], np.minimum(left, low[head]), np.maximum(right, high[last]), text[head]


def _pairs(name, a, b, low, high, text, salt):
    right = (mix(name ^ salt) >> np.uint64(63)).astype(bool)
    next_to = text[1:] == text[:-1]
    joins = np.zeros(len(name), bool)
    joins[:-1] = ~right[:-1] & right[1:] & next_to
    gone = np.zeros(len(name), bool)
    gone[1:] = joins[:-1]
    new_low, new_high = low.copy(), high.copy()
    # A left symbol depends on the one behind it, a right symbol on the one before it.
    then = np.concatenate([np.where(next_to, high[1:], b[:-1] + 1), b[-1:] + 1])
    prior = np.concatenate([a[:1] - 1, np.where(next_to, low[:-1], a[1:] - 1)])
    new_high = np.where(~right, np.maximum(high, then), high)
    new_low = np.where(right, np.minimum(low, prior), low)
    at = np.flatnonzero(joins)
    new, new_b = name.copy(), b.copy()
    new[at] = mix(name[at] * _A + name[at + 1] * _B + salt)
    new_b[at] = b[at + 1]
    new_low[at] = np.minimum(low[at], low[at + 1])
    new_high[at] = np.maximum(high[at], high[at + 1])
    keep = ~gone
    return new[keep], a[keep], new_b[keep], new_low[keep], new_high[keep], text[keep]


def levels(hashes: np.ndarray, first: np.ndarray, rounds: int = PAIR_ROUNDS):
    """Symbols of each round: name, first word, end, interval of words it depends on, text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    a = np.arange(len(hashes))
    state = hashes, a, a + 1, a, a + 1, text
    out = [state]
    for k in range(rounds):
        if not len(state[0]):
            break
        if k in RUN_BEFORE:
            state = _runs(*state, np.uint64(2 * k + 1))
        state = _pairs(*state, mix(np.array([2 * k + 2], np.uint64))[0])
        out.append(state)
    return out


def anchors(hashes: np.ndarray, first: np.ndarray, length: int, rounds: int = PAIR_ROUNDS) -> Anchors:
    """Anchors of all windows of ``length`` words."""
    n = len(hashes)
    sizes = np.diff(first)
    valid = np.zeros(n + 1, np.int64)
    full = sizes >= length
    np.add.at(valid, first[:-1][full], 1)
    np.add.at(valid, first[1:][full] - length + 1, -1)
    open_window = np.cumsum(valid)[:n] > 0
    of_window = np.full(n, -1, np.int8)
    parts = []
    all_levels = levels(hashes, first, rounds) if n else []
    for level in range(len(all_levels) - 1, -1, -1):
        if not open_window.any():
            break
        name, _, _, low, high, text = all_levels[level]
        lo = np.maximum(high - length, first[text])
        hi = np.minimum(low, first[text + 1] - length)
        some = np.flatnonzero((lo <= hi) & (low >= first[text]) & (high <= first[text + 1]))
        change = np.bincount(lo[some], minlength=n + 1) - np.bincount(hi[some] + 1, minlength=n + 1)
        now = (np.cumsum(change)[:n] > 0) & open_window
        of_window[now] = level
        open_window &= ~now
        seen = np.concatenate([[0], np.cumsum(now)])
        some = some[seen[hi[some] + 1] > seen[lo[some]]]
        parts.append((name[some], text[some], lo[some], hi[some], np.full(len(some), level, np.int8)))
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(np.uint64), none, none, none, none.astype(np.int8), of_window)
    return Anchors(*(np.concatenate(x) for x in zip(*parts)), of_window)


def windows_with_all(found: Anchors, good: np.ndarray) -> np.ndarray:
    """Whether all anchors of each window are ``good``; False where no window starts."""
    out = found.of_window >= 0
    n = len(out)
    for level in np.unique(found.level[~good]).tolist():
        bad = np.flatnonzero(~good & (found.level == level))
        change = np.bincount(found.low[bad], minlength=n + 1) - np.bincount(found.high[bad] + 1, minlength=n + 1)
        out &= ~((np.cumsum(change)[:n] > 0) & (found.of_window == level))
    return out
