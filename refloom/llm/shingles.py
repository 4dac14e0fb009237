"""Word shingles of many texts at once: 64-bit hashes by numpy, no Python object per word."""

from __future__ import annotations

import numpy as np

from . import common

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse mod 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_HALF = np.uint64(32)
#: Bytes hashed in one go; a piece ends at a space, so a longer word makes a longer piece.
PIECE = 1 << 18

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _MIX
    return h ^ (h >> _HALF)


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, where they begin)."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * power[: len(b)], out=sums[1:])
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = b != 32
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), starts


def word_hashes(text: bytes, words: bytes = common.ALNUM_WORDS) -> np.ndarray:
    """Hashes of the words in order. words: a table that maps bytes, those between words to a space; by default words are
    A-Z lower-cased runs of 0-9, a-z and characters above 0x7F."""
    return _hashes_at(text.translate(words))[0]


def _hashes_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) <= PIECE:
        return _piece_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        hashes, starts = _piece_hashes(data[at:end])
        parts.append((hashes, starts + at))
        at = end
    return np.concatenate([h for h, _ in parts]), np.concatenate([x for _, x in parts])


def words_of_all(texts: list[bytes], words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(word_hashes of all texts in a row, how many words each has)."""
    hashes, starts = _hashes_at(b"".join(t + b" " for t in texts).translate(words))
    return hashes, np.diff(np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts])))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of fewer words, but not none, one run."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    count = len(words) - k + 1
    total = np.zeros(count, np.uint64)
    for i in range(k):
        total = total * _STEP + words[i : i + count]
    return mixed(total + np.uint64(k))
