"""Word shingles of many texts at once.

Words are runs of bytes other than the six ASCII blanks, A-Z lower-cased. A word's hash is
a polynomial in its bytes, taken for all words of a slice as differences of one running
sum; a shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
SLICE_BYTES = 1 << 20
_BASE, _FACTOR = 0x9E6C63D0876A3F6B, 0x9E3779B97F4A7C15
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, _U)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _of_slice(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a slice."""
    a = np.frombuffer(data, np.uint8)
    word = (a != 32) & ((a < 9) | (a > 13))
    turns = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = turns[::2], turns[1::2]
    # Sizes are rounded up so that few tables of powers are made.
    power, inverse = _powers(1 << max(10, len(a).bit_length()))
    upto = np.concatenate([np.zeros(1, _U), ((a.astype(_U) + _U(1)) * power[:len(a)]).cumsum(dtype=_U)])
    return starts, mix((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(_FACTOR))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and each text's number of words."""
    data = b"\n".join([t or b"" for t in texts]).lower()
    begins = np.cumsum([0, *[len(t or b"") + 1 for t in texts]])
    starts, found, at = [], [], 0
    while at < len(data):
        gap = _BLANK.search(data, at + SLICE_BYTES) if len(data) - at > SLICE_BYTES else None
        end = gap.end() if gap else len(data)
        s, h = _of_slice(data[at:end])
        starts.append(s + at)
        found.append(h)
        at = end
    where = np.concatenate([np.zeros(0, np.int64), *starts])
    return np.concatenate([np.zeros(0, _U), *found]), np.diff(np.searchsorted(where, begins))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with fewer words is one shingle, one without words none."""
    words, many = word_hashes(texts)
    out, at = [], 0
    whole = np.zeros(max(0, len(words) - width + 1), _U) + _U(width)
    for d in range(width):
        whole = mix(whole * _U(_FACTOR) + words[d:d + len(whole)])
    for n in many.tolist():
        if n >= width:
            s = np.sort(whole[at:at + n - width + 1])
            out.append(s[np.concatenate([np.ones(1, bool), s[1:] != s[:-1]])])
        elif n:
            one = np.full(1, n, _U)
            for d in range(n):
                one = mix(one * _U(_FACTOR) + words[at + d:at + d + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def chunks(texts: list[bytes | None], size: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= size:
            out.append((start, i + 1))
            start, held = i + 1, 0
    return out + ([(start, len(texts))] if start < len(texts) else [])
