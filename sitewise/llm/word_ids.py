"""Ids of a word-piece tokenizer file at corpus speed.

The tokenizer splits a text into words and codes each word by itself, so a word is coded
once by the tokenizer's model alone and its ids are kept. That holds for texts of
printable ASCII and Latin-1 letters, whose lower case, splitting and byte letters are
spelled out here; any other text, and texts that may hold a special token, go through the
tokenizer whole. Kept words are of two generations: when the newer is full it becomes the
older, and a word that is met again moves to the newer, so frequent words stay known.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np

CACHED_WORDS = 250_000
TOGETHER = 64
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
# The file's own splitting rule for such texts: contractions, letters, single digits, other signs.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")

# The letters that stand for bytes outside ASCII in the file's vocabulary, by the byte-level rule:
# a byte is its own Latin-1 letter, but those without a visible one follow from U+0121 on.
_BYTE_LETTERS = {byte: 0x121 + byte - 0x7F for byte in range(0x7F, 0xA1)} | {0xAD: 0x143}


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        code, older, ids, ends = self.model.tokenize, self.older, [], []
        fresh = []
        for word in words:
            if (kept := older.get(word)) is not None:
                self.known[word] = kept
                continue
            fresh.append(word)
            ids += [piece.id for piece in code(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        self.known.update(zip(fresh, (raw[i:j] for i, j in zip([0, *ends[:-1]], ends))))

    def many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            few = texts[at:at + TOGETHER]
            split = [_WORD.findall(t.lower()) if "<|" not in t and _PLAIN.fullmatch(t) else None for t in few]
            words = set(chain.from_iterable(filter(None, split)))
            new = words.difference(self.known)
            if len(self.known) + len(new) > CACHED_WORDS:  # the few texts' words must all be known together
                self.known, self.older, new = {}, self.known, words
            self._learn(list(new))
            known = self.known.__getitem__
            out += [self.whole(t) if found is None else b"".join(map(known, found)) for t, found in zip(few, split)]
        return out


@cache
def word_ids(path: str) -> WordIds:
    """One per worker."""
    return WordIds(path)
