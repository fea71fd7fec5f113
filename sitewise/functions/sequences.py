"""Column functions over nucleotide text."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.functions.binding import let

# Fixed value: the alphabet, in feature order.
BASES = "ACGT"


def kmer_names(k: int = 3) -> list[str]:
    return ["".join(p) for p in product(BASES, repeat=k)]


def motif_class(motif: Column) -> Column:
    """The 5-letter motif if it matches the consensus, else why it does not."""
    # Fixed value: the consensus pattern.
    return (
        F.when(motif.isNull() | (F.length(motif) != 5), "window_unavailable")
        .when(motif.rlike("^[AGT][AG]AC[ACT]$"), motif)
        .otherwise("non_DRACH")
    )


def seq_window(seq: Column, pos: Column, half: int) -> Column:
    """``2*half+1`` letters centred on 1-based ``pos``; empty when they do not all exist."""
    full = (pos > half) & (pos <= F.length(seq) - half)
    return F.when(full, F.substring(seq, pos - half, F.lit(2 * half + 1))).otherwise("")


def gc_fraction(seq: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(seq, "[^GC]", "")), F.length(seq))


def normalise_sequence(seq: Column) -> Column:
    return F.replace(F.upper(seq), F.lit("U"), F.lit("T"))


def is_acgt(seq: Column) -> Column:
    return seq.rlike("^[ACGT]+$")


def base_at(seq: Column, pos: Column) -> Column:
    """Letter at 1-based ``pos``; NULL outside the sequence."""
    return F.when((pos >= 1) & (pos <= F.length(seq)), F.substring(seq, pos, F.lit(1)))


def kmers(seq: Column, k: int = 3) -> Column:
    """All overlapping k-letter pieces, in order."""
    def pieces(letters: Column) -> Column:
        joined = F.transform(letters, lambda x, i: F.concat(x, *[F.get(letters, i + j) for j in range(1, k)]))
        return F.slice(joined, F.lit(1), F.greatest(F.size(letters) - (k - 1), F.lit(0)))

    return F.when(F.length(seq) >= k, let(F.split(seq, ""), pieces)).otherwise(F.array().cast("array<string>"))


def kmer_denominator(seq: Column, k: int = 3) -> Column:
    return F.greatest(F.length(seq) - (k - 1), F.lit(1))


# Fixed value: letters whose k-mers are counted at once.
BLOCK_LETTERS = 1 << 18


def _letter_codes() -> np.ndarray:
    table = np.full(256, -1, dtype=np.int64)
    for code, base in enumerate(BASES):
        table[ord(base)] = code
        table[ord(base.lower())] = code
    return table


def kmer_fractions(k: int = 3):
    """Arrow UDF: fixed-order k-mer frequency vector of each sequence.

    Counting k-mers in place with built-ins takes one pass per k-mer; this takes
    one pass per block of a batch. A block holds ``BLOCK_LETTERS`` or one sequence, as
    the numbers worked on take some forty bytes a letter.
    """
    size = len(BASES) ** k

    def counted(texts: list[str]) -> np.ndarray:
        codes = _letter_codes()[np.frombuffer("".join(texts).encode("ascii", "replace"), dtype=np.uint8)]
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        n = max(len(codes) - k + 1, 0)
        word, usable = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for j in range(k):
            piece = codes[j:j + n]
            usable &= piece >= 0
            word = word * len(BASES) + np.maximum(piece, 0)
        usable &= row[:n] == row[k - 1:k - 1 + n]
        counts = np.bincount(row[:n][usable] * size + word[usable], minlength=len(texts) * size)
        return counts.reshape(len(texts), size) / np.maximum(lengths - k + 1, 1)[:, None]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fractions(seqs: pd.Series) -> pd.Series:
        out, block, letters = [], [], 0
        for text in seqs.fillna(""):
            if block and letters + len(text) > BLOCK_LETTERS:
                out.extend(counted(block))
                block, letters = [], 0
            block.append(text)
            letters += len(text)
        if block:
            out.extend(counted(block))
        return pd.Series(out, dtype=object)

    return fractions


def position_one_hot(seq: Column, width: int) -> Column:
    """``width * 4`` indicators, position-major in alphabet order."""
    bases = F.array(*[F.lit(b) for b in BASES])
    spots = F.sequence(F.lit(0), F.lit(width - 1))
    return let(F.split(seq, ""), lambda letters: F.flatten(F.transform(spots, lambda i: F.transform(
        bases, lambda b: F.when(F.get(letters, i) == b, 1.0).otherwise(0.0)))))


def to_acgt(text: Column) -> Column:
    """Project free text onto the four letters (used by checks on text tables)."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    mapped = "".join(BASES[i % 4] for i in range(len(alphabet)))
    return F.regexp_replace(F.translate(F.lower(text), alphabet, mapped), "[^ACGT]", "")
