"""Fill-in-the-middle documents, cut at line boundaries found by descent in a Fenwick tree.

A text is looked at as UTF-8 bytes in fixed blocks. A Fenwick tree over the blocks holds
how many units (lines) end in each and how many code points start in each. A cut after
the k-th unit is found by binary lifting: the descent sums whole subtrees until it stands
at the block in which that unit ends, having counted the code points before it, and only
that block is searched for its line ends. Blocks are counted once for both cuts.

The task returns two byte offsets and counts; the pieces are cut and put in order by
column functions, so texts go to Python once and do not come back.

Cuts and forms come from the SHA-256 of ``seed:doc_id``; a null id counts as the empty
string. Null text is empty. Empty texts and texts that hold one of the sentinels keep the
``plain`` form with null piece counts. A text of any length is one row and is held once in
memory; blocks bound only the search. Equal rows give equal rows. No rows: no rows. Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_NEWLINE = 10


@dataclass(frozen=True)
class FillParams:
    seed: int = 7
    percent: int = 100  # texts that are transformed
    spm_percent: int = 50  # of these, in suffix-prefix-middle order
    block_bytes: int = 1024


class UnitTree:
    """A Fenwick tree over the blocks of one text."""

    def __init__(self, text: bytes, block_bytes: int):
        self.text, self.step = np.frombuffer(text, np.uint8), block_bytes
        starts = np.arange(0, len(text), block_bytes)
        self.ends, self.leads = self.text == _NEWLINE, (self.text & 0xC0) != 0x80
        self.open_end = len(text) > 0 and text[-1] != _NEWLINE
        units = np.add.reduceat(self.ends, starts, dtype=np.int64) if len(text) else np.zeros(0, np.int64)
        points = np.add.reduceat(self.leads, starts, dtype=np.int64) if len(text) else np.zeros(0, np.int64)
        if self.open_end:
            units[-1] += 1
        self.units, self.points, self.n = self._tree(units), self._tree(points), int(units.sum())

    @staticmethod
    def _tree(counts: np.ndarray) -> list[int]:
        """Node ``i`` holds the counts of the ``i & -i`` blocks that end at block ``i``."""
        upto, at = np.r_[0, counts.cumsum()], np.arange(len(counts) + 1)
        return (upto - upto[at - (at & -at)]).tolist()

    def cut(self, k: int) -> tuple[int, int]:
        """Byte offset behind the ``k``-th unit, and the code points before that offset."""
        if k == 0:
            return 0, 0
        block, units, points, stride = 0, 0, 0, 1 << (len(self.units) - 1).bit_length()
        while stride:
            ahead = block + stride
            if ahead < len(self.units) and units + self.units[ahead] < k:
                block, units, points = ahead, units + self.units[ahead], points + self.points[ahead]
            stride >>= 1
        start = block * self.step
        inside = np.flatnonzero(self.ends[start:start + self.step])
        wanted = k - units - 1
        offset = start + int(inside[wanted]) + 1 if wanted < len(inside) else len(self.text)
        return offset, points + int(np.count_nonzero(self.leads[start:offset]))


_CUTS = "n long, from_byte long, to_byte long, prefix_chars long, middle_chars long"


def _cuts(batches: Iterator[tuple[pd.Series, ...]], params: FillParams) -> Iterator[pd.DataFrame]:
    for texts, first, second in batches:
        rows = []
        for text, h1, h2 in zip(texts, first, second):
            tree = UnitTree(bytes(text), params.block_bytes)
            low, high = sorted((int(h1) % (tree.n + 1), int(h2) % (tree.n + 1)))
            (a, before), (b, upto) = tree.cut(low), tree.cut(high)
            rows.append((tree.n, a, b, before, upto - before))
        yield pd.DataFrame(rows, columns=["n", "from_byte", "to_byte", "prefix_chars", "middle_chars"])


def transform(docs: DataFrame, params: FillParams = FillParams()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs`` (``doc_id``, ``text``)."""
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    sentinel = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | sentinel | (h[2] % 100 >= params.percent), "plain").when(h[3] % 100 < params.spm_percent, "spm").otherwise("psm")

    # Annotations choose the iterator form of the function.
    def of_batches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return _cuts(batches, params)

    cuts = F.pandas_udf(of_batches, _CUTS)
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    cut = rows.select("doc_id", "form", F.col("text").cast("binary").alias("t"), cuts(F.col("text").cast("binary"), "h1", "h2").alias("c"))
    size, a, b = F.octet_length("t"), F.col("c.from_byte").cast("int"), F.col("c.to_byte").cast("int")
    one = F.lit(1)
    prefix, middle, suffix = F.substring("t", one, a), F.substring("t", a + 1, b - a), F.substring("t", b + 1, size - b)
    mark = {s: F.lit(s).cast("binary") for s in (PREFIX, SUFFIX, MIDDLE)}
    output = F.when(F.col("form") == "plain", F.col("t")) \
        .when(F.col("form") == "psm", F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)) \
        .otherwise(F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle))
    cutting = F.col("form") != "plain"
    return cut.select("doc_id", "c.n", "form", F.when(cutting, F.col("c.prefix_chars")).alias("prefix_chars"),
                      F.when(cutting, F.col("c.middle_chars")).alias("middle_chars"), output.cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.

    No piece holds a sentinel, and a sentinel cannot arise where a piece meets one, so the
    three sentinels part the output exactly.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one, two, middle = F.get(parts, 1), F.get(parts, 2), F.get(parts, 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
