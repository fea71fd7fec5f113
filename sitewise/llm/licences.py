"""Licence scan: normalised passages compared with licence templates by the Dice coefficient of their word pairs.

A passage is a line of a text, and the whole text too. Normalising lower-cases A-Z and
turns every run of characters other than a-z and 0-9 into one space. The coefficient is
``2 * common / (n + m)`` over the sets of adjacent word pairs. A coefficient of at least
``least`` needs sizes within ``least / (2 - least)`` and its inverse of each other, so a
passage is only compared with templates of such sizes, and only when enough of its pairs
occur in any template at all.

Texts are scanned where they are; nothing is shuffled. Null or empty texts and passages
of fewer than two words match nothing. Repeated rows are each scanned alone. Of equally
like templates the first by name is the best.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names and wording of public licences and of the notices that refer to them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                  "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                  "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST = 0.8
_OTHER = re.compile(r"[^a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def word_pairs(passage: str) -> set[tuple[str, str]]:
    words = _OTHER.sub(" ", passage.translate(_LOWER)).split()
    return set(zip(words, words[1:]))


class Templates:
    """Templates by the passage sizes that can reach the least coefficient."""

    def __init__(self, texts: Mapping[str, str], least: float):
        self.least = least
        self.pairs = {name: word_pairs(text) for name, text in sorted(texts.items())}
        self.all = set().union(*self.pairs.values())
        self.of_size: dict[int, list[str]] = defaultdict(list)
        for name, pairs in self.pairs.items():
            if pairs:
                low, high = len(pairs) * least / (2 - least), len(pairs) * (2 - least) / least
                for n in range(math.floor(low), math.ceil(high) + 1):
                    self.of_size[n].append(name)

    def matches(self, passage: str) -> list[tuple[float, str]]:
        pairs = word_pairs(passage)
        names = self.of_size.get(len(pairs))
        if not names:
            return []
        known = pairs & self.all
        found = []
        for name in names:
            other = self.pairs[name]
            if 2 * len(known) >= self.least * (len(pairs) + len(other)):
                dice = 2 * len(known & other) / (len(pairs) + len(other))
                if dice >= self.least:
                    found.append((dice, name))
        return found


def _scanned(batches: Iterator[pd.DataFrame], texts: Mapping[str, str], least: float) -> Iterator[pd.DataFrame]:
    templates = Templates(texts, least)
    for batch in batches:
        rows = []
        for text in batch["text"]:
            lines = text.split("\n") if isinstance(text, str) else []
            passages = [*lines, text] if len(lines) > 1 else lines
            found = [templates.matches(p) for p in passages]
            every = [m for ms in found for m in ms]
            best = min(every, key=lambda m: (-m[0], m[1]), default=(None, None))
            rows.append((best[1], best[0], ";".join(sorted({m[1] for m in every})), sum(map(bool, found))))
        frame = pd.DataFrame(rows, columns=["licence", "dice", "licences", "n_passages"]).astype({"dice": "float64"})
        yield pd.concat([batch[["doc_id"]].astype("Int64").reset_index(drop=True), frame], axis=1)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, licence, dice, licences, n_passages``: best template, its coefficient, all templates found, passages that match one."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), "text")
    return rows.mapInPandas(lambda b: _scanned(b, templates, least), "doc_id long, licence string, dice double, licences string, n_passages long")
