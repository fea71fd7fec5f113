"""Language identification by the nearest of several centroids per language.

A text is lower-cased, everything but letters becomes a single space, and its letter
pairs and triples are counted in a hashed space of ``dims`` places. Counts times inverse
document frequency, scaled to length 1, are compared by cosine with ``clusters``
centroids per language (spherical k-means). The nearest centroid gives the language. A
text whose distance to it exceeds what the fitted sample shows for texts of its length,
with a margin, is rejected.

The model is fitted on a bounded sample: about ``sample`` documents per language, taken by
a hash of the document id, at most ``max_languages`` languages (the most frequent). The
sample reaches the driver as sparse counts, so its size is bounded by parameters. Every
document is classified by a scan; nothing is shuffled.

Null text, or text without a letter: ``und``, score 0, rejected. Without any labelled
document every text is ``und``. Repeated rows are each classified alone. Very long texts
are counted slice by slice. Columns of the input pass through untouched in ``classify``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
SLICE = 1 << 20
RESULT = "lang_pred string, score double, rejected boolean"


@dataclass(frozen=True)
class LanguageParams:
    sample: int = 400
    max_languages: int = 200
    clusters: int = 3
    rounds: int = 8
    dims: int = 8192
    quantile: float = 0.01
    margin: float = 0.5


@dataclass
class LanguageModel:
    """``centroids`` are rows of length 1; ``least`` is the smallest accepted cosine by bit length of the pair-and-triple count."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray = field(default_factory=lambda: np.zeros(64, np.float32))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None, dims: int) -> np.ndarray | None:
    """Counts of letter pairs and triples by hashed place; None for a text without a letter."""
    if not text:
        return None
    lowered, letters, total = text.lower(), _letters(), None
    for at in range(0, len(lowered), SLICE):
        points = np.frombuffer(lowered[max(0, at - 2):at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[points]
        if not is_letter.any():
            continue
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        kept = np.where(is_letter, points, 32)[keep]
        c = np.concatenate(([32], kept, [32] if kept[-1] != 32 else [])).astype(np.uint32)
        pairs = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA6B)
        triples = pairs[:-1] * np.uint32(0x27D4EB2F) ^ c[2:] * np.uint32(0xC2B2AE35)
        places = np.concatenate((pairs, triples))
        places ^= places >> np.uint32(15)
        places *= np.uint32(0x2C1B3C6D)
        counts = np.bincount(places >> np.uint32(32 - (dims - 1).bit_length()), minlength=dims)
        total = counts if total is None else total + counts
    return total


def held_out(doc_id: Column) -> Column:
    """Documents never learned from; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _sparse(texts: pd.Series, dims: int) -> pd.DataFrame:
    rows = []
    for text in texts:
        counts = gram_counts(text, dims)
        at = np.zeros(0, np.int64) if counts is None else np.flatnonzero(counts)
        rows.append((at.astype(np.int32), (at if counts is None else counts[at]).astype(np.int32)))
    return pd.DataFrame({"at": [r[0] for r in rows], "n": [r[1] for r in rows]})


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from ``doc_id, lang, text`` rows with a language and a text that are not held out."""
    if params.dims & (params.dims - 1):
        raise ValueError("dims must be a power of two")
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(params.max_languages).collect()
    if not counts:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, params.dims), np.float32), np.ones(params.dims, np.float32))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, params.sample / r["n"]))])
    dims = params.dims
    vectors = F.pandas_udf(lambda texts: _sparse(texts, dims), "at array<int>, n array<int>")
    picked = known.where(F.col("u") < F.try_element_at(share, F.col("lang"))).select("lang", "u", vectors("text").alias("v")) \
        .select("lang", "u", "v.at", "v.n").toPandas()
    return fit_vectors(picked.sort_values(["lang", "u"], kind="stable"), params)


def fit_vectors(picked: pd.DataFrame, params: LanguageParams) -> LanguageModel:
    """The model of sparse counts ``lang, at, n``."""
    picked = picked[[len(a) > 0 for a in picked["at"]]]
    seen = np.zeros(params.dims)
    for at in picked["at"]:
        seen[at] += 1
    idf = (np.log((1 + len(picked)) / (1 + seen)) + 1).astype(np.float32)
    languages, owner, centroids, best, size = sorted(picked["lang"].unique()), [], [], [], []
    for i, lang in enumerate(languages):
        rows = picked[picked["lang"] == lang].head(2 * params.sample)
        x = np.zeros((len(rows), params.dims), np.float32)
        for j, (at, n) in enumerate(zip(rows["at"], rows["n"])):
            x[j, at] = n
        size += x.sum(1).astype(np.int64).tolist()
        x *= idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = _spherical_means(x, min(params.clusters, len(x)), params.rounds)
        best += (x @ c.T).max(1).tolist()
        owner += [i] * len(c)
        centroids.append(c)
    model = LanguageModel(languages, np.array(owner, np.int64), np.concatenate(centroids) if centroids else np.zeros((0, params.dims), np.float32), idf)
    model.least = _least(np.array(size), np.array(best), params)
    return model


def _spherical_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    mean = x.mean(0)
    c = [x[int((x @ mean).argmax())]]
    while len(c) < k:  # the row farthest from all centroids so far
        c.append(x[int((x @ np.stack(c).T).max(1).argmin())])
    c = np.stack(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                s = x[near == j].sum(0)
                c[j] = s / np.linalg.norm(s)
    return c


def _least(size: np.ndarray, best: np.ndarray, params: LanguageParams) -> np.ndarray:
    """Per bit length of the count: a low quantile of the sample's cosines times the margin; lengths shorter than any seen accept all."""
    out, bits, last = np.zeros(64, np.float32), np.array([int(s).bit_length() for s in size]), 0.0
    for b in range(64):
        here = best[bits == b]
        if len(here):
            last = float(np.quantile(here, params.quantile)) * params.margin
        out[b] = last
    return out


def predict(texts: pd.Series, model: LanguageModel) -> pd.DataFrame:
    dims, rows = len(model.idf), []
    for text in texts:
        counts = gram_counts(text, dims) if model.languages else None
        if counts is None:
            rows.append((UNKNOWN, 0.0, True))
            continue
        x = counts * model.idf
        cosines = model.centroids @ x
        i = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[i]) / float(np.linalg.norm(x))))
        rows.append((model.languages[model.owner[i]], score, score < model.least[int(counts.sum()).bit_length()]))
    return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])


def classify(docs: DataFrame, text: str, model: LanguageModel, name: str = "_language") -> DataFrame:
    """Add the struct ``name`` with ``lang_pred``, ``score`` and ``rejected``."""
    return docs.withColumn(name, F.pandas_udf(lambda texts: predict(texts, model), RESULT)(text))
