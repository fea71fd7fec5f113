"""Hash-derived keys and deterministic randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 2**32


def content_key(col: Column) -> Column:
    """SHA-256 hex of the text itself."""
    return F.sha2(col, 256)


def hash32(*parts) -> Column:
    """A reproducible integer in [0, 2**32) from the given parts.

    Same inputs give the same number on every engine with MD5, so resampling
    needs no generator state and a lost task recomputes identical draws.
    """
    text = F.concat_ws("|", *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def random_sign(*parts) -> Column:
    """+1 or -1 with equal probability."""
    return F.when(hash32(*parts) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def poisson_weight(*parts) -> Column:
    """Poisson(1) count by inverting its distribution at a hashed uniform."""
    u = hash32(*parts) / F.lit(float(HASH_SPAN))
    expr, term, cumulative = None, 0.36787944117144233, 0.0
    for k in range(13):
        cumulative += term
        expr = F.when(u < cumulative, F.lit(k)) if expr is None else expr.when(u < cumulative, F.lit(k))
        term /= k + 1
    return expr.otherwise(F.lit(13))


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))
