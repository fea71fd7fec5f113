"""Column functions over per-position value arrays (NULL = not measured)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions.binding import let


def _slice(values: Column, first: Column, last: Column) -> Column:
    """1-based inclusive slice, empty when ``last < first``; bounds are clamped."""
    size = F.size(values)
    lo = F.greatest(first, F.lit(1))
    hi = F.least(last, size)
    return F.slice(values, lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))


def left_flank(values: Column, pos: Column, k: int) -> Column:
    return _slice(values, pos - k, pos - 1)


def right_flank(values: Column, pos: Column, k: int) -> Column:
    return _slice(values, pos + 1, pos + k)


def valid_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x.isNotNull()))


def _has_left(pos: Column, k: int) -> Column:
    return pos > k


def _has_right(values: Column, pos: Column, k: int) -> Column:
    return pos + k <= F.size(values)


# Fixed value: positions in a word of a mask; with the sign bit left out, 32 is the largest power of two.
_WORD = 32


def measured_mask(values: Column) -> Column:
    """Which values are measured, as an array of ``bits`` of 32 positions, first the highest, and the count ``before`` them.

    Its size is a small part of the vector's, and :func:`measured_upto` takes two lookups.
    """
    marks = F.array_join(F.transform(values, lambda x: F.when(x.isNull(), "0").otherwise("1")), "")

    def word(text: Column, i: Column) -> Column:
        return F.conv(F.rpad(F.substring(text, i * _WORD + 1, F.lit(_WORD)), _WORD, "0"), 2, 10).cast("long")

    def counted(words: Column) -> Column:
        ones = lambda first: F.aggregate(first, F.lit(0), lambda n, w: n + F.bit_count(w))
        return F.transform(words, lambda w, i: F.struct(w.alias("bits"), ones(F.slice(words, F.lit(1), i)).alias("before")))

    # One word more than full, so that the last position has a word after it.
    words = let(marks, lambda text: F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _WORD).cast("int")), lambda i: word(text, i)))
    return let(words, counted)


def measured_upto(mask: Column, last: Column) -> Column:
    """How many of the first ``last`` positions of a :func:`measured_mask` are measured; ``last`` must lie in 0 to the size."""
    word = F.get(mask, F.floor(last / _WORD).cast("int"))
    return word["before"] + F.bit_count(F.call_function("shiftright", word["bits"], _WORD - last % _WORD))


def flank_coverage(values: Column, pos: Column, k: int) -> tuple[Column, Column, Column]:
    """Measured fraction left, right and both; NULL where the full flank does not exist."""
    left = F.when(_has_left(pos, k), valid_count(left_flank(values, pos, k)))
    right = F.when(_has_right(values, pos, k), valid_count(right_flank(values, pos, k)))
    return left / k, right / k, (left + right) / (2 * k)


def flank_coverage_zero(values: Column, pos: Column, k: int) -> tuple[Column, Column, Column]:
    """As :func:`flank_coverage`, but an incomplete flank counts as 0.

    The combined fraction keeps the values of an incomplete right flank, and
    drops a left flank that does not fully exist.
    """
    left_n = F.when(_has_left(pos, k), valid_count(left_flank(values, pos, k))).otherwise(0)
    right_n = valid_count(right_flank(values, pos, k))
    right = F.when(_has_right(values, pos, k), right_n / k).otherwise(0.0)
    return (left_n / k).cast("double"), right, (left_n + right_n) / (2 * k)


def valid_mean(values: Column, digits: int | None = 8) -> Column:
    """Mean of the measured values; NULL if there is none."""
    kept = F.filter(values, lambda x: x.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    mean = F.try_divide(total, F.size(kept))
    return F.round(mean, digits) if digits is not None else mean


def flank_mean(values: Column, pos: Column, k: int, digits: int | None = 8) -> Column:
    return valid_mean(F.concat(left_flank(values, pos, k), right_flank(values, pos, k)), digits)


def main_window_valid(values: Column, pos: Column, k: int, min_fraction: float) -> Column:
    left, right, _ = flank_coverage(values, pos, k)
    return F.coalesce((left >= min_fraction) & (right >= min_fraction), F.lit(False))


def window_vector(values: Column, pos: Column, k: int, digits: int = 6) -> Column:
    """``2k+1`` values around ``pos``, NULL where unmeasured or outside.

    Scaled ``rint`` instead of ``round``: the latter goes through decimals for
    every element and takes most of the time of a dataset build.
    """
    scale = F.lit(float(10**digits))
    return let(values, lambda v: F.transform(
        F.sequence(pos - k, pos + k),
        lambda i: F.when(i >= 1, F.rint(F.get(v, (i - 1).cast("int")).cast("double") * scale) / scale),
    ))


def mask_of(window: Column) -> Column:
    return F.transform(window, lambda x: x.isNotNull().cast("int"))


def window_exclude_centre(window: Column, half: int, gap: int, reach: int,
                          min_fraction: float) -> tuple[Column, Column]:
    """Mean of offsets ``-reach..-gap`` and ``gap..reach`` of a centred window.

    Returns ``(ok, mean)``; ``ok`` needs ``min_fraction`` measured on each side,
    the mean is NULL otherwise. Offsets are inclusive.
    """
    width = reach - gap + 1
    left = F.slice(window, half + 1 - reach, width)
    right = F.slice(window, half + 1 + gap, width)
    ok = (valid_count(left) / width >= min_fraction) & (valid_count(right) / width >= min_fraction)
    return ok, F.when(ok, valid_mean(F.concat(left, right), None))


def probability_features(paired: Column, half: int, near: int = 10, far: int = 50) -> dict[str, Column]:
    """Summaries of a per-position pairing probability array of size ``2*half+1``.

    ``near`` is the flank next to the centre; the far region runs from there to ``far``.
    """
    eps = 2.220446049250313e-16
    entropies = F.transform(paired, lambda p: _binary_entropy(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))))
    unpaired = F.transform(paired, lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - p)))
    up = F.slice(unpaired, half + 1 - near, near)
    down = F.slice(unpaired, half + 2, near)
    outer = F.concat(F.slice(unpaired, half + 1 - far, far - near),
                     F.slice(unpaired, half + 2 + near, far - near))
    return {
        "mean_pairing_state_entropy": valid_mean(entropies, None),
        "predicted_unpaired_mean_up": valid_mean(up, None),
        "predicted_unpaired_mean_down": valid_mean(down, None),
        "predicted_unpaired_mean_flank": valid_mean(F.concat(up, down), None),
        "predicted_unpaired_mean_far": valid_mean(outer, None),
    }


def _binary_entropy(p: Column) -> Column:
    return -(p * F.ln(p) + (1 - p) * F.ln(1 - p))


def parse_array_json(col: Column, n: int, element: str = "double") -> Column:
    """JSON text to an array; an array of another length raises."""
    parsed = F.from_json(col, f"array<{element}>")
    return F.when(F.size(parsed) == n, parsed).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n} elements, got "), F.coalesce(F.size(parsed).cast("string"), F.lit("none")))))
