"""Evaluate a column once where lambdas would repeat it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is evaluated again for every element once
    projections are merged; bound as a lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
