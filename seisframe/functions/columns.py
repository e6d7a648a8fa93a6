"""Small column helpers used throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row instead of once per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rounded(column: Column | str, digits: int) -> Column:
    """Half-up rounding that never gives a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
