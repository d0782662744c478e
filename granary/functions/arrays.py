"""Array expressions that evaluate shared parts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    """The sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def first_argmax(values: Column) -> Column:
    """0-based index of the largest value; the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1
