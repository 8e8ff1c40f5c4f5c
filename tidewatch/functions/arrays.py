"""Array columns: values used more than once, and lookups in sorted arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Elements of an array that is looked through as a whole.
SHORT = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def halvings(ordered: Column) -> Column:
    """Steps to find a place in an array by halving: powers of two, falling to one."""
    return F.transform(F.sequence(F.ceil(F.log2(F.size(ordered) + 1)).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))


def among(ordered: Column, steps: Column, value: Column) -> Column:
    """Whether a sorted array, with its halvings, has the value: by a look at few of its elements (at all of a short one)."""
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ordered, at + step) <= value, at + step).otherwise(at))
    return F.when(F.size(ordered) <= SHORT, F.array_contains(ordered, value)).otherwise(F.coalesce(F.get(ordered, place) == value, F.lit(False)))
