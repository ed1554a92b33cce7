"""List functions of the rule language on array columns; all keep the order of their elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def total(xs: Column, kind: str) -> Column:
    """0 if empty."""
    return F.aggregate(xs, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


def largest(xs: Column, default: Column) -> Column:
    return F.coalesce(F.array_max(xs), default)


def smallest(xs: Column, default: Column) -> Column:
    return F.coalesce(F.array_min(xs), default)


def arg_max(xs: Column, key: Step) -> Column:
    """The element of the largest key, the later one of several; null if empty."""
    return F.aggregate(xs, F.try_element_at(xs, F.lit(1)), lambda a, x: F.when(key(a) > key(x), a).otherwise(x))


def arg_min(xs: Column, key: Step) -> Column:
    return F.aggregate(xs, F.try_element_at(xs, F.lit(1)), lambda a, x: F.when(key(a) < key(x), a).otherwise(x))


def sort_by(xs: Column, key: Step, descending: bool = False) -> Column:
    """Stable in both directions."""
    placed = F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    first, second = (-1, 1) if not descending else (1, -1)
    order = lambda a, b: F.when(a["k"] < b["k"], first).when(a["k"] > b["k"], second).otherwise(a["i"] - b["i"])
    return F.transform(F.array_sort(placed, order), lambda s: s["x"])


def fold(xs: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(xs, start, step)


def find(xs: Column, test: Step) -> Column:
    """The first element that passes, or null."""
    return F.try_element_at(F.filter(xs, test), F.lit(1))


def sequence(begin: Column, end: Column) -> Column:
    """From begin to before end; empty if there is nothing between."""
    return F.when(end > begin, F.sequence(begin, F.greatest(end - 1, begin))).otherwise(F.array().cast("array<bigint>"))


def nth(xs: Column, n: Column) -> Column:
    """Counted from 1; null out of range."""
    return F.when(n >= 1, F.try_element_at(xs, F.greatest(n, F.lit(1)).cast("int")))


def without_nth(xs: Column, n: Column) -> Column:
    return F.filter(xs, lambda _, i: i + 1 != n)


def zip_equal(xs: Column, ys: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Null where the lists are of different lengths, for the caller to report."""
    return F.when(F.size(xs) == F.size(ys), F.zip_with(xs, ys, step))


def first_of_each(xs: Column, key: Step) -> Column:
    """The first element of each key, in order."""
    keys = F.transform(xs, key)
    return F.filter(xs, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def reduce(xs: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The elements from the first on; null if there is none."""
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.try_element_at(xs, F.lit(1)), step)


def concat(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


def reverse(xs: Column) -> Column:
    return F.reverse(xs)


def last(xs: Column) -> Column:
    """Null if empty."""
    return F.try_element_at(xs, F.lit(-1))


def without_first(xs: Column) -> Column:
    return F.filter(xs, lambda _, i: i > 0)


def without_last(xs: Column) -> Column:
    return F.filter(xs, lambda _, i: i < F.size(xs) - 1)


def exists(xs: Column, test: Step) -> Column:
    return F.exists(xs, test)


def every(xs: Column, test: Step) -> Column:
    """True of an empty list."""
    return F.forall(xs, test)


def contains(xs: Column, x: Column) -> Column:
    return F.array_contains(xs, x)


def before(xs: Column, ys: Column) -> Column:
    """Whether a list goes before another: by their first difference, then by their length."""
    return xs < ys
