"""Column helpers for operators made of built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"
_PREFIX = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body
    names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def running(array: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over all elements before each one (exclusive), in blocks, so
    that long arrays take about 256 steps an element and no quadratic copying."""
    fold = lambda a: F.aggregate(a, start, op)
    blocks = F.ceil(F.size(array) / _PREFIX).cast("int")

    def body(a: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))),
                           lambda b: fold(F.slice(a, b * _PREFIX + 1, F.lit(_PREFIX))))
        bases = lambda s: F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b)))

        def at(k: Column, base: Column) -> Column:
            b = F.floor(k / _PREFIX).cast("int")
            return op(F.get(base, b), fold(F.slice(a, b * _PREFIX + 1, k - b * _PREFIX)))

        return let(sums, lambda s: let(bases(s), lambda base: F.transform(a, lambda _, k: at(k, base))))

    return let(array, body)
