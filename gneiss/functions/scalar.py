"""Scalar operators with the semantics of a dynamically typed language, as columns.

F1-F17: arithmetic, comparison, logic. Types are known when an expression is compiled, so truthiness and
equality across types are decided there and cost nothing at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def mod(a: Column, b: Column) -> Column:
    """the result takes the divisor's sign."""
    return a - b * F.floor(a / b)


def divide(a: Column, b: Column) -> Column:
    """always a double; a zero divisor is an error under ANSI mode."""
    return a.cast("double") / b.cast("double")


def truthy(c: Column, kind: str) -> Column:
    """kind: number, string, boolean or array."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "number":
        return F.coalesce(c != 0, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    return F.coalesce(F.size(c) > 0, F.lit(False))


def equal(a: Column, kind_a: str, b: Column, kind_b: str) -> Column:
    """numbers and booleans compare by value, other mixed types are unequal, never an error."""
    numeric = {"number", "boolean"}
    if kind_a == kind_b:
        return a.eqNullSafe(b)
    if {kind_a, kind_b} <= numeric:
        return a.cast("double").eqNullSafe(b.cast("double"))
    return F.lit(False)


def all_of(values: list[Column]) -> Column:
    """(and) is true."""
    return reduce(lambda x, y: x & y, values, F.lit(True))


def any_of(values: list[Column]) -> Column:
    """(or) is false."""
    return reduce(lambda x, y: x | y, values, F.lit(False))


def implies(a: Column, b: Column) -> Column:
    """F15 for booleans: not a, or b's value."""
    return F.when(a, b).otherwise(F.lit(True))
