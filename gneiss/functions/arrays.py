"""The standard library over arrays (A1-A21): built-in higher-order functions, total on empty arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

#: Rank of an epistemic status; the joint status is the highest one.
STATUS_RANK = {"exemplifiable": 0, "unknown": 1, "hallucinated": 2}


def count_exists(xs: Column) -> Column:
    return F.size(F.filter(xs, lambda x: F.coalesce(x.cast("boolean"), F.lit(False))))


def sum_values(xs: Column, kind: str = "double") -> Column:
    return F.aggregate(xs, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def witness(x: Column) -> Column:
    return x


def status_rank(s: Column) -> Column:
    return F.when(s == "hallucinated", 2).when(s == "exemplifiable", 0).otherwise(1)


def status_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("exemplifiable"), F.lit("unknown"), F.lit("hallucinated")), rank + 1)


def joint_status(statuses: Column) -> Column:
    """A single status passes through; of several, the highest rank wins."""
    return F.when(F.size(statuses) == 1, F.get(statuses, F.lit(0))).otherwise(status_name(F.array_max(F.transform(statuses, status_rank))))


def superpose(*statuses: Column) -> Column:
    """A5: a status that is one of several, as the array of them."""
    return F.array(*statuses)


def classify(names: Column, statuses: Column, wanted: str) -> Column:
    """The names whose status is the wanted one."""
    return F.transform(F.filter(F.arrays_zip(names.alias("n"), statuses.alias("s")), lambda x: x["s"] == wanted), lambda x: x["n"])


def collapse(observation: Column, superposed: Column | None = None) -> Column:
    """A5: what an observation makes of a superposed status; without one, of any. What isn't superposed (null) stays null."""
    made = F.when(observation == "witnessed", "exemplifiable").when(observation == "refuted", "hallucinated").otherwise("unknown")
    return made if superposed is None else F.when(superposed.isNotNull(), made)


def count_hallucinated(statuses: Column) -> Column:
    return F.size(F.filter(statuses, lambda s: s == "hallucinated"))


def teapot(claim: Column, evidence: Column) -> Column:
    """A claim needs evidence: claim implies evidence."""
    return ~claim | evidence


def cons(x: Column, xs: Column) -> Column:
    return F.array_prepend(xs, x)


def concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def filter_pairs(target: Column, pairs: Column) -> Column:
    """Names of the (name, value) pairs whose value is the target."""
    return F.transform(F.filter(pairs, lambda p: p["value"] == target), lambda p: p["name"])


def length(xs: Column) -> Column:
    return F.size(xs)


def nth(xs: Column, i: Column | int) -> Column:
    return F.get(xs, F.lit(i) if isinstance(i, int) else i)


def reverse(xs: Column) -> Column:
    return F.reverse(xs)


def map_array(f: Callable[[Column], Column], xs: Column) -> Column:
    return F.transform(xs, f)


def fold(f: Callable[[Column, Column], Column], start: Column, xs: Column) -> Column:
    return F.aggregate(xs, start, f)


def all_true(f: Callable[[Column], Column], xs: Column) -> Column:
    return F.forall(xs, f)


def any_true(f: Callable[[Column], Column], xs: Column) -> Column:
    return F.exists(xs, f)


def none_true(f: Callable[[Column], Column], xs: Column) -> Column:
    return ~F.exists(xs, f)


def member(x: Column, xs: Column) -> Column:
    return F.array_contains(xs, x)


def apply(f: Callable[..., Column], *args: Column) -> Column:
    return f(*args)


def compose(*fs: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """compose(f, g)(x) = f(g(x))."""
    return lambda x: reduce(lambda v, f: f(v), reversed(fs), x)


def pipe(x: Column, *fs: Callable[[Column], Column]) -> Column:
    return reduce(lambda v, f: f(v), fs, x)
