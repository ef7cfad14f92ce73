"""The standard library of functions over lists, as rules of the language.

The functions themselves are in gneiss.functions.arrays; the compiler offers those that columns can compute. What is
here is what stands beside them: labels, templates, constants, and the names that are verified by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .sexpr import Rules

#: Rules without a counterpart among functions of columns.
RULES = (
    "(= (unquote ?x) ?x)",
    "(= (export ?x) ?x)",
    "(= (witness ?x) ?x)",
)
STUB = "__stub__"
#: Names of the library that are taken as grounded.
VERIFIED = ("count-exists", "sum-values", "witness", "joint-status", "superpose", "collapse", "count-hallucinated", "teapot", "cons", "concat", "filter", "length", "nth", "reverse", "map", "fold", "all", "any-true", "none", "member", "apply", "compose", "pipe", "unquote", "export")


def rules() -> Rules:
    out = Rules()
    for r in RULES:
        out.add(r)
    return out


def stub(kind: str = "string") -> Column:
    """A value that equals nothing, itself neither."""
    return F.lit(None).cast(kind)


def verified_names(spark: SparkSession) -> DataFrame:
    """(name) of the library's manual verifications."""
    return spark.createDataFrame([(n,) for n in VERIFIED], "name string")
