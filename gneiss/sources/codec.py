"""Expressions and entries as JSON, and back (IO11, IO12)."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gneiss.plans.sexpr import Symbol

MARK = "__symbol__"


def encode(value: Any) -> Any:
    if isinstance(value, Symbol):
        return {MARK: str(value)}
    return [encode(x) for x in value] if isinstance(value, (tuple, list)) else value


def decode(value: Any) -> Any:
    if isinstance(value, dict):
        return Symbol(value[MARK])
    return tuple(decode(x) for x in value) if isinstance(value, list) else value


def dumps(value: Any) -> str:
    return json.dumps(encode(value))


def loads(text: str) -> Any:
    return decode(json.loads(text))


def symbol_json(name: Column) -> Column:
    """IO11: a column of symbols as JSON."""
    quoted = F.regexp_replace(name, r'(["\\])', r"\\$1")
    return F.concat(F.lit(f'{{"{MARK}": "'), quoted, F.lit('"}'))


def symbol_of(text: Column) -> Column:
    return F.get_json_object(text, f"$.{MARK}")


def rows_json(df: DataFrame) -> DataFrame:
    """IO11: (json) of the rows of a result, a report or a table of issues; absent values are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def rows_of(table: DataFrame, schema: str) -> DataFrame:
    """IO11: the rows of rows_json again."""
    return table.select(F.from_json("json", schema).alias("r")).select("r.*")


def program_table(spark: SparkSession, entries: dict[str, Any], diffs: dict[str, tuple[str, str]]) -> DataFrame:
    """IO10: a program as a table that a snapshot can hold."""
    rows = [(i, n, e.kind, dumps(e.wff), list(e.using), e.origin, [list(q) for q in e.quotes], e.line, e.module) for i, (n, e) in enumerate(entries.items())]
    rows += [(len(rows) + i, n, "diff", dumps([Symbol(x) for x in p]), [], None, [], 0, "") for i, (n, p) in enumerate(diffs.items())]
    return spark.createDataFrame(
        rows, "seq int, name string, kind string, wff string, using array<string>, origin string, quotes array<array<string>>, line int, module string"
    )


def program_of(table: DataFrame) -> tuple[dict[str, Any], dict[str, tuple[str, str]]]:
    """The entries and diffs of a program table, in their order."""
    from gneiss.plans.system import Entry

    entries: dict[str, Any] = {}
    diffs: dict[str, tuple[str, str]] = {}
    for r in table.orderBy("seq").collect():  # a program: as many rows as directives
        if r.kind == "diff":
            diffs[r["name"]] = tuple(map(str, loads(r.wff)))
        else:
            entries[r["name"]] = Entry(r.kind, loads(r.wff), tuple(r.using), r.origin, tuple(tuple(q) for q in r.quotes), r.line, r.module)
    return entries, diffs
