"""Search queries as text: (limit 5 (in "*.md" (near "alpha" "beta" 2))) becomes one DataFrame plan.

Nothing runs until the result is used, so a filter on documents or a limit written outside reaches the scan. A query
may hold parts for other systems, (scope lens (kind "term")), whose tagged forms mix with lines found: sets of forms
go by their keys, and forms turn into postings where a posting is asked for."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame, functions as F

from gneiss.operators import forms as O, indexed, lines as L, search as S

from .sexpr import parse, repaired

ACCESSOR = re.compile(r"(sr|ln|dx|hn)-(\w+)")


class Scope(Protocol):
    """Another system that a query may ask: it turns an expression into tagged forms or a scalar's row."""

    tag: str

    def evaluate(self, expr: Any) -> DataFrame: ...


@dataclass
class Search:
    """docs (doc, text); callers (doc, line, name, overlap) or ranges (doc, start, end, caller), if quotes are known;
    index: a kept index, which is searched in place of the texts; scopes: other systems by name, each a Scope or a
    function from an expression to a DataFrame (S18, U10). A phrase is looked for in the normalised text (S2), or
    with `literal` only as it stands within a line."""

    docs: DataFrame
    callers: DataFrame | None = None
    scopes: dict[str, Scope | Callable[[Any], DataFrame]] = field(default_factory=dict)
    literal: bool = False
    ranges: DataFrame | None = None
    index: DataFrame | None = None

    def phrase(self, text: str) -> DataFrame:
        """The lines of a phrase, with those who quote it."""
        if self.ranges is not None:
            return indexed.traced_phrase(self.docs, text, self.ranges)
        if self.index is not None:
            found = indexed.indexed_phrase(self.index, text)
        else:
            found = (L.phrase_lines if self.literal else L.normal_phrase_lines)(self.docs, text)
        return S.with_callers(found, self.callers) if self.callers is not None else found

    def posting(self, expr: Any) -> DataFrame:
        """A posting, or the forms or the scalar that the expression asks for."""
        if not isinstance(expr, tuple):
            return self.phrase(str(expr))
        head, args = str(expr[0]), list(expr[1:])
        if head == "scope":
            system = self.scopes[str(args[0])]
            return system(args[1]) if callable(system) else system.evaluate(args[1])
        if head == "re":
            return L.re_lines(self.docs, str(args[0]))
        if head == "in":
            return S.in_document(self._lines(args[1]), str(args[0]))
        if head == "near":
            return S.near(self._lines(args[0]), self._lines(args[1]), args[2] if len(args) > 2 else 5)
        if head == "lines":
            return S.line_range(self._lines(args[2]), args[0], args[1])
        if head in ("context", "before", "after"):
            return getattr(S, head)(args[0], self._lines(args[1]), L.lines_of(self.docs))
        if head == "rank":
            return S.rank(str(args[0]), self._lines(args[1]))
        if head == "limit":
            part = self.posting(args[1])
            return O.limit_forms(args[0], part, O.form_key(part)) if "tag" in part.columns else S.limit(args[0], part)
        if head == "count":
            return S.count(self.posting(args[0]))
        if head == "results":
            return S.results(self._lines(args[0]))
        if head == "forms":
            return self._forms(args[0])
        if head == "fmt":
            return O.display(self._forms(args[1]), str(args[0]))
        if accessor := ACCESSOR.fullmatch(head):
            return O.field_of(self._forms(args[0]), *accessor.groups())
        if head in ("has-key", "keys"):
            part = self._forms(args[-1])
            return O.keys(part) if head == "keys" else O.has_key(part, str(args[0]))
        sets = {"and": (S.and_, O.and_forms), "or": (S.or_, O.or_forms), "not": (S.not_, O.not_forms), "seq": (S.seq, None)}
        if head.removesuffix("-forms") not in sets:
            raise NameError(f"no such search operator: {head}")
        of_lines, of_forms = sets[head.removesuffix("-forms")]
        parts = [self.posting(a) for a in args]
        if of_forms and (head.endswith("-forms") or any("tag" in p.columns for p in parts)):
            parts = [p if "tag" in p.columns else O.forms_of(p) for p in parts]
            return parts[0] if len(parts) == 1 else of_forms(*parts)
        return parts[0] if len(parts) == 1 else of_lines(*parts)

    def _lines(self, expr: Any) -> DataFrame:
        found = self.posting(expr)
        return O.posting_of(found) if "tag" in found.columns else found

    def _forms(self, expr: Any) -> DataFrame:
        found = self.posting(expr)
        return found if "tag" in found.columns else O.forms_of(found)

    def parsed(self, text: str) -> Any:
        text = text.strip()
        return parse(repaired(text)) if text.startswith("(") else text

    def query(self, text: str, max_lines: int = 20, offset: int = 0, rank: str = "callers", max_callers: int | None = 5) -> DataFrame:
        """A page of the result, ranked; neighbourhoods stay in line order. A row shows max_callers of its callers,
        and counts all."""
        expr = self.parsed(text)
        head = str(expr[0]) if isinstance(expr, tuple) else ""
        found = self.posting(expr)
        if "ord" not in found.columns or "doc" not in found.columns:
            return found
        ranked = S.rank("line" if head in ("context", "before", "after") else rank, found)
        page = S.limit(max_lines, ranked, offset)
        return page if max_callers is None else page.withColumn("callers", F.slice("callers", 1, max_callers))

    def display(self, text: str) -> DataFrame:
        """Whatever the query gives as a posting; a scalar is one line of the document __result__."""
        found = self.posting(self.parsed(text))
        if "tag" in found.columns:
            return O.posting_of(found)
        if {"doc", "line", "context"} <= set(found.columns):
            return found
        value = F.concat_ws(", ", *[F.col(c).cast("string") for c in found.columns])
        return L.as_posting(found.select(F.lit("__result__").alias("doc"), F.lit(1).cast("long").alias("line"), value.alias("context")))


@dataclass(frozen=True)
class Cursor:
    """A place in the pages of a query; next and prev give other cursors."""

    search: Search
    text: str
    size: int = 20
    page: int = 0
    rank: str = "callers"

    def rows(self) -> DataFrame:
        return self.search.query(self.text, self.size, self.page * self.size, self.rank)

    def next(self) -> Cursor:
        return replace(self, page=self.page + 1)

    def prev(self) -> Cursor:
        return replace(self, page=max(0, self.page - 1))

    def at(self, page: int) -> Cursor:
        return replace(self, page=max(0, page))


def distinct_callers(posting: DataFrame) -> DataFrame:
    return posting.select(F.explode("callers.name").alias("name")).distinct()
