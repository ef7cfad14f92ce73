"""Graphs and health tables asked by query text.

A Lens asks one graph, a Health a table of items, a Hologram several graphs. A text in parentheses is an expression of
the system's own operators, which may be nested as filters; any other text is looked for in what the nodes or items
say. Results are tagged forms, or one row for a scalar. Each system can stand as a scope in a search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, functions as F

from gneiss.operators import forms as O, graph as G

from .sexpr import parse, repaired

OUTPUT = "__output__"


def _parsed(query: Any) -> Any:
    return parse(repaired(query)) if isinstance(query, str) and query.strip().startswith("(") else query


class _Asked:
    """What the systems share: plain texts, sets of forms, find and fuzzy."""

    tag: str

    def said(self) -> DataFrame:
        """(doc, text): what each node or item says, for plain searches."""
        raise NotImplementedError

    def own(self, head: str, args: list[Any]) -> DataFrame | None:
        raise NotImplementedError

    def evaluate(self, query: Any) -> DataFrame:
        expr = _parsed(query)
        if not isinstance(expr, tuple):
            from gneiss.operators.lines import normal_phrase_lines

            return normal_phrase_lines(self.said(), str(expr))
        head, args = str(expr[0]), list(expr[1:])
        if head in ("and", "or", "not"):
            return {"and": O.and_forms, "or": O.or_forms, "not": O.not_forms}[head](*[self.evaluate(a) for a in args])
        if head == "count":
            return O.count_forms(self.evaluate(args[0]))
        if head == "limit":
            return O.limit_forms(args[0], self.evaluate(args[1]), "name")
        found = self.own(head, args)
        if found is None:
            raise NameError(f"no such operator: {head}")
        return found

    def find(self, pattern: str, most: int = 50) -> DataFrame:
        return G.find(self.said().select(F.col("doc").alias("name")), pattern, most)

    def fuzzy(self, text: str, most: int = 10) -> DataFrame:
        return G.fuzzy(self.said().select(F.col("doc").alias("name")), text, most)


@dataclass
class Lens(_Asked):
    """nodes (name, kind, value, and quotes where they are known), edges (src, dst)."""

    nodes: DataFrame
    edges: DataFrame
    tag = "ln"

    @cached_property
    def depth(self) -> DataFrame:
        return G.depths(self.nodes, self.edges)

    def forms(self, nodes: DataFrame) -> DataFrame:
        inputs = self.edges.groupBy(F.col("dst").alias("name")).agg(F.sort_array(F.collect_set("src")).alias("inputs"))
        named = nodes.where(F.col("name") != OUTPUT).join(self.depth, "name", "left").join(inputs, "name", "left")
        return O.tagged(named.withColumn("inputs", F.coalesce("inputs", F.array().cast("array<string>"))), "ln")

    def said(self) -> DataFrame:
        text = F.concat_ws(" ", F.col("name"), F.concat(F.lit("["), F.col("kind"), F.lit("]")), F.col("value"))
        return self.nodes.where(F.col("name") != OUTPUT).select(F.col("name").alias("doc"), text.alias("text"))

    def _of(self, names: DataFrame) -> DataFrame:
        return self.forms(self.nodes.join(names.select("name").distinct(), "name", "left_semi"))

    def own(self, head: str, args: list[Any]) -> DataFrame | None:
        if head in ("kind", "focus") and len(args) > 1:
            inner = self.evaluate(args[1])
            return G.kind(inner, str(args[0])) if head == "kind" else G.focus(inner, str(args[0]))
        if head == "node":
            return self.forms(G.node(self.nodes, str(args[0])))
        if head == "kind":
            return self.forms(G.kind(self.nodes, str(args[0])))
        if head == "focus":
            return self.forms(G.focus(self.nodes, str(args[0])))
        if head == "inputs":
            return self._of(G.inputs(self.edges, str(args[0])))
        if head == "downstream":
            return self._of(G.downstream(self.edges, str(args[0])))
        if head == "roots":
            return self._of(G.layers(self.nodes, self.edges, self.depth).where("layer = 0"))
        if head == "layer":
            return self._of(self.depth.where(F.col("depth") == int(args[0])))
        if head == "depth":
            return G.depth_of(self.depth, str(args[0])).select(F.col("depth").alias("value"))
        if head == "value":
            return G.node(self.nodes, str(args[0])).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))
        if head == "terms":
            return G.kind(self.nodes.where(F.col("name") != OUTPUT), str(args[0])).select(F.col("name").alias("value"))
        if head == "quotes":
            return G.node(self.nodes, str(args[0])).select(F.explode("quotes").alias("value"))
        return None

    def focus(self, name: str) -> Lens:
        """The lens over the part of the graph around a node."""
        return Lens(*G.localize(self.nodes, self.edges, self.nodes.where(F.col("name") == name).select("name")))

    def view(self) -> DataFrame:
        """G22."""
        return G.in_order(self.nodes, self.depth)

    def not_found(self, name: str) -> str:
        """What to say of a name that isn't there."""
        near = [r["name"] for r in self.fuzzy(name).collect()]  # ten at most
        return f"no {name!r}. Did you mean: {', '.join(near)}" if near else f"no {name!r}"


@dataclass
class Health(_Asked):
    """items (name, category, type, kind, loc, detail)."""

    items: DataFrame
    tag = "dx"

    def said(self) -> DataFrame:
        kind = F.when(F.col("kind").isNotNull(), F.concat(F.lit("["), F.col("kind"), F.lit("]")))
        line = F.concat_ws(" ", "category", kind, F.concat_ws(": ", "type", "detail"))
        return self.items.groupBy(F.col("name").alias("doc")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))

    def own(self, head: str, args: list[Any]) -> DataFrame | None:
        if head in ("kind", "category", "type", "focus"):
            base = self.evaluate(args[1]) if len(args) > 1 else O.tagged(self.items, "dx")
            return G.select_items(base, **{"prefix" if head == "focus" else head: str(args[0])})
        if head in ("issues", "warnings", "danglings"):
            return O.tagged(G.select_items(self.items, category=head.removesuffix("s")), "dx")
        if head == "consistent":
            return G.consistent(self.items).select(F.col("consistent").alias("value"))
        if head == "ns":
            return G.namespaces(self.items).select(F.col("namespaces").alias("value"))
        return None

    def focus(self, prefix: str) -> Health:
        """G39."""
        return Health(G.select_items(self.items, prefix=prefix))

    def filtered(self, **by: str) -> DataFrame:
        """Items by equal category, kind or type and by namespace; a value that no item has is an error which
        names those that there are."""
        out = self.items
        for column, value in by.items():
            at = "name" if column == "namespace" else column
            test = F.startswith("name", F.lit(value)) if column == "namespace" else F.col(at) == value
            if self.items.where(test).isEmpty():
                known = self.items.withColumn("namespace", G.namespace(F.col("name")))
                names = [r["value"] for r in G.suggestions(known, column, value).collect()]  # ten at most
                raise ValueError(f"no items with {column} {value!r}. There are: {', '.join(names)}")
            out = out.where(test)
        return out


@dataclass
class Hologram(_Asked):
    """Several lenses, told apart by their number; labels name them."""

    lenses: list[Lens]
    labels: tuple[str, ...] = ()
    tag = "hn"

    @cached_property
    def nodes(self) -> DataFrame:
        return G.together([(x.nodes.where(F.col("name") != OUTPUT), x.edges) for x in self.lenses])[0]

    def _form(self, found: DataFrame) -> DataFrame:
        return O.tagged(found, "hn")

    def said(self) -> DataFrame:
        first = G.first_of(self.nodes)
        return Lens(first, self.lenses[0].edges).said()

    def own(self, head: str, args: list[Any]) -> DataFrame | None:
        if head in ("left", "right", "lens"):
            i = {"left": 0, "right": len(self.lenses) - 1}.get(head, int(args[0]) if head == "lens" else 0)
            inner = args[1:] if head == "lens" else args
            if not 0 <= i < len(self.lenses):
                raise IndexError(f"no lens {i} among {len(self.lenses)}")
            return self.lenses[i].evaluate(inner[0]) if inner else self.lenses[i].forms(self.lenses[i].nodes)
        n = len(self.lenses)
        if head == "divergent":
            return self._form(G.divergent(self.nodes, n))
        if head == "common":
            return self._form(G.common(self.nodes, n))
        if head == "only":
            if not 0 <= int(args[0]) < n:
                raise IndexError(f"no lens {args[0]} among {n}")
            return self._form(G.only(self.nodes, int(args[0])))
        return None
