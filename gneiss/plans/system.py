"""Logic programs: directives in, tables out.

The program itself is small and lives on the driver: names, expressions, rules, who uses whom. Values do not:
every evaluation compiles to columns, over the rows of `rows` if there are any (each row is then an environment
of its own, its columns facts), else over one row, and all terms, theorems and diffs of a program are evaluated
by a single select. Over rows, a theorem holds if it holds on every one of them, and a diff diverges if it does on any;
`theorems_by_row` says where. Quotes are verified by one join with the documents. Programs of several modules are
loaded by gneiss.plans.loader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.operators import logic, quotes
from gneiss.operators.graph import fuzzy

from .compiler import FORMS, OPERATORS, Compiler, Typed
from .sexpr import ParseError, Rules, Symbol, free_vars, keyword, parse, parse_all, substitute, symbols, to_sexp

HEADS = ("fact", "axiom", "defterm", "derive", "diff")
#: Effects that must run before a module's definitions.
EARLY = ("import", "load-document")
EVIDENCE_SCHEMA = "name string, doc string, quote string, caller string"
SOURCE_SCHEMA = "name string, has_evidence boolean, manual boolean, origin string"


class ProgramError(ValueError):
    """A directive that can't be taken in; the line is part of the message."""


def in_dependency_order(definitions: list[tuple[Any, int]]) -> list[tuple[Any, int]]:
    """Definitions so that what one mentions stands before it, otherwise as they are written. Those of a cycle
    stay in their order, and fail where they need one another."""
    place = {str(e[1]): i for i, (e, _) in reversed(list(enumerate(definitions)))}
    needs = [sorted(place[s] for s in symbols(e) - {str(e[1])} if s in place) for e, _ in definitions]
    out: list[int] = []
    done: set[int] = set()
    for first in range(len(definitions)):
        stack = [(first, iter(needs[first]))]
        open_ = {first}
        while stack:
            i, rest = stack[-1]
            if i in done:
                stack.pop()
                continue
            step = next((j for j in rest if j not in done and j not in open_), None)
            if step is None:
                done.add(i)
                out.append(i)
                stack.pop()
            else:
                open_.add(step)
                stack.append((step, iter(needs[step])))
    return [definitions[i] for i in out]


@dataclass
class Entry:
    kind: str
    wff: Any
    using: tuple[str, ...] = ()
    origin: str | None = None
    quotes: tuple[tuple[str, str], ...] = ()
    line: int = 0
    module: str = ""


@dataclass
class System:
    spark: SparkSession
    rows: DataFrame | None = None
    documents: DataFrame | None = None
    overridable: bool = False
    strict: bool = True
    functions: dict[str, Callable[..., Typed]] = field(default_factory=dict)
    effects: dict[str, Callable[..., Any]] = field(default_factory=dict)
    entries: dict[str, Entry] = field(default_factory=dict)
    diffs: dict[str, tuple[str, str]] = field(default_factory=dict)
    scopes: dict[str, System] = field(default_factory=dict)
    by_hand: set[str] = field(default_factory=set)
    errors: list[tuple[str, int, str, str]] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)

    # --- taking programs in ---

    def load(self, source: str, module: str = "", lenient: bool = False, resolve: Callable[[str, int], str] | None = None) -> System:
        """Execute a program's directives; names get the module's prefix, other names what `resolve` makes
        of them. As written, one after the other, and the first that fails ends the load; or, with lenient, imports
        first, then definitions in the order of their dependencies, then other effects: one that fails is recorded,
        and what needs it is skipped, with its root cause."""
        try:
            nodes = parse_all(source)
        except ParseError as e:
            if not lenient:
                raise
            nodes = e.nodes  # P3: reading stops at the error
            self.errors.append(("parse", int("".join(filter(str.isdigit, str(e).split(":")[0])) or 0), "error", str(e)))
        own = {str(e[1]) for e, _ in nodes if isinstance(e, tuple) and len(e) > 1 and e[0] in HEADS}
        prefixed = {n: Symbol(f"{module}.{n}") for n in own} if module else {}

        def named(expr: Any, line: int) -> Any:
            if isinstance(expr, Symbol):
                name = str(expr)
                return prefixed.get(name) or (Symbol(resolve(name, line)) if resolve and name not in own else expr)
            return tuple(named(x, line) for x in expr) if isinstance(expr, tuple) else expr

        if not lenient:
            for expr, line in nodes:
                try:
                    self._directive(named(expr, line), line, module)
                except (ProgramError, NameError, TypeError, KeyError, IndexError) as e:
                    raise ProgramError(f"line {line}: {e}") from e
            return self
        defines = lambda e: isinstance(e, tuple) and len(e) > 1 and e[0] in HEADS
        effects = [(e, line) for e, line in nodes if isinstance(e, tuple) and e and not defines(e)]
        for expr, line in [x for x in effects if str(x[0][0]) in EARLY]:
            self._attempt(expr, line, module)
        definitions = [(named(e, line), line) for e, line in nodes if defines(e)]
        seen: set[str] = set()
        for expr, line in definitions:
            if str(expr[1]) in seen:
                self.errors.append((str(expr[1]), line, "warning", "duplicate name"))
            seen.add(str(expr[1]))
        for expr, line in in_dependency_order(definitions):
            self._attempt(expr, line, module)
        for expr, line in [x for x in effects if str(x[0][0]) not in EARLY]:
            self._attempt(named(expr, line), line, module)
        return self

    def _attempt(self, expr: Any, line: int, module: str) -> None:
        """A directive of a lenient load."""
        name = str(expr[1] if expr[0] in HEADS else expr[0])
        needs = sorted((symbols(expr) - {name}) & self.failed.keys())
        try:
            if needs:
                raise ProgramError(f"skipped: {needs[0]} failed ({self.failed[needs[0]]})")
            self._directive(expr, line, module)
        except (ProgramError, NameError, TypeError, KeyError, IndexError, ValueError) as e:
            root = self.failed[needs[0]] if needs else name
            if expr[0] in HEADS:
                self.failed[name] = root
            self.errors.append((name, line, "skipped" if needs else "error", root if needs else str(e)))

    def _directive(self, expr: Any, line: int, module: str) -> None:
        if not isinstance(expr, tuple) or not expr or expr[0] not in HEADS:
            self.run(expr)
            return
        head, name = str(expr[0]), str(expr[1])
        if head == "diff":
            self.diffs[name] = (str(keyword(expr, ":replace")), str(keyword(expr, ":with")))
            return
        evidence, origin = keyword(expr, ":evidence"), keyword(expr, ":origin")
        found = tuple((str(evidence[1]), str(q)) for q in keyword(evidence, ":quotes", ())) if isinstance(evidence, tuple) else ()
        using = tuple(map(str, keyword(expr, ":using", ())))
        bind = keyword(expr, ":bind")
        wff = expr[2] if len(expr) > 2 and not (isinstance(expr[2], str) and expr[2].startswith(":")) else None
        if bind is not None:
            wff = self.instantiate(str(wff), {str(n): v for n, v in bind})
        kind = {"fact": "fact", "axiom": "axiom", "derive": "theorem", "defterm": "term-fwd" if wff is None else "term-comp"}[head]
        if name in self.entries and not self.overridable:
            raise ProgramError(f"{name} exists already")
        if kind == "term-comp" and self.strict and (unknown := self.undefined(wff)):
            raise ProgramError(f"{name} mentions unknown names: {', '.join(sorted(unknown))}")
        if kind == "axiom" and not free_vars(wff):
            raise ProgramError(f"axiom {name} has no variable")
        if kind == "theorem":
            unknown = [u for u in using if u not in self.entries]
            if unknown:
                raise ProgramError(f"{name} uses unknown names: {', '.join(unknown)}")
            if isinstance(wff, Symbol) and str(wff) in self.entries and self.entries[str(wff)].kind == "axiom":
                wff = self.entries[str(wff)].wff
            if self.strict and (hidden := {s for s in self._names(wff) if s not in self.visible(using)}):
                raise ProgramError(f"{name} uses names that aren't in :using: {', '.join(sorted(hidden))}")
        self.entries[name] = Entry(kind, wff, using, None if found else (origin or (None if kind != "theorem" else "derived")), found, line, module)

    def run(self, expr: Any) -> Any:
        """An effect, on the driver, never in tasks. Its arguments are taken as they stand, quotes taken off;
        (if effect a b) runs a or b by what the effect returns."""
        if not isinstance(expr, tuple) or not expr:
            return expr
        head = str(expr[0])
        if head == "if":
            return self.run(expr[2] if self.run(expr[1]) else expr[3] if len(expr) > 3 else ())
        if head in HEADS:
            return self._directive(expr, 0, "")
        if head in self.effects:
            return self.effects[head](self, *[x[1] if isinstance(x, tuple) and len(x) == 2 and x[0] == "quote" else x for x in expr[1:]])
        return None

    def instantiate(self, name: str, bound: dict[str, Any]) -> Any:
        """P10."""
        if name not in self.entries or self.entries[name].wff is None:
            raise ProgramError(f"nothing to instantiate: {name}")
        return substitute(self.entries[name].wff, bound)

    def retract(self, *names: str) -> None:
        """P11."""
        for n in names:
            self.entries.pop(n, None)
            self.diffs.pop(n, None)

    def verify_manual(self, *names: str) -> None:
        """P12."""
        self.by_hand |= set(names)

    def hot_patch(self, source: str, module: str = "") -> System:
        """A changed module's names are retracted, then its source is loaded."""
        self.retract(*[n for n, e in self.entries.items() if e.module == module])
        return self.load(source, module)

    def snapshot(self) -> System:
        """P25: a copy that later changes don't touch."""
        copied = System(self.spark, self.rows, self.documents, self.overridable, self.strict, dict(self.functions), dict(self.effects))
        copied.errors, copied.failed = list(self.errors), dict(self.failed)
        copied.entries, copied.diffs, copied.scopes, copied.by_hand = dict(self.entries), dict(self.diffs), dict(self.scopes), set(self.by_hand)
        return copied

    # --- names ---

    def _names(self, expr: Any) -> set[str]:
        return symbols(expr) & self.entries.keys()

    def undefined(self, expr: Any) -> set[str]:
        """L2: names in an expression that stand for nothing here; single letters may."""
        heads = {str(e.wff[1][0]) for e in self.entries.values() if isinstance(e.wff, tuple) and len(e.wff) == 3 and e.wff[0] == "=" and isinstance(e.wff[1], tuple)}
        known = self.entries.keys() | self.functions.keys() | OPERATORS.keys() | FORMS | {"scope", "delegate"} | self.scopes.keys() | heads | _bound(expr)
        columns = self.rows.columns if self.rows is not None else []
        return {s for s in symbols(expr) - known - set(columns) if not (len(s) == 1 and s.isalpha())}

    def visible(self, using: tuple[str, ...]) -> set[str]:
        """L3: what `using` names mention, again and again. Theorems bring what they were derived from."""
        seen: set[str] = set()
        open_ = [u for u in using if u in self.entries]
        while open_:
            n = open_.pop()
            if n not in seen:
                seen.add(n)
                e = self.entries[n]
                open_ += [*self._names(e.wff), *e.using]
        return seen

    def edges(self) -> list[tuple[str, str]]:
        """(name, what mentions or uses it)."""
        out = {(s, n) for n, e in self.entries.items() for s in {*self._names(e.wff), *(u for u in e.using if u in self.entries)} if s != n}
        return sorted(out)

    def dependents(self, name: str) -> set[str]:
        """L10."""
        out: set[str] = set()
        front = {name}
        edges = self.edges()
        while front:
            front = {d for s, d in edges if s in front} - out - {name}
            out |= front
        return out

    def provenance(self, name: str) -> dict[str, Any]:
        """An entry with those that it rests on."""
        e = self.entries[name]
        below = sorted({*self._names(e.wff), *e.using} - {name})
        return {"name": name, "kind": e.kind, "wff": to_sexp(e.wff), "origin": e.origin, "inputs": [self.provenance(b) for b in below if b in self.entries]}

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """G1: nodes (name, kind, value) and edges (src, dst) for the graph operators."""

        def kind(e: Entry) -> str:
            rests_on_axiom = any(self.entries[u].kind == "axiom" for u in e.using if u in self.entries)
            return "calc" if e.kind == "theorem" and not rests_on_axiom else e.kind

        nodes = [(n, kind(e), to_sexp(e.wff) if e.wff is not None else None) for n, e in self.entries.items()]
        return self.spark.createDataFrame(nodes, "name string, kind string, value string"), self.spark.createDataFrame(self.edges(), "src string, dst string")

    def probe(self, *names: str) -> tuple[DataFrame, DataFrame]:
        """G1: nodes (name, kind, value, quotes) and edges (src, dst) of all that the names rest on: a theorem on what it
        uses, a term on what it mentions, and __output__ on the names. Unknown names are left out."""
        inputs: dict[str, list[str]] = {}
        open_ = [n for n in names if n in self.entries]
        while open_:
            n = open_.pop()
            if n not in inputs:
                e = self.entries[n]
                below = list(e.using) if e.kind == "theorem" else sorted(self._names(e.wff)) if e.kind == "term-comp" else []
                inputs[n] = [b for b in below if b in self.entries]
                open_ += inputs[n]
        kind = lambda n: "calc" if self.entries[n].kind == "theorem" and not any(self.entries[u].kind == "axiom" for u in inputs[n]) else self.entries[n].kind
        value = lambda n: to_sexp(self.entries[n].wff) if self.entries[n].wff is not None else ""
        nodes = [(n, kind(n), value(n), [q for _, q in self.entries[n].quotes]) for n in sorted(inputs)] + [("__output__", "synthetic", "", [])]
        edges = [(b, n) for n, below in inputs.items() for b in below] + [(n, "__output__") for n in names if n in inputs]
        return self.spark.createDataFrame(nodes, "name string, kind string, value string, quotes array<string>"), self.spark.createDataFrame(edges, "src string, dst string")

    def roots(self) -> list[str]:
        """Names that no theorem uses and no term mentions."""
        used = {u for e in self.entries.values() if e.kind == "theorem" for u in e.using} | {s for e in self.entries.values() if e.kind == "term-comp" for s in self._names(e.wff)}
        return [n for n in self.entries if n not in used]

    def probe_all(self) -> tuple[DataFrame, DataFrame]:
        """The graph of the whole program, from its roots."""
        return self.probe(*self.roots())

    def dissect(self, diff: str) -> list[tuple[DataFrame, DataFrame]]:
        """The two graphs of a diff, of what is replaced and of what stands for it."""
        return self.compose(*self.diffs[diff])

    def compose(self, *names: str) -> list[tuple[DataFrame, DataFrame]]:
        """A graph for each name."""
        return [self.probe(n) for n in names]

    def inspect(self, name: str, most: int = 10) -> tuple[DataFrame, DataFrame] | list[str]:
        """The graph of a name, or the names that an unknown one may have meant."""
        if name in self.entries:
            return self.probe(name)
        names = self.spark.createDataFrame([(n,) for n in self.entries], "name string")
        return [r["name"] for r in fuzzy(names, name, most).collect()]

    def doc(self) -> DataFrame:
        """P20: what a program may call: operators, forms and functions, by name."""
        rows = [(n, "operator") for n in OPERATORS] + [(n, "form") for n in FORMS] + [(n, "function") for n in self.functions] + [(n, "effect") for n in self.effects]
        return self.spark.createDataFrame(sorted(rows), "name string, kind string")

    def contradictions(self) -> DataFrame:
        """(expression, names) of closed expressions that the program gives as true in one place and false in
        another, by (= expression true) and (= expression false)."""
        said = [(to_sexp(e.wff[1]), n, e.wff[2]) for n, e in self.entries.items() if isinstance(e.wff, tuple) and len(e.wff) == 3 and e.wff[0] == "=" and isinstance(e.wff[2], bool)]
        return logic.contradictions(self.spark.createDataFrame(said, "expression string, name string, value boolean"))

    # --- evaluation ---

    def rules(self, names: set[str] | None = None) -> Rules:
        """Rewrite axioms first, then theorems of that form, in the order of the program."""
        out = Rules()
        for kind in ("axiom", "theorem"):
            for n, e in self.entries.items():
                rule = isinstance(e.wff, tuple) and len(e.wff) == 3 and e.wff[0] == "=" and isinstance(e.wff[1], tuple)
                if e.kind == kind and rule and free_vars(e.wff[1]) and (names is None or n in names):
                    out.add(e.wff)
        return out

    def compiler(self, using: tuple[str, ...] | None = None, override: dict[str, Any] | None = None) -> Compiler:
        names = None if using is None else self.visible(using)
        terms = {n: e.wff for n, e in self.entries.items() if e.kind in ("fact", "term-comp", "theorem") and (names is None or n in names)}
        base = self.rows if self.rows is not None else self.spark.range(1).select()
        return Compiler.of(base, terms=terms | (override or {}), rules=self.rules(names), functions=self.functions, strict=self.strict)

    def select(self, expressions: dict[str, Any], keep: tuple[str, ...] = ()) -> DataFrame:
        """L1: any number of expressions in one projection."""
        base = self.rows if self.rows is not None else self.spark.range(1)
        compiler = self.compiler()
        read = lambda e: parse(e) if isinstance(e, str) and not isinstance(e, Symbol) else e
        made = {n: compiler.compile(self.resolved(read(e))) for n, e in expressions.items()}
        return base.select(*keep, *[c.alias(n) for n, c in made.items()])

    def evaluate(self, expr: Any) -> Any:
        """The value of an expression on one row."""
        if isinstance(expr, str) and not isinstance(expr, Symbol):
            expr = parse(expr)
        return self.select({"value": expr}).first()["value"]

    def resolved(self, expr: Any, outer: tuple[System, ...] = ()) -> Any:
        """Scopes, projections and delegations, replaced by values or by expressions of this system.

        (scope name e) is e in another system; (project e), inside, is e in the enclosing one; (delegate e) is e
        in the nearest enclosing system that can evaluate it, one level further out for each nested delegate."""
        if not isinstance(expr, tuple) or not expr or expr[0] == "quote":
            return expr
        head = str(expr[0])
        if head == "strict":
            body = self.resolved(expr[1], outer)
            columns = set(self.rows.columns) if self.rows is not None else set()
            return body if symbols(body) & columns else _literal(self.evaluate(body))
        if head == "scope" and str(expr[1]) == "self":
            return self.resolved(expr[2], (self, *outer))
        if head == "scope":
            inner = self.scopes.get(str(expr[1]))
            if inner is None:
                raise NameError(f"unknown scope: {expr[1]}")
            return _literal(inner.evaluate(inner.resolved(expr[2], (self, *outer))))
        if head == "project":
            owner = outer[0] if outer else self
            basis, body = (owner, expr[1]) if len(expr) == 2 else (owner.scopes.get(str(expr[1]), owner), expr[2])
            return _literal(basis.evaluate(body))
        if head == "delegate":
            depth, body, pattern = 1, expr[1], None
            if len(expr) == 3:
                pattern, body = expr[1], expr[2]
            while isinstance(body, tuple) and body and body[0] == "delegate":
                depth, body = depth + 1, body[-1]
            for system in outer:
                try:
                    value = system.evaluate(body)
                    if pattern is not None and not system.evaluate(substitute(pattern, {"?_self": _literal(value)})):
                        continue
                except (NameError, TypeError):
                    continue
                depth -= 1
                if not depth:
                    return _literal(value)
            raise NameError(f"no enclosing scope answers {to_sexp(expr)}")
        return tuple(self.resolved(x, outer) for x in expr)

    # --- tables ---

    def sources(self) -> DataFrame:
        """(name, verified, manual, origin): one row for each entry, its quotes verified against the documents."""
        rows = [(n, bool(e.quotes), n in self.by_hand, e.origin) for n, e in self.entries.items()]
        table = self.spark.createDataFrame(rows, SOURCE_SCHEMA)
        asked = [(n, d, q, n) for n, e in self.entries.items() for d, q in e.quotes]
        if not asked or self.documents is None:
            return table.select("name", F.when(F.col("has_evidence"), F.lit(False)).alias("verified"), "manual", "origin")
        found = quotes.verify_named(self.documents, self.spark.createDataFrame(asked, EVIDENCE_SCHEMA))
        checked = found.select("name", (F.col("strategy") != "none").alias("verified"))
        counts = self.spark.createDataFrame(asked, EVIDENCE_SCHEMA).groupBy("name").agg(F.count(F.lit(1)).alias("asked"))
        rolled = checked.groupBy("name").agg(F.bool_and("verified").alias("all"), F.count(F.lit(1)).alias("answered"))
        done = counts.join(rolled, "name", "left").select("name", (F.coalesce("all", F.lit(False)) & (F.col("answered") == F.col("asked"))).alias("v"))
        verified = F.when(F.col("has_evidence"), F.coalesce("v", F.lit(False)))
        return table.join(done, "name", "left").select("name", verified.alias("verified"), "manual", "origin")

    def theorems(self) -> DataFrame:
        """(name, holds, ungrounded, origin) of every theorem, all evaluated in one select. Truth and
        taint are computed afresh, so nothing needs to be derived again."""
        names = [n for n, e in self.entries.items() if e.kind == "theorem"]
        if not names:
            return self.spark.createDataFrame([], "name string, using array<string>, holds boolean, ungrounded array<string>, origin string")
        closed = {n: self.entries[n].wff for n in names if not free_vars(self.entries[n].wff)}
        truths = self._truths(closed)
        every = truths.agg(*[F.coalesce(F.bool_and(F.col(f"`{n}`")), F.lit(True)).alias(n) for n in closed]).first().asDict() if closed else {}
        rows = [(n, list(self.entries[n].using), every.get(n, True)) for n in names]
        table = self.spark.createDataFrame(rows, "name string, using array<string>, truth boolean")
        return logic.derive(table, F.col("truth"), table, self.sources()).drop("truth")

    def _truths(self, closed: dict[str, Any], keep: tuple[str, ...] = ()) -> DataFrame:
        """A boolean column for each expression: false where its value is false or null."""
        values = self.select(closed, keep)
        kinds = {f.name: f.dataType.typeName() for f in values.schema}
        col = lambda n: F.col(f"`{n}`")
        return values.select(*keep, *[(F.coalesce(col(n), F.lit(False)) if kinds[n] == "boolean" else col(n).isNotNull()).alias(n) for n in closed])

    def theorems_by_row(self, *keys: str) -> DataFrame:
        """L7 over rows: (keys, name, holds): every closed theorem on every row, in one projection."""
        closed = {n: e.wff for n, e in self.entries.items() if e.kind == "theorem" and not free_vars(e.wff)}
        each = [F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("holds")) for n in closed]
        return self._truths(closed, keys).select(*keys, F.explode(F.array(*each)).alias("t")).select(*keys, "t.*")

    def rederive(self, *names: str) -> DataFrame:
        """theorems() of some names; truth is computed with the taint, so one that doesn't hold stays so."""
        return self.theorems().where(F.col("name").isin(*names))

    def diff_values(self) -> DataFrame:
        """(diff, name, base, other, status, divergent): each diff's two values, and those of every dependent
        under both, in one select, and on how many rows they differ. Over several rows the values are those of one
        on which they differ, if there is one. A dependent that can't be computed is compared as an expression."""
        made: dict[tuple[str, str], tuple[Any, Any]] = {}
        columns: dict[str, Any] = {}
        base, rows = self.compiler(), []
        for diff, (replace, with_) in self.diffs.items():
            other = self.compiler(override={replace: Symbol(with_) if replace != with_ else self.entries[replace].wff})
            for name in [replace, *sorted(self.dependents(replace))]:
                wff = Symbol(name)
                if self.entries[name].kind in ("axiom", "term-fwd") or free_vars(self.entries[name].wff):
                    continue
                alt = Symbol(with_) if name == replace else self.entries[name].wff
                try:
                    columns[f"a{len(made)}"], columns[f"b{len(made)}"] = base.compile(wff), other.compile(alt)
                    made[diff, name] = (f"a{len(made)}", f"b{len(made)}")
                except (NameError, TypeError):
                    changed = to_sexp(substitute(self.entries[name].wff, {replace: Symbol(with_)}))
                    rows.append((diff, name, to_sexp(self.entries[name].wff), changed, int(changed != to_sexp(self.entries[name].wff))))
        if columns:
            # Compared by value; only what is shown becomes text.
            base_rows = (self.rows if self.rows is not None else self.spark.range(1)).select(*[c.alias(n) for n, c in columns.items()])
            differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
            shown = lambda a, b: F.max(F.struct(differ(a, b).alias("d"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")))
            asked = [x for a, b in made.values() for x in (shown(a, b).alias(a), F.count_if(differ(a, b)).alias(b))]
            one = base_rows.agg(*asked).first()
            rows += [(d, n, one[a]["a"] if one[a] else None, one[a]["b"] if one[a] else None, one[b]) for (d, n), (a, b) in made.items()]
        for diff, (replace, _) in self.diffs.items():
            for n, e in self.entries.items():
                if replace in e.using and replace not in symbols(e.wff) and e.kind == "theorem":
                    rows.append((diff, n, to_sexp(e.wff), f"<contaminated: uses {replace}>", 1))
            rows += [(diff, d, f"diff({p[0]} vs {p[1]})", f"<contaminated: references {replace}>", 1) for d, p in self.diffs.items() if d != diff and replace in p]
        table = self.spark.createDataFrame(rows, "diff string, name string, base string, other string, divergent long").distinct()
        return table.withColumn("status", F.when(F.col("divergent") == 0, "same").otherwise("divergent"))

    def diff_report(self) -> DataFrame:
        """(name, item) of diffs: downstream or value divergence, or contamination alone."""
        heads = self.spark.createDataFrame([(d, r) for d, (r, _) in self.diffs.items()], "diff string, replace string")
        rows = self.diff_values().join(heads, "diff").where("status = 'divergent'")
        tainted = F.startswith("other", F.lit("<contaminated"))
        below = F.col("name") != F.col("replace")
        counts = rows.groupBy("diff").agg(F.count_if(below & ~tainted).alias("real"), F.count_if(below & tainted).alias("tainted"), F.count_if(~below).alias("own"))
        item = F.when(F.col("real") > 0, "downstream_divergent").when(F.col("tainted") > 0, "contamination_only").when(F.col("own") > 0, "value_divergent")
        return counts.select(F.col("diff").alias("name"), item.alias("item"))

    def consistency(self, *diffs: str) -> DataFrame:
        """(name, item) of all issues and warnings; of some diffs only, if any are named."""
        state = self.sources().unionByName(
            self.theorems().select("name", F.lit(None).cast("boolean").alias("verified"), F.lit(False).alias("manual"), "origin")
        )
        listed = state.groupBy("name").agg(F.max("verified").alias("verified"), F.bool_or("manual").alias("manual"), F.max("origin").alias("origin"))
        items = logic.evidence_items(listed.withColumn("origin", F.when(F.col("origin") == "does not hold", logic.FABRICATION).otherwise(F.col("origin"))))
        if not self.diffs:
            return items
        return items.unionByName(self.diff_report().where(F.col("name").isin(*diffs)) if diffs else self.diff_report())

    def consistent(self) -> bool:
        return bool(logic.consistent(self.consistency()).first().consistent)

    def danglings(self) -> DataFrame:
        """Names that no theorem, term or diff refers to."""
        names = self.spark.createDataFrame([(n,) for n in self.entries], "name string")
        used = {s for s, _ in self.edges()} | {x for p in self.diffs.values() for x in p}
        return logic.danglings(names, self.spark.createDataFrame([(u,) for u in sorted(used)], "name string"))

    def state(self, blinded: bool = False) -> DataFrame:
        """The catalog, with values or with their types alone."""
        rows = [(n, e.kind, to_sexp(e.wff) if e.wff is not None else None, type(e.wff).__name__, e.module, e.line) for n, e in self.entries.items()]
        table = self.spark.createDataFrame(rows, "name string, kind string, value string, vtype string, module string, line int")
        return table.drop("value") if blinded else table

    def error_report(self) -> DataFrame:
        return self.spark.createDataFrame(self.errors, "name string, line int, status string, cause string")


def _bound(expr: Any) -> set[str]:
    """Names that a let in the expression binds."""
    if not isinstance(expr, tuple) or not expr:
        return set()
    own = {str(b[0]) for b in expr[1]} if expr[0] == "let" and len(expr) > 1 else set()
    return own.union(*map(_bound, expr))


def _literal(value: Any) -> Any:
    return tuple([Symbol("list"), *map(_literal, value)]) if isinstance(value, (list, tuple)) else value


def known_operators() -> list[str]:
    return sorted(OPERATORS)
