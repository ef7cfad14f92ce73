"""Expressions of the language as Spark columns.

Names stand for columns of a row, for lazy terms (expressions of their own), or for functions. Types are
found while compiling: number, string, boolean or array of one of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gneiss.functions import arrays as A, scalar as S

from .sexpr import Rules, Symbol, parse, substitute, symbols, to_sexp

Typed = tuple[Column, str]


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.ArrayType):
        return f"array of {kind_of(dtype.elementType)}"
    return "string"


@dataclass
class Compiler:
    """columns: kind of each column that a name may stand for."""

    columns: dict[str, str]
    terms: dict[str, Any] = field(default_factory=dict)
    rules: Rules = field(default_factory=Rules)
    functions: dict[str, Callable[..., Typed]] = field(default_factory=dict)
    strict: bool = True

    @classmethod
    def of(cls, df: DataFrame, **more: Any) -> Compiler:
        return cls({f.name: kind_of(f.dataType) for f in df.schema}, **more)

    def unknown(self, expr: Any) -> set[str]:
        """L2: names that stand for nothing."""
        known = self.columns.keys() | self.terms.keys() | self.functions.keys() | self.rules.by_head.keys() | OPERATORS.keys() | FORMS
        return {s for s in symbols(expr) if s not in known and not (len(s) == 1 and s.isalpha())}

    def compile(self, expr: Any) -> Column:
        if isinstance(expr, str) and not isinstance(expr, Symbol):
            expr = parse(expr)
        expr = self.rules.rewrite(self._equalities(expr))
        if self.strict and (bad := self.unknown(expr)):
            raise NameError(f"unknown names: {', '.join(sorted(bad))}")
        return self._typed(expr, {})[0]

    def _formal(self, expr: Any) -> bool:
        """Whether an expression has a head that nothing computes: it then stands for itself."""
        if not isinstance(expr, tuple) or not expr or expr[0] == "quote":
            return False
        head = str(expr[0])
        known = head in OPERATORS or head in FORMS or head in self.functions or head in self.columns or self.terms.get(head) is not None
        return not known or any(map(self._formal, expr[1:]))

    def _equalities(self, expr: Any) -> Any:
        """F16: equalities of formal expressions that the rules lead to a common one are true."""
        if not isinstance(expr, tuple) or not expr or expr[0] == "quote":
            return expr
        if expr[0] == "=" and len(expr) > 2 and any(map(self._formal, expr[1:])) and all(self.rules.joined(expr[1], x) for x in expr[2:]):
            return True
        return tuple(self._equalities(x) for x in expr)

    def _typed(self, expr: Any, env: dict[str, Typed]) -> Typed:
        if isinstance(expr, bool):
            return F.lit(expr), "boolean"
        if isinstance(expr, (int, float)):
            return F.lit(expr), "number"
        if isinstance(expr, Symbol):
            return self._name(str(expr), env)
        if isinstance(expr, str):
            return F.lit(expr), "string"
        if not expr:
            return F.array(), "array of string"
        head, args = expr[0], list(expr[1:])
        if head == "if":
            cond, kind = self._typed(args[0], env)
            (yes, kind_yes), (no, _) = self._typed(args[1], env), self._typed(args[2], env)
            return F.when(S.truthy(cond, kind.split()[0]), yes).otherwise(no), kind_yes
        if head == "let":
            inner = dict(env)
            for name, value in args[0]:
                inner[str(name)] = self._typed(value, inner)
            return self._typed(args[1], inner)
        if head in ("quote", "list"):
            items = [self._typed(x, env) for x in (args[0] if head == "quote" and isinstance(args[0], tuple) else args)]
            kinds = {k for _, k in items} or {"string"}
            if len(kinds) > 1:
                raise TypeError(f"a list of several kinds: {to_sexp(expr)}")
            return F.array(*[c for c, _ in items]), f"array of {kinds.pop()}"
        if head == "self":
            return [self._typed(self.rules.rewrite(a), env) for a in args][-1]
        if head in ("strict", "project"):
            return self._typed(args[-1], env)
        if head in self.terms and args and args[0] == ":bind":
            bound = {str(n): v for n, v in args[1]}
            return self._typed(self.rules.rewrite(substitute(self.terms[head], bound)), env)
        if head in self.functions:
            return self.functions[head](*[self._typed(a, env) for a in args])
        if head in OPERATORS:
            return OPERATORS[head](*[self._typed(a, env) for a in args])
        raise NameError(f"no such function: {to_sexp(head)}")

    def _name(self, name: str, env: dict[str, Typed]) -> Typed:
        if name in env:
            return env[name]
        if name in self.columns:
            return F.col(f"`{name}`"), self.columns[name]
        if name in self.terms:
            return self._typed(self.rules.rewrite(self.terms[name]), env)
        if self.strict:
            raise NameError(f"unknown name: {name}")
        return F.lit(name), "string"


def _plus(a: Typed, b: Typed) -> Typed:
    return (a[0] + b[0], "number") if a[1] == "number" else (F.concat(a[0], b[0]), a[1])


def _equal(*args: Typed) -> Typed:
    first = args[0]
    return S.all_of([S.equal(first[0], first[1], c, k) for c, k in args[1:]]), "boolean"


def _truths(args: tuple[Typed, ...]) -> list[Column]:
    return [S.truthy(c, k.split()[0]) for c, k in args]


def _number(f: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *args: (f(*[c for c, _ in args]), "number")


def _boolean(f: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *args: (f(*[c for c, _ in args]), "boolean")


FORMS = {"if", "let", "quote", "list", "strict", "self", "project", ":bind"}
OPERATORS: dict[str, Callable[..., Typed]] = {
    "+": _plus,
    "-": _number(lambda a, b: a - b),
    "*": _number(lambda a, b: a * b),
    "/": _number(S.divide),
    "mod": _number(S.mod),
    ">": _boolean(lambda a, b: a > b),
    "<": _boolean(lambda a, b: a < b),
    ">=": _boolean(lambda a, b: a >= b),
    "<=": _boolean(lambda a, b: a <= b),
    "=": _equal,
    "!=": lambda a, b: (~S.equal(a[0], a[1], b[0], b[1]), "boolean"),
    "and": lambda *args: (S.all_of(_truths(args)), "boolean"),
    "or": lambda *args: (S.any_of(_truths(args)), "boolean"),
    "not": lambda a: (~_truths((a,))[0], "boolean"),
    "implies": lambda a, b: (S.implies(_truths((a,))[0], _truths((b,))[0]), "boolean"),
    "length": _number(A.length),
    "sum-values": lambda *args: (A.sum_values(args[0][0] if args[0][1].startswith("array") else F.array(*[c for c, _ in args])), "number"),
    "count-exists": lambda *args: (A.count_exists(F.array(*[c.cast("boolean") for c, _ in args])), "number"),
    "nth": lambda i, xs: (A.nth(xs[0], i[0]), xs[1].removeprefix("array of ")),
    "reverse": lambda xs: (A.reverse(xs[0]), xs[1]),
    "member": lambda x, xs: (A.member(x[0], xs[0]), "boolean"),
    "cons": lambda x, xs: (A.cons(x[0], xs[0]), xs[1]),
    "concat": lambda *args: (A.concat(*[c for c, _ in args]), args[0][1]),
    "joint-status": lambda *args: (A.joint_status(F.array(*[c for c, _ in args])), "string"),
}
