"""Registered queries of the language: reading, rewriting, evaluation, programs, modules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import arrays as A
from gneiss.operators import graph as G, logic
from gneiss.sources import codec

from . import library, loader
from .catalogue import _sources, _table, query
from .compiler import Compiler
from .sexpr import Rules, Symbol, free_vars, match, parse, parse_all, repaired, substitute, symbols, to_sexp
from .system import System, in_dependency_order
from .views import Lens

REPORT = "Sales in the third quarter were 40.\nCosts were 25 and rent was 5.\nStaff: 12."
PROGRAM = """
(fact sales 40 :evidence (evidence "q3" :quotes ("Sales in the third quarter were 40")))
(fact costs 25 :evidence (evidence "q3" :quotes ("costs were 25")))
(fact rent 5 :evidence (evidence "q3" :quotes ("the rent is unknown")))
(fact staff 12 :origin "counted")
(fact seats 14)
(defterm profit (- sales costs) :origin "by definition")
(defterm net (- profit rent))
(defterm healthy :origin "forward")
(axiom healthy-rule (= (healthy ?x) (> ?x 0)) :origin "rule")
(axiom largest-one (= (largest ?a) ?a) :origin "rule")
(axiom largest-more (= (largest ?a ?b ?...r) (if (> ?a ?b) (largest ?a ?...r) (largest ?b ?...r))) :origin "rule")
(defterm largest :origin "forward")
(derive makes-money (> profit 0) :using (profit))
(derive is-healthy healthy-rule :bind ((?x net)) :using (healthy-rule net))
(derive too-large (> staff seats) :using (staff seats))
(diff rent-free :replace rent :with staff)
(diff same-seats :replace seats :with seats)
"""


def values(names: str, *rows: str) -> str:
    """SQL of a small table that is known beforehand."""
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) t({names})"


def _system(spark) -> System:
    docs = spark.createDataFrame([("q3", REPORT)], "doc string, text string")
    return System(spark, documents=docs).load(PROGRAM)


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- reading and rewriting ---


@query(values("line, head, name, mentions", "1, 'fact', 'a', ''", "2, 'defterm', 'b', 'a'", "4, 'derive', 't', 'a,b'", "5, 'say', NULL, ''"))
def directive_table(spark, sf_dir):
    """P1, P2, P9, P13."""
    text = '(fact a 1 :origin "x") ; a comment\n(defterm b (+ a ?x 2.5))\n\n(derive t (> b a) :using (a b))\n(say "a (b) \\" ;")'
    rows = []
    for e, line in parse_all(text):
        head = str(e[0])
        defined = str(e[1]) if head != "say" else None
        rows.append((line, head, defined, ",".join(sorted(symbols(e) - {head, defined, "+", ">"}))))
    return _rows(spark, rows, "line int, head string, name string, mentions string")


@query(values("source, printed", "'(a  \"x y\" 1.50)', '(a \"x y\" 1.5)'", "'''(1 2)', '(quote 1 2)'", "'(f true -3 ?x :k)', '(f true -3 ?x :k)'"))
def printed_expressions(spark, sf_dir):
    """P2."""
    texts = ['(a  "x y" 1.50)', "'(1 2)", "(f true -3 ?x :k)"]
    return _rows(spark, [(t, to_sexp(parse(t))) for t in texts], "source string, printed string")


@query(values("source, fixed", "'(count (re \"a\"', '(count (re \"a\"))'", "'(limit 2 (list 1 2)))', '(limit 2 (list 1 2))'", "'''(a b)', '(a b)'"))
def repaired_queries(spark, sf_dir):
    """P23."""
    texts = ['(count (re "a"', "(limit 2 (list 1 2)))", "'(a b)"]
    return _rows(spark, [(t, repaired(t)) for t in texts], "source string, fixed string")


@query(values("pattern, expression, result", "'(f ?x ?x)', '(f 1 2)', NULL", "'(f ?x ?x)', '(f (g) (g))', '(r (g))'", "'(f ?x ?...r)', '(f 1 2 3)', '(r 1 2 3)'", "'(f ?x 1)', '(f 2 true)', NULL"))
def matched_patterns(spark, sf_dir):
    """U1, U2."""
    cases = [("(f ?x ?x)", "(f 1 2)", "(r ?x)"), ("(f ?x ?x)", "(f (g) (g))", "(r ?x)"), ("(f ?x ?...r)", "(f 1 2 3)", "(r ?x ?...r)"), ("(f ?x 1)", "(f 2 true)", "(r ?x)")]
    rows = []
    for p, e, r in cases:
        bound = match(parse(p), parse(e))
        rows.append((p, e, None if bound is None else to_sexp(substitute(parse(r), bound))))
    return _rows(spark, rows, "pattern string, expression string, result string")


@query("SELECT p_partkey, greatest(p_size, p_size % 7, 5) AS most, p_size * 2 + 1 AS twice, 6 AS folded FROM part")
def rewritten_expressions(spark, sf_dir):
    """Variadic rules, rules by head and number of arguments, a function as an argument, folding."""
    rules = Rules()
    for r in (
        "(= (largest ?a) ?a)",
        "(= (largest ?a ?b ?...r) (if (> ?a ?b) (largest ?a ?...r) (largest ?b ?...r)))",
        "(= (call ?f ?x) (?f ?x))",
        "(= (double ?x) (* ?x 2))",
        "(= (down ?n) (if (> ?n 0) (+ ?n 0) 0))",
    ):
        rules.add(r)
    part = _table(spark, sf_dir, "part")
    c = Compiler.of(part, rules=rules)
    return part.select("p_partkey", c.compile("(largest p_size (mod p_size 7) 5)").cast("int").alias("most"), c.compile("(+ (call double p_size) 1)").alias("twice"), c.compile("(down (* 2 3))").alias("folded"))


@query(values("left_side, right_side, equal", "'(add a b)', '(add b a)', true", "'(add a b)', '(add a a)', false", "'(add (neg a) a)', 'zero', true"))
def joined_equalities(spark, sf_dir):
    """F16."""
    rules = Rules()
    rules.add("(= (add ?x ?y) (add ?y ?x))")
    rules.add("(= (add ?x (neg ?x)) zero)")
    cases = [("(add a b)", "(add b a)"), ("(add a b)", "(add a a)"), ("(add (neg a) a)", "zero")]
    return _rows(spark, [(a, b, rules.joined(parse(a), parse(b))) for a, b in cases], "left_side string, right_side string, equal boolean")


# --- scalar operators over rows ---


@query("""SELECT o_orderkey, o_orderstatus || '-x' AS tag, o_orderstatus <> 'F' AS other, o_custkey + o_orderkey AS added, (o_orderstatus = 'F' OR o_totalprice > 200000) AS either,
 NOT (o_orderkey % 2 <> 0) AS even, [1, 2, 3][(o_orderkey % 3) + 1] AS picked, o_totalprice BETWEEN 1000 AND 90000 AS within FROM orders""")
def operators_over_rows(spark, sf_dir):
    """F1, F6-F9, F11-F14, F19, F25."""
    o = _table(spark, sf_dir, "orders")
    c = Compiler.of(o, terms={"between": parse("(and (>= o_totalprice ?low) (<= o_totalprice ?high))")})
    made = {
        "tag": '(+ o_orderstatus "-x")',
        "other": '(!= o_orderstatus "F")',
        "added": "(+ o_custkey o_orderkey)",
        "either": '(or (= o_orderstatus "F") (> o_totalprice 200000))',
        "even": "(not (mod o_orderkey 2))",
        "picked": "(nth (mod o_orderkey 3) (quote (1 2 3)))",
        "within": "(between :bind ((?low 1000) (?high 90000)))",
    }
    cols = {n: c.compile(e) for n, e in made.items()}
    cols["picked"] = Compiler.of(o.withColumn("at", F.expr("cast(o_orderkey % 3 as int)"))).compile("(nth at (quote (1 2 3)))")
    return o.withColumn("at", F.expr("cast(o_orderkey % 3 as int)")).select("o_orderkey", *[col.alias(n) for n, col in cols.items()])


@query("SELECT c_custkey, c_acctbal > 0 AS good, 'nowhere' AS loose, c_acctbal * 2 AS doubled FROM customer")
def functions_and_loose_names(spark, sf_dir):
    """Functions of the user's, and names that stand for themselves where that is allowed."""
    c = _table(spark, sf_dir, "customer")
    functions = {"twice": lambda x: (x[0] * 2, "number")}
    loose = Compiler.of(c, functions=functions, strict=False)
    return c.select("c_custkey", loose.compile("(> c_acctbal 0)").alias("good"), loose.compile("nowhere").alias("loose"), loose.compile("(twice c_acctbal)").alias("doubled"))


@query(values("expression, unknown", "'(+ a nowhere)', 'nowhere'", "'(foo (bar a))', 'bar,foo'", "'(if x a b)', ''"))
def unknown_names(spark, sf_dir):
    """L2."""
    c = Compiler({"a": "number"})
    texts = ["(+ a nowhere)", "(foo (bar a))", "(if x a b)"]
    return _rows(spark, [(t, ",".join(sorted(c.unknown(parse(t))))) for t in texts], "expression string, unknown string")


@query("SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above, o_totalprice - (SELECT min(o_totalprice) FROM orders) AS over_least, 12 AS delegated, 3 AS forced FROM orders")
def scoped_values(spark, sf_dir):
    """Values of other systems, of the enclosing one, and of the nearest that can answer."""
    o = _table(spark, sf_dir, "orders")
    stats = System(spark, rows=o.agg(F.avg("o_totalprice").alias("mean"), F.min("o_totalprice").alias("least")))
    inner = System(spark).load("(fact x 5)")
    outer = System(spark, rows=o, scopes={"stats": stats})
    base = System(spark, scopes={"in": inner}).load("(fact z 7)")
    outer.functions["base"] = lambda: (F.lit(base.evaluate("(scope in (+ x (delegate z)))")), "number")
    made = {"above": "(> o_totalprice (project stats mean))", "over_least": "(- o_totalprice (scope stats least))", "delegated": "(base)", "forced": "(self 1 (+ 1 (strict (+ 1 1))))"}
    return outer.select(made, keep=("o_orderkey",)).withColumn("delegated", F.col("delegated").cast("int"))


# --- programs ---


@query(
    values(
        "name, kind, value",
        "'sales', 'fact', '40'", "'costs', 'fact', '25'", "'rent', 'fact', '5'", "'staff', 'fact', '12'", "'seats', 'fact', '14'", "'profit', 'term-comp', '(- sales costs)'", "'net', 'term-comp', '(- profit rent)'",
        "'healthy', 'term-fwd', NULL", "'healthy-rule', 'axiom', '(= (healthy ?x) (> ?x 0))'", "'largest-one', 'axiom', '(= (largest ?a) ?a)'",
        "'largest-more', 'axiom', '(= (largest ?a ?b ?...r) (if (> ?a ?b) (largest ?a ?...r) (largest ?b ?...r)))'", "'largest', 'term-fwd', NULL", "'makes-money', 'theorem', '(> profit 0)'",
        "'is-healthy', 'theorem', '(= (healthy net) (> net 0))'", "'too-large', 'theorem', '(> staff seats)'",
    )
)
def program_state(spark, sf_dir):
    """P4-P8, P10, P20."""
    return _system(spark).state().select("name", "kind", "value")


@query(
    values("name, holds, origin", "'makes-money', true, 'derived'", "'is-healthy', true, 'derived'", "'too-large', false, 'does not hold'")
)
def program_theorems(spark, sf_dir):
    """L4, L5, L7, L8."""
    return _system(spark).rederive("makes-money", "is-healthy", "too-large").select("name", "holds", "origin")


@query(
    values(
        "name, item",
        "'rent', 'unverified'", "'staff', 'no_evidence'", "'too-large', 'no_evidence'", "'profit', 'no_evidence'", "'healthy', 'no_evidence'", "'largest', 'no_evidence'", "'healthy-rule', 'no_evidence'",
        "'largest-one', 'no_evidence'", "'largest-more', 'no_evidence'", "'rent-free', 'downstream_divergent'",
    )
    + " WHERE name <> 'too-large' UNION ALL SELECT 'too-large', 'potential_fabrication'"
)
def program_consistency(spark, sf_dir):
    """Quotes verified against the named document, and what the program's items are."""
    return _system(spark).consistency()


@query(
    values("diff, name, base, other, status", "'rent-free', 'rent', '5', '12', 'divergent'", "'rent-free', 'net', '10', '3', 'divergent'", "'rent-free', 'is-healthy', 'true', 'true', 'same'", "'same-seats', 'seats', '14', '14', 'same'", "'same-seats', 'too-large', 'false', 'false', 'same'")
)
def program_diffs(spark, sf_dir):
    """L11, L12, L15."""
    return _system(spark).diff_values().select("diff", "name", "base", "other", "status")


@query(values("name, item", "'rent-free', 'downstream_divergent'"))
def program_diff_report(spark, sf_dir):
    """L13, L15."""
    return _system(spark).diff_report()


@query(values("consistent", "false"))
def program_consistent(spark, sf_dir):
    """L16."""
    s = _system(spark)
    return _rows(spark, [(s.consistent(),)], "consistent boolean")


@query(values("src, dst", "'sales', 'profit'", "'costs', 'profit'", "'profit', 'net'", "'rent', 'net'", "'net', 'is-healthy'", "'healthy-rule', 'is-healthy'", "'is-healthy', '__output__'"))
def probed_graph(spark, sf_dir):
    """G1."""
    return _system(spark).probe("is-healthy")[1]


@query(values("name, kind, depth", "'sales', 'fact', 0", "'costs', 'fact', 0", "'rent', 'fact', 0", "'healthy-rule', 'axiom', 0", "'profit', 'term-comp', 1", "'net', 'term-comp', 2", "'is-healthy', 'theorem', 3", "'__output__', 'synthetic', 4"))
def topological_view(spark, sf_dir):
    """G2, G22."""
    return Lens(*_system(spark).probe("is-healthy")).view().select("name", "kind", "depth")


@query(values("name", "'makes-money'", "'is-healthy'", "'too-large'", "'healthy'", "'largest-one'", "'largest-more'", "'largest'"))
def program_roots(spark, sf_dir):
    """All that nothing rests on, which a probe of the whole program begins at."""
    return _rows(spark, [(n,) for n in _system(spark).roots()], "name string")


@query(values("kind, n", "'fact', 5", "'axiom', 3", "'term-comp', 2", "'term-fwd', 2", "'theorem', 1", "'calc', 2", "'synthetic', 1"))
def probed_program(spark, sf_dir):
    """The graph of a whole program, by kind."""
    return G.kinds(_system(spark).probe_all()[0]).select("kind", F.col("n").cast("int").alias("n"))


@query(values("diffs, n", "'same-seats', 0", "'rent-free', 1"))
def incremental_consistency(spark, sf_dir):
    """The items of some diffs only."""
    s = _system(spark)
    of = lambda d: s.consistency(d).agg(F.count_if(F.col("item").endswith("divergent")).cast("int").alias("n")).select(F.lit(d).alias("diffs"), "n")
    return of("same-seats").unionByName(of("rent-free"))


@query(values("asked, found", "'net', '__output__,costs,net,profit,rent,sales'", "'OFI', 'profit'", "'nothing', ''"))
def inspected_names(spark, sf_dir):
    """A known name gets its graph, an unknown one the names that hold it."""
    s, rows = _system(spark), []
    for asked in ("net", "OFI", "nothing"):
        got = s.inspect(asked)
        rows.append((asked, ",".join(got if isinstance(got, list) else sorted(r["name"] for r in got[0].collect()))))
    return _rows(spark, rows, "asked string, found string")


@query(values("name, path, kind", "'is-healthy', '', 'theorem'", "'net', 'is-healthy', 'term-comp'", "'healthy', 'is-healthy', 'term-fwd'", "'healthy-rule', 'is-healthy', 'axiom'", "'healthy', 'is-healthy/healthy-rule', 'term-fwd'", "'profit', 'is-healthy/net', 'term-comp'", "'rent', 'is-healthy/net', 'fact'", "'sales', 'is-healthy/net/profit', 'fact'", "'costs', 'is-healthy/net/profit', 'fact'"))
def provenance_tree(spark, sf_dir):
    """P19."""
    rows = []

    def walk(tree, path):
        rows.append((tree["name"], path, tree["kind"]))
        for x in tree["inputs"]:
            walk(x, f"{path}/{tree['name']}".strip("/"))

    walk(_system(spark).provenance("is-healthy"), "")
    return _rows(spark, rows, "name string, path string, kind string")


@query(values("step, names", "'retracted', 'costs,net,rent'", "'by hand', 'rent'", "'instance', '(= (healthy seats) (> seats 0))'"))
def retracted_and_verified(spark, sf_dir):
    """P10, P11, P12."""
    s = _system(spark)
    instance = to_sexp(s.instantiate("healthy-rule", {"?x": Symbol("seats")}))
    s.verify_manual("rent")
    hand = [r["name"] for r in s.sources().where("manual").collect()]
    copy = s.snapshot()
    copy.retract("sales", "profit")
    left = sorted(n for n in copy.entries if n in ("sales", "costs", "profit", "net", "rent"))
    return _rows(spark, [("retracted", ",".join(left)), ("by hand", ",".join(hand)), ("instance", instance)], "step string, names string")


@query("SELECT doc_id AS name, CASE WHEN quality IS NOT NULL THEN quality WHEN toxic IS NOT NULL THEN toxic END AS value, CAST(CASE WHEN quality IS NOT NULL THEN 0 END AS INTEGER) AS store FROM documents LEFT JOIN labels USING (doc_id)")
def resolved_values(spark, sf_dir):
    """L11."""
    labels = _table(spark, sf_dir, "labels")
    names = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))
    store = lambda c: labels.select(F.col("doc_id").alias("name"), F.col(c).alias("value"))
    return logic.resolve_values(names, store("quality"), store("toxic"))


@query("SELECT lang AS expression, list_sort(list(DISTINCT source)) AS names FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING bool_or(quality = 1) AND NOT bool_and(quality = 1)")
def contradicting_labels(spark, sf_dir):
    """L21."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return logic.contradictions(d.select(F.col("lang").alias("expression"), F.col("source").alias("name"), (F.col("quality") == 1).alias("value")))


@query("SELECT l_orderkey, l_linenumber, name, holds FROM (SELECT l_orderkey, l_linenumber, unnest(['cheap', 'sold']) AS name, unnest([l_extendedprice * (1 - l_discount) < 50000, l_quantity > 0]) AS holds FROM lineitem)")
def theorems_over_rows(spark, sf_dir):
    """L7 over rows."""
    s = _line_system(spark, sf_dir)
    return s.theorems_by_row("l_orderkey", "l_linenumber")


def _line_system(spark, sf_dir) -> System:
    return System(spark, rows=_table(spark, sf_dir, "lineitem")).load(
        """(defterm price (* l_extendedprice (- 1 l_discount))) (defterm taxed (* price (+ 1 l_tax))) (fact none 0.0)
        (derive cheap (< price 50000) :using (price)) (derive sold (> l_quantity 0) :using ()) (diff untaxed :replace taxed :with price) (diff free :replace none :with none)"""
    )


@query("SELECT 'cheap' AS name, bool_and(l_extendedprice * (1 - l_discount) < 50000) AS holds FROM lineitem UNION ALL SELECT 'sold', bool_and(l_quantity > 0) FROM lineitem")
def theorems_of_all_rows(spark, sf_dir):
    """A theorem over rows holds if it does on all of them."""
    return _line_system(spark, sf_dir).theorems().select("name", "holds")


@query("SELECT 'untaxed' AS diff, 'taxed' AS name, count(*) FILTER (p * (1 + l_tax) <> p) AS divergent FROM (SELECT l_tax, l_extendedprice * (1 - l_discount) AS p FROM lineitem) UNION ALL SELECT 'free', 'none', 0")
def diff_over_rows(spark, sf_dir):
    """L12 over rows: on how many of them a diff's values differ."""
    return _line_system(spark, sf_dir).diff_values().select("diff", "name", "divergent")


# --- modules, passes, effects ---

FILES = {
    "app/main.pltg": '(import (quote std.money))\n(import (quote .parts))\n(defterm total (+ money.tax parts.size))\n(fact own 1)\n(run-on-entry (quote (fact entered 1)))\n(print "done" total)',
    "app/parts.pltg": "(import (quote std.money))\n(defterm size (* std.money.rate 10))\n(run-on-entry (quote (fact never 1)))",
    "lib/std/money.pltg": "(fact rate 2)\n(defterm tax (* rate 3))",
    "bad/main.pltg": "(import (quote .one))\n(defterm b (+ a nowhere))\n(derive t (> b 0) :using (b))\n(derive u (> t 0) :using (t))\n(fact a 1)\n(derive v (> a 0) :using (a))",
    "bad/one.pltg": "(import (quote .two))\n(fact first 1)",
    "bad/two.pltg": "(import (quote .one))\n(fact second 2)",
}


def _modules(spark, main: str, lenient: bool = False) -> loader.Loader:
    said: list[str] = []
    made = loader.Loader(System(spark, effects=loader.sinks(said.append)), FILES.get, ("lib",), lenient)
    made.load_main(main)
    made.said = said
    return made


@query(values("name, value", "'std.money.rate', 2", "'std.money.tax', 6", "'parts.size', 20", "'total', 26", "'own', 1", "'entered', 1"))
def module_values(spark, sf_dir):
    """Names of three modules, one of them found in a library folder and imported twice."""
    s = _modules(spark, "app/main.pltg").system
    got = s.select({n: Symbol(n) for n in s.entries})
    return got.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("int").alias("value")) for n in s.entries])).alias("x")).select("x.*")


@query(values("module, file, main, alias", "'', 'app/main.pltg', true, ''", "'std.money', 'lib/std/money.pltg', false, 'money'", "'parts', 'app/parts.pltg', false, ''"))
def module_table(spark, sf_dir):
    """P15, P16."""
    return _modules(spark, "app/main.pltg").modules().select("module", "file", "main", F.array_join("aliases", ",").alias("alias"))


@query(values("original, resolved, via, file, line", "'money.tax', 'std.money.tax', 'money', 'app/main.pltg', 3"))
def name_resolutions(spark, sf_dir):
    """P27."""
    return _modules(spark, "app/main.pltg").resolutions()


@query(values("name, status", "'import', 'error'", "'b', 'error'", "'t', 'skipped'", "'u', 'skipped'"))
def load_errors(spark, sf_dir):
    """A program with a circular import, a definition that fails and what it takes along."""
    return _modules(spark, "bad/main.pltg", lenient=True).system.error_report().select("name", "status")


@query(values("name", "'two.second'", "'one.first'", "'a'", "'v'"))
def loaded_in_spite(spark, sf_dir):
    """What of that program is loaded all the same."""
    s = _modules(spark, "bad/main.pltg", lenient=True).system
    return _rows(spark, [(n,) for n in s.entries], "name string")


@query(values("name, line, status", "'parse', 3, 'error'"))
def parse_errors(spark, sf_dir):
    """Reading stops at an error, which is recorded, and what stands before it is loaded."""
    s = System(spark).load("(fact a 1)\n(fact b 2)\n(fact c (+ 1", lenient=True)
    return s.error_report().select("name", "line", "status").where(F.lit(sorted(s.entries) == ["a", "b"]))


@query(values("root, skipped", "'b', 't,u'"))
def load_error_tree(spark, sf_dir):
    """P17."""
    s = _modules(spark, "bad/main.pltg", lenient=True).system
    return loader.error_tree(s).where("root = 'b'").select("root", F.array_join("skipped", ",").alias("skipped"))


@query(values("place, name", "0, 'c'", "1, 'b'", "2, 'a'", "3, 'd'"))
def dependency_order(spark, sf_dir):
    """P14."""
    ordered = in_dependency_order(parse_all("(defterm a (+ b 1)) (defterm b (+ c c)) (fact c 1) (fact d 2)"))
    return _rows(spark, [(i, str(e[1])) for i, (e, _) in enumerate(ordered)], "place int, name string")


@query(values("step, value", "'before', 40", "'patched', 50", "'kept', 40"))
def hot_patched(spark, sf_dir):
    """P18."""
    s = System(spark).load("(fact base 4) (defterm grown (* base 10))", module="m")
    copy = s.snapshot()
    before = s.evaluate("m.grown")
    s.hot_patch("(fact base 5) (defterm grown (* base 10))", module="m")
    return _rows(spark, [("before", before), ("patched", s.evaluate("m.grown")), ("kept", copy.evaluate("m.grown"))], "step string, value int")


@query(values("pass, error, names", "1, false, 'a'", "2, false, 'a,b'", "3, false, 'a,b'", "4, true, 'a,b'"))
def program_passes(spark, sf_dir):
    """P25: a pass that fails is tried again, another is left out, and a last one fails."""
    p = loader.Passes(System(spark))
    p.run(1, "(fact a 1)")
    p.run(2, "(fact a 2)")
    p.retry(2, "(fact b 2)", "that name is taken")
    p.run(3, "(fact c 3)")
    p.skip(3)
    p.run(4, "(defterm (")
    return p.finalize().select("pass", F.col("error").isNotNull().alias("error"), F.array_join("names", ",").alias("names"))


@query(values("fact, value, grounded", "'reported', 20, true", "'computed', 20, false", "'bad', 5, false"))
def self_repair(spark, sf_dir):
    """A program that patches a fact because a diff shows that it is wrong, and undoes a patch."""
    s = System(spark, effects=loader.repairs(), overridable=True).load(
        """(fact reported 15) (fact computed 20) (fact bad 5) (diff d :replace reported :with computed) (snapshot reported) (snapshot bad)
        (if (check-diff d) (rollback reported) (patch-fact reported 20 "report" "was 20" "as computed"))
        (patch-fact bad 9) (if (check-diff d) (rollback bad) (fact never 1))"""
    )
    return _rows(spark, [(n, s.evaluate(Symbol(n)), n in s.by_hand) for n in ("reported", "computed", "bad")], "fact string, value int, grounded boolean")


@query(values("block, status", "0, 'done'", "1, 'done'", "2, 'failed'", "3, 'waiting'"))
def tracked_blocks(spark, sf_dir):
    """Blocks run in order; one that fails ends it; changed ones run again."""
    t = loader.Tracker(System(spark), ["(fact a 1)", "(fact a 2)", "(fact c 3)"]).execute()
    return t.reload(["(fact a 1)", "(fact b 2)", "(fact b 3)", "(fact d 4)"]).status()


@query(
    values(
        "line",
        "'done 26'", "'downstream_divergent: rent-free'", "'no_evidence: healthy'", "'no_evidence: healthy-rule'", "'no_evidence: largest'", "'no_evidence: largest-more'", "'no_evidence: largest-one'",
        "'no_evidence: profit'", "'no_evidence: staff'", "'potential_fabrication: too-large'", "'unverified: rent'", "'consistent: false'",
    )
)
def printed_sinks(spark, sf_dir):
    """IO17."""
    said = _modules(spark, "app/main.pltg").said
    s = _system(spark)
    s.effects |= loader.sinks(said.append)
    s.run(parse("(consistency)"))
    said.append(f"consistent: {to_sexp(s.run(parse('(consistency :bool)')))}")
    return _rows(spark, [(x,) for text in said for x in text.split("\n")], "line string")


@query(values("module, text", "'one', '(fact a 1)'", "'two', '(import (quote one))\n\n(defterm b (+ one.a ?a a-b)) ; a'"))
def exported_names(spark, sf_dir):
    """P21."""
    sources, _ = loader.export_names([("one", "(fact a 1)"), ("two", "(defterm b (+ a ?a a-b)) ; a")])
    return _rows(spark, list(sources.items()), "module string, text string")


@query("SELECT doc_id AS doc, text || ' see [[fact:two.' || lang || ']] and [[fact:none]]' AS text FROM documents WHERE lang IN (SELECT DISTINCT lang FROM documents)")
def namespaced_marks(spark, sf_dir):
    """Marks in documents qualified by the module that owns the name."""
    langs = [r[0] for r in _table(spark, sf_dir, "documents").select("lang").distinct().collect()]
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" see [[fact:"), "lang", F.lit("]] and [[fact:none]]")).alias("text"))
    return docs.select(F.col("doc_id").alias("doc"), loader.namespaced(F.col("text"), dict.fromkeys(langs, "two")).alias("text"))


@query(values("name, kind, wff", "'a', 'fact', '{\"__symbol__\": \"x\"}'", "'b', 'term-comp', '[{\"__symbol__\": \"+\"}, {\"__symbol__\": \"a\"}, 1]'", "'d', 'diff', '[{\"__symbol__\": \"a\"}, {\"__symbol__\": \"b\"}]'"))
def program_codec(spark, sf_dir):
    """IO10, IO11: a program as a table, read back and written again."""
    s = System(spark).load("(fact a (quote x)) (defterm b (+ a 1)) (diff d :replace a :with b)")
    s.entries["a"].wff = Symbol("x")
    entries, diffs = codec.program_of(codec.program_table(spark, s.entries, s.diffs))
    return codec.program_table(spark, entries, diffs).select("name", "kind", "wff")


@query(values("name, kind", "'+', 'operator'", "'if', 'form'", "'twice', 'function'", "'print', 'effect'"))
def documented_names(spark, sf_dir):
    """P20."""
    s = System(spark, functions={"twice": lambda x: x}, effects=loader.sinks())
    return s.doc().where(F.col("name").isin("+", "if", "twice", "print"))


@query(values("graph, name", "'staff', 'staff'", "'rent', 'rent'", "'net', 'net'", "'net', 'profit'", "'net', 'sales'", "'net', 'costs'", "'net', 'rent'"))
def dissected_graphs(spark, sf_dir):
    """G37."""
    s = _system(spark)
    nodes, _ = G.together([*s.dissect("rent-free"), *s.compose("net")])
    label = F.element_at(F.array(F.lit("rent"), F.lit("staff"), F.lit("net")), F.col("lens_id") + 1)
    return nodes.where("name <> '__output__'").select(label.alias("graph"), "name")


# --- the standard library ---


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'exemplifiable' ELSE 'hallucinated' END AS collapsed,
 CASE WHEN quality = 0 OR toxic = 1 THEN 'hallucinated' WHEN quality = 1 AND toxic = 0 THEN 'exemplifiable' ELSE 'unknown' END AS joint,
 (coalesce(quality, 1) = 0)::INT + (coalesce(toxic, 0) = 1)::INT AS n_hallucinated, NOT coalesce(quality = 1, false) OR coalesce(toxic = 0, false) AS proven FROM documents LEFT JOIN labels USING (doc_id)""")
def epistemic_functions(spark, sf_dir):
    """A3-A7."""
    d = _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    observed = F.when(F.col("quality") == 1, "witnessed").when(F.col("quality") == 0, "refuted")
    both = F.when(F.col("quality").isNotNull(), A.superpose(F.lit("exemplifiable"), F.lit("hallucinated")))
    status = lambda c, good: F.when(F.col(c).isNull(), "unknown").when(F.col(c) == good, "exemplifiable").otherwise("hallucinated")
    statuses = F.array(A.witness(status("quality", 1)), status("toxic", 0))
    claim, proof = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 0, F.lit(False))
    return d.select("doc_id", A.collapse(observed, both).alias("collapsed"), A.joint_status(statuses).alias("joint"), A.count_hallucinated(statuses).alias("n_hallucinated"), A.teapot(claim, proof).alias("proven"))


@query("""SELECT p_partkey, [p_size, p_size % 7, p_size % 3, 1, 2] AS joined, 5 AS n, list_filter(['a', 'b', 'c'], lambda x: (x = 'a' AND p_size % 2 = 0) OR (x = 'b' AND p_size % 3 = 0) OR (x = 'c' AND p_size % 5 = 0)) AS even_names,
 (p_size + 1) * 2 AS composed, p_size * 2 + 1 AS piped, p_size * 3 AS applied, CAST(NULL AS VARCHAR) AS stub, p_size AS unquoted FROM part""")
def list_functions(spark, sf_dir):
    """A8-A12, A19-A21."""
    xs = F.array(F.col("p_size") % 7, F.col("p_size") % 3)
    more = A.concat(A.cons(F.col("p_size"), xs), F.array(F.lit(1), F.lit(2)))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), (F.col("p_size") % k == 0).alias("value")) for n, k in (("a", 2), ("b", 3), ("c", 5))])
    twice, up = lambda x: x * 2, lambda x: x + 1
    part = _table(spark, sf_dir, "part")
    c = Compiler.of(part, rules=library.rules())
    return part.select(
        "p_partkey",
        more.alias("joined"),
        A.length(more).alias("n"),
        A.filter_pairs(F.lit(True), pairs).alias("even_names"),
        A.compose(twice, up)(F.col("p_size")).alias("composed"),
        A.pipe(F.col("p_size"), twice, up).alias("piped"),
        A.apply(lambda x, y: x * y, F.col("p_size"), F.lit(3)).alias("applied"),
        library.stub().alias("stub"),
        c.compile("(unquote (export p_size))").alias("unquoted"),
    )


@query("SELECT source, list_sort(list(doc_id) FILTER (quality = 0)) AS bad, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def classified_names(spark, sf_dir):
    """By rows, and by arrays of names and statuses."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    rows = d.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "quality"))).alias("all"))
    names, statuses = F.transform("all", lambda x: x["doc_id"]), F.transform("all", lambda x: F.when(x["quality"] == 0, "hallucinated").otherwise("exemplifiable"))
    bad = A.classify(names, statuses, "hallucinated")
    return rows.select("source", F.when(F.size(bad) > 0, bad).alias("bad"), F.size("all").cast("long").alias("n"))


@query(values("name, manual", "'witness', true", "'cons', true", "'mine', false"))
def library_verified(spark, sf_dir):
    """A22, P12."""
    names = _rows(spark, [("witness",), ("cons",), ("mine",)], "name string")
    sources = names.select("name", F.lit(None).cast("boolean").alias("verified"), F.lit(False).alias("manual"), F.lit("std").alias("origin"))
    return logic.verify_manually(sources, library.verified_names(spark)).join(names, "name", "left_semi").select("name", "manual")


@query("SELECT s.name, s.verified FROM (SELECT doc_id AS name, quality = 1 AS verified FROM documents LEFT JOIN labels USING (doc_id)) s WHERE s.verified")
def grounded_names(spark, sf_dir):
    """Sources with verified evidence."""
    return _sources(spark, sf_dir).where(F.col("verified") & logic.grounded(F.col("verified"), F.col("manual"), F.col("origin"))).select("name", "verified")


@query(values("names", "'?a,?b'"))
def free_variables(spark, sf_dir):
    """U2."""
    return _rows(spark, [(",".join(sorted(free_vars(parse("(f ?a (g ?b ?a) c)")))),)], "names string")

