import random

import pytest

from gneiss.operators import graph as G
from gneiss.plans.system import ProgramError, System

REPORT = "The company earned $15M in Q3 revenue.\nOperating margin was 22% and headcount is 150 employees.\nNet income 3.3M."
PROGRAM = """
(fact revenue 15 :evidence (evidence "report.txt" :quotes ("The company earned $15M in Q3 revenue") :explanation "r"))
(fact margin 22 :evidence (evidence "report.txt" :quotes ("Operating margin was 22%")))
(fact headcount 150 :evidence (evidence "report.txt" :quotes ("Headcount is 150 employees")))
(fact net-income 3.3 :evidence (evidence "report.txt" :quotes ("no such words")))
(defterm double-rev (* revenue 2) :origin "double")
(defterm positive :origin "forward")
(axiom pos-rule (= (positive ?x) (> ?x 0)) :origin "positivity")
(defterm furthest :origin "forward")
(axiom furthest-alone (= (furthest ?from ?a) ?a) :origin "one is left")
(axiom furthest-of (= (furthest ?from ?a ?b ?...others) (if (> (* (- ?a ?from) (- ?a ?from)) (* (- ?b ?from) (- ?b ?from))) (furthest ?from ?a ?...others) (furthest ?from ?b ?...others))) :origin "the nearer goes")
(derive thm-positive (> double-rev 0) :using (double-rev revenue))
(derive thm-bound pos-rule :bind ((?x revenue)) :using (pos-rule revenue))
(derive thm-far (= (furthest 20 revenue margin 3) 3) :using (furthest furthest-alone furthest-of revenue margin))
(derive thm-wrong (> revenue 100) :using (revenue))
(derive thm-taint (> net-income 0) :using (net-income))
(diff d1 :replace revenue :with net-income)
(diff d2 :replace margin :with margin)
"""


@pytest.fixture(scope="module")
def system(spark):
    docs = spark.createDataFrame([("report.txt", REPORT)], "doc string, text string")
    return System(spark, documents=docs).load(PROGRAM)


def test_evaluation(system):
    assert system.evaluate("(+ revenue 1)") == 16
    assert system.evaluate("(furthest 10 1 2 3 revenue)") == 1
    assert system.evaluate("(positive margin)") is True
    with pytest.raises(NameError):
        system.evaluate("(+ nowhere 1)")


def test_theorems(system):
    got = {r.name: (r.holds, r.origin) for r in system.theorems().collect()}
    assert got["thm-positive"] == (True, "derived") and got["thm-far"] == (True, "derived")
    assert got["thm-wrong"] == (False, "does not hold") and got["thm-taint"] == (True, "potential fabrication")
    assert got["thm-bound"][0]


def test_diffs_and_consistency(system):
    got = {(r.diff, r.name): (float(r.base), float(r.other)) for r in system.diff_values().where("name in ('revenue', 'double-rev')").collect()}
    assert got == {("d1", "revenue"): (15.0, 3.3), ("d1", "double-rev"): (30.0, 6.6)}
    items = {(r["name"], r["item"]) for r in system.consistency().collect()}
    assert ("net-income", "unverified") in items and ("d1", "downstream_divergent") in items and ("thm-taint", "potential_fabrication") in items
    assert not any(n == "d2" for n, _ in items)
    assert not system.consistent()


def test_graph_and_provenance(system):
    nodes, edges = system.graph()
    depth = {r.name: r.depth for r in G.depths(nodes, edges).collect()}
    assert depth["revenue"] == 0 and depth["double-rev"] == 1 and depth["thm-positive"] == 2
    assert [i["name"] for i in system.provenance("thm-positive")["inputs"]] == ["double-rev", "revenue"]
    assert system.dependents("revenue") == {"double-rev", "thm-positive", "thm-bound", "thm-far", "thm-wrong"}
    assert "headcount" in {r.name for r in system.danglings().collect()}
    assert "value" not in system.state(blinded=True).columns


def test_errors(spark):
    s = System(spark)
    with pytest.raises(ProgramError):
        s.load("(fact a 1) (fact a 2)")
    with pytest.raises(ProgramError):
        System(spark).load("(axiom x (= (f 1) 2))")
    with pytest.raises(ProgramError):
        System(spark).load("(fact a 1) (fact b 2) (derive t (> b 0) :using (a))")
    lenient = System(spark).load("(fact a 1)\n(derive t (> b 0) :using (b))\n(derive u (> t 0) :using (t))\n(derive v (> a 0) :using (a))", lenient=True)
    assert {r.name: (r.status, r.line) for r in lenient.error_report().collect()} == {"t": ("error", 2), "u": ("skipped", 3)}
    assert "v" in lenient.entries


def test_scopes_and_modules(spark):
    inner = System(spark).load("(fact x 5) (defterm y (* x 2))")
    outer = System(spark).load("(fact x 1) (fact z 7)")
    outer.scopes["in"] = inner
    assert outer.evaluate("(scope in y)") == 10
    assert outer.evaluate("(+ x (scope in (+ x (project z))))") == 13
    assert outer.evaluate("(scope in (+ x (delegate z)))") == 12
    module = System(spark).load("(fact a 1) (defterm b (+ a 1))", module="m")
    assert module.evaluate("m.b") == 2
    copy = module.snapshot()
    module.hot_patch("(fact a 5) (defterm b (+ a 1))", module="m")
    assert (module.evaluate("m.b"), copy.evaluate("m.b")) == (6, 2)
    module.retract("m.a")
    with pytest.raises(NameError):
        module.evaluate("m.b")


def test_rows_are_environments(spark):
    rows = spark.createDataFrame([(1, 10.0, 3.0), (2, 1.0, 5.0)], "id long, sales double, cost double")
    s = System(spark, rows=rows).load("(defterm profit (- sales cost)) (axiom good (= (good ?x) (> ?x 0)) :origin \"o\")")
    got = {r.id: (r.p, r.g) for r in s.select({"p": "(+ 0 profit)", "g": "(good profit)"}, keep=("id",)).collect()}
    assert got == {1: (7.0, True), 2: (-4.0, False)}


def test_programs_survive_json(system, spark):
    from gneiss.sources import codec

    entries, diffs = codec.program_of(codec.program_table(spark, system.entries, system.diffs))
    assert (entries, diffs) == (system.entries, system.diffs)
    again = System(spark, documents=system.documents, entries=entries, diffs=diffs)
    assert again.evaluate("(furthest 16 revenue margin)") == 22


def test_truth_over_rows(spark):
    program = "(fact limit 0) (derive positive (> v limit) :using (limit)) (diff d :replace limit :with v)"
    for rows in ([(1, 5), (2, -5)], [(2, -5), (1, 5)]):
        s = System(spark, rows=spark.createDataFrame(rows, "k int, v int")).load(program)
        assert s.theorems().first().holds is False
        assert {(r.k, r.holds) for r in s.theorems_by_row("k").collect()} == {(1, True), (2, False)}
        assert s.diff_values().where("name = 'limit'").first().divergent == 2
    empty = System(spark, rows=spark.createDataFrame([], "k int, v int")).load(program)
    assert empty.theorems().first().holds is True and empty.diff_values().where("status <> 'same'").count() == 0


def test_unknown_names_in_terms(spark):
    with pytest.raises(ProgramError):
        System(spark).load("(defterm a (+ b1 1))")
    assert System(spark).load("(defterm a (let ((q1 2)) (+ q1 x)))").entries["a"].kind == "term-comp"


def brute_depths(facts, inputs):
    """One node at a time, as the rule says."""
    depth = {}

    def of(n):
        if n not in depth:
            depth[n] = 1 + max(map(of, inputs[n])) if inputs[n] else 0
        return depth[n]

    for n in inputs:
        of(n)
    held = {n: frozenset(i for i in inputs[n] if i in facts) for n in inputs}
    while True:
        n = next((n for n in inputs if depth[n] > 0 and any(m != n and depth[m] == depth[n] and held[n] > held[m] for m in inputs)), None)
        if n is None:
            break
        depth[n] += 1
    while any(inputs[n] and depth[n] <= max(depth[i] for i in inputs[n]) for n in inputs):
        for n in inputs:
            if inputs[n]:
                depth[n] = max(depth[n], 1 + max(depth[i] for i in inputs[n]))
    return depth


def test_depths_settle_as_by_brute_force(spark):
    random.seed(6)
    facts = [f"f{i}" for i in range(5)]
    inputs = {f: [] for f in facts} | {"x": []}
    for i in range(24):
        inputs[f"n{i}"] = sorted(set(random.sample(facts, random.randint(0, 3)) + random.sample(["x", *[f"n{j}" for j in range(i)]], min(i + 1, random.randint(1, 2)))))
    edges = spark.createDataFrame([(a, n) for n, below in inputs.items() for a in below], "src string, dst string")
    nodes = spark.createDataFrame([(n, "fact" if n in facts else "calc", "") for n in inputs], "name string, kind string, value string")
    assert {r["name"]: r.depth for r in G.settled_depths(nodes, edges).collect()} == brute_depths(set(facts), inputs)


def test_depths_settle(spark):
    edges = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "b"), ("b", "c")], "src string, dst string")
    nodes = spark.createDataFrame([("f", "fact", ""), ("g", "fact", ""), ("a", "calc", ""), ("b", "calc", ""), ("c", "calc", "")], "name string, kind string, value string")
    assert {r.name: r.depth for r in G.settled_depths(nodes, edges).collect()} == {"f": 0, "g": 0, "a": 1, "b": 3, "c": 4}
