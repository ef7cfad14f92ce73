import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gneiss.plans.compiler import Compiler
from gneiss.plans.search_language import Search
from gneiss.plans.sexpr import ParseError, RewriteLimitError, Rules, Symbol, free_vars, keyword, match, parse, parse_all, repaired, substitute, to_sexp


def test_reader():
    assert parse('(fact a 15 :evidence "x\\"y\\n") ; note') == ("fact", "a", 15, ":evidence", 'x"y\n')
    assert parse("(list 1.5 true -3 1e2)") == ("list", 1.5, True, -3, 100.0)
    assert [line for _, line in parse_all("(a)\n\n(b\nc)")] == [1, 3]
    for bad in ("(a", "a)", '"x', "a b"):
        with pytest.raises(ParseError):
            parse(bad)


atoms = st.one_of(st.integers(), st.booleans(), st.text(max_size=6).filter(lambda s: not s.startswith(":")), st.sampled_from([Symbol("x"), Symbol("a-b")]))
trees = st.recursive(atoms, lambda x: st.lists(x, min_size=1, max_size=4).map(tuple), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(trees)
def test_printing_and_reading_return_the_same(tree):
    assert parse(to_sexp(tree)) == tree


def test_repair():
    assert repaired("(count (re \"a\")") == '(count (re "a"))'
    assert repaired("(a b))") == "(a b)"


def test_match_and_substitute():
    assert match(parse("(f ?x ?x)"), parse("(f 1 2)")) is None
    assert match(parse("(f ?x ?x)"), parse("(f (g 1) (g 1))")) == {"?x": ("g", 1)}
    assert match(parse("(f ?x ?...r)"), parse("(f 1 2 3)")) == {"?x": 1, "?r": (2, 3)}
    assert match(parse("(f 1)"), parse("(f true)")) is None
    assert substitute(parse("(g ?...r ?x)"), {"?x": 1, "?r": (2, 3)}) == ("g", 2, 3, 1)
    assert free_vars(parse("(f ?a (g ?b))")) == {"?a", "?b"}
    assert keyword(parse("(d :using (a b) :using (c))"), ":using") == ("a", "b")


def test_rules():
    r = Rules()
    r.add("(= (digits ?n) ?n)")
    r.add("(= (digits ?n ?d ?...more) (digits (+ (* ?n 10) ?d) ?...more))")
    assert r.rewrite(parse("(digits 1 2 3)")) == 123
    assert [len(r.candidates(parse(e))) for e in ("(digits 1)", "(digits 1 2)", "(other 1)")] == [2, 1, 0]
    assert r.rewrite(parse("(self (digits 1 2))")) == parse("(self (digits 1 2))")
    swap = Rules()
    swap.add("(= (pair ?a ?b) (pair ?b ?a))")
    assert swap.joined(parse("(f (pair 1 2))"), parse("(f (pair 2 1))")) and not swap.joined(parse("(pair 1 2)"), parse("(pair 1 1)"))
    loop = Rules()
    loop.add("(= (f ?x) (f ?x))")
    with pytest.raises((RewriteLimitError, RecursionError)):
        loop.rewrite(parse("(f 1)"))


def test_compiled_expressions(spark):
    df = spark.createDataFrame([(15, 22.0, "x", True), (-7, 0.0, "", False)], "a long, b double, s string, t boolean")
    c = Compiler.of(df, terms={"double-a": parse("(* a 2)"), "share": parse("(/ a ?of)")})
    cases = {
        "(+ a 1)": [16, -6],
        "(mod a -3)": [0, -1],
        "(mod a 3)": [0, 2],
        '(= s "x")': [True, False],
        "(= a s)": [False, False],
        "(= t 1)": [True, False],
        "(if b 1 2)": [1, 2],
        "(and a s)": [True, False],
        "(or t s)": [True, False],
        "(not s)": [False, True],
        "(implies t (> a 20))": [False, True],
        "(let ((x (+ a 1)) (y (* x 2))) y)": [32, -12],
        "double-a": [30, -14],
        "(share :bind ((?of 5)))": [3.0, -1.4],
        "(length (list 1 2 3))": [3, 3],
        "(nth 1 (list a 9))": [9, 9],
        "(member 3 (quote (1 2 3)))": [True, True],
        "(and)": [True, True],
        "(or)": [False, False],
    }
    got = df.select(*[c.compile(e).alias(str(i)) for i, e in enumerate(cases)]).collect()
    for i, (e, want) in enumerate(cases.items()):
        assert [r[str(i)] for r in got] == want, e
    with pytest.raises(NameError):
        c.compile("(+ nowhere 1)")


def test_search_operators(spark):
    docs = spark.createDataFrame(
        [("src/a.py", "def foo():\n    return alpha\n"), ("src/b.py", "alpha\nbeta\n\ngamma\nalpha beta\nend\n"), ("c.md", "beta\nalpha")], "doc string, text string"
    )
    callers = spark.createDataFrame([("src/b.py", 1, "f1", 0.5), ("src/b.py", 1, "f2", 1.0), ("c.md", 2, "f1", 0.2)], "doc string, line long, name string, overlap double")
    s = Search(docs, callers)

    def keys(text, **more):
        return [(r.doc, r.line) for r in s.query(text, **more).collect()]

    assert keys("alpha") == [("src/b.py", 1), ("c.md", 2), ("src/a.py", 2), ("src/b.py", 5)]
    assert sorted(keys('(and "alpha" "beta")')) == [("src/b.py", 5)]
    assert sorted(keys('(not "alpha" "beta")')) == [("c.md", 2), ("src/a.py", 2), ("src/b.py", 1)]
    assert sorted(keys('(in "*.py" "alpha")')) == [("src/a.py", 2), ("src/b.py", 1), ("src/b.py", 5)]
    assert keys('(in "a.py" "alpha")') == [("src/a.py", 2)]
    assert sorted(keys('(near "alpha" "beta" 1)')) == [("c.md", 2), ("src/b.py", 1), ("src/b.py", 5)]
    assert keys('(near "alpha" "beta" 0)') == [("src/b.py", 5)]
    assert sorted(keys('(seq "alpha" "beta")')) == [("src/b.py", 1)]
    assert keys('(context 1 (in "c.md" "beta"))') == [("c.md", 1), ("c.md", 2)]
    assert keys('(before 1 "gamma")') == [("src/b.py", 3), ("src/b.py", 4)]
    assert keys('(after 2 "gamma")') == [("src/b.py", 4), ("src/b.py", 5), ("src/b.py", 6)]
    assert len(keys('(or "alpha" "beta")')) == 6
    assert keys('(rank "document" "alpha")', rank="document")[:2] == [("src/b.py", 1), ("src/b.py", 5)]
    assert keys('(limit 1 (rank "line" (re "^al")))') == [("c.md", 2)]
    assert len(keys('(limit -1 (re "^al"))')) == 2
    assert s.query('(count (lines 1 2 "alpha"))').first().n == 3
    assert keys("alpha", max_lines=2, offset=2) == [("src/a.py", 2), ("src/b.py", 5)]
    assert s.posting("alpha").where("doc = 'c.md'").first().total_callers == 1
    assert s.query('(results "gamma")').select(F.col("form.tag")).first()[0] == "sr"


def test_phrases_are_found_in_the_normalised_text(spark):
    text = "Zero.\nHe was going, and\nsing\n  and it was well-\nknown; SING (and) more sing and.\nsing land\ning\x1cand aning and"
    docs = spark.createDataFrame([(1, text), (2, "ing\n2. and"), (3, None), (4, ""), (5, "İng and \u212aing's")], "doc long, text string")
    s = Search(docs)

    def found(phrase):
        return sorted((r.doc, r.line, r.column, r.context) for r in s.posting(phrase).collect())

    assert found("Ing, AND") == [
        (1, 2, 10, "He was going, and"),
        (1, 3, 2, "sing"),
        (1, 5, 9, "known; SING (and) more sing and."),
        (1, 7, 1, "ing\x1cand aning and"),
        (2, 1, 1, "ing"),
    ]
    assert found("wellknown sing") == [(1, 4, 14, "  and it was well-")]
    assert found("king") == [(5, 1, 9, "İng and \u212aing's")]
    assert found("?!") == [] and found("") == []
    assert s.query('(count (and "going and" "was going"))').first().n == 1
    assert sorted((r.doc, r.line) for r in Search(docs, literal=True).posting("ing and").collect()) == [(1, 5), (1, 7)]
