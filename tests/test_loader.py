import pytest
from pyspark.sql import functions as F

from gneiss.operators import forms as O
from gneiss.plans import loader
from gneiss.plans.search_language import Cursor, Search
from gneiss.plans.sexpr import Symbol, parse
from gneiss.plans.system import ProgramError, System
from gneiss.plans.views import Health, Hologram, Lens

FILES = {
    "a/main.pltg": "(import (quote ..shared.units))\n(import (quote .near.deep))\n(import (quote only))\n(defterm sum (+ units.metre (+ deep.far only.one)))",
    "shared/units.pltg": "(fact metre 1)",
    "a/near/deep.pltg": "(import (quote ...shared.units))\n(defterm far (* units.metre 100))\n(run-on-entry (quote (fact entered 1)))",
    "lib/only.pltg": '(fact one 1000)\n(load-document "notes" "notes.txt")',
    "lib/notes.txt": "some notes",
    "loop/main.pltg": "(import (quote .x))",
    "loop/x.pltg": "(import (quote .main))",
    "gone/main.pltg": "(import (quote .missing))",
}


def load(spark, main, **more):
    made = loader.Loader(System(spark), FILES.get, ("lib",), **more)
    made.load_main(main)
    return made


def test_modules(spark):
    made = load(spark, "a/main.pltg")
    s = made.system
    assert s.evaluate("sum") == 1101 and "entered" not in s.entries
    assert set(s.entries) == {"shared.units.metre", "near.deep.far", "only.one", "sum"}
    assert [r.text for r in s.documents.collect()] == ["some notes"]
    assert {c.name: c.get(":dir") for c in made.contexts.values()} == {"": "a", "shared.units": "shared", "near.deep": "a/near", "only": "lib"}
    assert made.contexts[""].get(":main") and not made.contexts["only"].get(":main")
    with pytest.raises(ProgramError):
        made.contexts["only"].get(":colour")
    for main, said in (("loop/main.pltg", "circular import: loop/main.pltg -> loop/x.pltg -> loop/main.pltg"), ("gone/main.pltg", "no module .missing"), ("nowhere.pltg", "no such file")):
        with pytest.raises(ProgramError, match=said):
            load(spark, main)


def test_passes_and_trackers(spark):
    p = loader.Passes(System(spark))
    assert p.run(1, "(fact a 1)") is None and "exists already" in p.run(2, "(fact b 2) (fact a 3)")
    assert p.retry(2, "(fact c 2)", "a is taken") is None and set(p.system.entries) == {"a", "c"} and p.notes == {2: ["a is taken"]}
    t = loader.Tracker(System(spark), ["(fact a 1)", "(fact b 2)", "(fact c 3)"]).execute(1)
    assert set(t.system.entries) == {"a", "b"}
    assert set(t.execute().rollback(1).system.entries) == {"a"}
    assert set(t.reload(["(fact a 1)", "(fact x 2)"]).system.entries) == {"a", "x"}
    assert not t.reset().system.entries


def test_sinks_and_repairs(spark):
    said = []
    s = System(spark, effects=loader.sinks(said.append)).load('(fact a 1 :origin "report") (print "a is" a (+ a 1))')
    assert said == ["a is 1 2"]
    assert s.run(parse("(consistency :bool)")) is False and s.run(parse("(consistency :report)")).count() == 1
    with pytest.raises(ProgramError):
        s.run(parse("(consistency :raise)"))
    s.run(parse("(verify-manual (quote a))"))
    assert s.run(parse("(consistency :bool)")) is True


def test_exports(spark):
    text, defined = loader.qualified('(defterm b (+ a 1) :origin "a in a text") ; a\n(fact c (f (a)))', {"a": "m", "b": "m"})
    assert text == '(defterm b (+ m.a 1) :origin "a in a text") ; a\n(fact c (f (m.a)))' and defined == {"b", "c"}
    one = spark.createDataFrame([("see [[fact:a]], [[term:zz]] and [[fact:a]].",), ("",), ("no mark",)], "t string")
    got = [r[0] for r in one.select(loader.namespaced(F.col("t"), {"a": "m"}, "s.")).collect()]
    assert got == ["see [[fact:s.m.a]], [[term:zz]] and [[fact:s.m.a]].", "", "no mark"]


def test_views(spark):
    s = System(spark).load('(fact f.one 1) (fact f.two 2) (defterm g.sum (+ f.one f.two)) (diff d :replace f.one :with f.two)')
    lens = Lens(*s.probe("g.sum"))
    names = lambda df: sorted(r["name"] for r in df.select("name").collect())
    assert names(lens.evaluate('(inputs "g.sum")')) == ["f.one", "f.two"] and names(lens.evaluate('(not (focus "f.") (node "f.two"))')) == ["f.one"]
    assert lens.evaluate('(node "g.sum")').first().inputs == ["f.one", "f.two"] and lens.evaluate('(node "g.sum")').first().depth == 1
    assert "Did you mean: f.one" in lens.not_found("ONE") and lens.not_found("zz") == "no 'zz'"
    assert names(lens.focus("f.one").nodes) == ["__output__", "f.one", "g.sum"]
    with pytest.raises(NameError):
        lens.evaluate("(colour 1)")
    holo = Hologram([Lens(*x) for x in s.dissect("d")], ("f.one", "f.two"))
    assert names(holo.evaluate("(divergent)")) == ["f.one", "f.two"] and names(holo.evaluate("(only 1)")) == ["f.two"]
    assert names(holo.evaluate("(left)")) == ["f.one"] and names(holo.evaluate('(lens 1 (kind "fact"))')) == ["f.two"]
    for wrong in ("(lens 2)", "(only 5)"):
        with pytest.raises(IndexError):
            holo.evaluate(wrong)
    items = spark.createDataFrame([("a.x", "issue", "no_evidence", "fact", "f:1", ""), ("b", "warning", "manual", "term", "f:2", "")], "name string, category string, type string, kind string, loc string, detail string")
    health = Health(items)
    assert names(health.filtered(category="issue", namespace="a.")) == ["a.x"]
    with pytest.raises(ValueError, match="There are: fact, term"):
        health.filtered(kind="colour")
    assert health.evaluate("(ns)").first().value == "_root, a" and health.focus("b").evaluate("(consistent)").first().value is True
    assert [r.doc for r in health.evaluate("manual").collect()] == ["b"]


def test_searches_ask_views(spark):
    docs = spark.createDataFrame([("a.md", "alpha one\nbeta"), ("b.md", "alpha two")], "doc string, text string")
    s = System(spark).load("(fact alpha 1) (fact beta 2)")
    search = Search(docs, scopes={"lens": Lens(*s.probe("alpha", "beta"))})
    forms = search.posting(parse('(or (forms "alpha") (scope lens (kind "fact")))'))
    assert sorted(r.key for r in O.keys(forms).collect()) == ["a.md:1", "alpha", "b.md:1", "beta"]
    shown = {(r.doc, r.line, r.context) for r in search.display('(scope lens (kind "fact"))').collect()}
    assert shown == {("alpha", 1, "1"), ("beta", 1, "2")}
    back = {(r.doc, r.line, r.context) for r in O.posting_of(search.posting(parse('(forms "alpha")'))).collect()}
    assert back == {("a.md", 1, "alpha one"), ("b.md", 1, "alpha two")}
    assert [r.doc for r in Cursor(search, "alpha", 1).next().rows().collect()] == ["b.md"]
    assert search.posting(parse('(sr-line "beta")')).first().value == 2
    with pytest.raises(NameError):
        search.posting(parse('(sr-colour "beta")'))


def test_a_ranged_search_names_callers(spark):
    docs = spark.createDataFrame([("a", "the cat sat\non the mat")], "doc string, text string")
    ranges = spark.createDataFrame([("a", 4, 11, "q1"), ("a", 0, 3, "q2")], "doc string, start long, end long, caller string")
    found = Search(docs, ranges=ranges).query("cat sat on").first()
    assert (found.line, [(c["name"], c["overlap"]) for c in found.callers]) == (1, [("q1", 0.7)])


def test_names_that_stand_for_themselves(spark):
    s = System(spark, strict=False)
    assert s.evaluate("nowhere") == "nowhere" and s.evaluate(Symbol("x")) == "x"
