import hashlib
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from gneiss.functions import arrays as A, normalize as N
from gneiss.operators import forms, graph as G, indexed, integrity as I, lines as L, logic, quotes as Q, search
from gneiss.sources import documents as D, packages, references as R
from gneiss.sources.shared import listing, positioned, spread
from gneiss.streaming import reindex

TEXT = "  The 1. first item (about 3,000 units) is well-\nknown. It’s — truly — a multi-level case.\n  2. Second   item:\n reaches 3.14 percent."


def test_native_and_placed_normalisation_agree(spark):
    random.seed(2)
    texts = [TEXT, "", "-", "a-\nb", "1. x"] + ["".join(random.choices("aB12\n-., (:)9é'", k=30)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", N.normalized(F.col("text")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == Q.normalized_with_places(t)[0], t


def test_quotes(spark):
    docs = spark.createDataFrame([("d", TEXT), ("e", "nothing here")], "doc string, text string")
    quotes = spark.createDataFrame(
        [(1, "wellknown"), (2, "ABOUT 3,000 UNITS"), (3, "absent words"), (4, "multi-level case"), (5, "firstitem about"), (6, "")], "item int, quote string"
    )
    found = Q.scored(Q.find_everywhere(docs, quotes)).collect()
    assert {r["item"] for r in found if r.verified} == {1, 2, 4}
    places = {r["item"]: TEXT[r.start : r.end + 1] for r in found}
    assert places[2] == "about 3,000 units" and places[1] == "well-\nknown"
    assert all(0.7 < r.confidence <= 1 for r in found)
    assert Q.locate(TEXT, "firstitem about")[0] == "collapsed"
    named = Q.verify_named(docs, quotes.select(F.lit("d").alias("doc"), "quote", F.lit("c").alias("caller")))
    assert {r.quote: r.strategy for r in named.collect()}[""] == "none"


def test_occurrences_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa b aa"), (2, None), (3, "")], "doc int, text string")
    got = sorted((r.doc, r.start) for r in L.occurrences(docs, "aa").collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 7)]
    assert L.occurrences(docs, "").count() == 0


def test_trace_reports_each_pair_once(spark):
    random.seed(4)
    hits = [(d, s, s + random.randint(1, 900)) for d in range(3) for s in random.sample(range(3000), 20)]
    ranges = [(d, s, s + random.randint(1, 2000), f"q{s}") for d in range(3) for s in random.sample(range(3000), 20)]
    got = search.trace(spark.createDataFrame(hits, "doc int, start long, end long"), spark.createDataFrame(ranges, "doc int, start long, end long, caller string"), 128)
    want = {(d, s, e, c) for d, s, e in hits for d2, a, b, c in ranges if d == d2 and a < e and s < b}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.doc, r.start, r.end, r.caller) for r in rows} == want


def test_logic(spark):
    sources = spark.createDataFrame(
        [("a", True, False, None), ("b", False, False, None), ("c", None, False, "potential fabrication"), ("d", None, False, "report"), ("e", False, True, None)],
        "name string, verified boolean, manual boolean, origin string",
    )
    theorems = spark.createDataFrame([("t1", 5.0, ["a", "d"]), ("t2", 5.0, ["a", "b", "c"]), ("t3", -1.0, ["b"])], "name string, v double, using array<string>")
    got = {r.name: (r.holds, r.origin, r.ungrounded) for r in logic.derive(theorems, F.col("v") > 0, theorems, sources).collect()}
    assert got["t1"] == (True, "derived", None)
    assert got["t2"] == (True, "potential fabrication", ["b", "c"])
    assert got["t3"][:2] == (False, "does not hold")
    items = {(r["name"], r["item"]) for r in logic.evidence_items(sources).collect()}
    assert items == {("b", "unverified"), ("c", "potential_fabrication"), ("d", "no_evidence"), ("e", "manually_verified")}
    by_hand = logic.verify_manually(sources, spark.createDataFrame([("b",)], "name string"))
    assert {r.name for r in by_hand.where("manual").collect()} == {"b", "e"}
    assert logic.consistent(logic.evidence_items(sources)).first().consistent is False


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(n, "fact" if n in "ax" else "calc", n) for n in "abcdx"], "name string, kind string, value string")
    assert {r.name: r.depth for r in G.closure(edges, spark.createDataFrame([("a",)], "name string")).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    depth = G.depths(nodes, edges)
    assert {r.name: r.depth for r in depth.collect()} == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3}
    classes = {(r.src, r.dst): r.input_type for r in G.input_classes(nodes, edges, depth).collect()}
    assert classes[("a", "c")] == "pull" and classes[("b", "c")] == "use"
    cyclic = edges.union(spark.createDataFrame([("d", "a")], "src string, dst string"))
    assert G.closure(cyclic, spark.createDataFrame([("a",)], "name string")).count() == 4
    assert [r.name for r in G.fuzzy(spark.createDataFrame([("ab",), ("b",), ("cb",), ("bab",)], "name string"), "B").collect()] == ["b", "ab", "cb", "bab"]
    assert G.depth_of(depth, "zz").first().depth == -1


def test_chain_and_merkle(spark):
    random.seed(1)
    rows = [(k, n, f"{k}:{n}:{random.random()}") for k in range(5) for n in range(k * 3)]
    df = spark.createDataFrame(rows, "k int, n long, content string")
    made = I.build_chains(df, "k", "n", "content")
    assert I.check_chains(made, "k").where("status <> 'valid'").count() == 0
    spoilt = made.withColumn("hash", F.when((F.col("k") == 2) & (F.col("n") == 3), "x").otherwise(F.col("hash")))
    status = {r.n: r.status for r in I.check_chains(spoilt, "k").where("k = 2").collect()}
    assert status == {0: "valid", 1: "valid", 2: "valid", 3: "invalid", 4: "stale", 5: "stale"}
    assert I.clean(I.check_chains(spoilt, "k"), "k").where("k = 2").first().break_point == 3
    tree = I.merkle(df.withColumnRenamed("n", "pos"), "k").cache()
    root = {r.k: r.root for r in I.roots(tree, "k").collect()}
    for k, pos in ((1, 0), (2, 5), (4, 8), (4, 11)):
        leaf = next(c for a, n, c in rows if (a, n) == (k, pos))
        steps = I.proof(tree, "k", pos).where(F.col("k") == k).agg(F.collect_list(F.struct("level", "hash", "left")).alias("s"))
        assert steps.select(I.verify_proof(F.lit(leaf), F.col("s")).alias("r")).first().r == root[k]


def test_forms_and_arrays(spark):
    a = spark.createDataFrame([("ln", "x"), ("ln", "x"), ("ln", "y")], "tag string, name string")
    b = spark.createDataFrame([("hn", "x")], "tag string, name string")
    assert forms.and_forms(a, b).count() == 2 and forms.not_forms(a, b).count() == 1 and forms.or_forms(a, b).count() == 4
    one = spark.range(1)
    e = F.array().cast("array<int>")
    r = one.select(A.sum_values(e).alias("s"), A.all_true(lambda x: x > 0, e).alias("a"), A.any_true(lambda x: x > 0, e).alias("y"), A.nth(e, 0).alias("n")).first()
    assert (r.s, r.a, r.y, r.n) == (0.0, True, False, None)
    st = lambda *s: one.select(A.joint_status(F.array(*map(F.lit, s))).alias("s")).first().s
    assert st("witnessed") == "witnessed" and st("exemplifiable", "odd") == "unknown" and st("unknown", "hallucinated") == "hallucinated"


def test_sources(spark, tmp_path):
    for name, text in (("a.md", "# hi\n```scheme\n;; pltg\n(fact a 1)\n```\nend\n```python\nx\n```\n"), ("sub/b.txt", "two"), ("node/c.txt", "three"), ("d.bin", "no")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    docs = D.index_dir(spark, str(tmp_path / "in"), exclude=["node/"])
    assert sorted(r.doc for r in docs.collect()) == ["a.md", "sub/b.txt"]
    kinds = [(r.kind, r.start_line) for r in D.markdown_blocks(docs.where("doc = 'a.md'")).orderBy("start_line").collect()]
    assert kinds == [("prose", 1), ("executable", 3), ("prose", 6), ("code", 8)]
    D.save_snapshot({"docs": docs}, str(tmp_path / "snap"), "v1")
    assert D.load_snapshot(spark, str(tmp_path / "snap"), "v1", ["docs"])["docs"].count() == 2
    marked = spark.createDataFrame([("p", "see [[fact:a]] and [[fact:a]] or [[term:zz]] [[what:x]]")], "doc string, text string")
    known = spark.createDataFrame([("fact", "a", "1")], "type string, name string, value string")
    errors = {r.name: r.error for r in R.resolve(R.extract(marked), known).collect()}
    assert errors == {"a": None, "zz": "not found: zz", "x": "unknown type: what"}


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two")], "doc string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    run = lambda: reindex.reindex_stream(
        reindex.document_stream(spark, str(tmp_path / "in"), "doc string, text string"), L.word_postings, str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    run()
    assert reindex.current(spark, str(tmp_path / "out")).count() == 3
    spark.createDataFrame([("a", "four")], "doc string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {(r.doc, r.word) for r in reindex.current(spark, str(tmp_path / "out")).collect()} == {("a", "four"), ("b", "two")}


def test_large_trees_fold_as_by_hand(spark):
    sizes = {1: 1, 2: 2, 3: 3, 4: 1024, 5: 1025, 6: 2500}
    leaves = spark.createDataFrame([(k, p, f"{k}.{p}") for k, n in sizes.items() for p in range(n)], "k int, pos long, content string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for k, n in sizes.items():
        level, row = 0, [sha(f"{k}.{p}") for p in range(n)]
        want |= {(k, level, p): h for p, h in enumerate(row)}
        while len(row) > 1:
            row = [sha(row[i] + row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
            level += 1
            want |= {(k, level, p): h for p, h in enumerate(row)}
    assert {(r.k, r.level, r.pos): r.hash for r in I.merkle(leaves, "k").collect()} == want


def test_the_index_finds_what_the_texts_hold(spark):
    random.seed(8)
    texts = ["".join(random.choices(["ab ", "abc", "\n", "b-\nc ", "c. ", "  ", "AB "], k=40)) for _ in range(30)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    index = indexed.build_index(docs).cache()
    keys = lambda p: sorted((r.doc, r.line, r.column, r.context) for r in p.collect())
    for phrase in ("ab", "b abc", "c ab b", "bc c", "?", "zz"):
        assert keys(indexed.indexed_phrase(index, phrase)) == keys(L.normal_phrase_lines(docs, phrase)), phrase


def test_an_index_holds_a_context_once(spark):
    texts = ["the " * 4000, "A-\nb the\n\n the b", "The the\nx\n the", "\n", "", None, "ÀÉ the\n", "d 2. the-\n the. c"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "the\nthe")], "doc int, text string")
    index = indexed.build_index(docs).cache()
    assert sum(len(r.context or "") + sum(len(p.asDict().get("context", "")) for p in r.parts or []) for r in index.collect()) <= sum(len(t or "") for t in texts) + 6
    plain = indexed.build_index(docs.select("doc", F.concat("text", F.lit(" .")).alias("text"))).where("word IS NOT NULL")
    row = lambda r: (r.doc, r.pos, r.word, r.line, r.column)
    assert sorted(map(row, index.where("word IS NOT NULL").collect()), key=str) == sorted(map(row, plain.collect()), key=str)  # with and without marks
    keys = lambda p: sorted(((r.doc, r.line, r.column, r.context) for r in p.collect()), key=str)
    assert keys(indexed.indexed_phrase(index, "the")) == keys(L.normal_phrase_lines(docs, "the"))
    words = keys(indexed.indexed_word(index, "the"))
    assert (0, 1, 1, "the " * 4000) in words and (None, 2, 1, "the") in words and len(words) == 8, [w[:3] for w in words]


def test_a_long_text_is_indexed_in_pieces(spark, monkeypatch):
    def rows(text, size, config=N.Config()):
        docs = SimpleNamespace(sparkSession=spark, schema={"doc": StructField("doc", LongType())}, select=lambda *_: docs, mapInArrow=lambda run, _: run)
        monkeypatch.setattr(indexed, "SLICE_BYTES", size)
        return [b for b in indexed.build_index(docs, config)(iter([pa.RecordBatch.from_pydict({"doc": [7], "text": [text]})]))]

    def content(batches):
        return sorted((list(r.values()) for b in batches for r in b.to_pylist()), key=str)

    for text in ("the cat é\n" * 300_000, "the cat é " * 300_000):  # 3.3 MB
        assert max(b.nbytes - b["context"].nbytes for b in rows(text, 1 << 20)) < 16e6
    random.seed(6)
    texts = [TEXT, "a-\nb c-\n\n d\n1. e\n12. f g 1. h", "a" * 90 + "\n" + "b" * 90, "\n" * 99, "- . " * 40, "é é\n" * 30]
    texts += ["".join(random.choices(letters, k=200)) for letters in ("aB12\n-., (:)9é' ", "ab 1.\n", "a-\n ", "aÉ_ \n") for _ in range(30)]
    for n in range(1, 30):  # white space at the end of what Arrow holds
        assert [r["word"] for b in rows("a" * n + "\n", 1 << 20) for r in b.to_pylist() if r["word"]] == ["a" * n]
    for config in (N.Config(), N.Config(ignore_case=False), N.Config(remove_stopwords=True)):
        for text in texts:
            assert content(rows(text, 5, config)) == content(rows(text, 1 << 20, config)), text


def test_stopwords_in_places_and_columns_agree(spark):
    config = N.Config(remove_stopwords=True)
    random.seed(3)
    texts = [" ".join(random.choices(["the", "And", "house", "is", "of-the", "but", "not", "\n"], k=9)) for _ in range(60)] + ["the", "The and", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", N.normalized(F.col("text"), config).alias("n")).collect()}
    for i, t in enumerate(texts):
        p = Q.placed(t, config)
        assert got[i] == p.text and len(p.at) == len(p.text), t


def test_packages_and_stores(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two"), ("c", None)], "doc string, text string")
    store = packages.Store(spark, str(tmp_path / "s"), L.word_postings)
    assert [store.prepare(docs)[1], store.prepare(docs)[1]] == ["cold", "memory"]
    changed = docs.where("doc <> 'a'").unionByName(spark.createDataFrame([("d", "new")], "doc string, text string"))
    other = packages.Store(spark, str(tmp_path / "s"), L.word_postings)
    index, how = other.prepare(changed)
    assert how == "patched" and {(r.doc, r.word) for r in index.collect()} == {("b", "two"), ("d", "new")}
    assert other.divergence(changed).first().asDict() == {"missing": 0, "extra": 0}
    assert len(listing(spark, str(tmp_path / "s"))) == 2 and listing(spark, str(tmp_path / "none")) == []
    assert packages.root_of(D.manifest(docs.limit(0))) == "empty"
    packages.write_package({"t": docs}, str(tmp_path / "p"))
    docs.withColumn("text", F.lit("x")).write.mode("overwrite").parquet(str(tmp_path / "p" / "t"))
    with pytest.raises(packages.DamagedPackage):
        packages.read_package(spark, str(tmp_path / "p"))


def test_positions_and_spreading(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert sorted((r.k, r.pos) for r in positioned(df, ["k"]).collect()) == [(i, i) for i in range(1000)]
    one = df.coalesce(1)
    assert spread(one, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = df.repartition(64)
    assert spread(many, "k") is many


def test_companions(spark):
    source = spark.createDataFrame([("f", n, f"block {n}") for n in range(4)], "doc string, n long, content string")
    made = I.build_chains(source, "doc", "n", "content").withColumn("place", F.col("n").cast("int"))
    text = I.write_companion(made).first().text
    assert text.count(";; @@block") == 4 and text.endswith(";; @@end 3\n")
    read = I.parse_companion(spark.createDataFrame([("f", text + ";; a comment\n")], "doc string, text string"))
    assert sorted((r.n, r.content) for r in read.collect()) == [(n, f"block {n}") for n in range(4)]
    status = lambda c: [r.status for r in I.check_integrity(source, c, "doc").orderBy("n").collect()]
    assert status(read) == ["valid"] * 4
    assert status(read.where("n <> 1")) == ["valid", "invalid", "stale", "stale"]
    rows = spark.createDataFrame([(1, ""), (2, None), (3, text), (4, "plain"), (5, text + "stray"), (6, text + ";; fine")], "i int, t string")
    assert {r.i for r in rows.where(I.corrupted(F.col("t"))).collect()} == {4, 5}


def test_a_stream_forgets_documents(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, "doc string, text string, deleted boolean").write.parquet(str(tmp_path / "in" / name))
    source = lambda: reindex.document_stream(spark, str(tmp_path / "in" / "*"), "doc string, text string, deleted boolean")
    run = lambda: reindex.reindex_stream(source(), L.word_postings, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    put("a", [("a", "one", False), ("b", "two", False), ("c", "three", None)])
    run()
    put("b", [("a", "one", True), ("b", "", False)])
    run()
    assert {(r.doc, r.word) for r in reindex.current(spark, str(tmp_path / "out")).collect()} == {("c", "three")}
