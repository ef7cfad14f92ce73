"""Registered queries of searches, quotes, views, integrity and sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import normalize as N
from gneiss.operators import forms as O, graph as G, indexed, integrity as I, lines as L, logic, quotes as Q, search
from gneiss.sources import codec, documents as D, packages, references as R
from gneiss.sources.shared import new_path, stored, write_text
from gneiss.streaming import reindex as stream

from .catalogue import EDGES, ITEMS, SOURCES, THE, _docs, _graph, _items, _one, _phrase, _quotes, _sources, _table, query
from . import loader
from .catalogue_programs import _system, values
from .search_language import Cursor, Search
from .sexpr import parse
from .views import Health, Hologram, Lens

# --- phrases in normalised text, by texts, by a kept index, and traced to quotes ---

#: Documents of letters, single spaces and line ends alone: there the normalised text is the lines with spaces between.
CLEAN = r"""clean AS (SELECT doc_id AS doc, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-zà-öø-ÿß\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS t FROM documents),
cut AS (SELECT doc, string_split(t, chr(10)) AS p FROM clean), cl AS (SELECT doc, unnest(p) AS context, unnest(generate_series(1, len(p))) AS line FROM cut),
starts AS (SELECT doc, CAST(line AS BIGINT) AS line, context, coalesce(sum(length(context) + 1) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cl),
norm AS (SELECT doc, replace(t, chr(10), ' ') AS n FROM clean WHERE contains(replace(t, chr(10), ' '), 'ing and')),
hits AS (SELECT doc, i - 1 AS start FROM (SELECT doc, n, unnest(generate_series(1, length(n))) AS i FROM norm) WHERE n[i:i+6] = 'ing and'),
found AS (SELECT h.doc, s.line, min(h.start - s.start + 1) AS "column" FROM hits h JOIN starts s ON h.doc = s.doc AND h.start >= s.start AND h.start < s.start + length(s.context) + 1 GROUP BY ALL)"""
FOUND = f'WITH {CLEAN} SELECT doc, line, CAST("column" AS INTEGER) AS "column" FROM found'


def _clean(spark, sf_dir):
    text = F.lower("text")
    for pattern, new in ((r"[^a-zà-öø-ÿß\n]+", " "), (r" *\n[ \n]*", "\n"), (r"^\s+", ""), (r"\s+$", "")):
        text = F.regexp_replace(text, pattern, new)
    return _docs(spark, sf_dir).select("doc", text.alias("text"))


def _places(posting):
    return posting.select("doc", "line", "column")


@query(FOUND)
def search_normal(spark, sf_dir):
    """A phrase in the normalised text, over line ends, each hit at the line where it begins."""
    return _places(Search(_clean(spark, sf_dir)).posting("ing and"))


@query(FOUND)
def search_indexed(spark, sf_dir):
    """IO9, S1: the same from an index that is built, written and read again, without the texts."""
    docs = stored(_clean(spark, sf_dir))  # hashed and indexed
    store = packages.Store(spark, new_path(spark, "index"), indexed.build_index)
    index, _ = store.prepare(docs)
    return _places(Search(docs, index=index).posting("ing and"))


@query(f"WITH {CLEAN} SELECT doc, count(*) AS n FROM (SELECT doc, line FROM (SELECT doc, line, unnest(string_split(context, ' ')) AS w FROM starts) WHERE w = 'the' GROUP BY ALL) GROUP BY doc")
def word_indexed(spark, sf_dir):
    """S3: a word's lines from the index."""
    return indexed.indexed_word(indexed.build_index(_clean(spark, sf_dir)), "the").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CLEAN}, ranges AS (SELECT doc_id AS doc, (doc_id * 41) % 900 AS a, (doc_id * 41) % 900 + 300 AS b, 'q' || doc_id % 5 AS caller FROM documents),
met AS (SELECT h.doc, h.start, caller, round((least(h.start + 7, b) - greatest(h.start, a)) / 7, 3) AS overlap FROM hits h JOIN ranges r ON h.doc = r.doc AND a < h.start + 7 AND h.start < b),
said AS (SELECT m.doc, s.line, caller, max(overlap) AS overlap FROM met m JOIN starts s ON m.doc = s.doc AND m.start >= s.start AND m.start < s.start + length(s.context) + 1 GROUP BY ALL)
SELECT f.doc, f.line, CAST(count(caller) AS INTEGER) AS total_callers, coalesce(max(overlap), 0.0) AS best FROM found f LEFT JOIN said ON said.doc = f.doc AND said.line = f.line GROUP BY ALL""")
def trace_registered(spark, sf_dir):
    """The lines of a phrase with those whose quotes overlap it."""
    at = (F.col("doc") * 41) % 900
    ranges = _docs(spark, sf_dir).select("doc", at.alias("start"), (at + 300).alias("end"), F.concat(F.lit("q"), F.col("doc") % 5).alias("caller"))
    found = Search(_clean(spark, sf_dir), ranges=ranges).posting("ing and")
    best = F.coalesce(F.array_max(F.transform("callers", lambda c: c["overlap"])), F.lit(0.0))
    return found.select("doc", "line", "total_callers", best.alias("best"))


@query("SELECT doc_id AS doc, CAST(0 AS BIGINT) AS start, CAST(length(q) AS BIGINT) AS \"end\", 'c' || doc_id AS caller FROM (SELECT doc_id, regexp_extract(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), '^ ?([a-z]+ [a-z]+)', 1) AS q, length(text) AS n FROM documents) WHERE q <> ''")
def registered_ranges(spark, sf_dir):
    """Ranges of quotes that name their document: here its first two words, written with other case."""
    letters = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    docs = _docs(spark, sf_dir).select("doc", letters.alias("text"))
    first = F.regexp_extract("text", "^([a-z]+ [a-z]+)", 1)
    asked = docs.select("doc", F.upper(first).alias("quote"), F.concat(F.lit("c"), "doc").alias("caller")).where("quote <> ''")
    return Q.register_ranges(Q.verify_named(docs, asked))


@query(f"WITH {THE} SELECT (SELECT count(*) FROM a) AS n")
def scoped_search(spark, sf_dir):
    """A query that asks another search for a part of it."""
    docs = _docs(spark, sf_dir)
    inner = Search(docs, literal=True)
    return Search(docs, scopes={"other": inner.posting}, literal=True).query('(count (scope other "ing and"))')


@query(f"WITH {THE} SELECT '__result__' AS doc, CAST(1 AS BIGINT) AS line, CAST((SELECT count(*) FROM b) AS VARCHAR) AS context")
def displayed_scalar(spark, sf_dir):
    """S26."""
    return Search(_docs(spark, sf_dir), literal=True).display('(count "tion")').select("doc", "line", "context")


@query(f"WITH {THE} SELECT doc, line FROM b ORDER BY CAST(doc AS VARCHAR), line LIMIT 10 OFFSET 20")
def cursor_page(spark, sf_dir):
    """The third page, by a step forth, another, one too many and one back."""
    c = Cursor(Search(_docs(spark, sf_dir), literal=True), "tion", 10)
    return c.next().next().next().prev().rows().select("doc", "line")


@query(f"WITH {THE} SELECT doc, line, CAST(line % 9 + 1 AS INTEGER) AS total_callers, CAST(least(line % 9 + 1, 3) AS INTEGER) AS shown FROM b ORDER BY line % 9 DESC, CAST(doc AS VARCHAR), line LIMIT 30")
def callers_page(spark, sf_dir):
    """A page that shows three callers of each line and counts all."""
    hits = _phrase(spark, sf_dir, "tion")
    callers = hits.select("doc", "line", F.explode(F.sequence(F.lit(0), F.col("line") % 9)).alias("k")).select("doc", "line", F.concat(F.lit("f"), "k").alias("name"), F.lit(0.5).alias("overlap"))
    page = Search(_docs(spark, sf_dir), callers=callers, literal=True).query("tion", 30, max_callers=3)
    return page.select("doc", "line", "total_callers", F.size("callers").alias("shown"))


@query(f"""WITH {CLEAN} SELECT h.doc, s.line, CAST(h.start - s.start + 1 AS INTEGER) AS "column", CAST(h.start AS BIGINT) AS start FROM hits h JOIN starts s ON h.doc = s.doc AND h.start >= s.start AND h.start < s.start + length(s.context) + 1
 ORDER BY h.doc, s.line, h.start LIMIT 25""")
def first_hits(spark, sf_dir):
    """S2 with a limit: the first places of a phrase."""
    return L.phrase_hits(_clean(spark, sf_dir), "ing and", most=25).select("doc", "line", "column", "start")


@query(f"WITH {THE} SELECT doc, line, context FROM a WHERE doc % 2 = 0")
def forms_and_lines(spark, sf_dir):
    """Lines found and forms of another system met by key, and turned into a posting."""
    docs = _docs(spark, sf_dir)
    even = lambda expr: O.forms_of(L.phrase_lines(docs.where("doc % 2 = 0"), str(expr)))
    s = Search(docs, scopes={"even": even}, literal=True)
    return s.display('(and "ing and" (scope even "ing and"))').select(F.col("doc").cast("long").alias("doc"), "line", "context")


@query(f"WITH {THE} SELECT context AS value FROM a UNION ALL SELECT c_name FROM customer")
def form_fields(spark, sf_dir):
    """Fields of forms by their accessors."""
    names = O.mixed(_table(spark, sf_dir, "customer").select(F.lit("library.lens.ln").alias("tag"), F.col("c_name").alias("name")))
    s = Search(_docs(spark, sf_dir), scopes={"lens": lambda _: names}, literal=True)
    return s.posting(parse('(sr-context "ing and")')).unionByName(s.posting(parse("(ln-name (scope lens all))")))


@query(f"WITH {THE} SELECT 'sr-fmt' AS tag, 'md' AS perspective, doc, line, context FROM a")
def displayed_forms(spark, sf_dir):
    """U13."""
    return Search(_docs(spark, sf_dir), literal=True).posting(parse('(fmt "md" "ing and")')).select("tag", "perspective", "doc", "line", "context")


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_name = 'Customer#000000003' UNION ALL SELECT false")
def has_form_key(spark, sf_dir):
    """S29."""
    rows = _table(spark, sf_dir, "customer").select(F.lit("ln").alias("tag"), F.col("c_name").alias("name"))
    return O.has_key(rows, "Customer#000000003").unionByName(O.has_key(rows, "nobody"))


# --- normalisation and verification ---


@query(r"""WITH l AS (SELECT doc_id AS doc, regexp_replace('  7. ' || text, '(?m)^([^\S\n]{2,}|)[12]?[0-9]\.\s+', '\1 ', 'g') AS t FROM documents),
j AS (SELECT doc, regexp_replace(t, '([\p{L}\p{N}])-\n\s*([\p{L}\p{N}])', '\1\2', 'g') AS t FROM l) SELECT doc, regexp_replace(regexp_replace(t, '-\n([\s\S])', ' \1', 'g'), '\n', ' ', 'g') AS norm FROM j""")
def normalised_lists(spark, sf_dir):
    """V3, V4: list markers and line ends."""
    return _docs(spark, sf_dir).select("doc", N.hyphenation(N.lists(F.concat(F.lit("  7. "), "text"))).alias("norm"))


@query(r"""WITH w AS (SELECT doc_id AS doc, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS p FROM documents)
 SELECT doc, CASE WHEN len(list_filter(p, lambda x: x NOT IN ('the', 'and', 'of'))) > 0 THEN array_to_string(list_filter(p, lambda x: x NOT IN ('the', 'and', 'of')), ' ') ELSE coalesce(p[1], '') END AS norm FROM w""")
def normalised_stopwords(spark, sf_dir):
    """V6, V8: without some stop words, and nothing else changed."""
    only = N.Config().overridden(ignore_case=False, ignore_lists=False, ignore_hyphenation=False, ignore_punctuation=False, remove_stopwords=True, stopwords=("the", "and", "of"))
    return _docs(spark, sf_dir).select("doc", N.normalized(F.regexp_replace("text", r"\s+", " "), only).alias("norm"))


TEXT = "The plan is not to sell. Profits, in 2020, were high-\nly uneven — but fair."


@query(
    values(
        "item, strategy, verified, level, confidence",
        "1, 'exact', true, 'high', 0.969::DOUBLE", "2, 'exact', true, 'high', 0.964", "3, 'none', false, 'none', 0.0", "4, 'collapsed', true, 'high', 0.96", "5, 'none', false, 'none', 0.0",
    )
)
def verified_text(spark, sf_dir):
    """Quotes against a text that isn't registered, with their scores."""
    quotes = spark.createDataFrame([(1, "profits in 2020"), (2, "HIGHLY uneven, but fair"), (3, "not so"), (4, "Pro fits"), (5, "  ")], "item int, quote string")
    return Q.verify_text(TEXT, quotes).select("item", "strategy", "verified", "level", "confidence")


@query(values("item, verified, confidence", "1, true, 0.96875::DOUBLE", "2, false, 0.669167", "3, true, 0.99"))
def stopword_scores(spark, sf_dir):
    """What stop words cost that only one side has, dangerous ones in full."""
    config = N.Config().overridden(remove_stopwords=True, stopwords=("the", "is", "not", "to", "a"))
    docs = spark.createDataFrame([("d", "a plan sells the house\nthe plan is not sold to us")], "doc string, text string")
    quotes = spark.createDataFrame([("d", 1, "plan sells house", "x"), ("d", 2, "plan sold us", "x"), ("d", 3, "Plan", "x")], "doc string, item int, quote string, caller string")
    return Q.scored(Q.verify_named(docs, quotes, config), config).select("item", "verified", "confidence")


@query(values("quote, reason", "'', 'empty quote'", "'?;', 'nothing left after normalisation'", "'the', 'a stop word alone'", "'fine words', NULL"))
def rejected_quotes(spark, sf_dir):
    """V11."""
    rows = spark.createDataFrame([("",), ("?;",), ("the",), ("fine words",)], "quote string")
    return rows.select("quote", Q.rejected(F.col("quote"), N.Config(remove_stopwords=True)).alias("reason"))


# --- graphs and health tables by query text ---


@query("WITH " + EDGES + " SELECT name FROM nodes WHERE contains(kind, 'term') AND starts_with(name, 'n1') UNION ALL SELECT name FROM nodes WHERE name = 'r2'")
def lens_query(spark, sf_dir):
    """G8-G15 as text: nested filters, and sets of forms."""
    lens = Lens(*_graph(spark, sf_dir))
    return lens.evaluate('(or (kind "term" (focus "n1")) (node "r2"))').select("name")


@query("WITH " + EDGES + " SELECT 'roots' AS asked, count(*) AS n FROM nodes WHERE kind IN ('axiom', 'term-fwd') UNION ALL SELECT 'inputs', count(*) FROM edges WHERE dst = 'c5' UNION ALL SELECT 'downstream', count(*) FROM edges WHERE src = 'n4' UNION ALL SELECT 'layer', count(*) FROM nodes WHERE kind = 'term-fwd'")
def lens_counts(spark, sf_dir):
    """G10-G13."""
    lens = Lens(*_graph(spark, sf_dir))
    texts = {"roots": "(roots)", "inputs": '(inputs "c5")', "downstream": '(downstream "n4")', "layer": "(layer 1)"}
    each = [lens.evaluate(f"(count {t})").select(F.lit(a).alias("asked"), "n") for a, t in texts.items()]
    return O.mixed(*each)


@query(values("asked, value", "'depth', '2'", "'gone', '-1'", "'value', '(- profit rent)'", "'terms', 'net'", "'terms', 'profit'", "'quotes', 'Sales in the third quarter were 40'", "'text', 'sales'"))
def lens_scalars(spark, sf_dir):
    """Depth, value, names by kind, quotes of a node, and a text in what nodes say."""
    lens = Lens(*_system(spark).probe("is-healthy"))
    texts = {"depth": '(depth "net")', "gone": '(depth "none")', "value": '(value "net")', "terms": '(terms "comp")', "quotes": '(quotes "sales")'}
    each = [lens.evaluate(t).select(F.lit(a).alias("asked"), F.col("value").cast("string").alias("value")) for a, t in texts.items()]
    return O.mixed(*each, lens.evaluate("fact 40").select(F.lit("text").alias("asked"), F.col("doc").alias("value")))


@query(f"WITH {ITEMS} SELECT 'both' AS asked, count(*) AS n FROM items WHERE category = 'issue' AND contains(kind, 'term') AND starts_with(name, 'u1') UNION ALL SELECT 'warnings', count(*) FROM items WHERE category = 'warning' UNION ALL SELECT 'danglings', count(*) FROM items WHERE category = 'dangling' UNION ALL SELECT 'click', count(*) FROM items WHERE contains(type, 'cli')")
def health_query(spark, sf_dir):
    """G23, G24 as text."""
    health = Health(_items(spark, sf_dir))
    texts = {"both": '(category "issue" (kind "term" (focus "u1")))', "warnings": "(warnings)", "danglings": "(danglings)", "click": '(type "cli")'}
    return O.mixed(*[health.evaluate(f"(count {t})").select(F.lit(a).alias("asked"), "n") for a, t in texts.items()])


@query(f"WITH {ITEMS}, f AS (SELECT * FROM items WHERE starts_with(name, 'u1')) SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FILTER (category = 'issue') = 0 FROM f) AS consistent, (SELECT count(*) FILTER (category = 'issue') = 0 FROM items) AS whole")
def health_focus(spark, sf_dir):
    """G25, G39."""
    health = Health(_items(spark, sf_dir))
    own, good = G.focused(health.items, "u1")
    return own.agg(F.count(F.lit(1)).alias("n")).crossJoin(good).crossJoin(health.evaluate("(consistent)").select(F.col("value").alias("whole")))  # one row each


@query(f"WITH {ITEMS} SELECT DISTINCT type AS value FROM items WHERE contains(type, 'cli') UNION ALL SELECT DISTINCT kind FROM items")
def health_suggestions(spark, sf_dir):
    """What a filter that finds nothing may have meant."""
    items = _items(spark, sf_dir)
    return G.suggestions(items, "type", "clic").unionByName(G.suggestions(items, "kind", "zzz"))


@query(f"""WITH {SOURCES}, e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P')
 SELECT 'o' || k AS name, 'loader' AS category, 'error' AS type, 'f.pltg:' || k AS loc FROM e UNION ALL SELECT 'd' || name, 'issue', 'no_evidence', 'f.pltg:' || name FROM sources WHERE origin = 'report'
 UNION ALL SELECT 'd' || name, 'warning', 'manually_verified', 'f.pltg:' || name FROM sources WHERE manual UNION ALL SELECT 'c' || c_custkey, 'dangling', 'dangling', '?' FROM customer ANTI JOIN orders ON o_custkey = c_custkey""")
def report_items(spark, sf_dir):
    """One health table of a load's errors, issues, warnings and danglings."""
    at = lambda c: F.concat(F.lit("f.pltg:"), F.col(c))
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    errors = orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("name"), F.lit("error").alias("status"), F.lit("late").alias("cause"), F.lit("fact").alias("kind"), at("o_orderkey").alias("loc"))
    found = logic.evidence_items(_sources(spark, sf_dir)).withColumn("name", F.concat(F.lit("d"), "name"))
    places = _sources(spark, sf_dir).select(F.concat(F.lit("d"), "name").alias("name"), F.lit("fact").alias("kind"), at("name").alias("loc"))
    loose = logic.danglings(customers.select(F.concat(F.lit("c"), "c_custkey").alias("name")), orders.select(F.concat(F.lit("c"), "o_custkey").alias("name")))
    made = G.report(errors, found.where("item = 'no_evidence'"), found.where("item = 'manually_verified'"), loose, places)
    return made.select("name", "category", "type", "loc")


def _halves(spark, sf_dir):
    """Three graphs over customers: two thirds, one third, and all."""
    nodes, edges = _graph(spark, sf_dir)
    custom = nodes.where("kind = 'fact'")
    k = F.substring("name", 2, 20).cast("long") % 3
    return Hologram([Lens(custom.where(k < 2), edges), Lens(custom.where(k == 2), edges), Lens(custom, edges)])


@query("""SELECT 'left' AS asked, count(*) AS n FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT 'right', count(*) FROM customer UNION ALL SELECT 'second', count(*) FROM customer WHERE c_custkey % 3 = 2 AND starts_with('c' || c_custkey, 'c1')
 UNION ALL SELECT 'divergent', count(*) FROM customer UNION ALL SELECT 'common', 0 UNION ALL SELECT 'only', 0""")
def holo_query(spark, sf_dir):
    """G31-G34 as text."""
    holo = _halves(spark, sf_dir)
    texts = {"left": "(left)", "right": "(right)", "second": '(lens 1 (focus "c1"))', "divergent": "(divergent)", "common": "(common)", "only": "(only 2)"}
    return O.mixed(*[holo.evaluate(f"(count {t})").select(F.lit(a).alias("asked"), "n") for a, t in texts.items()])


@query("SELECT 'c' || c_custkey AS name FROM customer WHERE contains(lower(c_name), 'customer') AND contains(c_name, '#000000001')")
def holo_text(spark, sf_dir):
    """A text in what the nodes of several graphs say, each name once."""
    return _halves(spark, sf_dir).evaluate("customer#000000001").select(F.col("doc").alias("name"))


@query('SELECT \'left\' AS bias, count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT \'right\', count(*) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT \'neutral\', count(*) FROM (SELECT l_orderkey FROM lineitem UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)')
def hologram_biases(spark, sf_dir):
    """G36."""
    a = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.sum("l_quantity").alias("value"))
    b = _table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("name"), F.col("o_totalprice").alias("value"))
    return O.mixed(*[G.side_by_side(a, b, x).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("bias"), "n") for x in ("left", "right", "neutral")])


SETS = """s AS (SELECT p_partkey AS k, list_sort(list_distinct(list_filter([CASE WHEN p_size % 2 = 0 THEN 'two' END, CASE WHEN p_size % 3 = 0 THEN 'three' END, CASE WHEN p_size % 5 = 0 THEN 'five' END], lambda x: x IS NOT NULL))) AS f FROM part),
d AS (SELECT DISTINCT f FROM s), l AS (SELECT a.f AS big, b.f AS small FROM d a JOIN d b ON len(b.f) < len(a.f) AND len(list_filter(b.f, lambda x: NOT list_contains(a.f, x))) = 0),
up AS (SELECT f, 0 AS n FROM d UNION SELECT l.big, up.n + 1 FROM up JOIN l ON l.small = up.f)"""


@query(f"WITH RECURSIVE {SETS} SELECT 'p' || k AS name, CAST(1 + max(n) AS INTEGER) AS depth FROM s JOIN up USING (f) GROUP BY k UNION ALL SELECT name, 0 FROM (VALUES ('two'), ('three'), ('five'), ('base')) v(name)")
def settled_depth(spark, sf_dir):
    """G2 with the bump: parts rest on what divides their size; one that rests on strictly more lies deeper."""
    part = _table(spark, sf_dir, "part")
    name = F.concat(F.lit("p"), "p_partkey")
    facts = [("two", 2), ("three", 3), ("five", 5)]
    held = F.array_compact(F.array(*[F.when(F.col("p_size") % k == 0, n) for n, k in facts]))
    edges = part.select(F.explode(held).alias("src"), name.alias("dst")).unionByName(part.select(F.lit("base").alias("src"), name.alias("dst")))
    nodes = spark.createDataFrame([(n, "fact", "") for n, _ in facts] + [("base", "axiom", "")], "name string, kind string, value string")
    return G.settled_depths(nodes.unionByName(part.select(name.alias("name"), F.lit("calc").alias("kind"), F.lit("").alias("value"))), edges)


# --- integrity ---


@query("SELECT conv_id, CAST(turn AS BIGINT) AS pos, sha256(text) AS hash FROM conversations")
def merkle_leaves(spark, sf_dir):
    """H7."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("content"))
    return I.leaves_of(I.merkle(c, "conv_id"), "conv_id")


def _companion(spark, sf_dir):
    """(source blocks, companion blocks) of conversations: the companion has the chain's hashes."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), F.col("text").alias("content"))
    made = I.build_chains(c, "conv_id", "n", "content")
    return c, made.select("conv_id", F.col("n").cast("int").alias("place"), "n", "content", "hash")


@query("SELECT conv_id, CAST(turn AS BIGINT) AS n, 'valid' AS status FROM conversations WHERE turn < 3 UNION ALL SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'invalid' ELSE 'stale' END FROM conversations WHERE turn >= 3")
def companion_integrity(spark, sf_dir):
    """H9: a companion in which block 3 was emptied."""
    source, blocks = _companion(spark, sf_dir)
    gone = blocks.where("n = 3").select("conv_id", "n")
    return I.check_integrity(source, I.clear_blocks(blocks, gone, "conv_id"), "conv_id")


@query("SELECT conv_id, CAST(turn AS INTEGER) AS place, CAST(turn AS BIGINT) AS n FROM conversations")
def companion_repair(spark, sf_dir):
    """H9: written as text, doubled and turned round, read again and repaired."""
    _, blocks = _companion(spark, sf_dir)
    safe = blocks.withColumn("content", F.regexp_replace("content", ";;", ""))
    text = I.write_companion(safe.withColumn("place", -F.col("place")), "conv_id")
    twice = I.parse_companion(text.withColumn("text", F.concat("text", "text")), "conv_id")
    return I.repair_order(twice, "conv_id").select("conv_id", "place", "n")


@query("SELECT conv_id, CAST(2 AS BIGINT) AS n, CAST(2 AS BIGINT) AS times FROM conversations WHERE turn = 2")
def companion_duplicates(spark, sf_dir):
    """H9: duplicate_blocks on rows that hold some."""
    _, blocks = _companion(spark, sf_dir)
    again = blocks.where("n = 2").withColumn("place", F.col("place") + 100).withColumn("hash", F.lit("x"))
    return I.duplicates(blocks.unionByName(again), "conv_id")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS blocks, CAST(0 AS BIGINT) AS wrong FROM conversations GROUP BY conv_id")
def companion_resolved(spark, sf_dir):
    """H9: of doubled blocks the one with the right hash stays."""
    _, blocks = _companion(spark, sf_dir)
    blocks = stored(blocks)
    again = blocks.where("n = 2").withColumn("place", F.col("place") - 100).withColumn("hash", F.lit("x"))
    right = blocks.select("conv_id", "n", "hash")
    left = I.resolve_duplicates(blocks.unionByName(again), "conv_id", right)
    return left.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("hash") == "x").alias("wrong"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS n, CASE WHEN turn = 1 THEN 'new' ELSE text END AS content FROM conversations UNION ALL SELECT DISTINCT conv_id, 500, 'new' FROM conversations WHERE turn = 1")
def companion_put(spark, sf_dir):
    """H9: blocks replaced and inserted."""
    _, blocks = _companion(spark, sf_dir)
    ones = blocks.where("n = 1").select("conv_id", "n", F.lit("new").alias("content"), "hash")
    return I.put_blocks(blocks, ones.unionByName(ones.withColumn("n", F.lit(500).cast("long"))), "conv_id").select("conv_id", "n", "content")


@query("SELECT conv_id, min(turn) FILTER (turn = 2) IS NOT NULL AS out_of_order FROM conversations GROUP BY conv_id")
def companion_order(spark, sf_dir):
    """H9: block 2 moved to the front."""
    _, blocks = _companion(spark, sf_dir)
    moved = blocks.withColumn("place", F.when(F.col("n") == 2, -1).otherwise(F.col("place")))
    wrong = I.out_of_order(moved, "conv_id").select("conv_id").distinct().withColumn("out", F.lit(True))
    return moved.select("conv_id").distinct().join(wrong, "conv_id", "left").select("conv_id", F.coalesce("out", F.lit(False)).alias("out_of_order"))


@query("SELECT page_id AS doc, length(trim(html)) > 0 AS plain, false AS whole FROM pages")
def companion_corruption(spark, sf_dir):
    """H9: pages are no companions; a block between comments is a whole one."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text"))
    block = F.concat(F.lit("\n;; note\n;; @@block 0 "), F.sha2("text", 256), F.lit("\n"), F.regexp_replace("text", ";;", ""), F.lit("\n;; @@end 0\n"))
    return pages.select("doc", I.corrupted(F.col("text")).alias("plain"), I.corrupted(block).alias("whole"))


# --- sources, packages and stores ---


@query("SELECT doc_id AS doc, sha256(text || chr(10)) AS sha256 FROM documents")
def indexed_files(spark, sf_dir):
    """IO3, H8: documents written as files in folders, and indexed without those that are ignored or no text."""
    folder = new_path(spark, "files")
    _docs(spark, sf_dir).write.partitionBy("doc").text(folder)
    write_text(spark, f"{folder}/skip/a.txt", "ignored")
    write_text(spark, f"{folder}/b.bin", "no text")
    found = D.index_dir(spark, folder, exclude=["skip/"])
    return found.select(F.regexp_extract("doc", "doc=([0-9]+)/", 1).cast("long").alias("doc"), "sha256")


@query(values("doc, text, error", "'notes', 'one', NULL", "'LICENSE', 'two', NULL", "'scan', NULL, 'unsupported document format'", "'memo', 'three', NULL"))
def ingested_files(spark, sf_dir):
    """IO13, IO1, IO2."""
    folder = new_path(spark, "files")
    for name, text in (("a.md", "one"), ("LICENSE", "two"), ("scan.pdf", "%PDF")):
        write_text(spark, f"{folder}/{name}", text)
    got = D.ingest(spark, f"{folder}/LICENSE", f"{folder}/scan.pdf").unionByName(D.load_document(spark, "notes", f"{folder}/a.md").select("doc", F.lit("").alias("path"), "text", F.lit(None).cast("string").alias("error")))
    held = D.register_documents(spark, {"memo": "three"}).select("doc", "text", F.lit(None).cast("string").alias("error"))
    return got.select("doc", "text", F.regexp_replace("error", ":.*", "").alias("error")).unionByName(held)


@query("SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, true AS damaged FROM documents")
def checked_package(spark, sf_dir):
    """IO6, IO7: a package read back whole, and one that lost a row found out."""
    docs, folder = _docs(spark, sf_dir), new_path(spark, "package")
    packages.write_package({"documents": docs}, folder)
    got = packages.read_package(spark, folder)["documents"]
    least = docs.agg(F.min("doc").alias("m")).first().m
    other = new_path(spark, "package")
    packages.write_package({"documents": docs}, other)
    docs.where(F.col("doc") != least).write.mode("overwrite").parquet(f"{other}/documents")
    try:
        packages.read_package(spark, other)
        damaged = False
    except packages.DamagedPackage:
        damaged = True
    return got.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).withColumn("damaged", F.lit(damaged))


def _changed(docs):
    last = F.col("doc") % 10
    return docs.where(last != 0).withColumn("text", F.when(last == 2, F.concat("text", F.lit(" zz"))).otherwise(F.col("text")))


def _words(docs):
    return docs.select("doc", F.explode(F.split("text", " ")).alias("word"))


@query("""WITH w AS (SELECT doc_id AS doc, unnest(string_split(CASE WHEN doc_id % 10 = 2 THEN text || ' zz' ELSE text END, ' ')) AS word FROM documents WHERE doc_id % 10 <> 0),
 h AS (SELECT unnest(['cold', 'memory', 'disk', 'patched']) AS how) SELECT how, (SELECT count(*) FROM documents) >= 0 AND (SELECT count(*) FROM w) > 0 AS ok FROM h""")
def prepared_tiers(spark, sf_dir):
    """H11, IO5, IO9: built cold, from memory, from disk by another session, and patched."""
    docs, folder = _docs(spark, sf_dir).where("doc % 10 <> 1"), new_path(spark, "store")
    store = packages.Store(spark, folder, _words)
    steps = [store.prepare(docs)[1], store.prepare(docs)[1]]
    again = packages.Store(spark, folder, _words)
    steps += [again.prepare(docs)[1], again.prepare(_changed(_docs(spark, sf_dir)))[1]]
    return spark.createDataFrame([(s, True) for s in steps], "how string, ok boolean")


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra")
def patched_divergence(spark, sf_dir):
    """A patched index has neither fewer nor more rows than one built in full."""
    store = packages.Store(spark, new_path(spark, "store"), _words)
    store.prepare(_docs(spark, sf_dir))
    return store.divergence(_changed(_docs(spark, sf_dir)))


@query(f"WITH {ITEMS}, t AS (SELECT count(*) AS all_, count(*) FILTER (category = 'issue') AS few FROM items) SELECT 'cold' AS how, few AS n FROM t UNION ALL SELECT 'disk', few FROM t UNION ALL SELECT 'memory', few FROM t UNION ALL SELECT 'incremental', all_ FROM t")
def evaluated_tiers(spark, sf_dir):
    """H12, IO8: items computed, read by their root, kept in memory, and patched from stale ones."""
    items, folder = _items(spark, sf_dir), new_path(spark, "items")
    few = items.where("category = 'issue'")
    packages.Evaluations(spark, folder).evaluate("r1", lambda: few)
    cache = packages.Evaluations(spark, folder)
    steps = [packages.Evaluations(spark, new_path(spark, "items")).evaluate("r1", lambda: few)]
    steps += [cache.evaluate("r1", lambda: items), cache.evaluate("r1", lambda: items)]
    steps.append(cache.evaluate("r2", lambda: items, lambda stale: stale.unionByName(items.where("category <> 'issue'"))))
    return O.mixed(*[t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "n") for t, how in steps])


@query("WITH " + EDGES + " SELECT 'nodes' AS part, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def structure_package(spark, sf_dir):
    """IO7, IO12: a graph as a package."""
    nodes, edges = _graph(spark, sf_dir)
    folder = new_path(spark, "package")
    packages.write_package({"nodes": nodes, "edges": edges}, folder)
    got = packages.read_package(spark, folder)
    return O.mixed(*[got[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k in ("nodes", "edges")])


@query("SELECT doc_id AS doc, 'prose' AS kind, 1 AS start_line FROM documents UNION ALL SELECT doc_id, 'executable', 3 FROM documents UNION ALL SELECT doc_id, 'code', 7 FROM documents")
def literate_blocks(spark, sf_dir):
    """IO16: documents made of a heading, an executable block and one of other code."""
    word = F.regexp_extract("text", r"\w+", 0)
    text = F.concat(F.lit("# "), word, F.lit("x\n```scheme\n;; pltg\n(fact a 1)\n```\n```python\n"), word, F.lit("y\n```\n"))
    return D.markdown_blocks(_docs(spark, sf_dir).select("doc", text.alias("text"))).select("doc", "kind", F.col("start_line").cast("int").alias("start_line"))


@query("SELECT count(*) AS runs, max(o_orderkey) AS last, o_orderstatus AS project FROM orders GROUP BY o_orderstatus UNION ALL SELECT 1, 7, 'one' FROM orders WHERE o_orderkey = 7 UNION ALL SELECT count(*), max(o_orderkey), 'left' FROM orders WHERE o_orderstatus <> 'F'")
def history_projects(spark, sf_dir):
    """IO14: projects, one run, and what is left when a project's runs are cleared."""
    runs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("project"))
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("runs"), F.max("id").alias("last")).withColumn("project", F.lit(name)).where("runs > 0")
    return D.projects(runs).select("runs", "last", "project").unionByName(total(D.history_get(runs, "id", 7), "one")).unionByName(total(D.history_clear(runs, "F"), "left"))


@query(values("path, text", "'main', '[[fact:sources.one.a]] and [[term:none]]'", "'one', '(fact a 1)'", "'two', '(import (quote one))\n\n(defterm b (+ one.a 1))'", "'r', 'a document'"))
def exported_project(spark, sf_dir):
    """IO15."""
    folder = new_path(spark, "project")
    docs = spark.createDataFrame([("r", "a document")], "doc string, text string")
    loader.export_project(spark, folder, [("one", "(fact a 1)"), ("two", "(defterm b (+ a 1))")], docs, "[[fact:a]] and [[term:none]]")
    read = loader.reader(spark)
    files = [("main", read(f"{folder}/main.pgmd")), ("one", read(f"{folder}/sources/one.pltg")), ("two", read(f"{folder}/sources/two.pltg"))]
    back = spark.read.text(f"{folder}/resources").select(F.col("doc").alias("path"), F.col("value").alias("text"))
    return spark.createDataFrame(files, "path string, text string").unionByName(back)


@query(f"WITH {ITEMS} SELECT name, category, detail FROM items WHERE category = 'issue'")
def report_json(spark, sf_dir):
    """IO11: a report as JSON and back."""
    rows = _items(spark, sf_dir).where("category = 'issue'").select("name", "category", "detail")
    return codec.rows_of(codec.rows_json(rows), "name string, category string, detail string")


@query("SELECT doc_id AS name, '{\"__symbol__\": \"' || lang || '\"}' AS json, lang AS back FROM documents")
def json_codec(spark, sf_dir):
    """IO11: symbols as JSON and back, on rows."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "lang")
    json = codec.symbol_json(F.col("lang"))
    return docs.select("name", json.alias("json"), codec.symbol_of(json).alias("back"))


@query("SELECT doc_id AS doc, count(*) AS n FROM (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 10 = 2 THEN text || ' zz' ELSE text END, ' ')) AS w FROM documents WHERE doc_id % 10 NOT IN (0, 3)) GROUP BY doc_id")
def streamed_index(spark, sf_dir):
    """A file stream in two batches: documents changed, deleted, and emptied in the second one."""
    docs, folder = _docs(spark, sf_dir).withColumn("deleted", F.lit(False)), new_path(spark, "stream")
    last = F.col("doc") % 10
    docs.write.parquet(f"{folder}/in/a")
    index = lambda d: _words(d).where("word <> 'none at all'") if d is not None else None

    def run():
        source = stream.document_stream(spark, f"{folder}/in/*", "doc long, text string, deleted boolean")
        stream.reindex_stream(source, index, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()

    run()
    text = F.when(last == 2, F.concat("text", F.lit(" zz"))).when(last == 3, "none at all").otherwise(F.col("text"))
    changed = docs.where(last.isin(0, 2, 3)).select("doc", text.alias("text"), (last == 0).alias("deleted"))
    changed.withColumn("text", F.when(last == 3, F.lit(None)).otherwise(F.col("text"))).write.parquet(f"{folder}/in/b")
    run()
    return stream.current(spark, f"{folder}/out").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    """A stream's counts by event-time window, all rows in time."""
    folder = new_path(spark, "events")
    _table(spark, sf_dir, "events").select("ts", "event_type").write.parquet(f"{folder}/in")
    source = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{folder}/in")
    counts = stream.windowed_counts(source, "ts", "event_type")
    name = "w" + folder.rsplit("-", 1)[-1]
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("SELECT 'fact' AS type, 'p' || (doc_id % 7) AS name, count(*) AS docs FROM documents GROUP BY ALL")
def extracted_marks(spark, sf_dir):
    """Marks in documents, each once for a document."""
    name = F.concat(F.lit("p"), F.col("doc") % 7)
    marked = _docs(spark, sf_dir).select("doc", F.concat(F.regexp_replace("text", r"\[\[", ""), F.lit(" [[fact:"), name, F.lit("]] [[fact:"), name, F.lit("]]")).alias("text"))
    return R.extract(marked).groupBy("type", "name").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT c_custkey AS name, 'n' || c_nationkey AS using_, 0 AS depth FROM customer WHERE c_custkey = 7")
def restricted_names(spark, sf_dir):
    """L3, L4: what one derivation may see directly."""
    seen = logic.visible(_graph(spark, sf_dir)[1], _one(spark, "c7")).where("depth = 1")
    return seen.select(F.lit(7).cast("long").alias("name"), F.col("name").alias("using_"), (F.col("depth") - 1).alias("depth"))


@query(f"WITH {THE} SELECT doc, count(*) AS n FROM a GROUP BY doc")
def phrase_by_document(spark, sf_dir):
    """S1 with the literal test, by document."""
    return _phrase(spark, sf_dir, "ing and").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {THE}, h AS (SELECT doc, count(*) AS hits FROM b GROUP BY doc) SELECT hits, count(*) AS docs FROM h GROUP BY hits")
def ranked_documents(spark, sf_dir):
    """S21."""
    ranked = search.rank("document", _phrase(spark, sf_dir, "tion"))
    return ranked.groupBy("doc").agg((-F.min("ord.hits")).alias("hits")).groupBy("hits").agg(F.count(F.lit(1)).alias("docs"))
