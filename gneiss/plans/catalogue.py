"""The registered queries of the engine and the SQL that each must equal.

Documents stand for registered documents, benchmark items for quotes, labels for facts about documents, the
keys of region, nation, customer and orders for a provenance graph, events for health items, conversations for
ordered blocks. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.functions import arrays as A, normalize as N, scalar as S
from gneiss.operators import forms, graph as G, integrity as I, lines as L, logic, quotes as Q, search
from gneiss.plans.compiler import Compiler
from gneiss.plans.search_language import Search
from gneiss.plans.sexpr import Rules
from gneiss.plans.system import System
from gneiss.sources import documents as D, references as R
from gneiss.sources.shared import spread

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

# --- SQL pieces ---
LINES = r"""lines AS (SELECT doc, CAST(i AS BIGINT) AS line, p[i] AS context FROM
 (SELECT doc_id AS doc, string_split(text, chr(10)) AS p, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
 WHERE i < len(p) OR p[i] <> '')"""
THE = LINES + r", a AS (SELECT * FROM lines WHERE contains(lower(context), 'ing and')), b AS (SELECT * FROM lines WHERE contains(lower(context), 'tion'))"
EDGES = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
nodes AS (SELECT 'r' || r_regionkey AS name, 'axiom' AS kind, r_name AS value FROM region UNION ALL SELECT 'n' || n_nationkey, 'term-fwd', n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'fact', c_name FROM customer UNION ALL SELECT 'o' || o_orderkey, 'calc', o_orderstatus FROM orders)"""
SOURCES = """sources AS (SELECT doc_id AS name, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS verified, coalesce(toxic, 0) = 1 AND quality = 0 AS manual,
 CASE WHEN quality IS NULL AND doc_id % 3 = 0 THEN 'potential fabrication' WHEN quality IS NULL AND doc_id % 3 = 1 THEN 'unknown' WHEN quality IS NULL THEN 'report' ELSE NULL END AS origin
 FROM documents LEFT JOIN labels USING (doc_id))"""
ITEMS = """items AS (SELECT 'u' || user_id || CASE WHEN event_id % 4 = 0 THEN '' ELSE '.e' || event_id % 7 END AS name,
 CASE WHEN value > 50 THEN 'issue' WHEN value > 10 THEN 'warning' ELSE 'dangling' END AS category, event_type AS type,
 CASE WHEN event_id % 2 = 0 THEN 'fact' ELSE 'term-comp' END AS kind, 'f' || event_id % 5 || '.pltg:' || event_id % 100 AS loc, CAST(event_id AS VARCHAR) AS detail FROM events)"""
CHAIN = """blocks AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
chain AS (SELECT conv_id, turn AS n, text AS content, k, sha256(text) AS hash FROM blocks WHERE k = 1
 UNION ALL SELECT b.conv_id, b.turn, b.text, b.k, sha256(b.text || c.hash) FROM chain c JOIN blocks b ON b.conv_id = c.conv_id AND b.k = c.k + 1)"""
CONTEXT_SQL = "WITH {lines}, m AS (SELECT * FROM lines WHERE contains(lower(context), 'ing and')) SELECT DISTINCT l.doc, l.line FROM lines l JOIN m ON l.doc = m.doc AND l.line BETWEEN m.line - {b} AND m.line + {a}"
CLOSURE = "WITH RECURSIVE " + EDGES + ", up AS (SELECT {seed} AS name, 0 AS depth UNION SELECT {to}, depth + 1 FROM up JOIN edges ON {frm} = up.name) SELECT name, CAST(min(depth) AS BIGINT) AS depth FROM up GROUP BY name"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")


def _key(posting: DataFrame) -> DataFrame:
    return posting.select("doc", "line")


def _phrase(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return L.phrase_lines(_docs(spark, sf_dir), text)


def _ab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _phrase(spark, sf_dir, "ing and"), _phrase(spark, sf_dir, "tion")


# --- lines and search ---


@query(r"SELECT count(*) AS n_lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '\bthe\b')")
def re_count(spark, sf_dir):
    return L.re_lines(_docs(spark, sf_dir), r"\bthe\b").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {LINES} SELECT count(*) AS n, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(length(context)) AS BIGINT) AS chars FROM lines")
def lines_scan(spark, sf_dir):
    return L.lines_of(_docs(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"), F.sum(F.length("context")).cast("long").alias("chars"))


@query(f"WITH {LINES} SELECT doc, line FROM lines WHERE regexp_matches(context, '[0-9]+')")
def re_lines(spark, sf_dir):
    return _key(L.re_lines(_docs(spark, sf_dir), "[0-9]+"))


@query("""WITH t AS (SELECT doc_id AS doc, trim(regexp_replace(regexp_replace(lower(text), '[^a-zà-öø-ÿß]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM documents),
 p AS (SELECT doc, norm, unnest(generate_series(1, length(norm))) AS i FROM t WHERE contains(norm, 'ing and')) SELECT doc, count(*) AS n FROM p WHERE norm[i:i+6] = 'ing and' GROUP BY doc""")
def phrase_count_by_doc(spark, sf_dir):
    letters = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-zà-öø-ÿß]+", " "), " +", " "))
    docs = _docs(spark, sf_dir).select("doc", letters.alias("text"))
    return L.occurrences(docs, "ing and").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINES} SELECT doc, line FROM lines WHERE contains(lower(context), 'tion') AND CAST(doc AS VARCHAR) LIKE '1%7'")
def in_glob(spark, sf_dir):
    return _key(search.in_document(_phrase(spark, sf_dir, "tion"), "1*7"))


@query(f"WITH {LINES} SELECT doc, line FROM lines WHERE contains(lower(context), 'tion') AND CAST(doc AS VARCHAR) = '17'")
def in_suffix(spark, sf_dir):
    return _key(search.in_document(_phrase(spark, sf_dir, "tion"), "17"))


@query(f"WITH {THE} SELECT doc, line FROM a SEMI JOIN b USING (doc, line)")
def and_lines(spark, sf_dir):
    return _key(search.and_(*_ab(spark, sf_dir)))


@query(f"WITH {THE} SELECT doc, line, max(s) AS last_set, min(s) AS first_set FROM (SELECT doc, line, 0 AS s FROM a UNION ALL SELECT doc, line, 1 FROM b) GROUP BY ALL")
def or_lines(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    got = search.or_(a.withColumn("column", F.lit(0)), b.withColumn("column", F.lit(1)))
    return got.select("doc", "line", F.col("column").cast("int").alias("last_set"), F.col("set_ord").alias("first_set"))


@query(f"WITH {THE} SELECT doc, line FROM b ANTI JOIN a USING (doc, line)")
def not_lines(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    return _key(search.not_(b, a))


@query(f"WITH {THE} SELECT doc, line FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc = a.doc AND abs(b.line - a.line) <= 2)")
def near_lines(spark, sf_dir):
    return _key(search.near(*_ab(spark, sf_dir), 2))


@query(f"WITH {THE} SELECT doc, line FROM a WHERE line < (SELECT max(line) FROM b WHERE b.doc = a.doc)")
def seq_lines(spark, sf_dir):
    return _key(search.seq(*_ab(spark, sf_dir)))


@query(f"WITH {THE} SELECT doc, line FROM b WHERE line BETWEEN 3 AND 9")
def line_range(spark, sf_dir):
    return _key(search.line_range(_phrase(spark, sf_dir, "tion"), 3, 9))


def _around(spark, sf_dir, which, n):
    docs = _docs(spark, sf_dir)
    return _key(which(n, L.phrase_lines(docs, "ing and"), L.lines_of(docs)))


@query(CONTEXT_SQL.format(lines=LINES, b=2, a=2))
def context_lines(spark, sf_dir):
    return _around(spark, sf_dir, search.context, 2)


@query(CONTEXT_SQL.format(lines=LINES, b=1, a=0))
def before_lines(spark, sf_dir):
    return _around(spark, sf_dir, search.before, 1)


@query(CONTEXT_SQL.format(lines=LINES, b=0, a=1))
def after_lines(spark, sf_dir):
    return _around(spark, sf_dir, search.after, 1)


@query(f"WITH {THE}, h AS (SELECT doc, line, count(*) OVER (PARTITION BY doc) AS hits FROM b) SELECT doc, line, hits FROM h ORDER BY hits DESC, CAST(doc AS VARCHAR), line LIMIT 50")
def rank_document_topk(spark, sf_dir):
    ranked = search.rank("document", _phrase(spark, sf_dir, "tion"))
    return search.limit(50, ranked).select("doc", "line", (-F.col("ord.hits")).alias("hits"))


@query(f"WITH {THE} SELECT doc, line FROM b ORDER BY doc, line LIMIT 20 OFFSET 40")
def rank_line_page(spark, sf_dir):
    return _key(search.limit(20, search.rank("line", _phrase(spark, sf_dir, "tion")), 40))


@query(f"WITH {THE}, near AS (SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc = a.doc AND abs(b.line - a.line) <= 3)) SELECT count(*) AS n FROM near WHERE CAST(doc AS VARCHAR) LIKE '%1%'")
def search_text(spark, sf_dir):
    return Search(_docs(spark, sf_dir), literal=True).query('(count (in "*1*" (near "ing and" "tion" 3))')


TOKENS = r"""tokens AS (SELECT doc, unnest(w) AS word, CAST(unnest(generate_series(0, len(w) - 1)) AS BIGINT) AS pos FROM
 (SELECT doc_id AS doc, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM documents))"""


@query(f"WITH {TOKENS} SELECT word, count(*) AS n, count(DISTINCT doc) AS docs FROM tokens WHERE word <> '' GROUP BY word HAVING count(DISTINCT doc) >= 5")
def word_freq_min_docs(spark, sf_dir):
    plain = N.Config(ignore_case=False, ignore_lists=False, ignore_hyphenation=False, ignore_punctuation=False)
    return L.word_frequency(_docs(spark, sf_dir), 5, config=plain)


NORMAL = r"""normal AS (SELECT doc_id AS doc, trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')), '[^a-z0-9à-öø-ÿß ]', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM documents),
quotes AS (SELECT item_id AS item, trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')), '[^a-z0-9à-öø-ÿß ]', ' ', 'g'), ' +', ' ', 'g')) AS q FROM benchmark)"""


@query(f"WITH {TOKENS} SELECT doc, pos FROM tokens WHERE word = 'the'")
def word_postings(spark, sf_dir):
    plain = N.Config(ignore_case=False, ignore_lists=False, ignore_hyphenation=False, ignore_punctuation=False)
    texts = _docs(spark, sf_dir).select("doc", F.regexp_replace("text", r"\s+", " ").alias("text"))
    return L.word_postings(texts, config=plain).where("word = 'the'").select("doc", F.col("pos").cast("long").alias("pos"))


# --- quotes and provenance ---


def _quotes(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("quote"))


@query(f"WITH {NORMAL} SELECT doc, item FROM normal, quotes WHERE q <> '' AND contains(' ' || norm || ' ', ' ' || q || ' ')")
def quote_verify_exact(spark, sf_dir):
    return Q.find_everywhere(_docs(spark, sf_dir), _quotes(spark, sf_dir)).select("doc", "item")


@query(f"WITH {NORMAL} SELECT count(*) AS n, count(DISTINCT doc) AS docs FROM normal, quotes WHERE q <> '' AND contains(' ' || norm || ' ', ' ' || q || ' ')")
def quote_confidence(spark, sf_dir):
    got = Q.scored(Q.find_everywhere(_docs(spark, sf_dir), _quotes(spark, sf_dir)))
    return got.where(F.col("verified") & (F.col("level") == "high")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("docs"))


@query(f"WITH {NORMAL}, f AS (SELECT doc, item FROM normal, quotes WHERE contains(' ' || norm || ' ', ' ' || q || ' ')) SELECT item_id AS name, count(doc) > 0 AS verified, count(*) AS quotes FROM benchmark LEFT JOIN f ON item = item_id GROUP BY item_id")
def evidence_rollup(spark, sf_dir):
    quotes = _quotes(spark, sf_dir)
    found = Q.find_everywhere(_docs(spark, sf_dir), quotes).select("item", F.lit(True).alias("found"))
    checked = quotes.select("item").join(found, "item", "left").select(F.col("item").alias("name"), F.coalesce("found", F.lit(False)).alias("verified"))
    return Q.evidence_rollup(checked)


@query(r"SELECT doc_id AS doc, contains(replace(lower(regexp_replace(text, '\s+', '', 'g')), ' ', ''), 'ingand') AS found FROM documents")
def quote_verify_collapsed(spark, sf_dir):
    norm = F.lower(F.regexp_replace("text", r"\s+", " "))
    return _docs(spark, sf_dir).select("doc", Q.collapsed(norm, F.lit("ing and")).alias("found"))


RANGES = """hits AS (SELECT doc_id AS doc, CAST((doc_id * 37) % 3000 AS BIGINT) AS "start", CAST((doc_id * 37) % 3000 + 60 AS BIGINT) AS "end" FROM documents),
ranges AS (SELECT doc_id AS doc, CAST((doc_id * 41) % 3000 AS BIGINT) AS "start", CAST((doc_id * 41) % 3000 + 80 + doc_id % 500 AS BIGINT) AS "end", 'q' || doc_id % 9 AS caller FROM documents)"""


def _ranges(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc")
    at = lambda k: (F.col("doc") * k) % 3000
    hits = d.select("doc", at(37).alias("start"), (at(37) + 60).alias("end"))
    return hits, d.select("doc", at(41).alias("start"), (at(41) + 80 + F.col("doc") % 500).alias("end"), F.concat(F.lit("q"), F.col("doc") % 9).alias("caller"))


@query(f"""WITH {RANGES} SELECT h.doc, h."start", h."end", caller, round((least(h."end", r."end") - greatest(h."start", r."start")) / (h."end" - h."start"), 3) AS overlap
 FROM hits h JOIN ranges r ON h.doc = r.doc AND r."start" < h."end" AND h."start" < r."end" """)
def trace_overlap(spark, sf_dir):
    return search.trace(*_ranges(spark, sf_dir))


@query(f"WITH {THE} SELECT doc, line, CAST(row_number() OVER (ORDER BY line % 3 <> 0, -(line % 5 + 1) * (CASE WHEN line % 3 = 0 THEN 1 ELSE 0 END), doc, line) AS INTEGER) AS r FROM b QUALIFY r <= 40")
def callers_rank(spark, sf_dir):
    hits = _phrase(spark, sf_dir, "tion")
    some = hits.where("line % 3 = 0").select("doc", "line", F.explode(F.sequence(F.lit(0), F.col("line") % 5)).alias("k"))
    callers = some.select("doc", "line", F.concat(F.lit("f"), "k").alias("name"), F.lit(0.5).alias("overlap"))
    ranked = search.rank("callers", search.with_callers(hits.withColumn("ord", F.struct("doc", "line")), callers))
    top = search.limit(40, ranked).agg(F.sort_array(F.collect_list(F.struct("ord", "doc", "line"))).alias("all"))
    return top.select(F.posexplode("all").alias("i", "x")).select("x.doc", "x.line", (F.col("i") + 1).alias("r"))


# --- logic ---


def _sources(spark, sf_dir):
    joined = _table(spark, sf_dir, "documents").select("doc_id").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    third = F.col("doc_id") % 3
    origin = F.when(F.col("quality").isNotNull(), F.lit(None)).when(third == 0, logic.FABRICATION).when(third == 1, "unknown").otherwise("report")
    manual = (F.coalesce("toxic", F.lit(0)) == 1) & (F.col("quality") == 0)
    return joined.select(F.col("doc_id").alias("name"), (F.col("quality") == 1).alias("verified"), manual.alias("manual"), origin.cast("string").alias("origin"))


@query(f"""WITH {SOURCES}, i AS (SELECT name, unnest([CASE WHEN verified IS NOT NULL AND NOT verified AND NOT coalesce(manual, false) THEN 'unverified' END,
 CASE WHEN origin = 'report' THEN 'no_evidence' END, CASE WHEN manual THEN 'manually_verified' END, CASE WHEN origin = 'potential fabrication' THEN 'potential_fabrication' END]) AS item FROM sources)
 SELECT name, item FROM i WHERE item IS NOT NULL""")
def consistency_items(spark, sf_dir):
    return logic.evidence_items(_sources(spark, sf_dir))


BAD = "bad AS (SELECT name FROM sources WHERE NOT (coalesce(verified, false) OR coalesce(manual, false) OR (verified IS NULL AND coalesce(origin, '') <> 'potential fabrication')))"
USED = "used AS (SELECT c_custkey AS name, unnest([CAST(c_custkey % 97 AS BIGINT), CAST(c_custkey % 89 AS BIGINT), CAST(c_nationkey AS BIGINT)]) AS source FROM customer)"


def _derivations(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    using = F.array((F.col("c_custkey") % 97).cast("long"), (F.col("c_custkey") % 89).cast("long"), F.col("c_nationkey").cast("long"))
    return c.select(F.col("c_custkey").alias("name"), "c_acctbal", using.alias("using"))


@query(f"""WITH {SOURCES}, {BAD}, {USED}, u AS (SELECT DISTINCT name FROM used WHERE source IN (SELECT name FROM bad))
 SELECT c_custkey AS name, c_acctbal > 0 AS holds, CASE WHEN NOT c_acctbal > 0 THEN 'does not hold' WHEN u.name IS NOT NULL THEN 'potential fabrication' ELSE 'derived' END AS origin
 FROM customer LEFT JOIN u ON u.name = c_custkey""")
def derive_holds(spark, sf_dir):
    d = _derivations(spark, sf_dir)
    return logic.derive(d, F.col("c_acctbal") > 0, d, _sources(spark, sf_dir)).select("name", "holds", "origin")


def _graph(spark, sf_dir):
    t = lambda n: _table(spark, sf_dir, n)
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    edges = (
        t("nation").select(k("r", "n_regionkey").alias("src"), k("n", "n_nationkey").alias("dst"))
        .unionAll(t("customer").select(k("n", "c_nationkey"), k("c", "c_custkey")))
        .unionAll(t("orders").select(k("c", "o_custkey"), k("o", "o_orderkey")))
    )
    node = lambda n, p, key, kind, v: t(n).select(k(p, key).alias("name"), F.lit(kind).alias("kind"), F.col(v).alias("value"))
    nodes = (
        node("region", "r", "r_regionkey", "axiom", "r_name")
        .unionAll(node("nation", "n", "n_nationkey", "term-fwd", "n_name"))
        .unionAll(node("customer", "c", "c_custkey", "fact", "c_name"))
        .unionAll(node("orders", "o", "o_orderkey", "calc", "o_orderstatus"))
    )
    return nodes, edges


def _one(spark, name):
    return spark.createDataFrame([(name,)], "name string")


def _long_depth(df):
    return df.select("name", F.col("depth").cast("long").alias("depth"))


@query(CLOSURE.format(seed="'r0'", to="edges.dst", frm="edges.src"))
def taint_closure(spark, sf_dir):
    return _long_depth(logic.taint(_graph(spark, sf_dir)[1], _one(spark, "r0")))


@query(CLOSURE.format(seed="'n3'", to="edges.dst", frm="edges.src") + " HAVING min(depth) > 0")
def dependents_closure(spark, sf_dir):
    return _long_depth(logic.dependents(_graph(spark, sf_dir)[1], _one(spark, "n3")))


@query(CLOSURE.format(seed="'c7'", to="edges.src", frm="edges.dst"))
def using_visibility(spark, sf_dir):
    return _long_depth(logic.visible(_graph(spark, sf_dir)[1], _one(spark, "c7")))


@query(CLOSURE.format(seed="'c7'", to="edges.src", frm="edges.dst"))
def subgraph_up(spark, sf_dir):
    return _long_depth(G.subgraph(_graph(spark, sf_dir)[1], _one(spark, "c7"), "upstream"))


@query(CLOSURE.format(seed="'n1'", to="edges.dst", frm="edges.src"))
def subgraph_down(spark, sf_dir):
    return _long_depth(G.subgraph(_graph(spark, sf_dir)[1], _one(spark, "n1"), "downstream"))


@query(
    "WITH RECURSIVE " + EDGES + ", d AS (SELECT 'n1' AS name, 0 AS depth UNION SELECT dst, depth + 1 FROM d JOIN edges ON src = name), u AS (SELECT 'n1' AS name, 0 AS depth UNION SELECT src, depth + 1 FROM u JOIN edges ON dst = name)"
    " SELECT name, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT * FROM d UNION ALL SELECT * FROM u) GROUP BY name"
)
def subgraph_both(spark, sf_dir):
    return _long_depth(G.subgraph(_graph(spark, sf_dir)[1], _one(spark, "n1"), "both"))


DEPTHS = "WITH RECURSIVE " + EDGES + ", d AS (SELECT name, 0 AS depth FROM nodes WHERE name NOT IN (SELECT dst FROM edges) UNION SELECT dst, depth + 1 FROM d JOIN edges ON src = name), depths AS (SELECT name, max(depth) AS depth FROM d GROUP BY name)"


@query(DEPTHS + " SELECT name, CAST(depth AS BIGINT) AS depth FROM depths")
def graph_depth(spark, sf_dir):
    return _long_depth(G.depths(*_graph(spark, sf_dir)))


@query(DEPTHS + """ SELECT CASE WHEN kind IN ('axiom', 'term-fwd') THEN 'declare' WHEN b.depth - a.depth = 1 THEN 'use' ELSE 'pull' END AS input_type, count(*) AS n
 FROM edges JOIN nodes ON nodes.name = src JOIN depths a ON a.name = src JOIN depths b ON b.name = dst GROUP BY 1""")
def input_classes(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.input_classes(nodes, edges, G.depths(nodes, edges)).groupBy("input_type").agg(F.count(F.lit(1)).alias("n"))


@query(DEPTHS + " SELECT CAST(CASE WHEN kind IN ('axiom', 'term-fwd') THEN 0 ELSE depth END AS BIGINT) AS layer, count(*) AS n FROM nodes JOIN depths USING (name) GROUP BY 1")
def graph_layers(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.layers(nodes, edges, G.depths(nodes, edges)).groupBy(F.col("layer").cast("long").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS base, l_extendedprice * (1 - (l_discount + 0.01)) AS other FROM lineitem")
def diff_scenarios(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    got = logic.scenarios(rows, {"base": {"d": F.col("l_discount")}, "other": {"d": F.col("l_discount") + F.lit(0.01)}}, lambda b: price * (1 - b["d"]))
    return got.select("l_orderkey", "l_linenumber", "base", "other")


@query("SELECT CASE WHEN l_discount <> least(l_discount, 0.05) THEN 'value_divergent' ELSE 'same' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def diff_classify(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").withColumn("capped", F.least("l_discount", F.lit(0.05)))
    return rows.select(logic.diff_flags("l_discount", "capped").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS name FROM documents ANTI JOIN labels USING (doc_id)")
def danglings(spark, sf_dir):
    names = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))
    return logic.danglings(names, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name")))


@query("WITH " + EDGES + " SELECT name FROM nodes WHERE name NOT IN (SELECT src FROM edges)")
def roots(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return logic.roots(nodes.select("name"), edges)


@query(f"WITH {SOURCES} SELECT name, origin AS item, coalesce(source || ':' || lang, '?') AS loc FROM sources LEFT JOIN (SELECT doc_id, source, lang FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = name WHERE origin IS NOT NULL")
def located_issues(spark, sf_dir):
    items = _sources(spark, sf_dir).where("origin is not null").select("name", F.col("origin").alias("item"))
    half = _table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    places = half.select(F.col("doc_id").alias("name"), F.col("source").alias("file"), F.col("lang").alias("line"))
    return logic.located(items, places).select("name", "item", "loc")


# --- graph views and health ---


@query("WITH " + EDGES + " SELECT kind, count(*) AS n, min(name) AS first, max(name) AS last FROM nodes GROUP BY kind")
def kinds(spark, sf_dir):
    return G.kinds(_graph(spark, sf_dir)[0])


@query("""SELECT n_name AS name, CASE WHEN lower(n_name) = 'n_1' THEN 0 WHEN ends_with(lower(n_name), 'n_1') THEN 1 WHEN starts_with(lower(n_name), 'n_1') THEN 2 ELSE 3 END AS score
 FROM nation WHERE contains(lower(n_name), 'n_1') ORDER BY score, length(name), name LIMIT 10""")
def fuzzy_names(spark, sf_dir):
    return G.fuzzy(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "n_1", 10)


@query("SELECT c_name AS name FROM customer WHERE regexp_matches(c_name, '[37]7$') ORDER BY c_name LIMIT 50")
def find_names(spark, sf_dir):
    return G.find(_table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "[37]7$", 50)


def _items(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    category = F.when(F.col("value") > 50, "issue").when(F.col("value") > 10, "warning").otherwise("dangling")
    name = F.concat(F.lit("u"), "user_id", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(".e"), F.col("event_id") % 7)))
    loc = F.concat(F.lit("f"), F.col("event_id") % 5, F.lit(".pltg:"), F.col("event_id") % 100)
    kind = F.when(F.col("event_id") % 2 == 0, "fact").otherwise("term-comp")
    return e.select(name.alias("name"), category.alias("category"), F.col("event_type").alias("type"), kind.alias("kind"), loc.alias("loc"), F.col("event_id").cast("string").alias("detail"))


@query(f"""WITH {ITEMS}, f AS (SELECT category, type, kind, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE '_root' END AS ns, regexp_replace(loc, ':[^:]*$', '') AS file FROM items)
 SELECT 'category' AS dimension, category AS value, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'kind', kind, count(*) FROM f GROUP BY ALL
 UNION ALL SELECT 'namespace', ns, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'file', file, count(*) FROM f GROUP BY ALL""")
def stats_grouping_sets(spark, sf_dir):
    return G.stats(_items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT category, type, kind, count(*) AS n FROM items GROUP BY ALL")
def health_summary(spark, sf_dir):
    return G.summary(_items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT name, detail FROM items WHERE category = 'issue' AND contains(kind, 'term') AND starts_with(name, 'u1')")
def health_filter(spark, sf_dir):
    return G.select_items(_items(spark, sf_dir), category="issue", kind="term", prefix="u1").select("name", "detail")


@query(f"WITH {ITEMS}, n AS (SELECT DISTINCT CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE '_root' END AS ns FROM items) SELECT string_agg(ns, ', ' ORDER BY ns) AS namespaces FROM n")
def ns_list(spark, sf_dir):
    return G.namespaces(_items(spark, sf_dir))


@query(f"""WITH {ITEMS}, p AS (SELECT DISTINCT name FROM items WHERE name LIKE 'u1%'), old AS (SELECT * FROM items WHERE CAST(detail AS INTEGER) % 3 <> 0), fresh AS (SELECT * FROM items WHERE CAST(detail AS INTEGER) % 3 = 0 AND name IN (FROM p))
 SELECT name, detail FROM old WHERE type NOT IN ('click') AND name NOT IN (FROM p) UNION ALL SELECT name, detail FROM fresh""")
def incremental_merge(spark, sf_dir):
    items = _items(spark, sf_dir)
    patched = items.where("name like 'u1%'").select("name").distinct()
    third = F.col("detail").cast("int") % 3 == 0
    return G.incremental(items.where(~third), patched, items.where(third).join(patched, "name", "left_semi").select(*items.columns), ("click",)).select("name", "detail")


LENSES = """g AS (SELECT c_custkey AS name, c_mktsegment AS kind, c_name AS value, unnest(CASE WHEN c_custkey % 3 = 0 THEN [0, 1, 2] WHEN c_custkey % 3 = 1 THEN [0, 2] ELSE [1] END) AS lens_id FROM customer),
s AS (SELECT name, any_value(value) AS value, list_sort(list(lens_id)) AS lenses FROM g GROUP BY name)"""


def _lenses(spark, sf_dir):
    k = F.col("c_custkey") % 3
    where = F.when(k == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(k == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1)))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("value"), F.explode(where).alias("lens_id"))


@query(f"WITH {LENSES} SELECT name, value FROM s WHERE len(lenses) < 3")
def holo_divergent(spark, sf_dir):
    return G.divergent(_lenses(spark, sf_dir), 3).select("name", "value")


@query(f"WITH {LENSES} SELECT name, value FROM s WHERE len(lenses) = 3")
def holo_common(spark, sf_dir):
    return G.common(_lenses(spark, sf_dir), 3).select("name", "value")


@query(f"WITH {LENSES} SELECT name, value FROM s WHERE lenses = [1]")
def holo_only(spark, sf_dir):
    return G.only(_lenses(spark, sf_dir), 1).select("name", "value")


@query("""SELECT coalesce(a.name, b.name) AS name, a.value AS "left", b.value AS "right" FROM (SELECT l_orderkey AS name, sum(l_quantity) AS value FROM lineitem GROUP BY 1) a
 FULL JOIN (SELECT o_orderkey AS name, round(o_totalprice / 1000) AS value FROM orders WHERE o_orderkey % 2 = 0) b USING (name) WHERE a.value IS DISTINCT FROM b.value""")
def side_by_side(spark, sf_dir):
    a = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.sum("l_quantity").alias("value"))
    b = _table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("name"), F.round(F.col("o_totalprice") / 1000).alias("value"))
    return G.side_by_side(a, b, "divergence")


# --- forms ---


def _all_forms(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.lit("ln").alias("tag"), F.col("c_name").alias("name"), F.col("c_custkey").alias("value"))


def _forms(spark, sf_dir):
    n = _all_forms(spark, sf_dir)
    return n.where("value % 2 = 0"), n.where("value % 3 = 0")


@query("SELECT c_name AS name, c_custkey AS value FROM customer WHERE c_custkey % 6 = 0")
def and_forms(spark, sf_dir):
    return forms.and_forms(*_forms(spark, sf_dir)).select("name", "value")


@query("SELECT c_name AS name, c_custkey AS value FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def not_forms(spark, sf_dir):
    return forms.not_forms(*_forms(spark, sf_dir)).select("name", "value")


@query("SELECT c_name AS name, c_custkey AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name, c_custkey FROM customer WHERE c_custkey % 3 = 0")
def or_forms(spark, sf_dir):
    return forms.or_forms(*_forms(spark, sf_dir)).select("name", "value")


# --- functions and expressions ---

STATUS = "CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 0 THEN 'hallucinated' ELSE 'exemplifiable' END"


@query(f"""WITH s AS (SELECT source, {STATUS} AS st FROM documents LEFT JOIN labels USING (doc_id))
 SELECT source, CASE WHEN bool_or(st = 'hallucinated') THEN 'hallucinated' WHEN bool_or(st = 'unknown') THEN 'unknown' ELSE 'exemplifiable' END AS joint, count(*) FILTER (st = 'hallucinated') AS n_hallucinated FROM s GROUP BY source""")
def joint_status(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    st = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 0, "hallucinated").otherwise("exemplifiable")
    return d.groupBy("source").agg(A.status_name(F.max(A.status_rank(st))).alias("joint"), F.count_if(st == "hallucinated").alias("n_hallucinated"))


ARR = "[p_size, p_size % 7, p_size % 3]"


@query(f"""SELECT p_partkey, CAST(len(list_filter({ARR}, lambda x: x <> 0)) AS BIGINT) AS n_exist, CAST(list_sum({ARR}) AS BIGINT) AS total, CAST(list_sum(list_transform({ARR}, lambda x: x * 2)) AS BIGINT) AS doubled,
 CAST({ARR}[2] AS BIGINT) AS second, CAST(list_reverse({ARR})[1] AS BIGINT) AS last, len(list_filter({ARR}, lambda x: x > 0)) = 3 AS all_pos, len(list_filter({ARR}, lambda x: x > 40)) > 0 AS any_big, len(list_filter({ARR}, lambda x: x = 5)) = 0 AS none_five, list_contains({ARR}, 1) AS has_one FROM part""")
def array_functions(spark, sf_dir):
    xs = F.array("p_size", F.col("p_size") % 7, F.col("p_size") % 3)
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        A.count_exists(xs).cast("long").alias("n_exist"),
        A.sum_values(xs, "bigint").alias("total"),
        A.fold(lambda a, x: a + x, F.lit(0).cast("bigint"), A.map_array(lambda x: (x * 2).cast("bigint"), xs)).alias("doubled"),
        A.nth(xs, 1).cast("long").alias("second"),
        A.nth(A.reverse(xs), 0).cast("long").alias("last"),
        A.all_true(lambda x: x > 0, xs).alias("all_pos"),
        A.any_true(lambda x: x > 40, xs).alias("any_big"),
        A.none_true(lambda x: x == 5, xs).alias("none_five"),
        A.member(F.lit(1), xs).alias("has_one"),
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def member_semi(spark, sf_dir):
    big = _table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) / 7 AS ratio, CAST((-o_orderkey) - (-3) * floor(CAST(-o_orderkey AS DOUBLE) / -3) AS BIGINT) AS m, o_totalprice >= 1000 AND o_orderstatus = 'F' AS both, NOT (o_orderkey % 2 = 0) OR o_totalprice > 50000 AS implied FROM orders")
def scalar_ops(spark, sf_dir):
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        S.divide(k, F.lit(7)).alias("ratio"),
        S.mod(-k, F.lit(-3)).cast("long").alias("m"),
        S.all_of([F.col("o_totalprice") >= 1000, F.col("o_orderstatus") == "F"]).alias("both"),
        S.implies(k % 2 == 0, F.col("o_totalprice") > 50000).alias("implied"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END AS price, l_returnflag = 'A' AND l_quantity > 10 AS flagged FROM lineitem")
def compiled_expression(spark, sf_dir):
    rules = Rules()
    rules.add("(= (net ?p ?d) (* ?p (- 1 ?d)))")
    rows = _table(spark, sf_dir, "lineitem")
    c = Compiler.of(rows, rules=rules)
    price = c.compile("(let ((q l_quantity)) (if (> q 25) (net l_extendedprice l_discount) l_extendedprice))")
    return rows.select("l_orderkey", "l_linenumber", price.alias("price"), c.compile('(and (= l_returnflag "A") (> l_quantity 10))').alias("flagged"))


@query("SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders")
def project_scalar(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    totals = System(spark, rows=o.agg(F.avg("o_totalprice").alias("mean")))
    return System(spark, rows=o, scopes={"totals": totals}).select({"above": "(> o_totalprice (project totals mean))"}, keep=("o_orderkey",))


# --- integrity and sources ---


@query(f"WITH RECURSIVE {CHAIN} SELECT conv_id, n, hash FROM chain")
def hash_chain(spark, sf_dir):
    return I.build_chains(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "n", "hash")


@query("SELECT conv_id, turn AS n, CASE WHEN turn < 2 THEN 'valid' WHEN turn = 2 THEN 'invalid' ELSE 'stale' END AS status FROM conversations")
def chain_status(spark, sf_dir):
    made = I.build_chains(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    spoilt = made.withColumn("content", F.when(F.col("n") == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return I.check_chains(spoilt, "conv_id")


MERKLE = """l0 AS (SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, sha256(text) AS hash FROM conversations)"""


def _merkle_sql(levels: int) -> str:
    steps = [
        f"l{i} AS (SELECT key, pos // 2 AS pos, CASE WHEN max(CASE WHEN pos % 2 = 1 THEN hash END) IS NULL THEN max(CASE WHEN pos % 2 = 0 THEN hash END)"
        f" ELSE sha256(max(CASE WHEN pos % 2 = 0 THEN hash END) || max(CASE WHEN pos % 2 = 1 THEN hash END)) END AS hash FROM l{i - 1} GROUP BY ALL)"
        for i in range(1, levels + 1)
    ]
    return f"WITH {MERKLE}, {', '.join(steps)} SELECT key AS conv_id, hash AS root FROM l{levels}"


@query(_merkle_sql(10))
def merkle_root(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("content"))
    return I.roots(I.merkle(c, "conv_id"), "conv_id")


@query("SELECT conv_id, turn AS pos, CASE WHEN turn % 5 = 4 THEN 'removed' ELSE 'modified' END AS change FROM conversations WHERE turn % 5 = 4 OR turn % 3 = 1")
def merkle_diff(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("content"))
    leaf = lambda d: d.select("conv_id", "pos", F.sha2("content", 256).alias("hash"))
    new = c.where("pos % 5 <> 4").withColumn("content", F.when(F.col("pos") % 3 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return I.diff_leaves(leaf(c), leaf(new), "conv_id")


@query("SELECT doc_id AS doc, CASE WHEN doc_id % 10 = 0 THEN 'deleted' WHEN doc_id % 10 = 1 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def manifest_diff(spark, sf_dir):
    docs, last = _docs(spark, sf_dir), F.col("doc") % 10
    new = docs.where(last != 0).withColumn("text", F.when(last == 2, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return D.manifest_diff(D.manifest(docs.where(last != 1)), D.manifest(new))


@query("""WITH r AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name FROM pages)
 SELECT page_id AS doc, name, CASE WHEN p.url IS NULL THEN 'not found: ' || name END AS error FROM r LEFT JOIN (SELECT DISTINCT url FROM pages) p ON p.url = name""")
def ref_resolve(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    marked = pages.select(F.col("page_id").alias("doc"), F.regexp_replace("html", 'href="([^"]*)"', "[[fact:$1]]").alias("text"))
    catalog = pages.select(F.lit("fact").alias("type"), F.col("url").alias("name"), F.col("url").alias("value")).distinct()
    return R.resolve(R.extract(marked), catalog).select("doc", "name", "error")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40")
def history_page(spark, sf_dir):
    runs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return D.history_page(runs, 20, 40)


# --- more of the search page, the lens and the sources ---


@query(f"""WITH {THE} SELECT doc, line FROM b ORDER BY line % 3 <> 0, CASE WHEN line % 3 = 0 THEN -1.0 / (line % 5 + 1) ELSE 0 END, CASE WHEN line % 3 = 0 THEN -(line % 4 + 1) ELSE 0 END, doc, line
 LIMIT greatest(30, (SELECT count(*) - 30 FROM b))""")
def coverage_rank(spark, sf_dir):
    hits = _phrase(spark, sf_dir, "tion").withColumn("ord", F.struct("doc", "line"))
    names = hits.where("line % 3 = 0").select("doc", "line", F.explode(F.sequence(F.lit(0), F.col("line") % 4)).alias("k"))
    callers = names.select("doc", "line", F.concat(F.lit("f"), "k").alias("name"), (F.lit(1.0) / (F.col("line") % 5 + 1)).alias("overlap"))
    ranked = search.rank("coverage", search.with_callers(hits, callers))
    return _key(search.limit(max(30, hits.count() - 30), ranked))


@query(f"WITH {THE}, t AS (SELECT doc, line FROM b WHERE line % 2 = 0) SELECT (SELECT count(*) FROM b) AS rows, (SELECT count(DISTINCT doc % 7) FROM t) AS callers")
def search_totals(spark, sf_dir):
    hits = _phrase(spark, sf_dir, "tion")
    callers = hits.where("line % 2 = 0").select("doc", "line", F.concat(F.lit("f"), F.col("doc") % 7).alias("name"), F.lit(1.0).alias("overlap"))
    return search.totals(search.with_callers(hits, callers))


@query(f"WITH {THE} SELECT doc, line FROM a ORDER BY CAST(doc AS VARCHAR), line LIMIT greatest(0, (SELECT count(*) FROM a) - 5)")
def limit_negative(spark, sf_dir):
    return _key(search.limit(-5, _phrase(spark, sf_dir, "ing and")))


@query(f"WITH {THE} SELECT 'sr' AS tag, doc, line, context FROM a")
def result_forms(spark, sf_dir):
    return search.results(_phrase(spark, sf_dir, "ing and")).select("form.tag", "form.doc", "form.line", "form.context")


@query(f"WITH {THE} SELECT 'sr' AS tag, CAST(doc AS VARCHAR) || ':' || line AS key FROM a UNION ALL SELECT 'ln', c_name FROM customer")
def form_keys(spark, sf_dir):
    sr = forms.tagged(_phrase(spark, sf_dir, "ing and"), "sr")
    ln = _table(spark, sf_dir, "customer").select(F.lit("ln").alias("tag"), F.col("c_name").alias("name"))
    both = forms.mixed(sr, ln)
    return both.select("tag", forms.form_key(both).alias("key"))


@query("SELECT count(*) AS n FROM customer")
def count_forms(spark, sf_dir):
    return forms.count_forms(_all_forms(spark, sf_dir))


@query("SELECT c_name AS name FROM customer ORDER BY c_custkey LIMIT 7")
def limit_forms(spark, sf_dir):
    return forms.limit_forms(7, _all_forms(spark, sf_dir), "value").select("name")


@query("WITH " + EDGES + " SELECT name, kind FROM nodes WHERE contains(kind, 'term')")
def lens_kind(spark, sf_dir):
    return G.kind(_graph(spark, sf_dir)[0], "term").select("name", "kind")


@query("WITH " + EDGES + " SELECT 'in' AS side, src AS name FROM edges WHERE dst = 'c9' UNION ALL SELECT 'out', dst FROM edges WHERE src = 'c9'")
def lens_neighbours(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return G.inputs(edges, "c9").select(F.lit("in").alias("side"), "name").unionAll(G.downstream(edges, "c9").select(F.lit("out").alias("side"), "name"))


@query("WITH " + EDGES + " SELECT name, value FROM nodes WHERE starts_with(name, 'n1')")
def lens_focus(spark, sf_dir):
    return G.focus(_graph(spark, sf_dir)[0], "n1").select("name", "value")


@query("WITH " + EDGES + " SELECT name, value FROM nodes WHERE name = 'r2'")
def lens_node(spark, sf_dir):
    return G.node(_graph(spark, sf_dir)[0], "r2").select("name", "value")


@query(DEPTHS + " SELECT CAST(coalesce(max(depth), -1) AS INTEGER) AS depth FROM depths WHERE name = 'o1'")
def lens_depth(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.depth_of(G.depths(nodes, edges), "o1")


@query(DEPTHS + " SELECT name FROM depths WHERE depth = 1")
def lens_layer(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.depths(nodes, edges).where("depth = 1").select("name")


@query(DEPTHS + """ SELECT src AS name, CAST(max(b.depth) AS BIGINT) AS depth FROM edges JOIN nodes ON nodes.name = src JOIN depths a ON a.name = src JOIN depths b ON b.name = dst
 WHERE kind NOT IN ('axiom', 'term-fwd') AND b.depth - a.depth = 1 GROUP BY src""")
def last_use_depth(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    depth = G.depths(nodes, edges)
    return _long_depth(G.last_use(G.input_classes(nodes, edges, depth), depth))


@query("WITH RECURSIVE " + EDGES + ", u AS (SELECT 'n2' AS name UNION SELECT src FROM u JOIN edges ON dst = name), d AS (SELECT 'n2' AS name UNION SELECT dst FROM d JOIN edges ON src = name), k AS (FROM u UNION FROM d) SELECT src, dst FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)")
def localize_edges(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.localize(nodes, edges, _one(spark, "n2"))[1]


@query("WITH " + EDGES + " SELECT name, CASE WHEN name LIKE 'o%' THEN value || '!' ELSE value END AS value FROM nodes WHERE name NOT LIKE 'o%' OR name IN (SELECT dst FROM edges WHERE src = 'c1') UNION ALL SELECT name, value FROM nodes WHERE name LIKE 'o%' AND name NOT IN (SELECT dst FROM edges WHERE src = 'c1')")
def partial_reprobe(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    fresh = nodes.withColumn("value", F.when(F.startswith("name", F.lit("o")), F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return G.reprobe(nodes, edges, fresh, _one(spark, "c1")).select("name", "value")


@query(f"WITH {ITEMS} SELECT count(*) FILTER (category = 'issue') = 0 AS consistent FROM items WHERE value IS NULL".replace(" WHERE value IS NULL", ""))
def health_consistent(spark, sf_dir):
    return G.consistent(_items(spark, sf_dir))


@query("SELECT conv_id, count(*) AS blocks, min(turn) FILTER (turn = 2) IS NULL AS clean, min(turn) FILTER (turn = 2) AS break_point FROM conversations GROUP BY conv_id")
def chain_breaks(spark, sf_dir):
    made = I.build_chains(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    spoilt = made.withColumn("content", F.when(F.col("n") == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    checked = I.check_chains(spoilt, "conv_id")
    return I.clean(checked, "conv_id").join(checked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks")), "conv_id")


@query("SELECT key AS conv_id, count(*) AS verified FROM (SELECT conv_id AS key, turn FROM conversations WHERE turn = 1) GROUP BY key")
def merkle_proofs(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("content"))
    tree = I.merkle(c, "conv_id")
    steps = I.proof(tree, "conv_id", 1).groupBy("conv_id").agg(F.collect_list(F.struct("level", "hash", "left")).alias("steps"))
    leaf = c.where("pos = 1").join(steps, "conv_id").join(I.roots(tree, "conv_id"), "conv_id")
    return leaf.where(I.verify_proof(F.col("content"), F.col("steps")) == F.col("root")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("verified"))


@query("WITH d AS (SELECT source, doc_id FROM documents UNION ALL SELECT source, doc_id FROM documents WHERE doc_id % 7 = 0) SELECT source AS k, doc_id AS n, count(*) AS times FROM d GROUP BY ALL HAVING count(*) > 1")
def duplicate_blocks(spark, sf_dir):
    blocks = _table(spark, sf_dir, "documents").select(F.col("source").alias("k"), F.col("doc_id").alias("n"))
    return I.duplicates(blocks.unionAll(blocks.where("n % 7 = 0")), "k")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'done' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0")
def history_merge(spark, sf_dir):
    runs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    gone = runs.where("id % 5 = 0").withColumn("op", F.lit("delete"))
    put = runs.where("id % 5 = 1").select("id", F.lit("done").alias("status"), F.lit("put").alias("op"))
    return D.history_apply(runs, gone.unionByName(put))


@query(r"""WITH w AS (SELECT doc_id AS doc, unnest(string_split(CASE WHEN doc_id % 10 = 2 THEN text || ' zz' ELSE text END, ' ')) AS word FROM documents WHERE doc_id % 10 <> 0) SELECT doc, count(*) AS n FROM w GROUP BY doc""")
def reindex_incremental(spark, sf_dir):
    docs, last = _docs(spark, sf_dir), F.col("doc") % 10
    new = docs.where(last != 0).withColumn("text", F.when(last == 2, F.concat("text", F.lit(" zz"))).otherwise(F.col("text")))
    index = lambda d: d.select("doc", F.explode(F.split("text", " ")).alias("word"))
    old = docs.where(last != 1)
    return D.reindex(index(old), D.manifest(old), new, index).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS doc FROM documents WHERE NOT regexp_matches(source, '^src1') AND source <> 'src3'")
def ignore_rules(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit("data"), "source", F.concat(F.col("doc_id"), F.lit(".txt")))
    return d.where(~D.ignored(path, ["src1*", "src3/"])).select(F.col("doc_id").alias("doc"))


@query("SELECT doc_id AS name, typeof(quality) AS vtype FROM labels".replace("typeof(quality)", "'int'"))
def blinded_state(spark, sf_dir):
    facts = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), "quality", F.typeof("quality").alias("vtype"))
    return logic.blinded(facts)


@query("SELECT doc_id AS doc, count(*) AS copies FROM documents GROUP BY doc_id")
def deduplicated_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return Q.deduplicated(docs.unionAll(docs)).groupBy("doc").agg(F.count(F.lit(1)).alias("copies"))


def _others() -> None:
    from . import catalogue_programs, catalogue_sources  # noqa: F401  they register their queries here


def queries() -> dict[str, Query]:
    _others()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _others()
    return dict(_sql)
