"""Provenance graphs (G1-G40): closures, depth, layers, health tables, comparison of several graphs.

nodes (name, kind, value), edges (src, dst): src is an input of dst. Closures go frontier by frontier: each round
joins only the nodes found last and drops those already seen, which lie in one folder of the shared store, a
part for each depth. So diamonds don't multiply paths, and a lost executor costs one round. Query texts over graphs
and health tables are in gneiss.plans.views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gneiss.sources.shared import new_path, stored, written

KINDS = ("fact", "axiom", "theorem", "calc", "term-fwd", "term-comp", "synthetic")


def _rounds(edges: DataFrame, seeds: DataFrame, once: bool, nodes: DataFrame | None = None) -> DataFrame:
    """(name, depth) by rounds from the seeds: with `once` a name only at the first depth that it is found at. With
    nodes, more rounds than there are nodes are an error."""
    spark = edges.sparkSession
    edges, most = stored(edges.select("src", "dst")), None
    folder = new_path(spark, "closure")
    schema = T.StructType([T.StructField("name", seeds.schema["name"].dataType), T.StructField("depth", T.IntegerType())])
    found, n = written(seeds.select("name").distinct(), f"{folder}/depth=0"), 0
    while found:
        n += 1
        if nodes is not None and n > 16:  # few graphs are so deep that their nodes must be counted
            most = most or nodes.count()
            if n > most:
                raise ValueError("the graph has a cycle")
        seen = spark.read.schema(schema).parquet(folder)
        step = seen.where(F.col("depth") == n - 1).join(edges, F.col("name") == F.col("src")).select(F.col("dst").alias("name")).distinct()
        if once:
            step = step.join(seen.select("name"), "name", "left_anti")
        found = written(step, f"{folder}/depth={n}")
    return spark.read.schema(schema).parquet(folder)


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(name, depth): all that edges lead to from the seeds (name), by the least number of steps."""
    return _rounds(edges, seeds, once=True)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def subgraph(edges: DataFrame, name: DataFrame, direction: str) -> DataFrame:
    """Upstream (inputs), downstream, or both."""
    if direction == "downstream":
        return closure(edges, name)
    up = closure(reversed_edges(edges), name)
    if direction == "upstream":
        return up
    return up.unionByName(closure(edges, name)).groupBy("name").agg(F.min("depth").alias("depth"))


def localize(nodes: DataFrame, edges: DataFrame, name: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of a graph around a node, all that it rests on and all that rests on it, with its edges."""
    near = stored(subgraph(edges, name, "both").select("name"))
    inside = edges.join(near.withColumnRenamed("name", "src"), "src", "left_semi").join(near.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return nodes.join(near, "name", "left_semi"), inside.select("src", "dst")


def settled_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G2 with the bump: of nodes at one depth over 0, one whose set of fact inputs strictly holds another's (the
    empty set too) moves a level down, until none does; then nodes move below all their inputs.

    What is compared are the distinct sets of a depth. A set meets only those that hold its rarest fact, and an
    empty one is a mark on its depth, so a fact that many nodes use doesn't bring all of them together."""
    edges = stored(edges.select("src", "dst").distinct())
    facts = edges.join(nodes.where("kind = 'fact'").select(F.col("name").alias("src")), "src", "left_semi")
    held = stored(facts.groupBy(F.col("dst").alias("name")).agg(F.sort_array(F.collect_set("src")).alias("facts")))
    none = F.array().cast(held.schema["facts"].dataType)
    now = stored(depths(nodes, edges).join(held, "name", "left").select("name", "depth", F.coalesce("facts", none).alias("facts")))
    while True:
        sets = stored(now.where("depth > 0").select("depth", "facts").distinct())
        each = sets.where(F.size("facts") > 0).select("depth", "facts", F.explode("facts").alias("fact"))
        often = each.groupBy("depth", "fact").agg(F.count(F.lit(1)).alias("n"))
        rarest = each.join(often, ["depth", "fact"]).groupBy("depth", "facts").agg(F.min(F.struct("n", "fact"))["fact"].alias("fact"))
        inner = rarest.select("depth", "fact", F.col("facts").alias("inside"))
        smaller = (F.size("inside") < F.size("facts")) & (F.size(F.array_except("inside", "facts")) == 0)
        bumped = each.join(inner, ["depth", "fact"]).where(smaller).select("depth", "facts")
        empty = sets.where(F.size("facts") == 0).select("depth")
        bumped = stored(bumped.unionByName(sets.where(F.size("facts") > 0).join(empty, "depth", "left_semi")).distinct())
        if bumped.isEmpty():
            break
        more = bumped.withColumn("more", F.lit(1))
        now = stored(now.join(more, ["depth", "facts"], "left").select("name", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "facts"))
    now = now.select("name", "depth")
    while True:
        below = edges.join(now.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg((F.max("depth") + 1).alias("least"))
        later = stored(now.join(below, "name", "left").select("name", F.greatest("depth", F.coalesce("least", F.lit(0))).alias("depth"), (F.col("least") > F.col("depth")).alias("moved")))
        now = later.select("name", "depth")
        if later.where("moved").isEmpty():
            return now


def reprobe(old_nodes: DataFrame, edges: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes again after a change: those that the changed names reach come from `fresh`, the others stay."""
    reached = stored(closure(edges, changed).select("name"))
    return old_nodes.join(reached, "name", "left_anti").unionByName(fresh.join(reached, "name", "left_semi"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, depth), the longest path from a node without inputs."""
    leaves = nodes.select("name").join(edges.select(F.col("dst").alias("name")).distinct(), "name", "left_anti")
    return _rounds(edges, leaves, once=False, nodes=nodes).groupBy("name").agg(F.max("depth").alias("depth"))


def input_classes(nodes: DataFrame, edges: DataFrame, depth: DataFrame) -> DataFrame:
    """Each edge as declare (an axiom or forward term), use (from the layer below) or pull (from deeper)."""
    kind = nodes.select(F.col("name").alias("src"), "kind")
    near = depth.select(F.col("name").alias("src"), F.col("depth").alias("src_depth"))
    far = depth.select(F.col("name").alias("dst"), F.col("depth").alias("dst_depth"))
    named = edges.join(kind, "src").join(near, "src").join(far, "dst")
    how = F.when(F.col("kind").isin("axiom", "term-fwd"), "declare").when(F.col("dst_depth") - F.col("src_depth") == 1, "use").otherwise("pull")
    return named.select("src", "dst", how.alias("input_type"))


def last_use(classes: DataFrame, depth: DataFrame) -> DataFrame:
    """For each input, the greatest depth at which it is used."""
    far = depth.select(F.col("name").alias("dst"), "depth")
    return classes.where("input_type = 'use'").join(far, "dst").groupBy(F.col("src").alias("name")).agg(F.max("depth").alias("depth"))


def layers(nodes: DataFrame, edges: DataFrame, depth: DataFrame) -> DataFrame:
    """Axioms and forward terms, and computed terms used at several depths, lie in layer 0."""
    used = edges.join(depth.withColumnRenamed("name", "dst"), "dst").groupBy(F.col("src").alias("name")).agg(F.count_distinct("depth").alias("at"))
    joined = nodes.join(depth, "name").join(used, "name", "left")
    root = F.col("kind").isin("axiom", "term-fwd") | ((F.col("kind") == "term-comp") & (F.coalesce("at", F.lit(0)) > 1))
    return joined.select("name", "kind", F.when(root, 0).otherwise(F.col("depth")).alias("layer"))


def in_order(nodes: DataFrame, depth: DataFrame) -> DataFrame:
    """Nodes with their depth, inputs before what rests on them: sorted by depth, then name."""
    return nodes.join(depth, "name").orderBy("depth", "name")


def consumer(edges: DataFrame, classes: DataFrame, name: str, *types: str) -> DataFrame:
    """The inputs of a node with their class, of some classes only if any are named."""
    own = classes.where(F.col("dst") == name).join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    return (own.where(F.col("input_type").isin(*types)) if types else own).select(F.col("src").alias("name"), "input_type")


# --- lens ---------------------------------------------------------------------------------------------


def node(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def kind(nodes: DataFrame, part: str) -> DataFrame:
    """By a part of the kind's name."""
    return nodes.where(F.contains("kind", F.lit(part)))


def inputs(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("dst") == name).select(F.col("src").alias("name"))


def downstream(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("src") == name).select(F.col("dst").alias("name"))


def focus(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.startswith("name", F.lit(prefix)))


def depth_of(depth: DataFrame, name: str) -> DataFrame:
    """-1 if absent."""
    return depth.where(F.col("name") == name).agg(F.coalesce(F.max("depth"), F.lit(-1)).alias("depth"))


def find(nodes: DataFrame, pattern: str, most: int = 50) -> DataFrame:
    """Names that hold a pattern, sorted."""
    return nodes.where(F.col("name").rlike(pattern)).select("name").distinct().orderBy("name").limit(most)


def fuzzy(nodes: DataFrame, text: str, most: int = 10) -> DataFrame:
    """Names that contain a text in any case; equal ones, then ends, then beginnings, then shorter names."""
    low, q = F.lower("name"), text.lower()
    score = F.when(low == q, 0).when(F.endswith(low, F.lit(q)), 1).when(F.startswith(low, F.lit(q)), 2).otherwise(3)
    return nodes.where(F.contains(low, F.lit(q))).select("name", score.alias("score")).distinct().orderBy("score", F.length("name"), "name").limit(most)


def kinds(nodes: DataFrame) -> DataFrame:
    """How many nodes of each kind."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


# --- health items (name, category, type, kind, loc, detail) ---------------------------------------------


def namespace(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", 1)).otherwise("_root")


def file_of(loc: Column) -> Column:
    return F.when(F.contains(loc, F.lit(":")), F.regexp_replace(loc, ":[^:]*$", "")).otherwise(loc)


def select_items(items: DataFrame, category: str | None = None, kind: str | None = None, type: str | None = None, prefix: str | None = None) -> DataFrame:
    """Equal category, part of the kind, part of the type, beginning of the name."""
    for on, test in (
        (category, F.col("category") == category),
        (kind, F.contains("kind", F.lit(kind))),
        (type, F.contains("type", F.lit(type))),
        (prefix, F.startswith("name", F.lit(prefix))),
    ):
        items = items.where(test) if on is not None else items
    return items


def suggestions(items: DataFrame, column: str, asked: str, most: int = 10) -> DataFrame:
    """What a filter that found nothing may have meant: values that share their first three letters with it, or
    all values if none does, sorted."""
    values = items.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    first, asked = F.substring("value", 1, 3), asked.rstrip(".")
    near = F.contains(F.col("value"), F.lit(asked[:3])) | F.contains(F.lit(asked), first)
    marked = values.withColumn("near", near)
    any_near = marked.agg(F.coalesce(F.bool_or("near"), F.lit(False)).alias("some"))
    return marked.crossJoin(any_near).where(F.col("near") | ~F.col("some")).select("value").orderBy("value").limit(most)  # one row beside the values


def report(errors: DataFrame, issues: DataFrame, warnings: DataFrame, danglings: DataFrame, places: DataFrame) -> DataFrame:
    """One table of health items. errors: (name, status, cause, kind, loc) of a load; issues and warnings:
    (name, item); danglings: (name); places: (name, kind, loc) of the program's entries."""
    loader = errors.select("name", F.lit("loader").alias("category"), F.col("status").alias("type"), "kind", "loc", F.col("cause").alias("detail"))
    placed = lambda df, category, type_: (
        df.join(places, "name", "left").select("name", F.lit(category).alias("category"), type_.alias("type"), "kind", F.coalesce("loc", F.lit("?")).alias("loc"), type_.alias("detail"))
    )
    return (
        loader.unionByName(placed(issues, "issue", F.col("item")))
        .unionByName(placed(warnings, "warning", F.col("item")))
        .unionByName(placed(danglings, "dangling", F.lit("dangling")))
    )


def consistent(items: DataFrame) -> DataFrame:
    return items.agg((F.count_if(F.col("category") == "issue") == 0).alias("consistent"))


def namespaces(items: DataFrame) -> DataFrame:
    """Sorted distinct namespaces as one text."""
    spaces = items.select(namespace(F.col("name")).alias("ns")).distinct()
    return spaces.agg(F.array_join(F.sort_array(F.collect_list("ns")), ", ").alias("namespaces"))


def stats(items: DataFrame) -> DataFrame:
    """Five counts in one pass, by grouping sets: (dimension, value, n)."""
    names = ("category", "type", "kind", "namespace", "file")
    facts = items.select("category", "type", "kind", namespace(F.col("name")).alias("namespace"), file_of(F.col("loc")).alias("file"))
    grouped = facts.groupingSets([[F.col(n)] for n in names], *names).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    which, value = F.lit(names[-1]), F.col(names[-1])
    for i, n in enumerate(names[:-1]):
        one = F.col("g") == 31 - (1 << (4 - i))
        which, value = F.when(one, n).otherwise(which), F.when(one, F.col(n)).otherwise(value)
    return grouped.select(which.alias("dimension"), value.alias("value"), "n")


def summary(items: DataFrame) -> DataFrame:
    """G29."""
    return items.groupBy("category", "type", "kind").agg(F.count(F.lit(1)).alias("n"))


def incremental(items: DataFrame, patched: DataFrame, fresh: DataFrame, evidence_types: tuple[str, ...] = ("unverified", "no_evidence")) -> DataFrame:
    """Items of the patched names and of evidence are replaced by fresh ones."""
    kept = items.where(~F.col("type").isin(*evidence_types)).join(patched.select("name"), "name", "left_anti")
    return kept.unionByName(fresh)


def focused(items: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The items of a namespace, and whether no issue is left among them."""
    own = select_items(items, prefix=prefix)
    return own, consistent(own)


# --- several graphs, told apart by lens_id ---------------------------------------------------------------


def in_lens(nodes: DataFrame, lens: int) -> DataFrame:
    return nodes.where(F.col("lens_id") == lens)


def together(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several graphs as one, each with the number of its graph as lens_id."""
    nodes = [n.select(F.lit(i).alias("lens_id"), "name", "kind", "value") for i, (n, _) in enumerate(graphs)]
    edges = [e.select(F.lit(i).alias("lens_id"), "src", "dst") for i, (_, e) in enumerate(graphs)]
    both = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(both(parts[1:]))
    return both(nodes), both(edges)


def first_of(nodes: DataFrame) -> DataFrame:
    """Each name once, as the first graph that has it says."""
    return _spread(nodes).select("name", "p.kind", "p.value", "lenses")


def _spread(nodes: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("kind", "value"), F.col("lens_id"))
    return nodes.groupBy("name").agg(F.sort_array(F.collect_set("lens_id")).alias("lenses"), first.alias("p"))


def divergent(nodes: DataFrame, lenses: int) -> DataFrame:
    """In some graphs but not in all; the first graph's payload."""
    return _spread(nodes).where(F.size("lenses") < lenses).select("name", "p.kind", "p.value", "lenses")


def common(nodes: DataFrame, lenses: int) -> DataFrame:
    """G33."""
    return _spread(nodes).where(F.size("lenses") == lenses).select("name", "p.kind", "p.value", "lenses")


def only(nodes: DataFrame, lens: int) -> DataFrame:
    """G34."""
    return _spread(nodes).where((F.size("lenses") == 1) & (F.get("lenses", F.lit(0)) == lens)).select("name", "p.kind", "p.value", "lenses")


def side_by_side(left: DataFrame, right: DataFrame, bias: str = "neutral") -> DataFrame:
    """(name, left, right) under a bias: neutral, left, right or divergence."""
    both = left.select("name", F.col("value").alias("left")).join(right.select("name", F.col("value").alias("right")), "name", "full")
    if bias == "left":
        return both.where(F.col("left").isNotNull())
    if bias == "right":
        return both.where(F.col("right").isNotNull())
    return both.where(~F.col("left").eqNullSafe(F.col("right"))) if bias == "divergence" else both
