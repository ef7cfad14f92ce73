"""The logic system's tables (L3-L21): grounding, taint, derivation, what-if diffs, consistency.

Stores are tables: sources (name, verified, manual, origin), derivations (name, using array), edges (src, dst:
dst mentions src). Each rule is a join or filter over them, computed afresh, so nothing goes stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .graph import closure

FABRICATION = "potential fabrication"


def grounded(verified: Column, manual: Column, origin: Column) -> Column:
    """A source with evidence is grounded if that is verified, by quotes or by hand; one with an origin text
    unless the text says that it may be fabricated."""
    return F.coalesce(verified, F.lit(False)) | F.coalesce(manual, F.lit(False)) | (verified.isNull() & ~F.coalesce(F.contains(origin, F.lit(FABRICATION)), F.lit(False)))


def ungrounded_sources(derivations: DataFrame, sources: DataFrame) -> DataFrame:
    """Name and the sorted direct sources that aren't grounded."""
    used = derivations.select("name", F.explode("using").alias("source"))
    bad = sources.where(~grounded(F.col("verified"), F.col("manual"), F.col("origin"))).select(F.col("name").alias("source"))
    return used.join(bad, "source").groupBy("name").agg(F.sort_array(F.collect_set("source")).alias("ungrounded"))


def derive(rows: DataFrame, holds: Column, derivations: DataFrame, sources: DataFrame) -> DataFrame:
    """Name, holds, ungrounded and origin of each theorem. holds: its truth on the row of its values."""
    bad = ungrounded_sources(derivations, sources)
    truth = F.coalesce(holds, F.lit(False))
    origin = F.when(~truth, "does not hold").when(F.col("ungrounded").isNotNull(), FABRICATION).otherwise("derived")
    return rows.withColumn("holds", truth).join(bad, "name", "left").withColumn("origin", origin)


def taint(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Everything that an ungrounded source reaches, with the least number of steps."""
    return closure(edges, seeds)


def dependents(edges: DataFrame, names: DataFrame) -> DataFrame:
    """What depends on the names, without them."""
    return closure(edges, names).where(F.col("depth") > 0)


def visible(edges: DataFrame, using: DataFrame) -> DataFrame:
    """L3: names that a derivation may see: all that its `using` names mention, again and again."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), using)


def scenarios(rows: DataFrame, bindings: dict[str, dict[str, Column]], expression: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """One expression under several bindings of its names, side by side: a column for each scenario, in
    one pass over the rows and without a join."""
    return rows.select("*", *[expression(b).alias(name) for name, b in bindings.items()])


def diff_flags(base: str, other: str, dependents_diverge: Column | None = None) -> Column:
    """What a diff shows."""
    differ = ~F.col(base).eqNullSafe(F.col(other))
    if dependents_diverge is not None:
        return F.when(dependents_diverge, "downstream_divergent").when(differ, "value_divergent").otherwise("same")
    return F.when(differ, "value_divergent").otherwise("same")


def evidence_items(sources: DataFrame) -> DataFrame:
    """(name, item) for unverified, no_evidence, manually_verified and potential_fabrication. Origins
    `unknown` and `derived` aren't asked for evidence. One pass over the sources."""
    has = F.col("verified").isNotNull()
    plain = F.col("origin").isNotNull() & ~F.col("origin").isin("unknown", "derived")
    said = F.coalesce(F.contains("origin", F.lit(FABRICATION)), F.lit(False))
    manual = F.coalesce(F.col("manual"), F.lit(False))
    items = F.array_compact(
        F.array(
            F.when(has & ~F.col("verified") & ~manual, "unverified"),
            F.when(~has & plain & ~said & ~manual, "no_evidence"),
            F.when(manual, "manually_verified"),
            F.when(said, "potential_fabrication"),
        )
    )
    return sources.select("name", F.explode(items).alias("item"))


ISSUES = ("unverified", "no_evidence", "potential_fabrication", "downstream_divergent", "value_divergent")


def consistent(items: DataFrame) -> DataFrame:
    """Consistent unless an item is an issue; warnings don't count."""
    return items.agg(F.count_if(F.col("item").isin(*ISSUES)).alias("issues")).select((F.col("issues") == 0).alias("consistent"), "issues")


def located(items: DataFrame, places: DataFrame) -> DataFrame:
    """With file, line and kind where known."""
    return items.join(places, "name", "left").withColumn("loc", F.when(F.col("file").isNull(), "?").otherwise(F.concat_ws(":", "file", "line")))


def danglings(names: DataFrame, referenced: DataFrame) -> DataFrame:
    """Names that nothing refers to."""
    return names.join(referenced.select("name").distinct(), "name", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no input of another."""
    return nodes.join(edges.select(F.col("src").alias("name")).distinct(), "name", "left_anti")


def retract(tables: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """Every store without the names."""
    return {k: t.join(names, "name", "left_anti") for k, t in tables.items()}


def verify_manually(sources: DataFrame, names: DataFrame) -> DataFrame:
    """P12."""
    marked = names.select("name").distinct().withColumn("by_hand", F.lit(True))
    joined = sources.join(marked, "name", "left")
    return joined.withColumn("manual", F.coalesce("by_hand", "manual", F.lit(False))).drop("by_hand")


def blinded(facts: DataFrame) -> DataFrame:
    """Names and types, no values."""
    return facts.select("name", "vtype")


def contradictions(said: DataFrame) -> DataFrame:
    """(expression, names) of said (expression, name, value) with both truth values."""
    both = said.groupBy("expression").agg(F.bool_or("value").alias("yes"), F.bool_and("value").alias("all"), F.sort_array(F.collect_set("name")).alias("names"))
    return both.where(F.col("yes") & ~F.col("all")).select("expression", "names")


def resolve_values(names: DataFrame, *stores: DataFrame) -> DataFrame:
    """(name, value, store) of names by the first store (name, value) that has them, null where none does."""
    joined, value, which = names, F.lit(None), F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(stores))):
        joined = joined.join(s.select("name", F.col("value").alias(f"v{i}"), F.lit(True).alias(f"in{i}")), "name", "left")
        value = F.when(F.col(f"in{i}"), F.col(f"v{i}")).otherwise(value)
        which = F.when(F.col(f"in{i}"), F.lit(i)).otherwise(which)
    return joined.select("name", value.alias("value"), which.alias("store"))
