"""The algebra over posting sets (S5-S24): semi and anti joins by (doc, line), band joins, ranks, limits.

A band join is an equi-join on document and line bucket: lines are cut into buckets as wide as the band, so
a hot document is spread over its buckets and a line meets only three of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gneiss.sources.documents import glob_regex

from .lines import CALLERS, as_posting

KEY = ["doc", "line"]


def and_(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Keys in all; rows of the first."""
    return reduce(lambda a, b: a.join(b.select(*KEY).distinct(), KEY, "left_semi"), others, first)


def or_(*sets: DataFrame) -> DataFrame:
    """Keys in any; the last set's row, at the place of the first. One aggregation by key, no window."""
    marked = [s.withColumn("set", F.lit(i)) for i, s in enumerate(sets)]
    union = reduce(DataFrame.unionByName, marked)
    payload = F.struct("column", "context", "callers", "total_callers")
    picked = union.groupBy(*KEY).agg(F.max_by(payload, F.col("set")).alias("p"), F.min(F.struct("set", "ord")).alias("o"))
    return picked.select(*KEY, "p.*", F.col("o.ord").alias("ord"), F.col("o.set").alias("set_ord"))


def not_(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Keys of the first that are in no other."""
    return reduce(lambda a, b: a.join(b.select(*KEY), KEY, "left_anti"), others, first)


def in_document(posting: DataFrame, pattern: str) -> DataFrame:
    """A glob on the document, or its name or the end of its path. A filter that reaches the scan."""
    doc = F.col("doc").cast("string")
    if "*" in pattern or "?" in pattern:
        return posting.where(doc.rlike(glob_regex(pattern)))
    return posting.where((doc == pattern) | doc.endswith("/" + pattern))


def count(posting: DataFrame) -> DataFrame:
    """S10."""
    return posting.agg(F.count(F.lit(1)).alias("n"))


def near(a: DataFrame, b: DataFrame, distance: int = 5) -> DataFrame:
    """Rows of a with a row of b in the same document at most `distance` lines away."""
    width = max(1, distance)
    there = b.select(F.col("doc").alias("b_doc"), F.col("line").alias("b_line")).distinct()
    around = F.explode(F.array(*[F.floor(F.col("b_line") / width) + i for i in (-1, 0, 1)])).alias("bucket")
    there = there.select("b_doc", "b_line", around)
    here = a.withColumn("a_bucket", F.floor(F.col("line") / width))
    close = (F.col("doc") == F.col("b_doc")) & (F.col("a_bucket") == F.col("bucket")) & (F.abs(F.col("line") - F.col("b_line")) <= distance)
    return here.join(there, close, "left_semi").drop("a_bucket")


def seq(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a before the last row of b in the same document."""
    last = b.groupBy("doc").agg(F.max("line").alias("last"))
    return a.join(last, "doc").where(F.col("line") < F.col("last")).select(*a.columns)


def line_range(posting: DataFrame, start: int, end: int) -> DataFrame:
    """S14."""
    return posting.where(F.col("line").between(start, end))


def around(posting: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """The matches with the lines before and after them; lines that were no match have no callers."""
    wanted = (
        posting.select("doc", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"))
        .where(F.col("line") > 0)
        .distinct()
        .join(posting.select(*KEY), KEY, "left_anti")
    )
    return posting.drop("set_ord").unionByName(as_posting(lines.join(wanted, KEY, "left_semi")))


def context(n: int, posting: DataFrame, lines: DataFrame) -> DataFrame:
    return around(posting, lines, n, n)


def before(n: int, posting: DataFrame, lines: DataFrame) -> DataFrame:
    return around(posting, lines, n, 0)


def after(n: int, posting: DataFrame, lines: DataFrame) -> DataFrame:
    return around(posting, lines, 0, n)


def _best() -> Column:
    return F.coalesce(F.array_max(F.transform("callers", lambda c: c["overlap"])), F.lit(0.0))


def rank(strategy: str, posting: DataFrame) -> DataFrame:
    """S19-S22, as a new `ord`: sorting happens once, when rows are limited or shown."""
    traced = F.when(F.col("total_callers") > 0, 0).otherwise(1).alias("traced")
    if strategy == "callers":
        order = F.struct(traced, (-F.col("total_callers")).alias("callers"), (-_best()).alias("overlap"), F.col("ord").alias("was"))
    elif strategy == "coverage":
        order = F.struct(traced, (-_best()).alias("overlap"), (-F.col("total_callers")).alias("callers"), F.col("ord").alias("was"))
    elif strategy == "document":
        hits = posting.groupBy("doc").agg(F.count(F.lit(1)).alias("hits"), F.min("ord").alias("first"))
        posting = posting.join(hits, "doc")
        order = F.struct((-F.col("hits")).alias("hits"), F.col("first"), (-F.col("total_callers")).alias("callers"), F.col("line").alias("at"))
    elif strategy == "line":
        order = F.struct("doc", "line")
    else:
        return posting
    return posting.withColumn("ord", order).drop("hits", "first")


def limit(n: int, posting: DataFrame, offset: int = 0) -> DataFrame:
    """The first n in order, as a top-k; a negative n leaves that many out at the end."""
    if n >= 0:
        page = posting.orderBy("ord")
        return (page.offset(offset) if offset else page).limit(n)
    # Without the last -n rows: a top-k from the other end, taken out by key.
    return posting.join(posting.orderBy(F.desc("ord")).limit(-n).select(*KEY), KEY, "left_anti")


def totals(posting: DataFrame) -> DataFrame:
    """Rows, and distinct callers over all of them."""
    names = posting.select(F.explode("callers.name").alias("name")).agg(F.count_distinct("name").alias("callers"))
    return posting.agg(F.count(F.lit(1)).alias("rows")).crossJoin(names)  # two rows of one


def results(posting: DataFrame) -> DataFrame:
    """Tagged forms."""
    form = F.struct(F.lit("sr").alias("tag"), "doc", "line", "column", "context", "callers")
    return posting.select(form.alias("form"), "ord")


def trace(hits: DataFrame, ranges: DataFrame, bin_width: int = 4096) -> DataFrame:
    """Hits (doc, start, end) with the quote ranges (doc, start, end, caller) that they overlap, and the
    share of the hit that is covered. Ranges are dealt to bins of bin_width, so a large document is spread."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / bin_width), F.floor(e / bin_width)))
    left = hits.select("doc", "start", "end", bins(F.col("start"), F.col("end")).alias("bin"))
    right = ranges.select(F.col("doc").alias("r_doc"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "caller", bins(F.col("start"), F.col("end")).alias("r_bin"))
    both = left.join(right, (F.col("doc") == F.col("r_doc")) & (F.col("bin") == F.col("r_bin")) & (F.col("r_start") < F.col("end")) & (F.col("start") < F.col("r_end")))
    covered = F.least("end", "r_end") - F.greatest("start", "r_start")
    share = F.round(covered / (F.col("end") - F.col("start")), 3)
    # A pair that shares several bins is reported in the bin where the overlap begins.
    once = F.col("bin") == F.floor(F.greatest("start", "r_start") / bin_width)
    return both.where(once).select("doc", "start", "end", "caller", share.alias("overlap"))


def with_callers(posting: DataFrame, callers: DataFrame) -> DataFrame:
    """Postings with their callers (doc, line, name, overlap), the best first; each name counts once."""
    best = callers.groupBy(*KEY, "name").agg(F.max("overlap").alias("overlap"))
    listed = best.groupBy(*KEY).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("overlap")).alias("o"), "name"))),
            lambda c: F.struct(c["name"].alias("name"), (-c["o"]).alias("overlap")),
        ).alias("callers")
    )
    bare = posting.drop("callers", "total_callers").join(listed, KEY, "left")
    filled = F.coalesce("callers", F.array().cast(CALLERS))
    return bare.withColumn("callers", filled).withColumn("total_callers", F.size("callers"))
