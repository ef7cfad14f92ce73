"""Secret scanning with multipart credential linking, in DataFrame operations only.

Three kinds are secrets by themselves (the base): `assign`, a named secret with its value, `access`, an
access identifier, and `hex`, a long hexadecimal run. Three more are weak: a bare 40-character key, a login
name and an endpoint look like much ordinary text. They are reported only where a part that complements
them stands within SCOPE code points in the same document: a key or an endpoint near an access identifier,
a login or an endpoint near an assigned secret.

Spark's regular expressions give matched strings but no places. A text is therefore also split by the same
pattern: the lengths of the pieces between, and of the matches, add up to the places (one window over the
matches of one document). Only documents with a match of a base kind go on, since a weak part needs one.
Linking is an interval join: parts are dealt to buckets of SCOPE code points, a strong part also to the
neighbouring buckets that its scope touches, and joined on document and bucket; a document with many parts
is spread over its buckets, and a bucket holds no more parts than fit in SCOPE code points.

Results for odd input: null text is the empty text, without spans; repeated rows, and rows with equal or
null doc_id, are told apart by a row number taken once, before the table is stored; an empty table stays
empty; places count code points; columns of any other name stay untouched in `redacted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import stored

SCOPE = 256
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kind -> (pattern, its group that must be long enough, least length). Runs as short as the least length
#: are asked for in the pattern where that can't move a match: a run is one match or none.
BASE = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "login": (r"(?i)\b(?:user|username|login|account)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9._@-]{3,}", 0, 3),
    "endpoint": (r"\b(?:https?|jdbc:[a-z0-9]+|s3|ftp|ssh)://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![A-Za-z0-9.-])[a-z0-9.-]+\.amazonaws\.com\b", 0, 3),
}
COMPLEMENTS = {"key": ["access"], "login": ["assign"], "endpoint": ["access", "assign"]}
KINDS = [*BASE, *WEAK]
NAMED = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Array of (before, long, value): length of what precedes each match since the last one, of the match,
    and of its group."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("m"), value.alias("v"))
    return F.transform(
        zipped, lambda x: F.struct(F.length(x["b"]).alias("before"), F.length(x["m"]).alias("long"), F.length(x["v"]).alias("value"))
    )


def suspicious(text: Column) -> Column:
    """Whether a base kind may occur: documents without are not looked at again."""
    text = F.coalesce(text, F.lit(""))
    return text.rlike(NAMED) | text.rlike(BASE["access"][0]) | text.rlike(BASE["hex"][0])


def _spans(hits: DataFrame) -> DataFrame:
    """hits (uid, text): uid, kind (its number in KINDS), start, end of every candidate."""
    each = []
    for k, (pattern, group, _) in enumerate({**BASE, **WEAK}.values()):
        each.append(F.struct(F.lit(k).alias("kind"), _matches(F.col("text"), pattern, group).alias("matches")))
    found = hits.select("uid", F.explode(F.array(*each)).alias("k")).select("uid", "k.kind", F.posexplode("k.matches").alias("i", "m"))
    so_far = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.before") + F.col("m.long")).over(so_far)
    least = F.lit(0)
    for k, (_, _, n) in enumerate({**BASE, **WEAK}.values()):
        least = F.when(F.col("kind") == k, n).otherwise(least)
    return found.select("uid", "kind", (end - F.col("m.long")).alias("start"), end.alias("end"), "m.value").where(F.col("value") >= least).drop("value")


def _linked(spans: DataFrame) -> DataFrame:
    """The weak spans with a complementary part in scope."""
    base = len(BASE)
    bucket = lambda c: F.floor(c / SCOPE).cast("long")
    pairs = F.array(*[F.struct(F.lit(KINDS.index(w)).alias("weak"), F.lit(KINDS.index(s)).alias("strong")) for w, s_ in COMPLEMENTS.items() for s in s_])
    strong = (
        spans.where(F.col("kind") < base)
        .select("uid", F.col("kind").alias("s_kind"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
        .withColumn("pair", F.explode(pairs))
        .where(F.col("pair.strong") == F.col("s_kind"))
        .withColumn("bucket", F.explode(F.sequence(bucket(F.col("s_start") - SCOPE), bucket(F.col("s_end") + SCOPE))))
        .select(F.col("uid").alias("s_uid"), F.col("pair.weak").alias("s_weak"), F.col("bucket").alias("s_bucket"), "s_start", "s_end")
    )
    # A long weak span may begin far before the scope of a part that follows it: it goes to all its buckets.
    weak = spans.where(F.col("kind") >= base).withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    near = (
        (F.col("uid") == F.col("s_uid"))
        & (F.col("bucket") == F.col("s_bucket"))
        & (F.col("kind") == F.col("s_weak"))
        & (F.col("start") <= F.col("s_end") + SCOPE)
        & (F.col("s_start") <= F.col("end") + SCOPE)
    )
    return weak.join(strong, near, "left_semi").drop("bucket").distinct()


def find_spans(hits: DataFrame) -> DataFrame:
    """hits (uid, text) -> uid, kind, start, end of all reported spans, base and linked."""
    candidates = stored(_spans(hits), "secret-parts")
    return candidates.where(F.col("kind") < len(BASE)).unionByName(_linked(candidates))


def _hits(docs: DataFrame, columns: list[Column], text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*columns, F.when(suspicious(F.col(text_col)), text).alias("text"), F.monotonically_increasing_id().alias("uid"))


def _names(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    rows = stored(_hits(docs, [F.col(id_col).alias("doc_id")], text_col), "secret-rows")
    spans = find_spans(rows.where(F.col("text").isNotNull()).select("uid", "text"))
    listed = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", _names(x["kind"]), x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long")
    digests = listed.select(
        "uid",
        F.col("spans").alias("all"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    ).select(
        "uid",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        "base_sha256",
        "spans",
        F.size(F.filter("all", lambda x: x["kind"] >= len(BASE))).cast("long").alias("n_linked"),
    )
    zero = F.lit(0).cast("long")
    filled = lambda d: [
        "doc_id",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.coalesce(F.col("base_sha256"), F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce(F.col("spans"), F.lit("")).alias("spans"),
        F.coalesce(F.col("n_linked"), zero).alias("n_linked"),
    ]
    return rows.select("uid", "doc_id").join(digests, "uid", "left").select(*filled(None))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each reported span, or run of overlapping spans, replaced by [SECRET]; n_chars, if there is
    such a column, follows the text. Rows and other columns stay as they are."""
    suspect = F.coalesce(suspicious(F.col(text_col)), F.lit(False))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stored(docs.where(suspect).select(whole, F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid")), "secret-hits")
    spans = find_spans(rows.select("uid", "text"))
    before = Window.partitionBy("uid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    runs = spans.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0))).groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "done"))).alias("runs"), F.max("end").alias("last")
    )
    text = F.col("text")
    pieces = F.transform(
        "runs",
        lambda x: F.when(
            (x["start"] >= x["done"]),
            F.concat(F.substring(text, (x["done"] + 1).cast("int"), (x["start"] - x["done"]).cast("int")), F.lit("[SECRET]")),
        ).otherwise(F.lit("")),
    )
    masked = F.concat(F.array_join(pieces, ""), F.substring(text, (F.col("last") + 1).cast("int"), F.length(text)))
    changed = rows.join(runs, "uid", "left").withColumn("new", F.when(F.col("runs").isNotNull(), masked).otherwise(text))
    own = lambda c: F.col("row").getField(c)
    out = [
        F.col("new").alias(c) if c == text_col else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else own(c).alias(c)
        for c in docs.columns
    ]
    return docs.where(~suspect).unionByName(changed.select(*out))
