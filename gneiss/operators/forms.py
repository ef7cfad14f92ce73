"""Tagged forms and set algebra by their keys.

A form is a row with a tag and the fields of that tag; rows of several tags are one table in which absent fields are
null. A tag may be qualified by modules: library.lens.ln is ln."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .lines import CALLERS, as_posting

#: tag -> its fields. Lists of several tags are unions in which absent fields are null.
TAGS = {
    "sr": ("doc", "line", "column", "context", "callers"),
    "ln": ("name", "kind", "value", "depth", "inputs"),
    "dx": ("name", "category", "kind", "type", "detail"),
    "hn": ("name", "kind", "value", "lenses"),
}
#: The names under which a query language offers the operators.
ALIASES = {"or": "or-forms", "and": "and-forms", "not": "not-forms", "count": "count-forms", "limit": "limit-forms"}


def base_tag(tag: Column) -> Column:
    return F.substring_index(tag, ".", -1)


def tagged(rows: DataFrame, tag: str) -> DataFrame:
    return rows.select(F.lit(tag).alias("tag"), *[F.col(c) for c in TAGS[tag]])


def mixed(*forms: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), forms)


def forms_of(posting: DataFrame) -> DataFrame:
    """A posting as sr forms."""
    return tagged(posting, "sr")


def posting_of(forms: DataFrame) -> DataFrame:
    """Forms as a posting: sr forms as they were, others as line 1 of a document of their name, with their
    value, or kind and detail, as its text."""
    has = set(forms.columns)
    col = lambda name, kind: F.col(name).cast(kind) if name in has else F.lit(None).cast(kind)
    is_sr = base_tag(F.col("tag")) == "sr"
    said = F.coalesce(col("value", "string"), F.concat_ws(" ", col("category", "string"), col("kind", "string"), col("type", "string"), col("detail", "string")))
    rows = forms.select(
        F.when(is_sr, col("doc", "string")).otherwise(col("name", "string")).alias("doc"),
        F.when(is_sr, col("line", "long")).otherwise(1).alias("line"),
        F.when(is_sr, col("context", "string")).otherwise(said).alias("context"),
        F.coalesce(col("column", "int"), F.lit(1)).alias("at"),
        F.coalesce(col("callers", CALLERS), F.array().cast(CALLERS)).alias("named"),
    )
    once = rows.groupBy("doc", "line").agg(F.max(F.struct("context", "at", "named")).alias("p")).select("doc", "line", "p.*")
    posting = as_posting(once, F.col("at"))
    callers = once.select(F.col("doc").alias("c_doc"), F.col("line").alias("c_line"), F.col("named"))
    joined = posting.drop("callers", "total_callers").join(callers, (F.col("doc") == F.col("c_doc")) & (F.col("line") == F.col("c_line")))
    return joined.withColumn("callers", F.col("named")).withColumn("total_callers", F.size("named")).select(*posting.columns)


def field_of(forms: DataFrame, tag: str, name: str) -> DataFrame:
    """(value) of a field of the forms with that tag."""
    if name not in TAGS[tag]:
        raise NameError(f"{tag} has no {name}")
    return forms.where(base_tag(F.col("tag")) == tag).select(F.col(name).alias("value"))


def display(forms: DataFrame, perspective: str) -> DataFrame:
    """Display forms: the tag becomes TAG-fmt, a perspective is carried along, and the column of a line goes."""
    shown = forms.drop("column").withColumn("tag", F.concat(base_tag(F.col("tag")), F.lit("-fmt")))
    return shown.withColumn("perspective", F.lit(perspective))


def form_key(forms: DataFrame) -> Column:
    """A name, or document and line."""
    has = set(forms.columns)
    line = F.concat_ws(":", F.col("doc").cast("string"), F.col("line").cast("string")) if {"doc", "line"} <= has else F.lit(None).cast("string")
    name = F.col("name").cast("string") if "name" in has else F.lit(None).cast("string")
    return F.when(base_tag(F.col("tag")) == "sr", line).otherwise(name)


def keys(forms: DataFrame) -> DataFrame:
    """S29."""
    return forms.select(form_key(forms).alias("key"))


def has_key(forms: DataFrame, key: str) -> DataFrame:
    """One row, whether a form has that key."""
    return forms.agg(F.coalesce(F.bool_or(form_key(forms) == key), F.lit(False)).alias("found"))


def and_forms(a: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of a, repeated ones too, whose key is in all others."""
    return reduce(lambda x, y: x.withColumn("key", form_key(x)).join(keys(y).distinct(), "key", "left_semi").drop("key"), others, a)


def not_forms(a: DataFrame, *others: DataFrame) -> DataFrame:
    """S31."""
    return reduce(lambda x, y: x.withColumn("key", form_key(x)).join(keys(y).distinct(), "key", "left_anti").drop("key"), others, a)


def or_forms(*forms: DataFrame) -> DataFrame:
    """A bag; nothing is dropped."""
    return mixed(*forms)


def count_forms(a: DataFrame) -> DataFrame:
    return a.agg(F.count(F.lit(1)).alias("n"))


def limit_forms(n: int, a: DataFrame, order: str | Column = "ord") -> DataFrame:
    return a.orderBy(order).limit(n)
