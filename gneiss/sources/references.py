"""References in text: [[type:name]] marks, resolved against a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MARK = r"\[\[(\w+):([^\]]+)\]\]"
TYPES = ("fact", "term", "axiom", "theorem", "quote", "diff")


def extract(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, type, name), each once for a document."""
    both = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(MARK), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(MARK), F.lit(2)).alias("n")
    )
    return docs.select(F.col(doc).alias("doc"), F.explode(both).alias("r")).select("doc", F.col("r.t").alias("type"), F.col("r.n").alias("name")).distinct()


def resolve(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """With the value of the catalog (type, name, value) and an error where there is none."""
    known = catalog.select("type", "name", "value")
    error = F.when(~F.col("type").isin(*TYPES), F.concat(F.lit("unknown type: "), "type")).when(
        F.col("value").isNull(), F.concat(F.lit("not found: "), "name")
    )
    return references.join(known, ["type", "name"], "left").withColumn("error", error)


def rewrite(text: Column, style: str = "$2") -> Column:
    """The text with each mark replaced, $1 standing for its type and $2 for its name."""
    return F.regexp_replace(text, MARK, style)
