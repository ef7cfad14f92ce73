"""Documents as lines, and the scans over them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions.normalize import Config, normalized

from .quotes import normalized_with_places

#: A posting: one matched line. Operators keep these columns; ord carries the order that `limit` sees.
POSTING = ["doc", "line", "column", "context", "callers", "total_callers", "ord"]
CALLERS = "array<struct<name:string,overlap:double>>"


def lines_of(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line from 1, context): a row for each line; a line end at the very end begins no line."""
    split = F.split(F.col(text), "\n")
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(split).alias("i", "context"), F.size(split).alias("n"))
    return rows.where((F.col("i") < F.col("n") - 1) | (F.col("context") != "")).select("doc", (F.col("i") + 1).cast("long").alias("line"), "context")


def as_posting(rows: DataFrame, column: Column | None = None) -> DataFrame:
    """Rows (doc, line, context) without callers, in document and line order."""
    return rows.select(
        "doc",
        "line",
        (column if column is not None else F.lit(1)).cast("int").alias("column"),
        "context",
        F.array().cast(CALLERS).alias("callers"),
        F.lit(0).cast("int").alias("total_callers"),
        F.struct(F.col("doc").cast("string").alias("doc"), F.col("line").alias("line")).alias("ord"),
    )


def re_lines(docs: DataFrame, pattern: str, doc: str = "doc", text: str = "text") -> DataFrame:
    """Lines in which a regular expression is found."""
    return as_posting(lines_of(docs, doc, text).where(F.col("context").rlike(pattern)))


def occurrences(docs: DataFrame, phrase: str, doc: str = "doc", text: str = "text", config: Config = Config()) -> DataFrame:
    """S2 on normalised text: (doc, start, end) of every occurrence, overlapping ones too. The substring
    test prunes documents before places are counted."""
    norm = docs.select(F.col(doc).alias("doc"), normalized(F.col(text), config).alias("norm"))
    found = norm.where(F.contains("norm", F.lit(phrase)) & F.lit(phrase != ""))
    # Cut before every occurrence, overlapping ones too: where the pieces begin is where the phrase stands.
    pieces = F.split("norm", f"(?={re.escape(phrase)})")
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    begins = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
    starts = F.when(F.startswith("norm", F.lit(phrase)), begins).otherwise(F.slice(begins, F.lit(2), F.size(begins)))
    return found.select("doc", F.explode(starts).alias("start")).select("doc", "start", (F.col("start") + len(phrase)).alias("end"))


def phrase_lines(docs: DataFrame, phrase: str, doc: str = "doc", text: str = "text", ignore_case: bool = True) -> DataFrame:
    """Lines that hold a phrase literally within the line, with the column of its first place. Less than S2: see
    normal_phrase_lines."""
    needle = phrase.lower() if ignore_case else phrase
    low = F.lower if ignore_case else lambda c: c
    # Lines without the phrase go before rows are made of them.
    numbered = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.locate(needle, low(x)).alias("column"), x.alias("context")))
    hits = docs.select(F.col(doc).alias("doc"), F.explode(F.filter(numbered, lambda x: x["column"] > 0)).alias("l")).select("doc", "l.*")
    return as_posting(hits, F.col("column"))


def _letters(c: Column) -> Column:
    """The ASCII letters in lower case, with the one other character (the Kelvin sign) whose lower case is one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_replace(F.translate(c, upper + "\u212a", upper.lower() + "k"), "[^a-z]", "")


def phrase_hits(docs: DataFrame, phrase: str, doc: str = "doc", text: str = "text", most: int | None = None) -> DataFrame:
    """Every occurrence of the normalised phrase in the normalised document, over punctuation, white space,
    hyphenation and line ends, overlapping ones too: (doc, line, column, context, start, end), the last two in the
    normalised text. Normalisation leaves the order of letters as it is, so only documents that hold the letters of the
    phrase are looked at. With `most`, the first so many by document, line and column."""
    wanted = normalized_with_places(phrase)[0]
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.lit(wanted != ""))
    rows = rows.where(F.contains(_letters(F.col("text")), _letters(F.lit(wanted))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, t in zip(b["doc"], b["text"], strict=True):
                norm, at, _ = normalized_with_places(t)
                line, seen = 1, 0
                hit = norm.find(wanted)
                while hit >= 0:
                    place = at[hit]
                    line, seen = line + t.count("\n", seen, place), place
                    begin, end = t.rfind("\n", 0, place) + 1, t.find("\n", place)
                    out.append((name, line, place - begin + 1, t[begin : end if end >= 0 else len(t)], hit, hit + len(wanted)))
                    hit = norm.find(wanted, hit + 1)
            yield pd.DataFrame(out, columns=["doc", "line", "column", "context", "start", "end"])

    kind = rows.schema["doc"].dataType.simpleString()
    found = rows.mapInPandas(run, f"doc {kind}, line long, column int, context string, start long, end long")
    return found if most is None else found.orderBy("doc", "line", "column").limit(most)


def by_line(hits: DataFrame) -> DataFrame:
    """A posting of the lines in which hits begin, with the column of the first one there."""
    first = hits.groupBy("doc", "line").agg(F.min(F.struct("column", "context")).alias("h"))
    return as_posting(first.select("doc", "line", "h.column", "h.context"), F.col("column"))


def normal_phrase_lines(docs: DataFrame, phrase: str, doc: str = "doc", text: str = "text") -> DataFrame:
    """S2 as a posting."""
    return by_line(phrase_hits(docs, phrase, doc, text))


def word_postings(docs: DataFrame, doc: str = "doc", text: str = "text", config: Config = Config()) -> DataFrame:
    """S3: the inverted index: (doc, word, pos) of every token of the normalised text."""
    tokens = F.split(normalized(F.col(text), config), " ")
    return docs.select(F.col(doc).alias("doc"), F.posexplode(tokens).alias("pos", "word")).where(F.col("word") != "").select("doc", "word", "pos")


def word_frequency(docs: DataFrame, min_docs: int = 1, doc: str = "doc", text: str = "text", config: Config = Config()) -> DataFrame:
    """Words in at least min_docs documents, with their count. Counting by (word, document) first makes
    both sums partial aggregates; no distinct set of documents is held for a word."""
    tokens = F.split(normalized(F.col(text), config), " ")
    words = docs.select(F.col(doc).alias("doc"), F.explode(tokens).alias("word")).where(F.col("word") != "")
    each = words.groupBy("word", "doc").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
