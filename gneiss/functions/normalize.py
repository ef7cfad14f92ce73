"""Text normalisation for quote matching, as native column expressions.

Steps, in order: case, list markers, hyphenation, punctuation, stop words (if asked for), white space. Each
step is a regular expression over the whole text, so a document is normalised inside whole-stage codegen;
`staged` also returns the text after each step, from which the penalties of a match are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

# Thresholds, penalties, marks and words that decide a match.
CONFIDENCE_THRESHOLD, HIGH, MEDIUM = 0.7, 0.9, 0.7
PENALTIES = {
    "whitespace_normalization": 0.001,
    "whitespace_trimming": 0.001,
    "hyphenation_normalization": 0.005,
    "case_normalization": 0.01,
    "list_normalization": 0.01,
    "punctuation_removal": 0.02,
    "collapsed_space_match": 0.03,
    "stopword_removal": 0.125,
    "dangerous_stopword_removal": 0.31,
}
UNKNOWN_PENALTY = 0.1
#: Marks that always go; the point, the comma and the hyphen depend on what stands around them.
OTHER_MARKS = "[;:?'\"()\\[\\]{}…—–`\u2018\u2019\u201c\u201d\u00ab\u00bb\u00a0\u2007\u202f]"
STOPWORDS = (
    "a", "an", "the", "this", "that", "these", "those", "it", "its", "in", "on", "at", "to", "for", "with", "by", "of",
    "therefore", "and", "or", "but", "so", "as", "is", "are", "was", "were",
)
DANGEROUS = ("not", "no", "never", "none", "nor", "neither", "without", "except", "but", "however", "although", "despite")


@dataclass(frozen=True)
class Config:
    ignore_case: bool = True
    ignore_lists: bool = True
    ignore_hyphenation: bool = True
    ignore_punctuation: bool = True
    remove_stopwords: bool = False
    threshold: float = CONFIDENCE_THRESHOLD
    penalties: dict[str, float] = field(default_factory=lambda: dict(PENALTIES))
    stopwords: tuple[str, ...] = STOPWORDS
    dangerous: tuple[str, ...] = DANGEROUS
    high: float = HIGH
    medium: float = MEDIUM

    def overridden(self, **values: object) -> Config:
        """V8: with other values; penalties are added to those that there are."""
        if "penalties" in values:
            values["penalties"] = self.penalties | dict(values["penalties"])
        return replace(self, **values)

    def penalty(self, step: str) -> float:
        return self.penalties.get(step, UNKNOWN_PENALTY)


def lists(c: Column) -> Column:
    return F.regexp_replace(c, r"(?Umd)^([^\S\n]{2,}|)[12]?\d\.\s+", "$1 ")


def hyphenation(c: Column) -> Column:
    joined = F.regexp_replace(c, r"(?U)(?<=[\p{L}\p{N}])-\n\s*(?=[\p{L}\p{N}])", "")
    return F.regexp_replace(F.regexp_replace(joined, r"-\n(?=[\s\S])", " "), r"\n", " ")


def punctuation(c: Column) -> Column:
    dashes = F.regexp_replace(c, r"(?U)(?<![\p{L}\p{N}])-|-(?!\s*[\p{L}\p{N}])", " ")
    points = F.regexp_replace(dashes, r"(?<![\p{L}\p{N}])[,.]|[,.](?![\p{L}\p{N}])", " ")
    return F.regexp_replace(points, OTHER_MARKS, " ")


def whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stopwords(c: Column, words: tuple[str, ...]) -> Column:
    """Without stop words; a text of nothing else keeps its first word."""
    parts = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    kept = F.filter(parts, lambda w: ~w.isin(*words))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))


def staged(c: Column, config: Config = Config()) -> list[tuple[str, Column]]:
    """(step, text after it) in order."""
    out = []
    for name, on, step in (
        ("case_normalization", config.ignore_case, F.lower),
        ("list_normalization", config.ignore_lists, lists),
        ("hyphenation_normalization", config.ignore_hyphenation, hyphenation),
        ("punctuation_removal", config.ignore_punctuation, punctuation),
        ("stopword_removal", config.remove_stopwords, lambda x: stopwords(x, config.stopwords)),
        ("whitespace_normalization", True, whitespace),
    ):
        if on:
            c = step(c)
            out.append((name, c))
    return out


def normalized(c: Column, config: Config = Config()) -> Column:
    return staged(c, config)[-1][1]


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, " ", "")
