"""Quote verification (V9-V16): which quotes stand in which documents, and how surely.

A quote must hold a token of its document, so pairs are found by an equi-join on the quote's rarest word
(by document count): no quote is tried on every document. `verify_named` is for quotes that name their
document. Original places and scores come from Python over matched pairs only, document by document, so that a text
is normalised once for all of its quotes. Ranges of verified quotes can be kept (`register_ranges`); searches then
tell who quotes what they find."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions import normalize as N
from gneiss.sources.shared import stored


def prepared(docs: DataFrame, doc: str = "doc", text: str = "text", config: N.Config = N.Config()) -> DataFrame:
    norm = N.normalized(F.col(text), config)
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), norm.alias("norm"))


def exact(norm: Column, quote: Column) -> Column:
    """V9: the quote at token boundaries of the normalised text."""
    return F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.concat(F.lit(" "), quote, F.lit(" ")))


def collapsed(norm: Column, quote: Column) -> Column:
    return F.contains(N.collapsed(norm), N.collapsed(quote))


def strategy(norm: Column, quote: Column) -> Column:
    return F.when(quote == "", "none").when(exact(norm, quote), "exact").when(collapsed(norm, quote), "collapsed").otherwise("none")


def rejected(quote: Column, config: N.Config = N.Config()) -> Column:
    """Why a quote can't be looked for, or null."""
    norm = N.normalized(quote, config)
    reason = F.when(F.trim(quote) == "", "empty quote").when(norm == "", "nothing left after normalisation")
    if config.remove_stopwords:
        reason = reason.when(F.lower(F.trim(quote)).isin(*config.stopwords), "a stop word alone")
    return reason


def verify_named(docs: DataFrame, quotes: DataFrame, config: N.Config = N.Config()) -> DataFrame:
    """Quotes (doc, quote, caller) against the document that they name. Unregistered documents give no row."""
    have = prepared(docs, config=config)
    asked = quotes.withColumn("q", N.normalized(F.col("quote"), config)).withColumn("reason", rejected(F.col("quote"), config))
    return have.join(asked, "doc").withColumn("strategy", F.when(F.col("reason").isNull(), strategy(F.col("norm"), F.col("q"))).otherwise("none"))


def register_ranges(checked: DataFrame) -> DataFrame:
    """(doc, start, end, caller) of the quotes that verify_named found, in the normalised text. A quote that
    matched without spaces stands where its letters do, with or without spaces between them."""
    around = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    plain = F.instr(around, F.concat(F.lit(" "), F.col("q"), F.lit(" "))) - 1
    letters = F.transform(F.split(N.collapsed(F.col("q")), ""), lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}])", r"\\$1"))
    loose = F.array_join(letters, " ?")
    start = F.when(F.col("strategy") == "exact", plain).otherwise(F.regexp_instr("norm", loose) - 1)
    length = F.when(F.col("strategy") == "exact", F.length("q")).otherwise(F.length(F.regexp_substr("norm", loose)))
    found = checked.where("strategy <> 'none'").withColumn("start", start.cast("long")).withColumn("size", length.cast("long"))
    return found.select("doc", "start", (F.col("start") + F.col("size")).alias("end"), "caller")


def verify_text(text: str, quotes: DataFrame, config: N.Config = N.Config()) -> DataFrame:
    """Quotes (item, quote) against one text that isn't registered: its name is its hash."""
    spark = quotes.sparkSession
    name = F.substring(F.sha2(F.lit(text), 256), 1, 16)
    docs = spark.range(1).select(name.alias("doc"), F.lit(text).alias("text"))
    asked = quotes.select(name.alias("doc"), "item", "quote", F.col("item").cast("string").alias("caller"))
    return scored(verify_named(docs, asked, config), config)


def find_everywhere(docs: DataFrame, quotes: DataFrame, config: N.Config = N.Config()) -> DataFrame:
    """(doc, item, norm, q, text, quote) of quotes (item, quote) that stand in a document at token boundaries: the
    exact half of V9. Quotes that match only when spaces are left out are not found (verify_named finds them).

    Documents are normalised once and kept while the result is read. Each quote is keyed by its rarest word;
    documents send one row for each distinct word that keys a quote."""
    have = stored(prepared(docs, config=config))
    asked = stored(quotes.withColumn("q", N.normalized(F.col("quote"), config)).where(F.col("q") != ""))
    words = asked.select("item", F.explode(F.array_distinct(F.split("q", " "))).alias("word"))
    wanted = words.select("word").distinct()
    held = stored(have.select("doc", F.explode(F.array_distinct(F.split("norm", " "))).alias("word")).join(wanted, "word", "left_semi"))
    spread = held.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    key = words.join(spread, "word", "left").groupBy("item").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "word"))["word"].alias("word"))
    pairs = held.join(key, "word").select("doc", "item")
    return pairs.join(asked, "item").join(have, "doc").where(exact(F.col("norm"), F.col("q")))


# --- original places and confidence -------------------------------------------------------------------


def _replaced(text: str, at: list[int], pattern: str, new: str, flags: int = 0) -> tuple[str, list[int]]:
    """re.sub that carries along the original place of each character; \\1 in new is the first group."""
    out, places, last = [], [], 0
    for m in re.finditer(pattern, text, flags):
        out.append(text[last : m.start()])
        places += at[last : m.start()]
        filled = new.replace("\\1", m.group(1) or "") if "\\1" in new else new
        out.append(filled)
        places += [at[min(m.start(), len(at) - 1)]] * len(filled)
        last = m.end()
    out.append(text[last:])
    return "".join(out), places + at[last:]


WORD = r"[^\W_]"


@dataclass(frozen=True)
class Placed:
    """A normal text, the original place of each of its characters, the steps that changed it, and the stop words
    that went (the dangerous ones alone, if any of them did)."""

    text: str
    at: list[int]
    steps: list[str]
    removed: frozenset[str] = frozenset()


def _without_stopwords(text: str, at: list[int], config: N.Config) -> tuple[str, list[int], frozenset[str]]:
    words = list(re.finditer(r"\S+", text))
    kept = [m for m in words if m[0].lower() not in config.stopwords]
    if len(kept) == len(words):
        return text, at, frozenset()
    if not kept:
        return words[0][0], at[words[0].start() : words[0].end()], frozenset()
    out, places = "", []
    for m in kept:
        if out:
            out, places = out + " ", [*places, at[m.start() - 1]]
        out, places = out + m[0], places + at[m.start() : m.end()]
    gone = {m[0] for m in words} - {m[0] for m in kept}
    return out, places, frozenset({w for w in gone if w.lower() in config.dangerous} or gone)


def placed(text: str, config: N.Config = N.Config()) -> Placed:
    """V1: a text normalised with places."""
    steps = [
        ("case_normalization", config.ignore_case, None, "", 0),
        ("list_normalization", config.ignore_lists, r"^([^\S\n]{2,}|)[12]?\d\.\s+", "\\1 ", re.M),
        ("hyphenation_normalization", config.ignore_hyphenation, rf"(?<={WORD})-\n\s*(?={WORD})", "", 0),
        ("hyphenation_normalization", config.ignore_hyphenation, r"-\n(?=[\s\S])|\n", " ", 0),
        ("punctuation_removal", config.ignore_punctuation, rf"(?<!{WORD})-|-(?!\s*{WORD})", " ", 0),
        ("punctuation_removal", config.ignore_punctuation, rf"(?<!{WORD})[,.]|[,.](?!{WORD})", " ", 0),
        ("punctuation_removal", config.ignore_punctuation, N.OTHER_MARKS.replace("\\\\", "\\"), " ", 0),
        ("stopword_removal", config.remove_stopwords and bool(text.strip()), None, "", 0),
        ("whitespace_normalization", True, r"\s+", " ", 0),
    ]
    at, used, removed = list(range(len(text))), [], frozenset()
    for name, on, pattern, new, flags in steps:
        if not on:
            continue
        if name == "case_normalization":
            changed, after = "".join(c.lower() if len(c.lower()) == 1 else c for c in text), at
        elif name == "stopword_removal":
            changed, after, removed = _without_stopwords(text, at, config)
        else:
            changed, after = _replaced(text, at, pattern, new, flags)
        if changed != text and name not in used and name != "stopword_removal":
            used.append(name)
        text, at = changed, after
    lead = len(text) - len(text.lstrip())
    stripped = text.strip()
    if stripped != text:
        used.append("whitespace_trimming")
    return Placed(stripped, at[lead : lead + len(stripped)], used, removed)


def normalized_with_places(text: str) -> tuple[str, list[int], list[str]]:
    got = placed(text)
    return got.text, got.at, got.steps


def _stopword_penalty(ours: frozenset[str], theirs: frozenset[str], words: int, config: N.Config) -> float:
    """What stop words cost that went from one side only: little for a long text, but each dangerous one in full."""
    only = ours - theirs
    dangerous = [w for w in only if w.lower() in config.dangerous]
    return config.penalty("stopword_removal") * len(only) / max(1, words) + config.penalty("dangerous_stopword_removal") * len(dangerous)


def locate_in(text: str, doc: Placed, quote: str, config: N.Config = N.Config()) -> tuple[str, int, int, int, float, list[str]]:
    """(strategy, original start and end, normal start, score, steps) of a quote in a text that is normalised."""
    asked = placed(quote, config)
    q = asked.text
    missing = ("none", -1, -1, -1, 0.0, [])
    if not q:
        return missing
    found, how = f" {doc.text} ".find(f" {q} "), "exact"
    end = found + len(q) - 1
    if found < 0:
        tight = [i for i, c in enumerate(doc.text) if c != " "]
        i = doc.text.replace(" ", "").find(q.replace(" ", ""))
        if i < 0:
            return missing
        found, end, how = tight[i], tight[i + len(q.replace(" ", "")) - 1], "collapsed"
    start, stop = doc.at[found], doc.at[end]
    portion = placed(text[start : stop + 1], config)
    steps = ["collapsed_space_match"] if how == "collapsed" else []
    steps += portion.steps
    steps += [s for s in asked.steps if s not in steps]
    score = 1.0 - sum(config.penalty(s) for s in steps)
    score -= _stopword_penalty(asked.removed, portion.removed, len(quote.split()), config)
    score -= _stopword_penalty(portion.removed, asked.removed, len(text[start : stop + 1].split()), config)
    if asked.removed != portion.removed:
        steps.append("stopword_removal_difference")
    return how, start, stop, found, round(max(0.0, min(1.0, score)), 6), steps


def locate(text: str, quote: str, config: N.Config = N.Config()) -> tuple[str, int, int, float, list[str]]:
    how, start, stop, _, score, steps = locate_in(text, placed(text, config), quote, config)
    return how, start, stop, score, steps


RESULT = "strategy string, start long, end long, normal_start long, line long, confidence double, steps string, words int, before string, after string"


def scored(pairs: DataFrame, config: N.Config = N.Config(), context: int = 40) -> DataFrame:
    """Pairs (doc, item, text, quote) with the quote's place, line, confidence, level, whether it is verified,
    its number of words, the text around it, and the reason where it isn't verified. Pairs of a document come
    together, and its text is normalised once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, doc = None, None
        for b in batches:
            rows = []
            for t, q in zip(b["text"], b["quote"], strict=True):
                if t != text:
                    text, doc = t, placed(t or "", config)
                how, start, stop, normal, score, steps = locate_in(t or "", doc, q or "", config)
                at = (t.count("\n", 0, start) + 1, t[max(0, start - context) : start], t[stop + 1 : stop + context]) if start >= 0 else (-1, None, None)
                words = len(placed(q or "", config).text.split()) or len((q or "").split())
                rows.append((how, start, stop, normal, at[0], score, ",".join(steps), words, at[1], at[2]))
            yield pd.concat([b[["doc", "item"]].reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    together = pairs.select("doc", "item", "text", "quote").repartition("doc").sortWithinPartitions("doc")
    out = together.mapInPandas(run, f"doc {kinds['doc']}, item {kinds['item']}, {RESULT}")
    none = F.col("strategy") == "none"
    level = F.when(none, "none").when(F.col("confidence") > config.high, "high").when(F.col("confidence") > config.medium, "medium").otherwise("low")
    verified = ~none & (F.col("confidence") >= config.threshold)
    reason = F.when(none, "not found in document").when(~verified, "below the confidence threshold")
    return out.withColumn("level", level).withColumn("verified", verified).withColumn("reason", reason)


def evidence_rollup(checked: DataFrame, by: str = "name") -> DataFrame:
    """Evidence is verified if all of its quotes are."""
    return checked.groupBy(by).agg(F.bool_and("verified").alias("verified"), F.count(F.lit(1)).alias("quotes"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """A document and content once."""
    return docs.withColumn("sha", F.sha2("text", 256)).dropDuplicates(["doc", "sha"]).drop("sha")
