"""Quality rules as a ledger of failure bits.

`ledger` evaluates every rule once for each document and stores the measurements with one long of
failure bits. A policy is a version and a mask over the bits: applying it, or a new version of it, is
one bitwise AND over the stored bits and reads no text. `ablation` counts, from the bits alone, what
each rule rejects and what it alone rejects; rows are first summed by bit pattern (at most 2 ** rules
patterns), so hot sources or copies never meet in one task. The ledger holds rules that no policy uses yet: what
they would reject is known before they are taken in.

Words are runs of bytes other than space and \\x09-\\x0D. Repeated words are those inside any window of
eight words that occurs twice or more in the text. Windows are compared by a 64-bit hash first; every
hash match is then compared word by word, and a document with a false match is counted by its tuples.

Results for odd input: null text is an empty text (all measures 0, fails `few_words`); a text of any
length is measured whole; repeated rows each get their row; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import release_memory, small_batches, stored

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
NOT_A_WORD_POINT = WHITE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point
WINDOW = 8
SLICE_BYTES = 8 << 20
DIGITS, UPPER = b"0123456789", bytes(range(65, 91))
BULLETS = (b"-", b"*", b"\xe2\x80\xa2")
ELLIPSES = (b"...", b"\xe2\x80\xa6")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Measures that rules use beside those of the contract.
MORE = ["n_lines", "n_digits", "n_upper", "n_bullets", "n_ellipses", "n_braces", "longest_line"]

#: (name, failing condition as SQL over the measures); the position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 10 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("upper_case", "100 * n_upper > 50 * word_chars"),
    ("bullets", "100 * n_bullets > 90 * n_lines"),
    ("ellipses", "100 * n_ellipses > 30 * n_lines"),
    ("braces", "100 * n_braces > n_words"),
    ("one_line", "longest_line > 100000"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
        return sum(bits[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("v1", ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words")),
        Policy("all", tuple(name for name, _ in RULES)),
    )
}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _repeats_by_tuples(codes: np.ndarray) -> int:
    seen: dict[tuple, int] = {}
    keys = [tuple(codes[i : i + WINDOW].tolist()) for i in range(len(codes) - WINDOW + 1)]
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    hit = np.zeros(len(codes) + 1, np.int64)
    for i, k in enumerate(keys):
        if seen[k] > 1:
            hit[i] += 1
            hit[min(i + WINDOW, len(codes))] -= 1
    return int((np.cumsum(hit)[:-1] > 0).sum())


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """For each document, how many of its words lie in a window that occurs twice or more in it."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = int(starts[-1])
    out = np.zeros(len(words), np.int64)
    n = total - WINDOW + 1
    if n < 1:
        return out
    codes = pa.array(chain.from_iterable(words), pa.binary(), size=total).dictionary_encode().indices.to_numpy()
    codes = codes.astype(np.uint64)
    doc = np.repeat(np.arange(len(words)), counts)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = _mix(h + codes[j : j + n] + np.uint64(j + 1))
    h = _mix(h ^ doc[:n].astype(np.uint64))
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return out
    a, b = order[same], order[same + 1]
    equal = doc[a] == doc[b]
    for j in range(WINDOW):
        equal &= codes[a + j] == codes[b + j]
    false_docs = set(doc[a[~equal]].tolist()) | set(doc[b[~equal]].tolist())
    edges = np.zeros(total + 1, np.int64)
    hit = np.unique(np.concatenate([a[equal], b[equal]]))
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + WINDOW, -1)
    covered = np.cumsum(edges)[:-1] > 0
    np.add.at(out, doc[covered], 1)
    for d in false_docs:
        out[d] = _repeats_by_tuples(codes[starts[d] : starts[d + 1]])
    return out


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    words = [b.split() for b in raw]
    lines = [[x for x in b.split(b"\n") if x.strip()] for b in raw]
    count = lambda values: np.fromiter(values, np.int64, len(raw))
    return {
        "n_words": count(map(len, words)),
        "word_chars": count(len(b.translate(None, NOT_A_WORD_POINT)) for b in raw),
        "n_symbols": count(len(b) - len(b.translate(None, SYMBOLS)) for b in raw),
        "n_dup_lines": count(len(x) - len(set(x)) for x in lines),
        "n_repeat_words": repeat_words(words),
        "n_lines": count(map(len, lines)),
        "n_digits": count(len(b) - len(b.translate(None, DIGITS)) for b in raw),
        "n_upper": count(len(b) - len(b.translate(None, UPPER)) for b in raw),
        "n_bullets": count(sum(x.lstrip().startswith(BULLETS) for x in own) for own in lines),
        "n_ellipses": count(sum(x.rstrip().endswith(ELLIPSES) for x in own) for own in lines),
        "n_braces": count(b.count(b"{") + b.count(b"}") for b in raw),
        "longest_line": count(max(map(len, own), default=0) for own in lines),
    }


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes, one row at least: a long text gets a slice of its own."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n + 1
    if at < len(texts):
        yield at, len(texts)


def _measured(names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            for at, end in slices(texts):
                got = measure(texts.slice(at, end - at).to_pylist())
                kept = [b.column(b.schema.get_field_index(c)).slice(at, end - at) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v) for v in got.values())], names=[*names, *got])
        release_memory()

    return run


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns (all but the text, unless named), the measures, and `failed`, the failure bits."""
    small_batches(docs.sparkSession)
    names = [c for c in (keep if keep is not None else docs.columns) if keep is not None or c != text_col]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in names)
    wanted = list(dict.fromkeys([*names, text_col]))
    got = docs.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(
        _measured([f.name for f in docs.schema if f.name in names], text_col),
        fields + ", ".join(f"{m} long" for m in [*MEASURES, *MORE]),
    )
    bits: Column = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return got.withColumn("failed", bits)


def rejected(policy: Policy, bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def verdicts(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    return ledger_df.select("*", F.lit(policy.version).alias("policy"), (~rejected(policy)).alias("kept"))


def ablation(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that it rejects, and those that it alone rejects."""
    patterns = ledger_df.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).count()
    rows = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rows]))
    return (
        patterns.withColumn("r", each)
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("rejects"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("rejects_alone"),
        )
    )


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of documents as a table in the shared folder: id, measures, bits. Policies and ablations read it."""
    return stored(ledger(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep=["doc_id"]), "quality-ledger")


def quality_rules(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    got = verdicts(stored_ledger(docs), policy)
    return got.select("doc_id", *MEASURES, rejected(BASE).alias("base_failed"), "kept", "failed", *MORE)


def drop_rejected(docs: DataFrame, policy: Policy = POLICIES["v1"], text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns, whatever those are called."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return ledger(rows, keep=["row"]).where(~rejected(policy)).select("row.*")


_TESTS = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))
#: quality_rules with the policy v1 over the table documents.
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT id, i, w[i:i + {WINDOW - 1}] AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM w)),
often AS (SELECT id, g FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM g JOIN often USING (id, g)) GROUP BY id),
l AS (SELECT id, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
 length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
 length(regexp_replace(x, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper,
 CAST(len(list_filter(l, lambda y: regexp_matches(y, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullets, CAST(len(list_filter(l, lambda y: regexp_matches(y, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipses,
 length(regexp_replace(x, '[^{{}}]', '', 'g')) AS n_braces, CAST(coalesce(list_max(list_transform(l, lambda y: strlen(y))), 0) AS BIGINT) AS longest_line
 FROM t JOIN w USING (id) JOIN l USING (id) LEFT JOIN r USING (id)),
b AS (SELECT *, CAST({_TESTS} AS BIGINT) AS failed FROM m)
SELECT doc_id, {", ".join(MEASURES)}, failed & {BASE.mask} <> 0 AS base_failed, failed & {POLICIES["v1"].mask} = 0 AS kept, failed, {", ".join(MORE)} FROM b
"""
