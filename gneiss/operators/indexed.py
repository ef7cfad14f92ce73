"""A kept index of documents and the search over it (IO9, S1, S3).

The index (doc, pos, word, line, column, context, parts) has a row for every token of the normalised text with the place
where it begins, and of a word that runs over a line end the places of its parts; and a row for every line that isn't
empty, with its context and without a word. So a context is held once, however many words its line has. The index is
built once, patched document by document (sources.packages.Store), and searched without its texts. A phrase begins at
the end of one token, goes through whole tokens, and ends at the beginning of another, so it is a chain of joins on
(doc, pos), each after a filter on the word; lines found get their contexts by one aggregation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gneiss.functions.normalize import Config
from gneiss.sources.shared import small_batches

from . import search
from .lines import as_posting, by_line, phrase_hits
from .quotes import placed

TOKENS = "pos long, word string, line long, column int, context string, parts array<struct<at:int,line:bigint,column:int>>"
PARTS = pa.list_(pa.struct([("at", pa.int32()), ("line", pa.int64()), ("column", pa.int32())]))
FIELDS = [("pos", pa.int64()), ("word", pa.string()), ("line", pa.int64()), ("column", pa.int32()), ("context", pa.string()), ("parts", PARTS)]
SLICE_BYTES, SLICE_TOKENS = 1 << 20, 100_000
#: Texts of other characters than these are normalised by more than lower case and white space.
MARKED = r"[^A-Za-z0-9_\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff} \n]"
#: Where a long text may be cut: its lines; its tokens, if it has no marks; and tokens with marks, where no rule of
#: normalisation reaches from one side to the other. (A digit at the beginning of a line may number a list.)
LINE_CUT, PLAIN_CUT = re.compile(rb"\n"), re.compile(rb"[ \n]")
MARKED_CUT = re.compile(rb"(?<=[A-Za-z0-9])(?: (?=[A-Za-z])|\n(?=[A-Za-z0-9]))")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) in pieces of about SLICE_BYTES of text."""
    for b in batches:
        upto, at = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield b.slice(at, end - at)
            at = end


def _pieces(text: pa.StringScalar, cut: re.Pattern) -> Iterator[str]:
    """A text in pieces of SLICE_BYTES, and on to the next place to cut."""
    buffer, at = text.as_buffer(), 0
    while at < buffer.size:
        found = cut.search(buffer, at + SLICE_BYTES)
        end = found.end() if found else buffer.size
        yield buffer.slice(at, end - at).to_pybytes().decode()
        at = end


def _rows(doc: pa.Array, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of the index; columns that aren't given are null."""
    own = [columns[name].cast(kind) if name in columns else pa.nulls(len(doc), kind) for name, kind in FIELDS]
    return pa.RecordBatch.from_arrays([doc, *own], names=["doc", *(name for name, _ in FIELDS)])


def _line_rows(doc: pa.Array, text: pa.Array) -> pa.RecordBatch:
    lists = pc.split_pattern(text, "\n")
    owner, context = pc.list_parent_indices(lists), lists.flatten()
    first = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    line = pa.array(np.arange(len(context)) - first[owner.to_numpy()] + 1)
    full = pc.not_equal(context, "")
    return _rows(doc.take(owner.filter(full)), line=line.filter(full), context=context.filter(full))


def _plain_tokens(doc: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """The tokens of texts without marks, of all together."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(text))  # utf8_split_whitespace may keep a last white space
    full = pc.not_equal(lists.flatten(), "")
    owner = pc.list_parent_indices(lists).filter(full).to_numpy().astype(np.int64)
    letters = np.frombuffer("\n".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
    white = (letters == 10) | (letters == 32)
    start = np.flatnonzero(~white & np.concatenate([[True], white[:-1]])) if len(letters) else np.zeros(0, np.int64)
    ends = np.concatenate([[-1], np.flatnonzero(letters == 10)])  # of lines
    begins = np.concatenate([[0], np.cumsum(pc.utf8_length(text).to_numpy().astype(np.int64) + 1)[:-1]])  # of texts
    after = np.searchsorted(ends, start) - 1
    line = after - (np.searchsorted(ends, begins) - 1)[owner] + 1
    pos = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return _rows(doc.take(pa.array(owner)), pos=pa.array(pos), word=lists.flatten().filter(full), line=pa.array(line), column=pa.array(start - ends[after]))


def _marked_tokens(text: str, config: Config) -> Iterator[list[tuple]]:
    """(pos, word, line, column, parts) of a text's tokens, some at a time."""
    norm = placed(text, config)
    begins = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(begins, at)
        return line, at - begins[line - 1] + 1

    out, start = [], 0
    for pos, word in enumerate(norm.text.split(" ") if norm.text else []):
        at = norm.at[start : start + len(word)]
        parts = None
        if at[-1] - at[0] != len(at) - 1:
            parts = [dict(zip(("at", "line", "column"), (i, *place(x)), strict=True)) for i, x in enumerate(at) if i == 0 or x != at[i - 1] + 1]
        out.append((pos, word, *place(at[0]), parts))
        start += len(word) + 1
        if len(out) >= SLICE_TOKENS:
            yield out
            out = []
    if out:
        yield out


def _tokens(doc: pa.Array, text: pa.Array, config: Config, plain: bool) -> Iterator[pa.RecordBatch]:
    """The tokens of texts; where plain, those without marks are taken together."""
    marked = pc.match_substring_regex(text, MARKED) if plain else pa.array(np.ones(len(text), bool))
    if not pc.all(marked).as_py():
        yield _plain_tokens(doc.filter(pc.invert(marked)), text.filter(pc.invert(marked)))
    for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
        for rows in _marked_tokens(text[i].as_py(), config):
            pos, word, line, column, parts = (list(x) for x in zip(*rows, strict=True))
            yield _rows(
                doc.take(pa.array([i] * len(rows))), pos=pa.array(pos), word=pa.array(word, pa.string()),
                line=pa.array(line), column=pa.array(column), parts=pa.array(parts, PARTS),
            )


def _moved(rows: pa.RecordBatch, pos: int, lines: int, columns: int) -> pa.RecordBatch:
    """Rows of a piece of a text as rows of the text: so many tokens, lines, and columns of its first line come before."""
    if not (pos or lines or columns):
        return rows

    def place(line: pa.Array, column: pa.Array) -> tuple[pa.Array, pa.Array]:
        return pc.add(line, lines), pc.add(column, pc.if_else(pc.equal(line, 1), pa.scalar(columns, pa.int32()), pa.scalar(0, pa.int32())))

    line, column = place(rows["line"], rows["column"])
    parts, own = rows["parts"], rows["parts"].flatten()
    if len(own):
        fields = [own.field("at"), *place(own.field("line"), own.field("column"))]
        size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        parts = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["at", "line", "column"]), mask=parts.is_null())
    return _rows(rows["doc"], pos=pc.add(rows["pos"], pos), word=rows["word"], line=line, column=column, context=rows["context"], parts=parts)


def _long(doc: pa.Array, text: pa.Array, config: Config, plain: bool) -> Iterator[pa.RecordBatch]:
    """The index of one long text, piece by piece: no batch grows with the text, but by a line or token that is long."""
    lines = 0
    for piece in _pieces(text[0], LINE_CUT):
        yield _moved(_line_rows(doc, pa.array([piece])), 0, lines, 0)
        lines += piece.count("\n")
    cut = MARKED_CUT if not plain or pc.match_substring_regex(text, MARKED)[0].as_py() else PLAIN_CUT
    pos = lines = columns = 0
    for piece in [text[0].as_py()] if config.remove_stopwords else _pieces(text[0], cut):
        n = 0
        for rows in _tokens(doc, pa.array([piece]), config, plain):
            yield _moved(rows, pos, lines, columns)
            n += rows.num_rows
        pos, columns = pos + n, len(piece) - piece.rfind("\n") - 1 + (0 if "\n" in piece else columns)
        lines += piece.count("\n")


def build_index(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """IO9: the index of documents (doc, text)."""
    small_batches(docs.sparkSession)
    plain = config.ignore_case and not config.remove_stopwords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            doc, text = b.column(0), b.column(1).cast(pa.string()).fill_null("")
            if len(text) == 1 and text[0].as_buffer().size > SLICE_BYTES:
                yield from _long(doc, text, config, plain)
            else:
                yield _line_rows(doc, text)
                yield from _tokens(doc, text, config, plain)

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "text").mapInArrow(run, f"doc {kind}, {TOKENS}")


def _begins(found: DataFrame, offset: Column) -> DataFrame:
    """found with the place `offset` letters into its word in place of that of the word."""
    own = F.filter("parts", lambda x: x["at"] <= offset)
    part = F.get(own, F.size(own) - 1)
    return found.select(
        "doc", "pos", F.coalesce(part["line"], F.col("line")).alias("line"),
        F.coalesce(part["column"] + offset - part["at"], F.col("column") + offset).cast("int").alias("column"),
    )


def _posting(hits: DataFrame) -> DataFrame:
    """hits (doc, line, column), and rows with a line's context and no column: a posting of the lines that have hits."""
    lines = hits.groupBy("doc", "line").agg(F.min("column").alias("column"), F.max("context").alias("context")).where(F.col("column").isNotNull())
    return as_posting(lines, F.col("column"))


def _in_lines(index: DataFrame, hits: DataFrame) -> DataFrame:
    lines = index.where(F.col("word").isNull()).select("doc", "line", "column", "context")
    return _posting(hits.select("doc", "line", "column", F.lit(None).cast("string").alias("context")).unionByName(lines))


def indexed_phrase(index: DataFrame, phrase: str, config: Config = Config()) -> DataFrame:
    """A posting of the lines in which the normalised phrase begins."""
    words = placed(phrase, config).text.split(" ")
    if words == [""]:
        return _posting(index.where(F.lit(False)))
    if len(words) == 1:
        size = len(words[0])
        every = F.filter(F.sequence(F.lit(0), F.length("word") - size), lambda i: F.substring(F.col("word"), i + 1, F.lit(size)) == words[0])
        inside = F.when(F.col("parts").isNull(), F.array(F.instr("word", words[0]) - 1)).otherwise(every)  # on one line the first will do
        found = index.where(F.contains("word", F.lit(words[0]))).withColumn("offset", F.explode(inside))
        return _in_lines(index, _begins(found, F.col("offset")))
    found = _begins(index.where(F.endswith("word", F.lit(words[0]))), F.length("word") - len(words[0]))
    for i, w in enumerate(words[1:], 1):
        test = F.startswith("word", F.lit(w)) if i == len(words) - 1 else F.col("word") == w
        found = found.join(index.where(test).select("doc", (F.col("pos") - i).alias("pos")), ["doc", "pos"], "left_semi")
    return _in_lines(index, found)


def indexed_word(index: DataFrame, word: str) -> DataFrame:
    """S3. One pass over the index: its lines come with the word's tokens."""
    return _posting(index.where((F.col("word") == word) | F.col("word").isNull()).select("doc", "line", "column", "context"))


def traced_phrase(docs: DataFrame, phrase: str, ranges: DataFrame) -> DataFrame:
    """The lines of a phrase with those who quote it: ranges (doc, start, end, caller) as register_ranges keeps
    them. A caller counts once for a line, with its best overlap."""
    hits = phrase_hits(docs, phrase)
    met = search.trace(hits.select("doc", "start", "end"), ranges)
    callers = met.join(hits.select("doc", "start", "end", "line"), ["doc", "start", "end"]).select("doc", "line", F.col("caller").alias("name"), "overlap")
    return search.with_callers(by_line(hits), callers)
