"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents longer than the capacity are cut into pieces of it, the first piece taking the rest. Pieces and
the gaps of open sequences are sorted by size. In each round a sweep over both, from the largest size
down, gives every piece the smallest gap that holds it among those not yet taken (a stack: the last gap
seen is the successor of the piece's size); where pieces compete for gaps of one size, rank decides; then
the gaps shrink and the next round begins. When no piece finds a gap any more, the pieces left over open as many
new sequences as their total size needs.

Sizes are integers from 1 to the capacity, so the sorted pieces and gaps are runs of equal size (first rank, count):
the state of a round is a table of some thousand rows, whatever the number of documents. A round is one job over that
table: tasks sweep a range of sizes each, and what they leave over, pieces without a gap in their range and gaps
without a piece, is swept across ranges by a last task, which also shrinks the gaps. That gives the same matches as one
sweep over all sizes, since within a range the last gap seen is the last gap seen of all. Rounds are written to the
shared folder, and the driver learns from each only how many pieces are left.

The data are distributed too: pieces get their rank in their run by a range sort over (length, doc_id, piece), which
splits a hot length over many tasks, and take their sequence and offset from the matches of all rounds by one
broadcast join. Those are at most a few times the capacity in rows for each round.

Results for odd input: a null text is empty and its sequence holds the end id alone; repeated rows are
packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from .chunks import text_slices
from .common import new_path, release_memory, small_batches, stored, with_position
from .records import encoder

Run = tuple[int, int]  # first and count: ranks of pieces, or numbers of sequences


def sweep(pieces: dict[int, list[Run]], gaps: dict[int, list[Run]]) -> list[tuple[int, int, int, int, int]]:
    """One round. Matches each sequence with one piece at most: (length, first rank, count, first
    sequence, gap). Takes what it matches out of both."""
    matched = []
    stack: list[tuple[int, int, int]] = []  # gap, first sequence, count; the smallest gap on top
    for size in sorted(pieces.keys() | gaps.keys(), reverse=True):
        stack += [(size, first, n) for first, n in reversed(gaps.pop(size, []))]
        left = []
        for first, n in pieces.pop(size, []):
            while n and stack:
                gap, sequence, m = stack.pop()
                k = min(n, m)
                matched.append((size, first, k, sequence, gap))
                first, n = first + k, n - k
                if m > k:
                    stack.append((gap, sequence + k, m - k))
            if n:
                left.append((first, n))
        if left:
            pieces[size] = left
    for gap, sequence, n in stack:
        gaps.setdefault(gap, []).append((sequence, n))
    return matched


def _merged(runs: list[Run]) -> list[Run]:
    out: list[Run] = []
    for first, n in sorted(runs):
        if out and out[-1][0] + out[-1][1] == first:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((first, n))
    return out


PIECE, GAP, MATCH, OPENED = range(4)
#: A row of a round: a run of pieces or gaps of a size, a run of matches with their first sequence and the gap that they
#: were put into, or the number of sequences that are open.
ROUND = "kind int, size long, first long, n long, sequence long, gap long"
RANGES = 8
Rows = list[tuple[int, int, int, int, int, int]]


def _runs(rows: Rows, kind: int) -> dict[int, list[Run]]:
    out: dict[int, list[Run]] = defaultdict(list)
    for k, size, first, n, _, _ in rows:
        if k == kind:
            out[size].append((first, n))
    return {size: _merged(runs) for size, runs in out.items()}


def _rows(pieces: dict[int, list[Run]], gaps: dict[int, list[Run]], matches: list[tuple[int, int, int, int, int]]) -> Rows:
    held = [(kind, size, first, n, 0, 0) for kind, of in ((PIECE, pieces), (GAP, gaps)) for size, runs in of.items() for first, n in runs]
    return held + [(MATCH, size, first, n, sequence, gap) for size, first, n, sequence, gap in matches]


def swept(rows: Rows) -> Rows:
    """Sweep the pieces and gaps of some range of sizes; other rows stay."""
    pieces, gaps = _runs(rows, PIECE), _runs(rows, GAP)
    found = sweep(pieces, gaps)
    return [r for r in rows if r[0] in (MATCH, OPENED)] + _rows(pieces, gaps, found)


def finished(rows: Rows, capacity: int) -> Rows:
    """The end of a round: what the ranges left over is swept, gaps that were used shrink, and where nothing
    was matched new sequences open."""
    rows = swept(rows)
    pieces, gaps, opened = _runs(rows, PIECE), _runs(rows, GAP), sum(r[2] for r in rows if r[0] == OPENED)
    matches = [r[1:] for r in rows if r[0] == MATCH]
    for size, _, n, sequence, gap in matches:
        if gap > size:
            gaps[gap - size] = _merged(gaps.get(gap - size, []) + [(sequence, n)])
    if not matches and pieces:
        total = sum(size * n for size, runs in pieces.items() for _, n in runs)
        # Lengths over half the capacity can't share a sequence; the others need their total at least.
        need = max(-(-total // capacity), sum(n for size, runs in pieces.items() if 2 * size > capacity for _, n in runs))
        gaps[capacity] = _merged(gaps.get(capacity, []) + [(opened, need)])
        opened += need
    return _rows(pieces, gaps, matches) + [(OPENED, 0, opened, 0, 0, 0)]


def plan(counts: DataFrame, capacity: int) -> DataFrame:
    """counts (size, first, n): a run for each length. (size, first, n, sequence, gap): runs of pieces with their first
    sequence and the gap that they are put at the beginning of."""
    spark = counts.sparkSession
    folder = new_path(spark, "pack-rounds")
    names = [c.split()[0] for c in ROUND.split(", ")]
    zero = F.lit(0).cast("long")
    start = counts.select(F.lit(PIECE).alias("kind"), "size", "first", "n", zero.alias("sequence"), zero.alias("gap"))
    start = start.unionByName(spark.createDataFrame([(OPENED, 0, 0, 0, 0, 0)], ROUND))

    def as_rows(table: pa.Table) -> Rows:
        return list(zip(*[table.column(c).to_pylist() for c in names], strict=True))

    def as_batch(rows: Rows) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)

    def in_range(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([as_batch(swept(as_rows(table)))])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # the rows of one round
        if held:
            yield as_batch(finished(as_rows(pa.Table.from_batches(held)), capacity))

    state, number = start, 0
    while True:
        dealt = state.withColumn("range", F.expr(f"size div {-(-capacity // RANGES)}")).repartition(RANGES, "range")
        ranges = dealt.groupBy("range").applyInArrow(in_range, ROUND)  # few tasks, whatever the session's number is
        made = ranges.repartition(1).mapInArrow(last, ROUND)
        seen = Observation()
        left = F.count_if(F.col("kind") == PIECE).alias("pieces")
        made.observe(seen, left).write.parquet(f"{folder}/round={number}")
        if not seen.get["pieces"]:
            break
        state = spark.read.schema(ROUND).parquet(f"{folder}/round={number}").where(F.col("kind") != MATCH)
        number += 1
    return spark.read.schema(ROUND).option("recursiveFileLookup", "true").parquet(folder).where(F.col("kind") == MATCH).drop("kind")


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first takes what the others leave."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, words: bool = False, text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, words)
        for b in text_slices(batches, "text"):
            ids, ends = enc.encode(b.column(1))
            rows, at = [], 0
            for doc_id, to in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                own = np.append(ids[at:to], np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(pieces_of(len(own), capacity)):
                    rows.append((doc_id, k, start, n, zlib.crc32(own[start : start + n])))
                at = to
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release_memory()

    return docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (a `length` from 1 to capacity, doc_id, piece) with sequence_id and offset."""
    ranked = with_position(pieces, ["length", "doc_id", "piece"], "pack-order")
    counts = ranked.groupBy(F.col("length").alias("size")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    table = plan(counts, capacity).select(F.col("size").alias("p_length"), F.col("first").alias("low"), (F.col("first") + F.col("n")).alias("high"), "sequence", (capacity - F.col("gap")).alias("at"))
    joined = ranked.join(
        F.broadcast(table),  # bounded by the capacity, not by the data
        (F.col("length") == F.col("p_length")) & (F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high")),
    )
    return joined.select(
        *pieces.columns, (F.col("sequence") + F.col("pos") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset")
    )


def best_fit_pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    return pack(stored(tokenized_pieces(docs, vocabulary, end_id, capacity), "pack-pieces"), capacity)
