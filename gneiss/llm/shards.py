"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form one atomic group. Groups are ordered by the digest of their text, their
sizes are summed along that order, and a binary search finds the smallest shard capacity with which a
greedy fill needs no more than the given number of shards. The shards are then cut there, at digests,
so that giving a row its shard is a comparison with at most shards - 1 literals and needs no join.

The driver never holds the group sizes. It holds, for blocks of the prefix sums, the least and the
greatest sum in each. A greedy fill over blocks is certain except where a limit falls inside a block;
taking the low or the high end there bounds the true fill from both sides. The search narrows the
capacity as far as the blocks allow, and one job then splits only the blocks that still matter. With
64 parts at each split, sums of 100 TB take six jobs; a block that is one byte wide is exact.

Results for odd input: a null text counts as the empty text and has size 1; repeated rows each keep
their row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import partition_bases, stored, with_position

FIRST_BLOCKS = 4096
SPLIT = 64


@dataclass
class Blocks:
    """Blocks of prefix sums in order: start and width of the range, least and greatest sum inside."""

    rows: list[tuple[int, int, int, int]]

    def __post_init__(self) -> None:
        self.rows.sort()
        self.least = [r[2] for r in self.rows]

    def floor(self, limit: int, optimistic: bool) -> int:
        """A bound of the greatest prefix sum <= limit; exact unless limit falls inside a block."""
        i = bisect_right(self.least, limit) - 1
        if i < 0:
            return 0
        _, _, low, high = self.rows[i]
        return high if limit >= high else limit if optimistic else low

    def fill(self, capacity: int, shards: int, optimistic: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = self.floor(at + capacity, optimistic)
            cuts.append(at)
        return cuts


def _least(low: int, high: int, good) -> int:
    """The smallest value in [low, high] for which good() holds; good(high) is taken for granted."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid + 1, high)
    return low


def _blocks(sums: DataFrame, width: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Blocks of the given width over the ranges of prefix sums; their number is bounded by the caller."""
    if ranges:
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | F.col("total").between(low, high)
        sums = sums.where(inside)
    start = F.expr(f"(total div {width}L) * {width}L")
    got = sums.groupBy(start.alias("start")).agg(F.min("total").alias("low"), F.max("total").alias("high"))
    return [(r.start, width, r.low, r.high) for r in got.collect()]


def smallest_capacity(sums: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, prefix sums at which the shards end). sums: one row for each group with `total`, the
    sum of the sizes up to and with it."""
    width = max(1, -(-total // FIRST_BLOCKS))
    blocks = Blocks(_blocks(sums, width, []))
    floor_capacity = max(largest, -(-total // shards))
    while True:
        low = _least(floor_capacity, total, lambda c: blocks.fill(c, shards, True)[-1] >= total)
        high = _least(low, total, lambda c: blocks.fill(c, shards, False)[-1] >= total)
        if low == high:
            return high, blocks.fill(high, shards, False)
        near = blocks.fill(low, shards, False)
        far = blocks.fill(high, shards, True)
        spans = list(zip(near, far, strict=True))
        near_limit = [any(low <= f and n <= high for n, f in spans) for _, _, low, high in blocks.rows]
        unclear = [k and low < high for k, (_, _, low, high) in zip(near_limit, blocks.rows, strict=True)]
        finer = max(1, max(r[1] for r, u in zip(blocks.rows, unclear, strict=True) if u) // SPLIT)
        ranges: list[tuple[int, int]] = []  # neighbouring blocks become one range: a few for each shard
        for i, r in enumerate(blocks.rows):
            if unclear[i]:
                joins = i > 0 and unclear[i - 1]
                ranges.append((ranges.pop()[0] if joins else r[2], r[3]))
        kept = [r for r, u in zip(blocks.rows, unclear, strict=True) if not u]
        blocks = Blocks(kept + _blocks(sums, finer, ranges))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up `size` along a partition, in the order of its rows."""
    so_far = 0
    for b in batches:
        if not b.num_rows:
            continue
        sums = pc.add(pc.cumulative_sum(b.column("size")), so_far)
        so_far = sums[-1].as_py()
        yield pa.RecordBatch.from_arrays(
            [b.column("part"), b.column("key"), b.column("size"), sums], names=["part", "key", "size", "upto"]
        )


def group_sums(groups: DataFrame) -> DataFrame:
    """groups (key, size), one row for each group -> (key, size, total) along the order of key."""
    ranged = groups.repartitionByRange("key").sortWithinPartitions("key")
    local = stored(
        ranged.select(F.spark_partition_id().alias("part"), "key", "size").mapInArrow(
            _running, "part int, key string, size long, upto long"
        ),
        "shard-groups",
    )
    bases = partition_bases(local.groupBy("part").agg(F.sum("size").alias("s")), "part", "s")
    return local.join(F.broadcast(bases), "part").select("key", "size", (F.col("upto") + F.col("base")).alias("total"))


def minimax_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its shard: id, size, text_crc32, key, shard, slot, and `capacity`, the
    smallest feasible one in bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        ),
        "shard-rows",
    )
    sums = group_sums(rows.groupBy("key").agg(F.sum("size").alias("size")))
    total, largest = sums.agg(F.max("total"), F.max("size")).first()
    if total is None:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("capacity"))
    capacity, ends = smallest_capacity(sums, total, largest, shards)
    at = {r.total: r.key for r in sums.where(F.col("total").isin(ends)).collect()}  # at most one for each shard
    last_keys = [at[e] for e in dict.fromkeys(ends) if e < total]
    shard = F.lit(0)
    for k in last_keys:
        shard = shard + (F.col("key") > F.lit(k)).cast("int")
    placed = with_position(rows, ["key", "id"], "shard-order").withColumn("shard", shard)
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    first, before = F.lit(0).cast("long"), 0
    for s in range(shards):
        first = F.when(F.col("shard") == s, F.lit(before).cast("long")).otherwise(first)
        before += counts.get(s, 0)
    return placed.withColumn("slot", F.col("pos") - first).withColumn("capacity", F.lit(capacity)).drop("pos")
