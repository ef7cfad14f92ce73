"""Hash chains, Merkle trees and the companions of literate files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gneiss.sources.shared import stored

LEVELS = 10  # of a tree folded in one pass: a task holds the hashes of 1024 leaves at a time
# How a companion marks a block, and that pattern as Spark reads it.
BLOCK_START, BLOCK_END = ";; @@block {n} {h}", ";; @@end {n}"
BLOCK = r"(?s);; @@block (\d+) ([0-9a-f]{64})\n(.*?)\n;; @@end \1"


def build_chains(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """H1: (key, n, content, hash), each hash being sha256(content || hash before). A chain is sequential: its blocks
    pass through one task in order, of which only the last hash is held; other chains run beside it."""
    kind = rows.schema[key].dataType.simpleString()
    blocks = rows.select(F.col(key).alias("k"), F.col(order).cast("long").alias("n"), F.coalesce(F.col(content), F.lit("")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: object = run  # no key is this function
        last = ""
        for b in batches:
            hashes = []
            for k, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                last = hashlib.sha256((c + (last if k == chain else "")).encode()).hexdigest()
                chain = k
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.string())], names=["k", "n", "content", "hash"])

    ordered = blocks.repartition("k").sortWithinPartitions("k", "n", "content")
    return ordered.mapInArrow(run, f"k {kind}, n long, content string, hash string").withColumnRenamed("k", key)


def check_chains(stored_chain: DataFrame, key: str) -> DataFrame:
    """H2: (key, n, status): valid up to the first wrong hash, which is invalid; what follows is stale.

    A block is wrong if its hash isn't that of its content and the stored hash before it: no chain is rebuilt."""
    w = Window.partitionBy(key).orderBy("n")
    before = F.coalesce(F.lag("hash").over(w), F.lit(""))
    marked = stored_chain.withColumn("bad", F.sha2(F.concat("content", before), 256) != F.col("hash"))
    first = F.min(F.when(F.col("bad"), F.col("n"))).over(Window.partitionBy(key))
    status = F.when(first.isNull() | (F.col("n") < first), "valid").when(F.col("n") == first, "invalid").otherwise("stale")
    return marked.select(key, "n", status.alias("status"))


def clean(checked: DataFrame, key: str) -> DataFrame:
    """H3: whether a chain is whole, and where it breaks."""
    return checked.groupBy(key).agg(F.bool_and(F.col("status") == "valid").alias("clean"), F.min(F.when(F.col("status") == "invalid", F.col("n"))).alias("break_point"))


def _folded(leaves: Column) -> Column:
    """Array of (level from 1, pos, hash) above an array of hashes, LEVELS levels of it; an odd last node moves up."""
    empty = F.array().cast("array<struct<level:int,pos:int,hash:string>>")

    def up(acc: Column, level: Column) -> Column:
        now = acc["now"]
        last = F.size(now) - 1

        def pair(i: Column) -> Column:
            left = F.get(now, i * 2)
            return F.when(i * 2 < last, F.sha2(F.concat(left, F.get(now, i * 2 + 1)), 256)).otherwise(left)

        after = F.transform(F.sequence(F.lit(0), (last / 2).cast("int")), pair)
        named = F.transform(after, lambda h, i: F.struct(level.alias("level"), i.alias("pos"), h.alias("hash")))
        return F.struct(after.alias("now"), F.concat(acc["out"], named).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.struct(leaves.alias("now"), empty.alias("out")), up, lambda acc: acc["out"])


def merkle(leaves: DataFrame, key: str) -> DataFrame:
    """H4: leaves (key, pos from 0, content) to all nodes (key, level, pos, hash). Neighbours pair up level by
    level; an odd last node moves up as it is. A pass folds ten levels: a key's leaves are dealt out by 1024 to a
    task, and only the tops of those go to the next pass."""
    width = 1 << LEVELS
    bottom = stored(leaves.select(key, F.lit(0).alias("level"), F.col("pos").cast("long").alias("pos"), F.sha2("content", 256).alias("hash")))
    height = bottom.groupBy(key).agg(F.ceil(F.log2((F.max("pos") + 1).cast("double"))).cast("int").alias("height"))
    out, level, n = bottom, bottom, 0
    while not level.where("pos > 0").isEmpty():
        grouped = level.groupBy(key, F.expr(f"pos div {width}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("own"))
        above = grouped.select(key, "at", F.explode(_folded(F.transform("own", lambda x: x["hash"]))).alias("x"))
        place = F.expr(f"at * ({width} div shiftleft(1, x.level))").cast("long") + F.col("x.pos")
        nodes = above.select(key, (F.col("x.level") + n).alias("level"), place.alias("pos"), "x.hash")
        made = stored(nodes.join(height, key).where(F.col("level") <= F.col("height")).drop("height"))
        out, n = out.unionByName(made), n + LEVELS
        level = made.where(F.col("level") == n)
    return out


def leaves_of(nodes: DataFrame, key: str) -> DataFrame:
    """H7: the leaves of trees, by place."""
    return nodes.where("level = 0").select(key, "pos", "hash")


def roots(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.groupBy(key).agg(F.max_by("hash", "level").alias("root"))


def proof(nodes: DataFrame, key: str, pos: int) -> DataFrame:
    """H5: (key, level, hash, left) of the siblings from a leaf up; levels in which it moves up alone have none."""
    at = F.floor(F.lit(pos) / F.pow(F.lit(2), F.col("level"))).cast("long")
    sibling = F.when(at % 2 == 0, at + 1).otherwise(at - 1)
    return nodes.where(F.col("pos") == sibling).select(key, "level", "hash", (F.col("pos") < at).alias("left"))


def verify_proof(leaf: Column, steps: Column) -> Column:
    """steps: array of (level, hash, left) -> the root that it leads to."""
    up = lambda acc, s: F.sha2(F.when(s["left"], F.concat(s["hash"], acc)).otherwise(F.concat(acc, s["hash"])), 256)
    return F.aggregate(F.sort_array(steps), F.sha2(leaf, 256), up)


def diff_leaves(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """H6: (key, pos, change) by place."""
    both = old.select(key, "pos", F.col("hash").alias("was")).join(new.select(key, "pos", F.col("hash").alias("now")), [key, "pos"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return both.select(key, "pos", change.alias("change")).where(F.col("change").isNotNull())


# --- companions: blocks (key, place, n, content, hash), place being the order in the file -----------------


def parse_companion(files: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """H9: the blocks of companion files."""
    part = lambda i: F.regexp_extract_all(text, F.lit(BLOCK), F.lit(i)).alias(f"c{i}")
    blocks = files.select(F.col(key), F.posexplode(F.arrays_zip(part(1), part(2), part(3))).alias("place", "b"))
    return blocks.select(key, "place", F.col("b.c1").cast("long").alias("n"), F.col("b.c3").alias("content"), F.col("b.c2").alias("hash"))


def corrupted(text: Column) -> Column:
    """H9: a companion with content but without blocks, or with lines outside them that are no comment."""
    text = F.coalesce(text, F.lit(""))
    outside = F.split(F.regexp_replace(text, BLOCK, ""), "\n")
    stray = F.exists(outside, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith(";;"))
    return (F.trim(text) != "") & (~text.rlike(BLOCK) | stray)


def write_companion(blocks: DataFrame, key: str = "doc") -> DataFrame:
    """H9: (key, text) of blocks in the order of their place."""
    one = F.format_string(";; @@block %d %s\n%s\n;; @@end %d", "n", "hash", "content", "n")
    return blocks.groupBy(key).agg(
        F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "n", one.alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n")).alias("text")
    )


def duplicates(blocks: DataFrame, key: str) -> DataFrame:
    """H9: numbers that occur twice or more."""
    return blocks.groupBy(key, "n").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def out_of_order(blocks: DataFrame, key: str, place: str = "place") -> DataFrame:
    """H9: blocks whose number doesn't exceed that of the block before."""
    w = Window.partitionBy(key).orderBy(place)
    return blocks.withColumn("was", F.lag("n").over(w)).where(F.col("was") >= F.col("n")).drop("was")


def resolve_duplicates(blocks: DataFrame, key: str, canonical: DataFrame) -> DataFrame:
    """H9: of blocks whose number is in canonical (key, n, hash), only the first one with that hash stays."""
    asked = canonical.select(key, "n", F.col("hash").alias("right"))
    joined = blocks.join(asked, [key, "n"], "left")
    first = joined.where("hash = right").groupBy(key, "n").agg(F.min("place").alias("first"))
    return joined.join(first, [key, "n"], "left").where(F.col("right").isNull() | (F.col("place") == F.col("first"))).select(*blocks.columns)


def repair_order(blocks: DataFrame, key: str) -> DataFrame:
    """H9: each number once, its last block, in ascending order."""
    last = blocks.groupBy(key, "n").agg(F.max(F.struct("place", "content", "hash")).alias("b"))
    return last.select(key, F.col("n").cast("int").alias("place"), "n", "b.content", "b.hash")


def check_integrity(source: DataFrame, companion: DataFrame, key: str) -> DataFrame:
    """H9: (key, n, status) of a source's blocks (key, n, content): valid while the companion's content hashes to the
    source's chain; the first that doesn't, or is missing, is invalid, and what follows it is stale."""
    chain = build_chains(source, key, "n", "content").select(key, "n", F.col("hash").alias("expected"))
    have = companion.groupBy(key, "n").agg(F.max(F.struct("place", "content"))["content"].alias("found"))
    before = F.coalesce(F.lag("expected").over(Window.partitionBy(key).orderBy("n")), F.lit(""))
    right = F.sha2(F.concat(F.coalesce("found", F.lit("")), before), 256) == F.col("expected")
    marked = chain.join(have, [key, "n"], "left").withColumn("bad", ~right)
    first = F.min(F.when(F.col("bad"), F.col("n"))).over(Window.partitionBy(key))
    status = F.when(first.isNull() | (F.col("n") < first), "valid").when(F.col("n") == first, "invalid").otherwise("stale")
    return marked.select(key, "n", status.alias("status"))


def put_blocks(blocks: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """H9, insert and replace: fresh (key, n, content, hash) replaces blocks of its numbers, and the others stand among
    the old ones by number."""
    kept = blocks.join(fresh.select(key, "n").distinct(), [key, "n"], "left_anti")
    return kept.select(key, F.col("n").cast("int").alias("place"), "n", "content", "hash").unionByName(
        fresh.select(key, F.col("n").cast("int").alias("place"), F.col("n").cast("long").alias("n"), "content", "hash")
    )


def clear_blocks(blocks: DataFrame, which: DataFrame, key: str) -> DataFrame:
    """H9: blocks (key, n) emptied; their hash is that of nothing, so the chain breaks there."""
    marked = blocks.join(which.select(key, "n", F.lit(True).alias("gone")).distinct(), [key, "n"], "left")
    return marked.select(
        key, "place", "n", F.when(F.col("gone"), "").otherwise(F.col("content")).alias("content"), F.when(F.col("gone"), F.sha2(F.lit(""), 256)).otherwise(F.col("hash")).alias("hash")
    )
