"""Exact set-similarity join on word shingles, by partitioning the universe of shingles.

Two documents link when 100 * |intersection| >= 80 * |union| of their sets of five-word shingles. Then their
sets differ in at most H = (|r| + |s|) div 9 shingles (for 80 %). Sizes are cut into bands so wide that a
partner of at most the same size lies in a document's own band or in the one below. In each band shingles are
hashed into m > H segments. By the pigeonhole principle, if a document's units (one for each segment that must
be equal, one more where a difference of one shingle is allowed too) exceed H, a partner shows in one of them.

Every document indexes the content of its segments in its own band, and in a few `rich` segments (all of them
in small bands) also the content less any one shingle. It probes its own band and the band below. Empty
segments say nothing and are never used: m leaves room for that. What units a document has over H + 1 is its
slack: it may leave out as many of its most expensive units, by the number of documents that share them. A
unit that no other document shares costs nothing. So passages that thousands of documents share are left out
where cheaper units do the work, and a document whose every unit is its own is done.

Candidates are never listed as all pairs of a group. Equal sets are one class from the start. First each class is
compared with the first and the last class that index a unit it relies on; links found that way make
components. Units that still join different components are then compared by cells: classes are laid out in
blocks, related ones together, and a cell holds the classes of two blocks between which some unit runs. Each
unit is told by the set of blocks it touches, so that the many units of one group of near copies count once.

What travels to a cell is a parity sketch: a bit for each of 2^k buckets, the parity of the shingles hashed there.
Sketches of two sets differ in no more bits than the sets differ in shingles, so whoever differs in more than H
bits is no partner, for certain. A cell names at most `limit` pairs of any two components, those with the closest
sketches, and says if it left some out; named pairs are verified on whole texts, components are joined, and as
long as something was left out between components that are still apart, a further pass names sixteen times as
many. So no link is lost, and pairs inside a component are never named.

Shingles and classes are held as 64-bit fingerprints: two different texts with equal fingerprints of their sets
(some three pairs among 10^10 texts) would count as copies. Otherwise collisions only add candidates.

Results for odd input: null or empty text, and text of white space, has an empty set and links with nothing;
each row is a document of its own, also where doc_ids repeat; a row with null doc_id takes part, but its
id is never the smallest of a component; an empty table gives an empty result; other columns are ignored; a
text of any length is used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .chunks import text_slices
from .common import broadcast_if_small, discard, free_shuffles, release_memory, small_batches, stored
from .shards import group_sums

SHINGLE = 5
PERCENT = 80
NO_ID = -(1 << 63)
LAST_ID = (1 << 63) - 1
SEEN = 1 << 20
SLICE_BYTES = 2 << 20
#: Shingles of a block's classes, where each class counts CLASS_WEIGHT more: a block has 4096 classes at most.
BLOCK_SHINGLES, CLASS_WEIGHT = 1 << 19, 128
AT_ONCE = 1 << 19  # sketch words that a cell compares at once
NAMED, FURTHER = 8, 16
U = np.uint64

# A row's tag: band below or own (bit 0), kind (bits 1-2), rich segment (bits 3-7), slack (above).
EXACT, LESS, INDEXED_LESS, RICH_EXACT = range(4)


class NoCover(Exception):
    """A document's shingles fell into too few segments; another seed deals them otherwise."""


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    words = [(t or "").encode().lower().split() for t in texts]
    counts = [len(w) for w in words]
    total = sum(counts)
    if not total:
        return [np.zeros(0, U) for _ in texts]
    coded = pa.array(chain.from_iterable(words), pa.binary(), size=total).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), U, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy()]
    rolled = np.zeros(max(0, total - width + 1), U)
    for j in range(width):
        rolled = mix(rolled * U(3) + h[j : total - width + 1 + j]) if len(rolled) else rolled
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            one = np.full(1, n, U)
            for x in h[at : at + n]:
                one = mix(one * U(5) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def digest(shingles: np.ndarray) -> int:
    """The fingerprint of a set, as a signed long."""
    total = mix(shingles + U(0x51ED270B)).sum(dtype=U) + U(len(shingles))
    return int(mix(np.array([total]))[0].astype(np.int64))


def most_differences(a: int, b: int) -> int:
    """The greatest symmetric difference with which sets of these sizes are still similar."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles in 2^k buckets, 16 to 32 for each shingle in which a partner may differ."""
    bits = max(64, 1 << (16 * most_differences(len(shingles), len(shingles))).bit_length())
    at = (mix(shingles ^ U(0x6A09E667F3BCC909)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of words) made for fewer buckets, of which each joins several."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def apart(a: bytes, b: bytes) -> int:
    """In how many buckets sketches differ: the sets differ in as many shingles at least."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    width = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())


class Bands:
    """Band k holds sizes starts[k] to starts[k + 1] - 1; no partner of a size is two bands below it."""

    def __init__(self, first: int = 4, last: int = 1 << 40):
        self.starts = [first]
        while self.starts[-1] <= last:
            self.starts.append(-(-self.starts[-1] * 100 // PERCENT))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def shape(self, band: int) -> tuple[int, int]:
        """(segments, rich segments)."""
        top = self.starts[band + 1] - 1
        most = most_differences(top, top * 100 // PERCENT)
        segments = most + most // 8 + 4
        return segments, segments if segments <= 16 else 2


BANDS = Bands()


def signatures(shingles: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, tags) of a set: what it indexes and probes."""
    size = len(shingles)
    if size < BANDS.starts[0]:
        return np.zeros(0, U), np.zeros(0, np.int64)
    own = BANDS.of(size)
    keys, tags = [], []
    for below in (0, 1):
        band = own - below
        if band < 0 or 100 * (BANDS.starts[band + 1] - 1) < PERCENT * size:
            continue
        segments, rich = BANDS.shape(band)
        salt = U(seed * 1_000_003 + band * 7919 + 1)
        segment = (mix(shingles + mix(np.array([salt]))) % U(segments)).astype(np.int64)
        value = mix(shingles ^ U(0x9E3779B97F4A7C15))
        content = np.zeros(segments, U)
        np.add.at(content, segment, value)
        held = np.bincount(segment, minlength=segments)
        place = mix(np.arange(segments, dtype=U) * U(2) + salt * U(1 << 20))
        full = held > 0
        several = held[:rich] >= 2
        partner = min(size, BANDS.starts[band + 1] - 1)
        slack = int(full.sum() + several.sum()) - most_differences(size, partner) - 1
        if slack < 0:
            raise NoCover
        base = below | slack << 8
        where = np.flatnonzero(full)
        keys.append(mix(content[where] + place[where]))
        tags.append(base | np.where((where < rich) & (held[where] >= 2), RICH_EXACT << 1 | where << 3, EXACT << 1))
        # In rich segments: contents less one shingle, looked up among contents, ...
        less = np.flatnonzero((segment < rich) & (held[segment] >= 2))
        at = segment[less]
        keys.append(mix(content[at] - value[less] + place[at]))
        tags.append(base | LESS << 1 | at << 3)
        # ... and contents, looked up among contents less one shingle.
        at = np.flatnonzero(several)
        keys.append(mix(content[at] + place[at] + U(1)))
        tags.append(base | LESS << 1 | at << 3)
        if not below:
            less = less[held[segment[less]] >= 3]
            at = segment[less]
            keys.append(mix(content[at] - value[less] + place[at] + U(1)))
            tags.append(np.full(len(less), base | INDEXED_LESS << 1))
    return np.concatenate(keys), np.concatenate(tags).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in text_slices(batches, "text", SLICE_BYTES):
        yield b, shingle_sets(b.column(b.schema.get_field_index("text")).to_pylist())
    release_memory()


def digests(docs: DataFrame) -> DataFrame:
    """docs (id, at, text): id, at, n, h, sketch for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _batches(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())],
                names=["id", "at", "n", "h", "sketch"],
            )

    return docs.mapInArrow(run, "id long, at long, n long, h long, sketch binary")


def all_signatures(docs: DataFrame, seed: int) -> DataFrame:
    """docs (text): key, h1, tag. A set that a task has met goes out once, so copies that lie together
    don't multiply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _batches(batches):
            keys, ids, tags, rows = [], [], [], 0
            for s in sets:
                h1 = digest(s)
                if h1 in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(h1)
                k, t = signatures(s, seed)
                keys.append(k)
                tags.append(t)
                ids.append(np.full(len(k), h1, np.int64))
                rows += len(k)
                if rows > 100_000:
                    yield _rows(keys, ids, tags)
                    keys, ids, tags, rows = [], [], [], 0
            if rows:
                yield _rows(keys, ids, tags)

    def _rows(keys: list, ids: list, tags: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(tags).astype(np.int32))],
            names=["key", "h1", "tag"],
        )

    return docs.select("text").mapInArrow(run, "key long, h1 long, tag int")


def shared_units(rows: DataFrame) -> DataFrame:
    """The units that a document shares with another one: key, h1, probes (whether the document relies on
    the unit), indexes, low and high (first and last class that index it), n (rows that index it)."""
    dealt = rows.repartition("key")  # one exchange, which both branches read
    below, kind = F.col("tag").bitwiseAND(1), F.shiftright("tag", 1).bitwiseAND(3)
    index = (below == 0) & (kind != LESS)
    at_index = F.when(index, F.col("h1"))
    units = (
        dealt.groupBy("key")
        .agg(F.min(at_index).alias("low"), F.max(at_index).alias("high"), F.count(at_index).alias("n"), F.min("h1").alias("least"), F.max("h1").alias("most"))
        .where(F.col("low").isNotNull() & (F.col("least") < F.col("most")))
        .drop("least", "most")
    )
    shared = (
        dealt.join(units, "key")
        .withColumn("kind", kind)
        .withColumn("below", below)
        .withColumn("indexes", index)
        .withColumn("probes", (kind != INDEXED_LESS) & ((F.col("low") != F.col("h1")) | (F.col("high") != F.col("h1"))))
        .withColumn("segment", F.shiftright("tag", 3).bitwiseAND(31))
        .withColumn("slack", F.shiftright("tag", 8))
    )
    # The dearest units, as many as there is slack. The rows of one rich segment's differences are one unit.
    unit = F.when(kind == LESS, F.col("segment")).otherwise(F.col("key"))
    own = Window.partitionBy("h1", "below", "is_less", "unit")
    by_cost = Window.partitionBy("h1", "below").orderBy(F.desc("cost"), "is_less", "unit")
    droppable = (F.col("kind") != RICH_EXACT) & F.col("probes")
    return (
        shared.withColumn("is_less", F.col("kind") == LESS)
        .withColumn("unit", unit)
        .withColumn("cost", F.when(droppable, F.sum("n").over(own)).otherwise(F.lit(-1)))
        .withColumn("place", F.dense_rank().over(by_cost))
        .withColumn("probes", F.col("probes") & ((F.col("cost") < 0) | (F.col("place") > F.col("slack"))))
        .where(F.col("probes") | (F.col("indexes") & (F.col("n") > 2)))
        .select("key", "h1", "probes", "indexes", "low", "high", "n")
    )


def _fits(n_a: str, n_b: str):
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of classes whose sizes and sketches let them be similar."""
    of = lambda c: classes.select(F.col("h").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(_fits("n_a", "n_b")).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            near = [apart(*two) <= most_differences(*sizes) for sizes, two in zip(zip(n_a, n_b, strict=True), zip(x, y, strict=True), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return sized.mapInArrow(run, "a long, b long")


def close_members(n: np.ndarray, sketches: list[bytes], component: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing buckets) of a cell's members in different components, and on different sides if there are
    two, whose sizes and sketches let them be similar."""
    width = np.array([len(s) >> 3 for s in sketches], np.int64)
    two_sides = len(np.unique(side)) > 1
    rows = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        at = at[np.argsort(n[at], kind="stable")]
        rows[w] = at, np.frombuffer(b"".join([sketches[i] for i in at]), U).reshape(len(at), w)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for w, (at, words) in rows.items():
        for wider in (w, 2 * w):  # sizes that fit have sketches of equal lengths, or of neighbouring ones
            if wider not in rows:
                continue
            other, theirs = rows[wider]
            theirs = folded(theirs, w)
            step = max(1, AT_ONCE // len(other))
            for first in range(0, len(at), step):
                mine = at[first : first + step]
                low = int(np.searchsorted(n[other], -(-int(n[mine[0]]) * PERCENT // 100)))
                high = int(np.searchsorted(n[other], int(n[mine[-1]]) * 100 // PERCENT, side="right"))
                partner = other[low:high]
                a, b = n[mine][:, None], n[partner][None]
                may = (component[mine][:, None] != component[partner][None]) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
                if two_sides:
                    may &= side[mine][:, None] != side[partner][None]
                if wider == w:
                    may &= np.arange(first, first + len(mine))[:, None] < np.arange(low, low + len(partner))[None]
                i, j = np.nonzero(may)
                part = max(1, AT_ONCE // w)
                for k in range(0, len(i), part):
                    x, y = i[k : k + part], j[k : k + part]
                    bits = np.bitwise_count(words[first + x] ^ theirs[low + y]).sum(1, dtype=np.int64)
                    good = bits <= (n[mine[x]] + n[partner[y]]) * (100 - PERCENT) // (100 + PERCENT)
                    out.append((mine[x[good]], partner[y[good]], bits[good]))
    if not out:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def told_apart(members: DataFrame) -> DataFrame:
    """The keys of units whose members (key, h, component, probes; each once) are in different components. Of units
    with the same members, told by 128 bits and their number, one stands for all: they lead to the same cells."""
    of = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "h")).alias(f"set_{seed}")
    units = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("probes").alias("p"), of(1), of(2), F.count(F.lit(1)).alias("size"))
    return units.where("p AND x < y").groupBy("set_1", "set_2", "size").agg(F.min("key").alias("key")).select("key")


def cells(units: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame | None:
    """The members of all cells: first, second (blocks), block, h, component, n, sketch. None if no unit joins
    different components."""
    many = units.where(F.col("n") > 2).groupBy("key", "h1").agg(F.max("probes").alias("probes"))  # copies came from several tasks
    named = many.join(labels, F.col("h1") == F.col("node"), "left").select("key", F.col("h1").alias("h"), "probes", F.coalesce("component", "h1").alias("component"))
    members = stored(named, "jaccard-members")
    open_ = stored(members.join(told_apart(members), "key", "left_semi").select("key", "h", "component"), "jaccard-open")
    discard(members)
    if open_.isEmpty():
        discard(open_)
        return None
    # Related classes get one label: the smallest component among those that share a unit, twice over.
    label = open_.select("key", "h", F.col("component").alias("label"))
    for _ in range(2):
        least = label.groupBy("key").agg(F.min("label").alias("least"))
        spread = stored(label.select("key", "h").join(least, "key").groupBy("h").agg(F.min("least").alias("label")), "jaccard-label")
        label = open_.select("key", "h").join(spread, "h")
    at = F.format_string("%020d.%020d.%020d", "label", "component", "h")
    own = spread.join(open_.select("h", "component").distinct(), "h").join(classes.select("h", "n"), "h")
    laid = group_sums(own.select(at.alias("key"), (F.col("n") + CLASS_WEIGHT).alias("size")))
    blocks = stored(laid.select(F.element_at(F.split("key", r"\."), 3).cast("long").alias("h"), F.expr(f"total div {BLOCK_SHINGLES}L").alias("block")), "jaccard-blocks")
    placed = open_.join(blocks, "h").select("key", "h", "component", "block")
    touched = placed.select("key", "block").groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    runs = placed.join(touched, "key").select("blocks", "h", "component", "block").distinct()
    apart_ = runs.select("h", "component", "block", F.explode("blocks").alias("other"))
    cell = apart_.select(F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "h", "component").distinct()
    return stored(cell.join(classes.select("h", "n", "sketch"), "h"), "jaccard-cells")


def named_pairs(members: DataFrame, limit: int) -> DataFrame:
    """Of each cell and each two components the `limit` pairs (a, b) with the closest sketches; a row of nulls
    where there are more."""

    def run(cell: pa.Table) -> pa.Table:
        h, component, n, block = (cell.column(c).to_numpy() for c in ("h", "component", "n", "block"))
        i, j, bits = close_members(n, cell.column("sketch").to_pylist(), component, block)
        low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
        order = np.lexsort((j, i, bits, high, low))
        i, j, low, high = i[order], j[order], low[order], high[order]
        begins = np.ones(len(i), bool)
        begins[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(begins, np.arange(len(i)), 0))
        kept = place < limit
        a, b = h[i[kept]].tolist(), h[j[kept]].tolist()
        left = [None] if not kept.all() else []
        return pa.table({"a": pa.array(a + left, pa.int64()), "b": pa.array(b + left, pa.int64())})

    return members.groupBy("first", "second").applyInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of classes whose whole texts are similar. Texts come from the first document of a
    class; a pair and its two texts are one row of a stream, so no task holds a group."""
    wanted = stored(pairs.select("a").union(pairs.select("b")).distinct().join(classes.select(F.col("h").alias("a"), "id", "at"), "a"), "jaccard-wanted")
    found = docs.join(broadcast_if_small(wanted), ["id", "at"]).groupBy("a").agg(F.min("text").alias("text"))
    texts = stored(found.select(F.col("a").alias("h"), "text"), "jaccard-texts")
    of = lambda c: texts.select(F.col("h").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text = dict(zip(a, batch.column(2), strict=True)) | dict(zip(b, batch.column(3), strict=True))
            sets = dict(zip(text, shingle_sets([t.as_py() for t in text.values()]), strict=True))
            good = []
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                good.append(100 * both >= PERCENT * (len(sets[x]) + len(sets[y]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        release_memory()

    links = stored(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "jaccard-links")
    discard(wanted, texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component (its smallest node), by least labels and pointer jumping. Every step is
    written to the shared folder."""
    edges = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    first = F.least(F.min("b"), F.first("a")).alias("component")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(first).withColumn("was", F.lit(None).cast("long")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        lower = stored(lower, "labels")
        above = lower.select(F.col("node").alias("next"), F.col("next").alias("component"))
        step = stored(lower.join(above, "next").select("node", "component", "was"), "labels")
        discard(labels, lower)
        labels = step
        if step.where(F.col("component") != F.col("was")).isEmpty():
            discard(edges)
            return labels


def _members(docs: DataFrame, seed: int) -> DataFrame:
    """docs (id, at, text): id, at, n and h of each row, and `winner`, the smallest (id, class) of its component
    (null where the set is empty)."""
    spark: SparkSession = docs.sparkSession
    rows = stored(digests(docs), "jaccard-digests")
    first = F.min(F.struct("id", "at")).alias("first")
    last = F.min(F.when(F.col("id") == NO_ID, LAST_ID).otherwise(F.col("id"))).alias("least")
    grouped = rows.where(F.col("n") > 0).groupBy("h").agg(first, last, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(grouped.select("h", "first.id", "first.at", "least", "n", "sketch"), "jaccard-classes")
    units = stored(shared_units(all_signatures(docs, seed)), "jaccard-units")
    free_shuffles(spark)
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("end")
    found = units.where("probes").select("h1", ends).where(F.col("end") != F.col("h1"))
    star = stored(sketched(found.select(F.least("h1", "end").alias("a"), F.greatest("h1", "end").alias("b")).distinct(), classes), "jaccard-pairs")
    links = verified(star, docs, classes)
    labels = components(links)
    discard(star)
    limit = NAMED
    while (members := cells(units, labels, classes)) is not None:
        named = stored(named_pairs(members, limit), "jaccard-pairs")
        more = verified(named.where(F.col("a").isNotNull()).distinct(), docs, classes)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
        free_shuffles(spark)
        if named.where(F.col("a").isNull()).isEmpty():
            break
        limit *= FURTHER
    discard(units)
    placed = classes.select("h", "least").join(labels, F.col("h") == F.col("node"), "left").select("h", "least", F.coalesce("component", "h").alias("component"))
    winners = placed.groupBy("component").agg(F.min(F.struct(F.col("least").alias("id"), "h")).alias("winner"))
    return rows.select("id", "at", "n", "h").join(placed.join(winners, "component").select("h", "winner"), "h", "left")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at (a hash of the text, which tells rows of one id apart), text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("at"), F.col(text_col).alias("text"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    slim = _slim(docs, id_col, text_col)
    for seed in range(8):
        try:
            return _members(slim, seed)
        except Exception as e:  # the workers' exception reaches the driver as text
            if "NoCover" not in str(e):
                raise
    raise NoCover


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    found = _grouped(docs, id_col, text_col)
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    least = F.when(F.col("winner.id") != LAST_ID, F.col("winner.id"))
    return found.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("winner").isNull(), own).otherwise(least).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest doc_id (nulls last), and all rows without a
    shingle; columns as they are. Of rows that repeat both doc_id and text one stays."""
    found = stored(_grouped(docs, id_col, text_col).where(F.col("winner").isNotNull()), "jaccard-rows")
    place = F.struct(F.when(F.col("id") == NO_ID, LAST_ID).otherwise(F.col("id")).alias("id"), "h")
    losers = stored(found.where(place > F.col("winner")).select("id", "at").distinct(), "jaccard-losers")
    twice = stored(found.where(place == F.col("winner")).groupBy("id", "at").count().where("count > 1").select("id", "at"), "jaccard-twice")
    discard(found)
    mine = docs.alias("d")
    same = (F.coalesce(F.col(f"d.{id_col}").cast("long"), F.lit(NO_ID)) == F.col("l.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("l.at"))
    kept = mine.join(broadcast_if_small(losers).alias("l"), same, "left_anti")
    if twice.isEmpty():
        return kept
    repeated = broadcast_if_small(twice).alias("l")
    once = kept.alias("d").join(repeated, same, "left_anti")
    return once.unionByName(kept.alias("d").join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))


#: similarity_components over the table documents.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
x AS (SELECT r, unnest(g) AS k FROM s), p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM x a JOIN x b ON a.k = b.k AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.r = a JOIN s sb ON sb.r = b WHERE 100 * n >= 80 * (len(sa.g) + len(sb.g) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach AS (SELECT r, r AS t FROM s UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.t = e.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM s JOIN reach ON reach.r = s.r JOIN s o ON o.r = reach.t GROUP BY s.r, s.doc_id, len(s.g)
"""
