"""Length-delimited binary records of token ids, with masked checksums and an offset index.

A record is: length of the payload (u64), masked CRC-32 of those 8 bytes (u32), payload, masked CRC-32
of the payload (u32), and one byte 0x0A. Numbers are little-endian; a masked checksum is the CRC rotated
right by 15 bits plus 0xA282EAD8. The payload is a byte that says whether the document has an id,
that id (i64), the width of the ids in bytes (u8: 2 if all fit, else 4), then the ids. The last byte lets Spark's own text writer put the records into any
store that Spark can write, under its commit protocol: a task that is tried again leaves no torn or
doubled file. Part files in order of their number, and records in order of their place, are the documents
in ascending doc_id order (nulls first).

The index is a table of its own: part, offset, length, doc_id. `read_at` uses it to fetch records in any
order; `read_all` goes through the files and checks both sums of every record.

Results for odd input: a null text is the empty text (its record holds the end id alone); documents with
equal doc_id stand next to each other, each with its own record; an empty table gives no records; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunks import library_encoder, text_slices
from .common import input_partitions, new_path, partition_bases, release_memory, small_batches, stored

HEAD, FOOT, END = 12, 4, b"\n"
FILE_TEXT_BYTES, SLICE_BYTES = 24 << 20, 4 << 20
_encoders: dict = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), END])


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each record, checked."""
    at = 0
    while at < len(content):
        (n,), (sum_,) = struct.unpack_from("<Q", content, at), struct.unpack_from("<I", content, at + 8)
        if masked(content[at : at + 8]) != sum_:
            raise ValueError(f"length checksum differs at {at}")
        payload = content[at + HEAD : at + HEAD + n]
        (sum_,) = struct.unpack_from("<I", content, at + HEAD + n)
        if masked(payload) != sum_ or content[at + HEAD + n + FOOT : at + HEAD + n + FOOT + 1] != END:
            raise ValueError(f"payload checksum differs at {at}")
        yield at, payload
        at += HEAD + n + FOOT + 1


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<?qB", doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = struct.unpack_from("<?qB", payload)
    return (doc_id if has else None), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def encoder(path: str, words: bool):
    """One for each worker process, with what it has met."""
    if (path, words) not in _encoders:
        _encoders[path, words] = library_encoder(path, words)
    return _encoders[path, words]


def framed_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Records, without their last byte, of (doc_id, text). What a slice took is given back before the next one."""
    enc, last = encoder(vocabulary, words), np.array([end_id], np.uint32)
    for b in text_slices(batches, "text", SLICE_BYTES):
        ids, ends = enc.encode(b.column(1))
        out_rows, at = [], 0
        for doc_id, to in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
            out_rows.append(frame(payload_of(doc_id, np.concatenate([ids[at:to], last])))[:-1])
            at = to
        out = pa.RecordBatch.from_arrays([pa.array(out_rows, pa.binary())], names=["frame"])
        del b, ids, ends, out_rows
        yield out
        del out
        release_memory()


def write_token_records(docs: DataFrame, vocabulary: str, out: str, end_id: int, words: bool = True, text_col: str = "text") -> None:
    """Write the records of docs under out/records and the index under out/index."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return framed_batches(batches, vocabulary, end_id, words)

    ordered = (
        docs.select("doc_id", F.col(text_col).alias("text"))
        .repartitionByRange(input_partitions(docs, FILE_TEXT_BYTES), "doc_id")
        .sortWithinPartitions("doc_id")
    )
    framed = ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    framed.write.option("compression", "none").option("maxRecordsPerFile", 0).text(f"{out}/records")  # one plain file a task
    build_index(spark, out)


def _files(spark: SparkSession, out: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/records")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("part"), "content")


def build_index(spark: SparkSession, out: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = [(at, len(p), parse(p)[0]) for at, p in frames(content.as_py())]
                at, n, ids = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(got), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.int64())],
                    names=["part", "offset", "length", "doc_id"],
                )
        release_memory()

    with one_file_a_batch(spark):
        _files(spark, out).mapInArrow(run, "part long, offset long, length long, doc_id long").write.parquet(f"{out}/index")


@contextmanager
def one_file_a_batch(spark: SparkSession) -> Iterator[None]:
    """While it holds, an Arrow batch has one record file, not several."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_at(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """Records at the places of wanted (part, offset and an order column `at`): at, doc_id, ids. The places
    of a file are put together first, so each file is read once, by one task."""
    places = wanted.groupBy("part").agg(F.collect_list(F.struct("offset", "at")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, places_ in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = content.as_py()
                got = []
                for p in places_:
                    (n,) = struct.unpack_from("<Q", data, p["offset"])
                    ((_, payload),) = frames(data[p["offset"] : p["offset"] + HEAD + n + FOOT + 1])
                    got.append((p["at"], *parse(payload)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].astype(np.int64) for g in got], pa.list_(pa.int64()))],
                    names=["at", "doc_id", "ids"],
                )

    return _files(spark, out).join(places, "part").select("content", "places").mapInArrow(run, "at long, doc_id long, ids array<long>")


def read_all(spark: SparkSession, out: str) -> DataFrame:
    """Digest of every record, in the order of the files: part, place, doc_id, upto (ids before it in its
    part), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, before = [], 0
                for place, (_, payload) in enumerate(frames(content.as_py())):
                    doc_id, ids = parse(payload)
                    rows.append((part, place, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["part", "place", "doc_id", "upto", "n_tokens", "ids_crc32"])
        release_memory()

    return _files(spark, out).mapInArrow(run, "part long, place long, doc_id long, upto long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 1, words: bool = True) -> DataFrame:
    """Write docs, read the files back: doc_id, start, n_tokens, ids_crc32 and place of each record."""
    spark = docs.sparkSession
    out = new_path(spark, "token-records")
    write_token_records(docs, vocabulary, out, end_id, words)
    with one_file_a_batch(spark):
        got = stored(read_all(spark, out), "record-digests")
    sums = got.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = partition_bases(sums, "part", "n")  # a row for each file
    return got.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("upto")).alias("start"), "n_tokens", "ids_crc32", "part", "place"
    )
