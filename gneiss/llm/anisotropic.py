"""Nearest neighbours by inner product, with score-aware anisotropic quantisation.

Vectors are cut into subspaces of few dimensions; in each, a four-bit code names one of 16 centres. For a
query that a vector answers well, the part of the quantisation error that is parallel to the vector changes
the score most, so codebooks and codes minimise  w * |parallel error|^2 + |orthogonal error|^2  with
w = (d - 1) * T^2 / (1 - T^2), where T is the cosine above which scores matter. Codes are assigned by
coordinate descent over subspaces (the parallel error couples them), centres by solving the weighted least
squares that the codes give. The codebooks are fitted on a bounded, stated sample (the vectors with the
smallest hashes of their id); every vector is encoded and indexed.

A search goes through the codes of all vectors: two four-bit codes make one byte, so each query has one
table of 256 sums for each two subspaces. The vectors of the `rerank` codes of a block that are best by these
sums, and of all that tie with the last, are scored exactly, in double precision, on the original vectors; so a
group of copies is scored as a whole and takes one place. Each task passes on the k best of each query, and the
last step ranks those. Queries are taken in chunks of bounded size, each of which goes out with its job, and each
job adds its part to one table; the search is the stated query set against all rows, in blocks, and never a join of
all pairs.

Results for odd input: rows with a null id, and vectors that are null, empty, zero, of another dimension than most of the sample, or
that hold a null or a component that isn't finite take no part; equal vectors tie and rank by vec_id, repeated
rows of one vec_id are one vector of the index each, and one query with k neighbours of its own each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import new_path, stored

CENTRES = 16
SAMPLE = 20_000
QUERY_BYTES = 4 << 20  # of a chunk of queries, in double precision
ROWS_AT_ONCE = 4096
TABLES_AT_ONCE = 64  # queries whose tables of sums a task holds
FOUND = "query long, query_id long, vec_id long, score double"


def parallel_weight(dimension: int, threshold: float) -> float:
    return max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    """centres: subspace x 16 x dimensions of a subspace, of zero-padded unit vectors."""

    def __init__(self, centres: np.ndarray, weight: float, dimension: int):
        self.centres, self.weight, self.dimension = centres, weight, dimension

    @property
    def parts(self) -> int:
        return len(self.centres)

    def cut(self, x: np.ndarray) -> np.ndarray:
        width = self.parts * self.centres.shape[2]
        padded = np.zeros((len(x), width), np.float64)
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), self.parts, -1)

    def codes(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows x subspaces) of vectors, by coordinate descent on the anisotropic loss."""
        cut = self.cut(x)
        norm2 = (cut**2).sum((1, 2))
        # Each residual r of a subspace costs |r|^2, and all together (w - 1) * (r . x)^2 / |x|^2.
        own = ((cut[:, :, None, :] - self.centres[None]) ** 2).sum(3)
        along = ((cut[:, :, None, :] - self.centres[None]) * cut[:, :, None, :]).sum(3)
        codes = own.argmin(2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        factor = (self.weight - 1) / norm2
        for _ in range(rounds):
            for m in range(self.parts):
                rest = total - along[rows, m, codes[:, m]]
                cost = own[:, m] + factor[:, None] * (rest[:, None] + along[:, m]) ** 2
                codes[:, m] = cost.argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def fitted(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Move the centres to the weighted least-squares solution for these codes, subspace by subspace."""
        cut = self.cut(x)
        norm2 = (cut**2).sum((1, 2))
        factor = (self.weight - 1) / norm2
        for m in range(self.parts):
            residual = cut - self.centres[np.arange(self.parts)[None], codes]
            rest = (residual * cut).sum((1, 2)) - (residual[:, m] * cut[:, m]).sum(1)
            full = (cut[:, m] ** 2).sum(1) + rest
            for c in range(CENTRES):
                of = codes[:, m] == c
                if of.any():
                    v, f = cut[of, m], factor[of]
                    left = np.eye(v.shape[1]) * of.sum() + (v * f[:, None]).T @ v
                    right = v.sum(0) + (v * (f * full[of])[:, None]).sum(0)
                    self.centres[m, c] = np.linalg.solve(left, right)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x byte columns x 256: what two codes of a byte add to the score."""
        parts = np.einsum("qmd,mcd->qmc", self.cut(queries), self.centres)
        if self.parts % 2:
            parts = np.concatenate([parts, np.zeros((len(parts), 1, CENTRES))], 1)
        low, high = parts[:, 0::2], parts[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(parts), -1, 256).astype(np.float32)

    def packed(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.uint8)
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        return codes[:, 0::2] | codes[:, 1::2] << 4


def train(sample: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Quantiser:
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1]
    parts = -(-dimension // width)
    q = Quantiser(np.zeros((parts, CENTRES, width)), parallel_weight(dimension, threshold), dimension)
    cut = q.cut(sample)
    picks = rng.choice(len(sample), CENTRES, replace=len(sample) < CENTRES)
    q.centres[:] = cut[picks].transpose(1, 0, 2)
    weight, q.weight = q.weight, 1.0
    for i in range(rounds):
        if i == rounds // 2:
            q.weight = weight  # plain quantisation first, then the anisotropic loss
        q.fitted(sample, q.codes(sample))
    return q


def _dense(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, rows it has) of the vectors that take part."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    d = dimension or (int(np.bincount(lengths).argmax()) if len(lengths) else 0)
    rows = np.flatnonzero((lengths == d) & (d > 0))
    starts = np.cumsum(lengths) - lengths
    x = flat[starts[rows, None] + np.arange(d)] if len(rows) else np.zeros((0, d))
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[good], rows[good]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = F.col(id_col).isNotNull() & whole & finite & F.exists(v, lambda x: x != 0)
    return vectors.where(known).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def build_index(vectors: DataFrame) -> tuple[DataFrame, Quantiser | None]:
    """vectors (vec_id, vector) -> (vec_id, vector, code), stored, and the quantiser that made the codes."""
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # a top-k of bounded size
    sample, _ = _dense(picked.column("vector").combine_chunks())
    if not len(sample):
        return vectors, None
    q = train(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, rows = _dense(b.column(1), q.dimension)
            packed = [r.tobytes() for r in q.packed(q.codes(x))]
            own = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(packed, pa.binary())], names=["vec_id", "vector", "code"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return stored(vectors.mapInArrow(run, f"vec_id long, vector {kind}, code binary"), "vector-index"), q


def _search_blocks(q: Quantiser, first: int, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
    """A task's search: keeps, for each query, the k best of what it has seen. Queries are numbered from `first`,
    as several may have one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids = np.full((len(ids), k), -1, np.int64)
        best = np.full((len(ids), k), -np.inf)
        held: list[pa.RecordBatch] = []

        def look(block: pa.Table) -> None:
            x, _ = _dense(block.column("vector").combine_chunks(), q.dimension)
            vec = block.column("vec_id").to_numpy()
            codes, kind = np.unique(np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(vec), -1), axis=0, return_inverse=True)
            codes, kind = np.ascontiguousarray(codes.T), kind.ravel()
            for i in range(len(ids)):
                if i % TABLES_AT_ONCE == 0:
                    tables = q.tables(queries[i : i + TABLES_AT_ONCE])
                table = tables[i % TABLES_AT_ONCE]
                rough = table[0][codes[0]]
                for m in range(1, len(codes)):
                    rough = rough + table[m][codes[m]]
                # The cut is between codes: all vectors of a code, and all codes that tie at the cut, stay together.
                cut = -np.partition(-rough, rerank - 1)[rerank - 1] if rerank < len(rough) else -np.inf
                near = np.flatnonzero((rough >= cut)[kind])
                near = near[vec[near] != ids[i]]
                exact = (x[near] * queries[i]).sum(1)
                all_ids, all_scores = np.concatenate([best_ids[i], vec[near]]), np.concatenate([best[i], exact])
                top = np.lexsort((all_ids, -all_scores))[:k]
                best_ids[i], best[i] = all_ids[top], all_scores[top]

        def blocks() -> Iterator[pa.Table]:
            rows = 0
            for b in batches:
                held.append(b)
                rows += b.num_rows
                if rows >= ROWS_AT_ONCE:
                    yield pa.Table.from_batches(held)
                    held.clear()
                    rows = 0
            if rows:
                yield pa.Table.from_batches(held)

        for block in blocks():
            look(block)
        found = np.isfinite(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(x, k)[found.ravel()]) for x in (np.arange(first, first + len(ids)), ids)] + [pa.array(best_ids[found]), pa.array(best[found])],
            names=["query", "query_id", "vec_id", "score"],
        )

    return run


def search(index: DataFrame, q: Quantiser, queries: DataFrame, k: int = 20, rerank: int = 200) -> DataFrame:
    """The k nearest found of each query (vec_id, vector) but itself: query_id, rank, vec_id, score.
    rerank: distinct codes whose vectors are scored exactly for each query in each block of ROWS_AT_ONCE vectors."""
    spark = index.sparkSession
    size = max(TABLES_AT_ONCE, QUERY_BYTES // (8 * q.dimension))
    folder = new_path(spark, "near")
    chunk: list = []
    done = 0

    def search_chunk() -> None:
        nonlocal done
        own = np.array([r.vec_id for r in chunk], np.int64)
        x = np.array([r.vector for r in chunk], np.float64)
        found = index.select("vec_id", "vector", "code").mapInArrow(_search_blocks(q, done, own, x, k, rerank), FOUND)
        found.write.mode("append").parquet(folder)
        done += len(chunk)
        chunk.clear()

    for row in queries.select("vec_id", "vector").toLocalIterator(prefetchPartitions=True):
        if len(row.vector) == q.dimension:
            chunk.append(row)
        if len(chunk) == size:
            search_chunk()
    if chunk:
        search_chunk()
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = spark.read.schema(FOUND).parquet(folder)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, rerank: int = 200) -> DataFrame:
    """Queries: the vectors whose id is divisible by `every`; candidates: all other vectors."""
    index, q = build_index(usable(vectors, id_col, vector_col))
    if q is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, q, index.where(F.col("vec_id") % every == 0), k, rerank)
