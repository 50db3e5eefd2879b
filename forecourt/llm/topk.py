"""Exact top-k inner products by columnar branch-and-bound.

Vectors lie dimension by dimension. Per query and batch, scores are accumulated over
blocks of dimensions; after each block, candidates whose score so far plus the most
that the remaining dimensions can add (the product of the remaining norms) stays
below the k-th best so far are dropped, and the rest is compacted. Queries are handled in
blocks of bounded number against all rows; the k-th best scores among a sample of a block's
own queries are lower bounds with which every task begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
#: Dimensions accumulated between two compactions.
STEP = 16
#: Queries in a block, about; what is broadcast is this many vectors.
QUERIES = 4096
#: Rows handled at once.
ROWS = 8192
#: Queries of a block that give the first lower bounds.
SAMPLE = 512
#: Products of norms below this cannot overflow a long, nor any partial sum.
SAFE = 2.0**62
LEAST, MOST = -(2**63), 2**63 - 1


def _scaled(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dimension-major matrix of x, shorter vectors filled with zeros, that of floor(SCALE * x) as longs, and which vectors take part.

    Numbers beyond 2^62 stand for larger ones there; their vectors are scored by `exact`.
    """
    n = len(column)
    length = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become nan
    row = np.repeat(np.arange(n), np.maximum(length, 0))
    good = length >= 0
    good[row[~np.isfinite(value)]] = False
    place = np.arange(len(value)) - np.repeat(np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0), np.maximum(length, 0))
    plain = np.zeros((max(int(length.max(initial=0)), 1), n))
    keep = good[row]
    plain[place[keep], row[keep]] = value[keep]
    with np.errstate(over="ignore"):
        return plain, np.clip(np.floor(SCALE * plain), -SAFE, SAFE).astype(np.int64), good


def _norms(plain: np.ndarray) -> np.ndarray:
    """Norms of the scaled vectors, rounded up; infinite where squares overflow."""
    with np.errstate(over="ignore"):
        return np.sqrt(((SCALE * np.abs(plain) + 1) ** 2).sum(0)) * (1 + 1e-9)


def exact(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product of floor(SCALE * x) of two vectors in whole numbers of any size, clamped to the range of a long."""
    whole = lambda x: math.floor(SCALE * x) if abs(x) < 2.0**1000 else SCALE * int(x)
    return min(max(sum(whole(x) * whole(y) for x, y in zip(a.tolist(), b.tolist(), strict=False)), LEAST), MOST)


def _rest_norms(matrix: np.ndarray, step: int) -> np.ndarray:
    """For each block of dimensions the norm of all later ones; one column a vector."""
    squares = matrix.astype(np.float64) ** 2
    tail = np.concatenate((np.cumsum(squares[::-1], 0)[::-1], np.zeros((1, matrix.shape[1]))))
    return np.sqrt(tail[np.minimum(np.arange(step, len(matrix) + step, step), len(matrix))])


class Best:
    """The k best of one query: highest score, ties to the smaller id; `least` is a lower bound of the k-th best score, if one is known."""

    def __init__(self, k: int, least: int | None = None):
        self.k, self.least, self.score, self.id = k, least, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self):
        own = self.score[-1] if len(self.score) == self.k else None
        return own if self.least is None or own is not None and own > self.least else self.least

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


class Vectors:
    """Vectors as columns: ids, components, scaled components, norms."""

    def __init__(self, ids: np.ndarray, column: pa.ListArray, dims: int = 0):
        plain, matrix, good = _scaled(column)
        more = ((0, max(0, dims - len(plain))), (0, 0))
        self.ids, self.plain, self.matrix = ids[good], np.pad(plain[:, good], more), np.pad(matrix[:, good], more)
        self.norms = _norms(self.plain)

    def widen(self, dims: int) -> None:
        more = ((0, max(0, dims - len(self.plain))), (0, 0))
        self.plain, self.matrix = np.pad(self.plain, more), np.pad(self.matrix, more)


def search_block(best: list[Best], asked: Vectors, query_rest, rows: Vectors, step: int) -> None:
    """Brings a block of rows into the best of every query; both have as many dimensions."""
    ids, matrix, queries = rows.ids, rows.matrix, asked.matrix
    dims, rest, widest = len(matrix), _rest_norms(matrix, step), rows.norms.max(initial=0)
    for q, found in enumerate(best):
        others = ids != asked.ids[q]
        if not asked.norms[q] * widest < SAFE:
            with np.errstate(over="ignore", invalid="ignore"):
                safe = asked.norms[q] * rows.norms < SAFE
            wide = np.flatnonzero(others & ~safe)
            found.add(np.array([exact(asked.plain[:, q], rows.plain[:, i]) for i in wide], np.int64), ids[wide])
            others &= safe
        alive = np.flatnonzero(others)
        score = np.zeros(len(alive), np.int64)
        for b, at in enumerate(range(0, dims, step)):
            own = queries[at : at + step, q]
            score = score + own @ matrix[at : at + step][:, alive] if len(alive) != matrix.shape[1] else score + own @ matrix[at : at + step]
            if (least := found.floor()) is not None and at + step < dims:
                bound = score + query_rest[b, q] * rest[b, alive] * (1 + 1e-9) + 1
                if not (keep := bound >= least).all():
                    alive, score = alive[keep], score[keep]
                    if not len(alive):
                        break
        if len(alive):
            if (least := found.floor()) is not None:
                keep = score >= least
                alive, score = alive[keep], score[keep]
            found.add(score, ids[alive])


def first_floors(asked: Vectors, k: int) -> list[int | None]:
    """For each query a lower bound of its k-th best score: that among the other queries of a sample. None where the sample is too small."""
    some = np.arange(min(SAMPLE, len(asked.ids)))
    if len(some) <= k:
        return [None] * len(asked.ids)
    out = []
    for q in range(len(asked.ids)):
        others = some[asked.ids[some] != asked.ids[q]]
        if not asked.norms[q] * asked.norms[others].max(initial=0) < SAFE or len(others) < k:
            out.append(None)
        else:
            out.append(int(np.partition(asked.matrix[:, q] @ asked.matrix[:, others], len(others) - k)[len(others) - k]))
    return out


def _search(shared, k: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floors = shared.value
        best, rest = [Best(k, least) for least in floors], None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = Vectors(part.column(0).to_numpy(), part.column(1), len(asked.plain))
                if len(rows.plain) > len(asked.plain):
                    asked.widen(len(rows.plain))
                    rest = None
                rest = _rest_norms(asked.matrix, step) if rest is None else rest
                if len(rows.ids):
                    search_block(best, asked, rest, rows, step)
        n = [len(b.score) for b in best]
        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(asked.ids, n), "vec_id": np.concatenate([np.empty(0, np.int64), *(b.id for b in best)]), "score": np.concatenate([np.empty(0, np.int64), *(b.score for b in best)])})

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, block: int = QUERIES, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, a row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding; others are ignored. Components are floor(1024 * x) and
    scores their integer inner products; missing dimensions count as 0. Rows with a null
    vec_id, or vectors that are null or hold null or non-finite components, take no part.
    Ties go to the smaller vec_id. Rows with a query's own vec_id are not its candidates;
    of a repeated query the smallest vector asks, and repeated candidates each take a
    rank. Scores beyond the range of a long are clamped to it, and tie there. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = written(own.where(F.col("vec_id") % every == 0).where(whole).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    blocks = max(1, -(-asked.count() // block))
    parts = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().sort_by("vec_id")
        lists = part.column(1).combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        queries = Vectors(part.column(0).to_numpy(), lists)
        shared = spark.sparkContext.broadcast((queries, first_floors(queries, k)))
        found = own.mapInArrow(_search(shared, k, step), "query_id long, vec_id long, score long")
        found = found if blocks == 1 else written(found, "found")
        parts = found if parts is None else parts.union(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
