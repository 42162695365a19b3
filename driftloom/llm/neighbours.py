"""Nearest neighbours by a blocked matrix join: int8 tiles bound the distances, survivors are computed exactly."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import map_batches, materialise

#: Bytes of queries that one pass may broadcast; more queries take more passes over the rows.
QUERY_BYTES = 32 << 20
TILE_ROWS, TILE_QUERIES = 4096, 256


def usable(vec: str):
    """Not null, not empty, all components finite and not all zero."""
    v = F.col(vec).cast(ArrayType(DoubleType()))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & fine & F.exists(v, lambda x: x != 0)


class Quantised:
    """Rows as scale * int8 vectors, with the length of what rounding lost."""

    def __init__(self, x: np.ndarray):
        top = np.abs(x).max(axis=1, keepdims=True)
        self.scale = top / 127
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            self.q = np.rint(x / self.scale).astype(np.int8)
            back = self.q * self.scale
            self.error = np.sqrt(((x - back) ** 2).sum(axis=1))
            self.norm2 = (back**2).sum(axis=1)


#: Components whose products of two int8 values float32 adds up exactly: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1024


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of a with all rows of b, int8 values held as float32: half the width, so twice the speed, of double precision."""
    out = a[:, :EXACT] @ b[:, :EXACT].T
    if a.shape[1] > EXACT:
        out = out.astype(np.float64)
        for k in range(EXACT, a.shape[1], EXACT):
            out += a[:, k : k + EXACT] @ b[:, k : k + EXACT].T
    return out


def distance(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distance in double precision, components added in their order."""
    diff = (rows - x).T
    total = np.zeros(rows.shape[0])
    for d in diff * diff:
        total += d
    return np.sqrt(total)


class Searcher:
    """The k nearest rows seen so far, for each of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.coded = Quantised(vectors)
        self.wide = self.coded.q.astype(np.float32)
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in a tile of rows.

        The squared distance of the rounded vectors comes from the int8 products; the true
        distance differs by both rounding errors at most. So a row stays out where even
        its lower bound lies above the k-th distance so far, and all others are computed
        from the original vectors. Where nothing is known yet, the k rows that look
        nearest give a first limit.
        """
        coded = Quantised(rows)
        wide, worst, far = coded.q.astype(np.float32), float(coded.error.max()), float(coded.norm2.max())
        for at in range(0, len(self.ids), TILE_QUERIES):
            part = slice(at, at + TILE_QUERIES)
            with np.errstate(over="ignore", invalid="ignore"):
                d2 = products(self.wide[part], wide) * (-2 * coded.scale[:, 0])
                d2 *= self.coded.scale[part]
                d2 += coded.norm2
                d2 += self.coded.norm2[part, None]
            d2[self.ids[part, None] == ids[None, :]] = np.inf
            limits = np.array([best[-1][0] if len(best) == self.k else self._first_limit(at + i, d2[i], rows) for i, best in enumerate(self.best[part])])
            with np.errstate(over="ignore", invalid="ignore"):
                most = (limits + self.coded.error[part] + worst) ** 2 + 1e-9 * (self.coded.norm2[part] + far)
                live = ~(d2 > most[:, None])  # what overflowed is looked at, too
            for i in np.flatnonzero(live.any(axis=1)).tolist():
                q, some = at + i, np.flatnonzero(live[i])
                some = some[ids[some] != self.ids[q]]
                exact = distance(self.vectors[q], rows[some])
                order = np.lexsort((ids[some], exact))[: self.k]
                tile = [(float(exact[j]), int(ids[some[j]])) for j in order]
                self.best[q] = list(heapq.merge(self.best[q], tile))[: self.k]

    def _first_limit(self, q: int, d2: np.ndarray, rows: np.ndarray) -> float:
        if np.isfinite(d2).sum() < self.k:
            return np.inf
        near = np.argpartition(d2, self.k - 1)[: self.k]
        return float(distance(self.vectors[q], rows[near]).max())


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k nearest rows but its own id: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Exact: a row is dropped only where its lower bound lies above the k-th upper bound.
    Ties go to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite components take no part, as queries or as rows; only queries of the
    same length meet a row. Repeated (id, vector) rows count once as a query; as rows each takes a rank.
    Fewer candidates than k: all of them. Other columns are ignored.

    Ids are integers. Queries go to the workers in blocks of QUERY_BYTES, one after another; each
    worker task reads its rows in tiles and keeps k per query, so what is shuffled is k rows per query and task.
    """
    spark = rows.sparkSession
    pick = lambda df: df.where(usable(vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null")
    lean, asked = pick(rows), pick(queries).distinct()
    found, blocks = [], _query_blocks(asked)
    block = next(blocks, None)
    while block is not None:
        shared, block = spark.sparkContext.broadcast(block), next(blocks, None)

        def tiles(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q_vectors = shared.value
            searcher = Searcher(q_ids, q_vectors, k)
            dim = q_vectors.shape[1]
            for batch in batches:
                sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(sizes == dim))
                for i in range(0, len(batch), TILE_ROWS):
                    tile = batch.slice(i, TILE_ROWS)
                    searcher.add(tile.column(0).to_numpy(), tile.column(1).flatten().to_numpy().reshape(-1, dim))
            near = [(int(q), d, i) for q, best in zip(q_ids, searcher.best, strict=True) for d, i in best]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in near], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "score", "vec_id"])

        part = _nearest(map_batches(lean, tiles, "query_id long, score double, vec_id long"), k)
        if found or block is not None:  # several blocks: one broadcast is alive at a time
            part = materialise(part, "nearest")
            shared.destroy()
        found.append(part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _query_blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries of one length each, in blocks; one block's worth is on the driver at a time."""
    for (dim,) in sorted(asked.select(F.size("v")).distinct().collect()):
        ids, vectors, limit = [], [], max(1, QUERY_BYTES // (9 * dim + 32))
        for r in asked.where(F.size("v") == dim).toLocalIterator():
            ids.append(r.vec_id)
            vectors.append(np.array(r.v))
            if len(ids) == limit:
                yield np.array(ids), np.array(vectors)
                ids, vectors = [], []
        if ids:
            yield np.array(ids), np.array(vectors)
