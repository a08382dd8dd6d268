"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Index: every vector, less the mean of all, is turned by one random rotation and kept as the signs of
its coordinates (packed bits) with two numbers: its length and the inner product of its direction with
its own code. Search: a query, turned alike, is rounded to four-bit steps; bit counts of its four bit
planes under the code give an unbiased estimate of the inner product, with an error bound of ``EPS``
standard errors plus the rounding. A candidate is reranked on the original vectors in double precision
if its upper bound reaches the best ``k``-th exact score known so far.

The queries are held against all codes in waves of ``WAVE`` queries, the only thing sent to tasks; each
task keeps the ``k`` best of a query, and these are merged. Vectors that are null, zero, of another
length than most, or hold null or non-finite parts take no part; nor do null ids. Rows that share a
query's id count as its own row and are no candidates; an id found several times counts once, with its
best score. Ties go to the smaller id. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravox.session import keep

#: Standard errors of the estimate that the bound allows for.
EPS = 2.4
#: Queries of a wave; with 4 kB of numbers each this bounds what is sent to a task.
WAVE = 8192
ROWS = 4096
SEED = 20240


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all parts finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as rows of 64-bit words, length, inner product of direction and code)."""
    r = (x - mean) @ turn
    length = np.sqrt((r * r).sum(1))
    signs = r > 0
    dim = x.shape[1]
    aligned = np.abs(r).sum(1) / (np.sqrt(dim) * np.where(length > 0, length, 1.0))
    packed = np.packbits(np.pad(signs, ((0, 0), (0, -dim % 64))), axis=1, bitorder="little")
    return packed.view(np.uint64), length, np.where(length > 0, aligned, 1.0)


def index(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, np.ndarray]:
    """The written index (id, v, code, length, aligned) of all usable rows, its dimension and mean."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows, 0, np.zeros(0)
    dim = int(sizes.d)
    rows = rows.filter(F.size("v") == dim)
    mean = np.array(rows.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dim)]).alias("m")).first().m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for b in batches:
            if b.num_rows:
                codes, length, aligned = encode(_matrix(b.column(1), dim), mean, turn)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(aligned)],
                    names=["id", "v", "code", "length", "aligned"],
                )

    id_type = df.schema[key].dataType.simpleString()
    return keep(rows.mapInArrow(run, f"id {id_type}, v array<double>, code binary, length double, aligned double"), "ann-index"), dim, mean


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, summed in one fixed order so that equal vectors tie."""
    return (v * q).sum(1)


class Search:
    """The wave of queries that a task holds, and its best candidates so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, k: int, eps: float):
        self.ids, self.v, self.k, self.eps = ids, vectors, k, eps
        dim = vectors.shape[1]
        self.dim = dim
        turned = vectors @ rotation(dim)
        # Four-bit steps per query: turned ~ low + step * level.
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / 15.0, 1e-300)
        level = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, 15).astype(np.uint8)
        self.level_sum = level.sum(1, dtype=np.float64)
        self.planes = [
            np.packbits(np.pad((level >> j) & 1, ((0, 0), (0, -dim % 64))), axis=1, bitorder="little").view(np.uint64) for j in range(4)
        ]
        self.rounding = np.abs(turned - (self.low[:, None] + self.step[:, None] * level)).sum(1) / np.sqrt(dim)
        self.length = np.sqrt((vectors * vectors).sum(1))
        self.shift = vectors @ mean
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, ids.dtype))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)
        self.reranked = 0

    def add(self, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, length: np.ndarray, aligned: np.ndarray) -> None:
        root = np.sqrt(self.dim)
        ones = np.bitwise_count(codes).sum(1, dtype=np.float64)
        spread = length * np.sqrt(np.maximum(0.0, 1.0 - aligned**2)) / aligned / np.sqrt(max(1, self.dim - 1))
        for i in range(len(self.ids)):
            hits = np.zeros(len(ids))
            for j in range(4):
                hits += (1 << j) * np.bitwise_count(codes & self.planes[j][i]).sum(1, dtype=np.float64)
            # <sign code, query> from bit counts: signs are 2 b - 1.
            dot = 2.0 * (self.low[i] * ones + self.step[i] * hits) - (self.low[i] * self.dim + self.step[i] * self.level_sum[i])
            guess = self.shift[i] + length * dot / root / aligned
            upper = guess + self.eps * spread * self.length[i] + length / aligned * self.rounding[i]
            other = ids != self.ids[i]
            if not np.isfinite(self.floor[i]):  # the first k by estimate give a floor to prune with
                at = np.flatnonzero(other)
                at = at[np.argsort(-guess[at], kind="stable")[: self.k]]
                self._take(i, ids[at], exact(self.v[i], v[at]))
            at = np.flatnonzero((upper >= self.floor[i]) & other)
            self.reranked += len(at)
            if len(at):
                self._take(i, ids[at], exact(self.v[i], v[at]))

    def _take(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        s, d = np.concatenate([self.best[i][0], score]), np.concatenate([self.best[i][1], ids])
        order = np.lexsort((d, -s))
        _, first = np.unique(d[order], return_index=True)
        order = order[np.sort(first)][: self.k]
        self.best[i] = (s[order], d[order])
        if len(order) == self.k:
            self.floor[i] = s[order[-1]]

    def result(self) -> tuple[list, list, list]:
        q = np.repeat(self.ids, [len(b[0]) for b in self.best])
        return q, np.concatenate([b[1] for b in self.best]), np.concatenate([b[0] for b in self.best])


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, eps: float = EPS, wave: int = WAVE) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    id_type = df.schema[key].dataType.simpleString()
    out = f"query_id {id_type}, vec_id {id_type}, score double"
    rows, dim, mean = index(df, key, vector)
    empty = spark.createDataFrame([], out)
    found = []
    if dim:
        asked = rows.filter(F.col("id") % every == 0)
        asked = keep(asked.groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
        n_waves = -(-asked.count() // wave)
        for w in range(n_waves):
            # A wave holds about ``wave`` queries whatever their number: a bounded block.
            part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(n_waves)) == w).toPandas().sort_values("id")
            if not len(part):
                continue
            sent = spark.sparkContext.broadcast((part["id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.float64)))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                s = Search(*sent.value, mean, k, eps)
                for b in batches:
                    for i in range(0, b.num_rows, ROWS):
                        c = b.slice(i, ROWS)
                        codes = np.frombuffer(b"".join(c.column(2).to_pylist()), np.uint64).reshape(c.num_rows, -1)
                        s.add(np.asarray(c.column(0), np.int64), _matrix(c.column(1), dim), codes, np.asarray(c.column(3)), np.asarray(c.column(4)))
                q, d, x = s.result()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(x, pa.float64())], names=["query_id", "vec_id", "score"])

            wide = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
            found.append(wide.select(F.col("query_id").cast(id_type), F.col("vec_id").cast(id_type), "score"))
    every_found = reduce(DataFrame.unionByName, found, empty)
    every_found = every_found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
