"""Exact nearest neighbours by a block matrix join over int8 tiles.

Vectors are scaled to unit length and quantised to int8 with one scale a row. The product of two int8
tiles (exact in float32 for up to 1,024 dimensions at a time) times both scales is a cosine within a
known bound: with x = x' + e, |x.y - x'.y'| <= |x'| |e_y| + |e_x| |y|. A pair survives only if its upper
bound reaches the query's k-th best lower bound so far, from its heap; survivors are recomputed in
double precision on the original vectors and pushed on the heap. Nothing that could be among the k
nearest is cut off, so the result equals brute force, ties included.

Vectors are first divided by the power of two of their largest component. That changes no bit of a
cosine where nothing under- or overflows, and keeps norms of components such as 1e-200 or 1e200 finite.

Scale: queries are taken in blocks of about ``BLOCK_BYTES`` (a hash of vec_id says which block), whatever their
dimension, and a block goes to all tasks; candidates are never shuffled or replicated. Each task keeps the
heaps of one block and sends k rows a query; a window by query with a pushed-down group limit merges
them. More queries mean more passes over the candidates, each with the same memory: exact search costs
queries times candidates, 2 * dimensions operations each (a core does about 2e10 a second).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Bytes of a block of queries, about: 8 for a component and 5 for its codes and products.
BLOCK_BYTES, COMPONENT_BYTES = 32 << 20, 13
#: Candidates and queries of a tile.
TILE = 2_048
TILE_QUERIES = 1_024
#: Relative slack for rounding in float32 and in the bounds.
SLACK = 1e-5


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products in double precision, summed left to right."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two that brings their largest component to 0.5 up to 1; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines of double vectors that are scaled(); the one definition of the result's score."""
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


class Quantised:
    """int8 codes of scaled() vectors at unit length, with scales, code norms and error norms."""

    def __init__(self, x: np.ndarray) -> None:
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        if not (np.isfinite(length) & (length > 0)).all():
            raise ValueError("a vector without a finite direction")
        unit = x / length[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127.0
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.norm = np.sqrt(np.einsum("ij,ij->i", near, near)) * (1 + SLACK)
        rest = unit - near
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) * (1 + SLACK) + 1e-12


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 tile product as float64; float32 sums of 1,024 products of int8 are exact."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


class Heaps:
    """The k best (score, then smaller id) of each query, as sorted rows."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def push(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates of many queries at once."""
        k = self.score.shape[1]
        rows = np.unique(query)
        q = np.concatenate([query, np.repeat(rows, k)])
        s = np.concatenate([score, self.score[rows].ravel()])
        i = np.concatenate([ids, self.id[rows].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, rows)
        take = first[:, None] + np.arange(k)[None, :]
        self.score[rows], self.id[rows] = s[take], i[take]

    def floor(self) -> np.ndarray:
        return self.score[:, -1]


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", block: int = BLOCK_BYTES) -> DataFrame:
    """The k rows of ``vectors`` (vec_id, embedding) nearest to each of ``queries`` (same columns).

    Returns query_id, rank (from 1), vec_id, score. Rows with a query's own vec_id are no candidates of
    it. Vectors that usable() rejects, and rows without an id, take no part; only vectors of the
    query's dimension are compared with it. Every other finite vector takes part, however small or large its
    components. Of query rows with the same id the smallest vector is taken; candidate rows that repeat an id each count. Fewer candidates than k give fewer rows.
    """
    spark = vectors.sparkSession
    own = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(vector)).select("vec_id", F.col(vector).cast("array<double>").alias("v"))
    asked = own(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(asked, "ann-queries")
    size = asked.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    passes = max(1, -(-size * COMPONENT_BYTES // block))
    candidates = own(vectors)
    found = None
    for at in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == at) if passes > 1 else asked
        sent = spark.sparkContext.broadcast(_packed(part))  # about ``block`` bytes
        out = candidates.mapInArrow(_scan(sent, k), "query_id bigint, vec_id bigint, score double")
        if passes > 1:
            out = written(out, "ann-pass")
        found = out if found is None else found.unionByName(out)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(part: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a block of queries by dimension."""
    by: dict[int, list] = {}
    for vec_id, v in part.sort("vec_id").toLocalIterator():
        by.setdefault(len(v), []).append((vec_id, v))
    return {d: (np.array([r[0] for r in rows], np.int64), scaled(np.array([r[1] for r in rows], np.float64))) for d, rows in by.items()}


def _scan(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {d: (ids, v, Quantised(v), Heaps(len(ids), k)) for d, (ids, v) in sent.value.items()}
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype(np.int64)
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths()).astype(np.int64)
            flat, ends = np.asarray(lists.flatten()), np.cumsum(lengths)
            for d in np.unique(lengths).tolist():
                if d not in by:
                    continue
                rows = np.flatnonzero(lengths == d)
                for i in range(0, len(rows), TILE):
                    own = rows[i : i + TILE]
                    _tile(by[d], ids[own], scaled(flat[(ends[own] - d)[:, None] + np.arange(d)[None, :]]))
        for ids, _, _, heaps in by.values():
            q, j = np.nonzero(heaps.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(heaps.id[q, j]), pa.array(heaps.score[q, j])], names=["query_id", "vec_id", "score"])

    return run


def _tile(queries: tuple, ids: np.ndarray, x: np.ndarray) -> None:
    """One tile of candidates against all queries of the block, in tiles of queries."""
    own, v, qs, heaps = queries
    cs, k = Quantised(x), heaps.score.shape[1]
    for a in range(0, len(own), TILE_QUERIES):
        b = min(a + TILE_QUERIES, len(own))
        near = product(qs.codes[a:b], cs.codes) * qs.scale[a:b, None] * cs.scale[None, :]
        bound = qs.norm[a:b, None] * cs.error[None, :] + qs.error[a:b, None] + 1e-9
        low = near - bound
        low[own[a:b, None] == ids[None, :]] = -np.inf
        high = near + bound
        high[own[a:b, None] == ids[None, :]] = -np.inf
        least = heaps.floor()[a:b]
        if len(ids) > k:
            # k candidates of this tile are at least that near
            least = np.maximum(least, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
        q, c = np.nonzero((high >= least[:, None]) & (high > -np.inf))
        for i in range(0, len(q), 1 << 17):
            qq, cc = q[i : i + (1 << 17)], c[i : i + (1 << 17)]
            heaps.push(qq + a, cosine(v[a + qq], x[cc]), ids[cc])


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of ``embeddings`` to each row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = nearest(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP8_SQL = r"""
WITH u AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
m AS (SELECT vec_id, v, pow(2.0, floor(log2(list_max(list_transform(v, lambda x: abs(x)))))) AS p FROM u),
e AS (SELECT vec_id, list_transform(v, lambda x: x / p) AS v FROM m),
n AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS l FROM e),
a AS (SELECT vec_id, min(v) AS v FROM u WHERE vec_id % 50 = 0 GROUP BY vec_id),
q AS (SELECT vec_id, list_transform(v, lambda x: x / p) AS v FROM (SELECT *, pow(2.0, floor(log2(list_max(list_transform(v, lambda x: abs(x)))))) AS p FROM a)),
s AS (
  SELECT q.vec_id AS query_id, n.vec_id,
    list_reduce(list_transform(list_zip(q.v, n.v), lambda p: p[1] * p[2]), lambda a, b: a + b)
      / (sqrt(list_reduce(list_transform(q.v, lambda x: x * x), lambda a, b: a + b)) * n.l) AS score
  FROM q JOIN n ON q.vec_id <> n.vec_id AND len(q.v) = len(n.v)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
