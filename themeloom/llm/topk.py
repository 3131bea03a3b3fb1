"""Exact top-k by inner product with a table of pivot distances.

Vectors are floor(scale * x) in whole numbers. A bounded sample gives pivots, each far from those
before, and the origin; the distances of every vector to every pivot are computed once. The
triangle inequality turns the largest difference of two vectors' pivot distances into a lower bound
of their distance, and so into an upper bound of their inner product:
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2. Queries meet all candidates in blocks of bounded size on both
sides; within a block each query takes its candidates in order of their bounds and stops when no
bound left reaches its k-th best score. The k best of each block go to one ranking per query.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
without an id; shorter vectors count as padded with zeros; rows that repeat an id are one row, the
least vector; equal vectors of different ids are ranked by id; a query with fewer than k candidates
gets all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import table
from themeloom.runtime import cut

PIVOTS, PIVOT_SAMPLE = 32, 2_000
CANDIDATES, QUERIES, FIRST = 4_096, 1_024, 256


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double> of whole numbers), one row an id."""
    x = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    )
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("e", lambda c: F.floor(c * scale).cast("double"))
    return x.where(~bad).select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column, dim: int | None = None) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dim = int(lens.max(initial=0)) if dim is None else dim
    out = np.zeros((len(lens), dim))
    out[np.arange(dim) < lens[:, None]] = flat
    return out


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Rows far from each other, the origin first, from the first ids in hash order."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    x = matrix(some["v"].combine_chunks()) if some.num_rows else np.zeros((0, 0))
    out = [np.zeros(x.shape[1])]
    near = np.linalg.norm(x, axis=1)
    while len(out) < pivots and near.max(initial=0) > 0:
        out.append(x[int(near.argmax())])
        near = np.minimum(near, np.linalg.norm(x - out[-1], axis=1))
    return np.array(out)


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every row to every pivot."""
    dim = max(x.shape[1], pivots.shape[1])
    x, p = np.pad(x, ((0, 0), (0, dim - x.shape[1]))), np.pad(pivots, ((0, 0), (0, dim - pivots.shape[1])))
    squares = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T
    return np.sqrt(np.maximum(squares, 0))


def best_in_block(qid, q, tq, cid, c, tc, k: int):
    """(query_id, vec_id, score) of the k best candidates of every query of one block."""
    order = np.argsort(cid, kind="stable")
    cid, c, tc = cid[order], c[order], tc[order]
    top = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    exact = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object
    q, c = (q.astype(exact), c.astype(exact)) if exact is not object else (to_int(q), to_int(c))
    sq, sc = tq[:, 0] ** 2, tc[:, 0] ** 2  # the first pivot is the origin
    gap = np.zeros((len(q), len(c)), np.float32)
    a, b = tq.astype(np.float32), tc.astype(np.float32)
    for p in range(a.shape[1]):
        np.maximum(gap, np.abs(a[:, p, None] - b[None, :, p]), out=gap)
    slack = 1e-3 * (1 + np.abs(tq).max(initial=0) + np.abs(tc).max(initial=0))  # single precision and rounding
    gap = np.maximum(gap - np.float32(slack), 0)
    bound = (0.5 * (sq[:, None] + sc[None, :])).astype(np.float32)
    bound += np.float32(1e-6) * bound + np.float32(1)
    bound -= 0.5 * gap * gap
    ids, hits, scores = [], [], []
    for i in range(len(q)):
        own = np.flatnonzero(cid != qid[i])
        seq = own[np.argsort(-bound[i, own])]
        got, val = np.zeros(0, np.int64), np.zeros(0, exact)
        lo, step = 0, FIRST
        while lo < len(seq):
            if len(val) >= k and bound[i, seq[lo]] < val[-1]:
                break
            part = seq[lo : lo + step]
            got, val = np.concatenate([got, part]), np.concatenate([val, c[part] @ q[i]])
            keep = np.lexsort((got, -val))[:k]  # candidates are in order of id
            got, val = got[keep], val[keep]
            lo, step = lo + step, step * 2
        ids += [qid[i]] * len(got)
        hits.append(cid[got])
        scores += [saturated(v) for v in val]
    return ids, np.concatenate(hits) if hits else np.zeros(0, np.int64), scores


def to_int(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)


def saturated(v) -> int:
    return max(-(2**63), min(2**63 - 1, int(v)))


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for every id that ``is_query`` holds for."""
    x = cut(whole_vectors(vectors, scale))
    pivots = choose_pivots(x)
    total = x.agg(F.count("*").alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q")).first()
    nc, nq = math.ceil(total.n / CANDIDATES) or 1, math.ceil(total.q / QUERIES) or 1

    def measured(batches):
        for b in batches:
            t = pivot_table(matrix(b["v"]), pivots)
            yield b.append_column("t", pa.array(list(t), pa.list_(pa.float64())))

    t = cut(x.mapInArrow(measured, "vec_id long, v array<double>, t array<double>"))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(nc)).cast("int").alias("c")
    qblock = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(nq)).cast("int").alias("q")

    def every(n: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    both = t.select("vec_id", "v", "t", F.lit(0).alias("side"), block, every(nq, "q")).unionByName(
        t.where(is_query(F.col("vec_id"))).select("vec_id", "v", "t", F.lit(1).alias("side"), qblock, every(nc, "c"))
    )

    def search(group):
        side = group["side"].to_numpy()
        v, d = matrix(group["v"].combine_chunks()), matrix(group["t"].combine_chunks())
        ids = group["vec_id"].to_numpy()
        q, c = side == 1, side == 0
        a, b, s = best_in_block(ids[q], v[q], d[q], ids[c], v[c], d[c], k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())})

    found = both.groupBy("q", "c").applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 20
"""


def query(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
