"""Exact top-k inner products by block-at-a-time pruning.

Vectors of integers are seen as documents over 2 * dims terms: a component adds
its value times the query's, so within a block the most that dimension d can add
is q[d] times the block's largest (q[d] > 0) or smallest (q[d] < 0) component.
Rows are put in an order that keeps like vectors together and cut to blocks of
consecutive rows; each block has its term maxima and a forward index (ids and
components).  For each query, blocks are taken by falling sum of term maxima and
scored through the forward index until no block left can reach the k-th score;
blocks that tie with it are still scored, since ties go to the smaller id.

Spark side: blocks are dealt to shards of a bounded number of rows, queries to
batches of a bounded number; each (shard, batch) pair is one group, so memory is
bounded however many rows there are, and the k best of each pair meet in a
window per query.  Every query has to see every shard, so rows moved are
shards * queries + batches * rows.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part; components beyond 2 ** 53 in size are cut to it and sums wrap as
64-bit integers do; shorter vectors count as filled up with zeros; of rows with
one id the least vector stands for all, or with `every_row` each is a candidate of
the other ids' and a query whose best count together under the id; null ids take no
part; fewer candidates
than k give fewer rows; an empty table gives an empty result; other columns are
passed over.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows of a block, of a shard and of a query batch.
BLOCK_ROWS, SHARD_ROWS, BATCH_QUERIES = 64, 16_384, 1024
LARGEST = 2**53


def quantized(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", every_row: bool = False) -> DataFrame:
    """id, x: floor(scale * component), components as doubles; a row for each id that takes part, or for each such row."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(scale * c).cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST))).cast("bigint"))
    fine = x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole.alias("x"))
    return rows if every_row else rows.groupBy("id").agg(F.min("x").alias("x"))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _smallest_type(x: np.ndarray) -> np.ndarray:
    for t in (np.int8, np.int16, np.int32):
        if x.size == 0 or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max):
            return x.astype(t)
    return x


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * max(1, q.shape[1]) < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return np.einsum("qd,xd->qx", q, x)  # 64-bit integers, wrapping


def block_search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of x for each row of q by block-at-a-time pruning: query positions, ids, scores; and how many (query, block) pairs were scored."""
    starts = np.arange(0, len(ids), block_rows)
    high, low = np.maximum.reduceat(x, starts, axis=0).astype(np.int64), np.minimum.reduceat(x, starts, axis=0).astype(np.int64)
    exact = q.size == 0 or float(np.abs(q).max()) * max(float(np.abs(high).max()), float(np.abs(low).max())) * max(1, q.shape[1]) < 2**53
    # summed term maxima; without exactness every block has to be scored
    bounds = _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low) if exact else np.full((len(q), len(starts)), np.iinfo(np.int64).max)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(q)
    best_score = np.full((n, k), np.iinfo(np.int64).min)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    found = np.zeros(n, np.int64)
    live, scored = np.arange(n), 0
    for step in range(len(starts)):
        block = order[live, step]
        go = (found[live] < k) | (bounds[live, block] >= best_score[live, k - 1])
        live, block = live[go], block[go]
        if not len(live):
            break
        scored += len(live)
        for b in np.unique(block):  # queries that take the same block now share its forward index
            mine = live[block == b]
            rows = slice(starts[b], starts[b] + block_rows)
            scores, row_ids = _product(q[mine], x[rows].astype(np.int64)), ids[rows]
            other = row_ids[None, :] != q_ids[mine][:, None]
            for i, s, o in zip(mine, scores, other):
                if found[i] >= k:
                    o = o & (s >= best_score[i, k - 1])
                if not o.any():
                    continue
                s, d = np.concatenate([best_score[i, : found[i]], s[o]]), np.concatenate([best_id[i, : found[i]], row_ids[o]])
                top = np.lexsort((d, -s))[:k]
                found[i] = len(top)
                best_score[i, : found[i]], best_id[i, : found[i]] = s[top], d[top]
    at = np.arange(k)[None, :] < found[:, None]
    return np.nonzero(at)[0], best_id[at], best_score[at], scored


def _gather(dims: int, like: bool) -> Callable:
    """One group of rows to one row of binary arrays; `like`: in an order that keeps like vectors together."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["x"], dims), pdf["id"].to_numpy(np.int64)
        if like:
            x, ids = _ordered(x, ids)
        x = _smallest_type(x)
        return pd.DataFrame({"no": [key[0]], "ids": [ids.tobytes()], "x": [x.tobytes()], "kind": [x.dtype.str]})

    return run


def _ordered(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like vectors together: the rows are halved along their widest-spread direction again and again."""
    out, todo = [], [np.argsort(ids, kind="stable")]
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK_ROWS:
            out.append(at)
            continue
        y = x[at].astype(np.float64)
        y -= y.mean(axis=0)
        v = y[np.argmax((y * y).sum(axis=1))]
        for _ in range(3):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        order = at[np.argsort(y @ v, kind="stable")]
        half = (len(at) // 2 + BLOCK_ROWS - 1) // BLOCK_ROWS * BLOCK_ROWS
        todo += [order[half:], order[:half]]
    at = np.concatenate(out)
    return x[at], ids[at]


def top_k(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """rows: id, x (as from `quantized`) -> query_id, rank (from 1), id, score; every row but those of the query's id competes."""
    rows = staged(rows)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.count(F.when(is_query, 1)).alias("q")).first()
    dims, shards, batches = max(1, size["dims"] or 1), -(-size["n"] // SHARD_ROWS) or 1, -(-size["q"] // BATCH_QUERIES) or 1
    # rows are hashed evenly to groups of about SHARD_ROWS and BATCH_QUERIES rows
    grouped = lambda d, n, like: staged(d.groupBy(F.pmod(F.xxhash64("id", "x"), F.lit(n)).alias("no")).applyInPandas(_gather(dims, like), "no long, ids binary, x binary, kind string"))
    forward, asked = grouped(rows, shards, True), grouped(rows.where(is_query), batches, False)
    spread = lambda d, own, other, n: d.select(F.col("no").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(other), "ids", "x", "kind")
    left, right = spread(forward, "shard", "batch", batches), spread(asked, "batch", "shard", shards)

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in a.itertuples():
            ids, x = np.frombuffer(s.ids, np.int64), np.frombuffer(s.x, np.dtype(s.kind)).reshape(-1, dims)
            for t in b.itertuples():
                q_ids, q = np.frombuffer(t.ids, np.int64), np.frombuffer(t.x, np.dtype(t.kind)).reshape(-1, dims).astype(np.int64)
                at, found, scores, _ = block_search(q_ids, q, ids, x, k)
                out.append(pd.DataFrame({"query_id": q_ids[at], "id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype("int64")

    part = left.groupBy("shard", "batch").cogroup(right.groupBy("shard", "batch")).applyInPandas(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
