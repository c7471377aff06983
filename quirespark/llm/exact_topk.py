"""Exact top-k search by inner product: an impact-ordered index, read score at a time.

A posting is a vector's component; its impact is quantised to the power of two above its size. The segments of a shard
are read from the highest impact down, adding each posting's exact product to the score of its vector. What segments
are still unread can add at most the norm of a vector's unread components times that of the query. Reading stops once
these bounds prove that all but a few vectors cannot be among the best k; those few are scored again exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm import textkit as K
from quirespark.llm.rows import keyed
from quirespark.shared import table


def sound(v: Column) -> Column:
    """Whether a vector has components, none of them null or not finite."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) > 0) & good, F.lit(False))


def matrix(lists: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column as rows of a matrix; shorter rows end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    lens = np.diff(ends)
    width = int(lens.max(initial=1))
    out = np.zeros((len(lens), width), dtype)
    out[np.repeat(np.arange(len(lens)), lens), K.ragged_range(np.zeros(len(lens), np.int64), lens)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def best_of_shard(x: np.ndarray, keys: np.ndarray, q: np.ndarray, query_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For whole-number vectors x and queries q: pairs (query row, vector row) that may be among the best k, and scores."""
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    impact = np.frexp(np.abs(x).astype(np.float64))[1]  # |x| < 2 ** impact
    score = np.zeros((len(q), len(x)), kind)
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys[order], query_keys), len(keys) - 1)
    mine = keys[order][at] == query_keys
    own = (np.flatnonzero(mine), order[at[mine]])
    top = int(impact.max(initial=0))
    size = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    possible = np.ones(score.shape, bool)
    possible[own] = False
    k = min(k, len(x))
    for level in range(top, -1, -1):
        segment = np.where(impact == level, x, 0).astype(kind)
        if segment.any():
            score += q.astype(kind) @ segment.T
        unread = np.sqrt((np.where(impact < level, x, 0).astype(np.float64) ** 2).sum(1))
        if level > top - 2 and unread.any():
            continue
        slack = size[:, None] * unread[None, :] * (1 + 1e-6)
        low = score - slack
        low[own] = -np.inf
        proven = np.partition(low, len(x) - k, axis=1)[:, len(x) - k]
        possible = score + slack >= proven[:, None]
        possible[own] = False
        if possible.sum() <= 8 * k * len(q) or not unread.any():
            break
    row, col = np.nonzero(possible)
    exact = np.zeros(len(row), np.int64)
    for lo in range(0, len(row), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        exact[part] = (x[col[part]] * q[row[part]]).sum(1)
    return row, col, exact


def _search(k: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy()
        v, keys, ids = matrix(rows["v"], np.int64), rows["key"].to_numpy(), rows["id"].to_numpy()
        x, q = ~asks, asks
        if not x.any() or not q.any():
            return pa.table({"q": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        row, col, score = best_of_shard(v[x], keys[x], v[q], keys[q], k)
        order = np.lexsort((keys[x][col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        row, col, score = row[keep], col[keep], score[keep]
        return pa.table({"q": keys[q][row], "query_id": ids[q][row], "key": keys[x][col], "vec_id": ids[x][col], "score": score})

    return run


def top_k(vectors: DataFrame, queries: Column | str, k: int = 20, scale: int = 64, shard_rows: int = 8192, query_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that satisfies queries (a condition on id_col): the k best others by whole-number inner product.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id and score; ties go to the smaller id.
    The vectors lie in shards of about shard_rows, the queries in blocks of query_rows; every block meets every shard.

    Vectors that are null, empty, or hold null or non-finite components take no part, neither do rows without an id.
    Vectors of unequal length count as ending in zeros. Rows that repeat an id are further vectors, one of which does
    not exclude the other. An empty table gives an empty result. Further columns are ignored.
    """
    own = keyed(vectors.where(F.col(id_col).isNotNull()), id_col, vector_col)
    whole = F.transform("text", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    own = own.where(sound(F.col("text"))).select("key", F.col("id").cast("long").alias("id"), whole.alias("v"))
    asks = F.expr(queries) if isinstance(queries, str) else queries
    asked = own.withColumnRenamed("id", id_col).where(asks).withColumnRenamed(id_col, "id")
    shards = max(1, -(-own.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    part = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = own.select(part(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "key", "id", "v")
    asking = asked.select(every(shards).alias("shard"), part(blocks).alias("block"), F.lit(True).alias("asks"), "key", "id", "v")
    found = stored.unionByName(asking).groupBy("shard", "block").applyInArrow(_search(k), "q long, query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, scale=64)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
