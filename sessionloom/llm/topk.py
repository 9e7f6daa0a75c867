"""Exact top-k inner-product search by MaxScore."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.base import stash, table
from sessionloom.llm.vectors import matrix, usable

_EXACT = float(1 << 53)


def maxscore(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, own: int, block: int = 2048, chunk: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best rows for one query; rows stand in id order.

    A term's score over its lowest in the shard is at most its range. Terms are taken by falling range:
    the trailing ones whose ranges together cannot lift a row from the lowest score to the
    threshold are non-essential. The essential ones are traversed for all rows of a block,
    the others are probed a few at a time, only for rows that can still reach the k-th best.
    """
    ends = np.stack([query * high, query * low])
    top, floor = ends.max(0), ends.min(0)
    order = np.argsort(floor - top, kind="stable")
    gain = (top - floor)[order]
    rest_top = np.append(np.cumsum(top[order][::-1])[::-1], 0)
    rest_gain = np.append(np.cumsum(gain[::-1])[::-1], 0)
    best_at, best = np.empty(0, np.int64), np.empty(0, rows.dtype)
    for start in range(0, len(rows), block):
        part = rows[start : start + block]
        bound = best[-1] if len(best) == k else None
        essential = len(order) if bound is None else int(np.argmax(rest_gain <= bound - floor.sum()))
        terms = order[:essential]
        alive = np.nonzero(ids[start : start + block] != own)[0]
        scores = (part[:, terms] @ query[terms])[alive]
        while essential < len(order):
            keep = scores + rest_top[essential] > bound  # rows come in id order, so a tie with the k-th best loses
            alive, scores = alive[keep], scores[keep]
            terms = order[essential : essential + chunk]
            if len(alive):
                scores = scores + part[np.ix_(alive, terms)] @ query[terms]
            essential += len(terms)
        at, got = np.concatenate([best_at, alive + start]), np.concatenate([best, scores])
        first = np.lexsort((ids[at], -got))[:k]
        best_at, best = at[first], got[first]
    return best_at, best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query with all other rows.

    Both tables have (vec_id long, v array<long>). Rows are dealt to shards and queries to blocks by
    a hash of the id; each pair of a shard and a block is one bounded task; the shards' lists are merged
    with a window over at most k rows a shard. Ties go to the smaller id. Vectors of unequal lengths are compared
    over the shorter one's components. Rows with a null id take no part and repeated rows count
    once; fewer than k candidates give fewer rows; no queries or no rows give an empty result.
    """
    vectors = stash(vectors.where("vec_id is not null").select("vec_id", "v").distinct())
    queries = stash(queries.where("vec_id is not null").select("vec_id", "v").distinct())
    shards, blocks = -(-vectors.count() // shard_rows), -(-queries.count() // query_rows)
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    left = queries.withColumn("block", place(1, blocks)).withColumn("shard", every(shards))
    right = vectors.withColumn("shard", place(2, shards)).withColumn("block", every(blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return schema.empty_table()
        ids = c.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        qs, rows = matrix(q.column("v")), matrix(c.column("v"))[order]
        ids, width = ids[order], min(qs.shape[1], rows.shape[1])
        qs, rows = qs[:, :width], rows[:, :width]
        if width and float(np.abs(qs).max()) * float(np.abs(rows).max()) * width * 4 < _EXACT:
            qs, rows = qs.astype(np.float64), rows.astype(np.float64)  # exact, and faster
        high, low = (rows.max(0), rows.min(0)) if width else (rows, rows)
        out: list[np.ndarray] = []
        for own, query in zip(q.column("vec_id").to_numpy(), qs):
            at, score = maxscore(query, ids, rows, high, low, k, own) if width else (np.nonzero(ids != own)[0][:k], np.zeros(k, np.int64))
            out.append(np.stack([np.full(len(at), own), ids[at], score[: len(at)].astype(np.int64)]))
        return pa.table([pa.array(x) for x in np.concatenate(out, axis=1).astype(np.int64)], schema=schema)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double"))).alias("v"))
    return top_k(whole, whole.where(F.col("vec_id") % 100 == 0))


OP2_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
