"""Exact top-k search: tiled matrix products of query blocks and shards, partial selection per tile, tree merging.

Vectors are packed into rows of many vectors where they lie. Each shard belongs to one of G groups, query blocks are copied to every group, and a task
multiplies its shards with the blocks one tile at a time. Only k candidates for each query and task leave it; they are merged in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import parts_for

#: Vectors of a shard, and queries of a block; a tile of 2048 x 512 scores takes 8 MB.
SHARD, BLOCK = 2048, 512
#: Above this, products may leave the exact range of doubles and Python integers are used.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def usable(embedding: str = "embedding") -> Column:
    """Not null, not empty, every component present and finite."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))


def quantised(values: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * values.astype(np.float64))


def tile_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; sums beyond LONG are held at its ends."""
    bound = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1]
    if bound < _EXACT:
        return (q @ c.T).astype(np.int64)
    big = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in c], object).T
    return np.clip(big, -_LONG, _LONG).astype(np.int64)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the k highest scores, ties to the smaller id. ids: one row, or as many as score has."""
    ids = np.broadcast_to(ids, score.shape)
    if score.shape[1] > k:
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        # Ties at the k-th score: the smaller ids stay, in two selections without sorting the tile.
        over, tied = score > kth, score == kth
        room = k - over.sum(1)
        tie_ids = np.where(tied, ids, _LONG)
        few = np.partition(tie_ids, k - 1, axis=1)[:, :k]
        few.sort(axis=1)
        limit = few[np.arange(len(few)), np.maximum(room - 1, 0)][:, None]
        keep = over | (tied & (ids <= limit) & (room[:, None] > 0))
        extra = keep.sum(1) > k  # the same id twice
        order = np.flatnonzero(extra)
        for r in order:
            at = np.flatnonzero(keep[r])
            drop = at[np.lexsort((ids[r, at], -score[r, at]))[k:]]
            keep[r, drop] = False
        score, ids = score[keep].reshape(-1, k), ids[keep].reshape(-1, k)
    order = np.lexsort((ids, -score), axis=1)
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _packed(df: DataFrame, rows: int, keep: str) -> DataFrame:
    """(dim, n, ids, data) rows of at most ``rows`` vectors, packed within partitions. keep: SQL predicate on the id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, data = np.concatenate([h[0] for h in held[dim]]), np.concatenate([h[1] for h in held[dim]])
            held[dim] = []
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["dim", "n", "ids", "data"])

        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    x = quantised(flat[starts[at][:, None] + np.arange(dim)])
                    held.setdefault(int(dim), []).append((ids[at], x))
                    if sum(len(h[0]) for h in held[int(dim)]) + rows > rows:
                        yield out(int(dim))
        for dim in held:
            if held[dim]:
                yield out(dim)

    return df.where(keep).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "dim int, n int, ids binary, data binary")


def top_k(embeddings: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's ``k`` best rows, ties to the smaller vec_id.

    ``is_query`` is a SQL predicate on vec_id. Candidates are all rows of the same dimension with another vec_id than the query's own. Rows with a null id, and
    vectors that are null, empty or hold null or non-finite components take no part; a repeated candidate row counts each time, a repeated query once, by its smallest vector (arrays in order of their components). An
    empty table gives no rows; with fewer than k candidates all are returned. Extra columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable())
    n = rows.count()
    groups = parts_for(spark, n, 64 * SHARD)
    shards = _packed(rows, SHARD, "true").withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = _packed(queries, BLOCK, "true").select(F.col("dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    tiles = shards.hint("shuffle_hash").join(blocks, ["g", "dim"]).select("dim", "ids", "data", "q_ids", "q_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out(name: bytes) -> pa.RecordBatch:
            q, s, v = held.pop(name)
            real = v.ravel() != _LONG
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(q, s.shape[1])[real]), pa.array(v.ravel()[real]), pa.array(s.ravel()[real])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for dim, ids, data, q_ids, q_data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                c_id, q_id = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                score = tile_scores(np.frombuffer(q_data, np.float64).reshape(-1, dim), np.frombuffer(data, np.float64).reshape(-1, dim))
                own = q_id[:, None] == c_id
                score[own] = -_LONG
                best, who = best_of(score, np.where(own, _LONG, c_id) if own.any() else c_id, k)
                if q_ids in held:
                    _, s, v = held[q_ids]
                    best, who = best_of(np.concatenate((s, best), 1), np.concatenate((v, who), 1), k)
                held[q_ids] = (q_id, best, who)
                if len(held) > 64:
                    yield out(next(iter(held)))
        for name in list(held):
            yield out(name)

    part = tiles.mapInArrow(run, "query_id long, vec_id long, score long")

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        row = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
        return df.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("best"))

    first = merged(part.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(groups**0.5))))), "query_id", "salt")
    rows2 = first.select("query_id", F.explode("best").alias("b")).select("query_id", F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))
    return merged(rows2, "query_id").select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def pandas_top_k(vectors: dict[int, list[float]], queries: list[int], k: int) -> pd.DataFrame:
    """Plain version for tests."""
    rows = []
    for q in queries:
        a = [int(np.floor(256 * float(x))) for x in vectors[q]]
        scored = sorted((-sum(x * int(np.floor(256 * float(y))) for x, y in zip(a, v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(a))
        rows += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
