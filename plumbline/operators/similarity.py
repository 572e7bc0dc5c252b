"""Cosine neighbours of a stated query set, and votes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import saved


def _unit(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a batch (id, vector)."""
    v = b.column(1).flatten().to_numpy().reshape(-1, dim)
    return b.column(0).to_numpy(), v / np.sqrt((v * v).sum(1))[:, None]


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best of (query, id, score), ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff([*start, len(q)]))
    return order[rank < k]


def cosine_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 3, max_queries: int | None = None, block: int = 10_000, block_bytes: int = 32 << 20) -> DataFrame:
    """(query, rank, id, cosine): the k nearest other vectors of each query, ties (to 9 places) to the smaller id.

    Keys are whole numbers. Null vectors, those with null components and those of no length take no part; only vectors
    of one length meet. Queries are taken in blocks of block rows and block_bytes at most, each broadcast to one scan
    of all vectors: a matrix product a batch, and k rows a query and task are all that is shuffled. Over a stated
    max_queries it raises.
    """
    n = queries.count()
    if max_queries is not None and n > max_queries:
        raise ValueError(f"more than {max_queries} queries")
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform(vector, lambda x: x.cast("double"))
        rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()) & F.exists("v", lambda x: x != 0))
        return rows.withColumn("dim", F.size("v"))

    rows, asked = clean(vectors), clean(queries)
    parts = []
    for dim, many in sorted(map(tuple, asked.groupBy("dim").count().collect())):  # the lengths that vectors have
        each = max(1, min(block, block_bytes // (8 * dim)))
        blocks = -(-many // each)
        mine = asked.filter(F.col("dim") == dim).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        for i in range(blocks):
            q = pa.RecordBatch.from_pylist([{"id": r["id"], "v": r["v"]} for r in mine.filter(F.col("b") == i).collect()], pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))]))  # one block
            if q.num_rows:
                found = rows.filter(F.col("dim") == dim).select("id", "v").mapInArrow(_scan(spark.sparkContext.broadcast(_unit(q, dim)), dim, k), "query long, id long, cosine double")
                parts.append(found if blocks == 1 else saved(found))
    none = spark.createDataFrame([], "query long, id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("cosine", 9).desc(), "id"))
    out = reduce(DataFrame.unionByName, parts, none).withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select(F.col("query").cast(kind).alias("query"), "rank", F.col("id").cast(kind).alias("id"), "cosine")


def _scan(shared, dim: int, k: int):
    """A task's k best rows of each query of a block, which is all it returns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        query, found, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least = np.full(len(own), -np.inf)
        rows = max(16, (1 << 22) // len(own))
        for b in batches:
            for at in range(0, b.num_rows, rows):
                ids, v = _unit(b.slice(at, rows), dim)
                near = np.round(q @ v.T, 9)
                near[own[:, None] == ids[None, :]] = -np.inf
                if len(ids) > k:  # at most the k best of this slice, and what ties with the kth
                    least_here = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    least_here = np.full(len(own), -np.inf)
                i, j = np.nonzero((near >= np.maximum(least, least_here)[:, None]) & (near > -np.inf))
                query, found, score = np.concatenate([query, i]), np.concatenate([found, ids[j]]), np.concatenate([score, near[i, j]])
                top = _best(query, found, score, k)
                query, found, score = query[top], found[top], score[top]
                full = np.bincount(query, minlength=len(own)) >= k
                worst = np.full(len(own), np.inf)
                np.minimum.at(worst, query, score)
                least = np.where(full, worst, -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(found), pa.array(score)], ["query", "id", "cosine"])

    return work


def vote(df: DataFrame, by: str, choice: str) -> DataFrame:
    """(by, choice, n): the most frequent choice of each key, ties to the least choice."""
    counts = df.filter(F.col(choice).isNotNull()).groupBy(by, choice).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(choice).alias("c"))).alias("m")).select(by, F.col("m.c").alias(choice), (-F.col("m.n")).alias("n"))
