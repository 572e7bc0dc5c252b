"""Exact top-k inner products by a vector-approximation file.

The approximation file holds, for every vector, a byte a dimension: the number of its cell out of 256 cells of equal
width. With m the middle of a cell and h half its width, an inner product with q lies within q.m -+ h * sum|q|. Two
scans answer a block of queries: the first reads the file alone and gives, for each query, the kth best lower bound
over all rows; the second takes, batch by batch, only rows whose upper bound reaches it, and reads their exact vectors
in the order of that bound (for a similarity, the counterpart of the lower bound on distance) until the kth best score
beats every unread one. Rows stay where they are: a block of queries is broadcast (at most queries_block rows and
block_bytes), and a task returns k rows a query at most, so nothing is shuffled but results. Copies of one vector in a
batch are read once, and of them the k + 1 with the least ids count.

Scores are integers. Components up to a bound that keeps sums below 2 ** 52 are exact in double precision; a vector
with a larger one takes no cells and is scored with whole numbers of any size. A score beyond a long is returned as
the nearest long; the rank goes by the exact one. Other defined cases: vectors that are null, empty, or hold null or
non-finite components take no part. Only vectors of one length meet. A query's own row is no candidate for it, but
further rows of its id are, and every row with a query id is a query of its own, with its own ranks. Ties go to the
smaller id (null last), then either way. A query with no candidate has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

CELLS = 256
LONG = 2**63


def cell_width(low: int, high: int) -> int:
    return max(1, -(-(high - low + 1) // CELLS))


def order_key(score: int) -> str:
    """A string that sorts as the number does, however large."""
    digits = str(abs(score))
    return f"1{len(digits):04d}{digits}" if score >= 0 else f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


class Queries:
    """A block of queries of one length: their rows' numbers and ids, and vectors, large ones apart as lists of int."""

    def __init__(self, rows: list[tuple[int, int, list[int] | None, list[float] | None]], dim: int, scale: float, low: int, width: int):
        self.rid, self.id = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.large = {i: whole(r[3], scale) for i, r in enumerate(rows) if r[2] is None}
        self.x = np.array([r[2] or [0] * dim for r in rows], np.float64).reshape(len(rows), dim)
        self.low, self.width, self.slack = low, width, (width - 1) / 2 * np.abs(self.x).sum(1)
        self.small = np.array([r[2] is not None for r in rows], bool)
        self.floor = np.full(len(rows), -np.inf)

    def centre(self, cells: np.ndarray) -> np.ndarray:
        """The inner product of each query with the middles of cells (numbers less 128)."""
        return self.x @ ((cells.astype(np.float64) + CELLS // 2) * self.width + self.low + (self.width - 1) / 2).T


def whole(raw: list[float], scale: float) -> list[int]:
    return [math.floor(Fraction(v) * Fraction(scale)) for v in raw]


def lists(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lower_bounds(q: Queries, k: int, dim: int, batches: Iterator[pa.RecordBatch], rows: int) -> np.ndarray:
    """(queries, k): the k best lower bounds over all cells of some batches (rid, cells)."""
    best = np.full((len(q.rid), k), -np.inf)
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            reach = q.centre(lists(part.column(1), dim)) - q.slack[:, None]
            reach[q.rid[:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
            both = np.concatenate([best, reach], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    return best


class Found:
    """The k best rows of each query so far, of (score, id, whether it is null, row number)."""

    def __init__(self, q: Queries, k: int):
        self.q, self.k = q, k
        self.best: list[list[tuple]] = [[] for _ in q.rid]

    def add(self, i: int, entries: list[tuple]) -> None:
        """entries: (-score, id is null, id, row number)."""
        self.best[i] = sorted(self.best[i] + entries)[: self.k]

    def kth(self, i: int) -> float:
        return -self.best[i][-1][0] if len(self.best[i]) == self.k else -np.inf

    def read(self, part: pa.RecordBatch, dim: int, step: int = 64) -> None:
        """Takes in a batch (rid, id, cells, x) of rows without large components."""
        q, k = self.q, self.k
        rid, none = part.column(0).to_numpy(), part.column(1).is_null().to_numpy(zero_copy_only=False)
        ids = part.column(1).fill_null(0).to_numpy()
        x = lists(part.column(3), dim)
        # Of copies, the k + 1 least ids: one more than k, as the query's own row may be among them.
        _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * dim))).ravel(), return_inverse=True)
        order = np.lexsort((rid, ids, none, same))
        start = np.flatnonzero(np.concatenate([[True], np.diff(same[order]) != 0]))
        keep = order[np.arange(len(order)) - np.repeat(start, np.diff([*start, len(order)])) <= k]
        rid, none, ids, x = rid[keep], none[keep], ids[keep], x[keep].astype(np.float64)
        upper = q.centre(lists(part.column(2), dim)[keep]) + q.slack[:, None]
        upper[q.rid[:, None] == rid[None, :]] = -np.inf
        floor = np.maximum(q.floor, [self.kth(i) for i in range(len(q.rid))])
        for i in np.flatnonzero(((upper >= floor[:, None]) & (upper > -np.inf)).any(1) & q.small).tolist():
            some = np.flatnonzero((upper[i] >= floor[i]) & (upper[i] > -np.inf))
            some = some[np.argsort(-upper[i, some], kind="stable")]
            for at in range(0, len(some), step):
                if upper[i, some[at]] < self.kth(i):
                    break
                now = some[at : at + step]
                self.add(i, list(zip((-(x[now] @ q.x[i])).astype(np.int64).tolist(), none[now].tolist(), ids[now].tolist(), rid[now].tolist(), strict=True)))

    def compare(self, rows: list[tuple], which: list[int]) -> None:
        """Takes in rows (rid, id, vector as ints) one by one, for some of the queries."""
        for i in which:
            y = self.q.large.get(i) or [int(v) for v in self.q.x[i]]
            self.add(i, [(-sum(map(int.__mul__, y, x)), j is None, j or 0, r) for r, j, x in rows if r != self.q.rid[i]])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, queries_block: int = 16_384, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where is_query holds, the k best other rows by integer inner product
    of floor(scale * x)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    raw = F.transform(vector, lambda v: v.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), raw.alias("raw"), F.coalesce(is_query, F.lit(False)).alias("q")).filter((F.size("raw") > 0) & F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = rows.withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("raw"), "most": F.array_max(F.transform("raw", lambda v: F.abs(v))) * scale})
    limit = F.least(F.lit(1 << 20), F.floor(F.sqrt(F.lit(2.0**51) / F.col("dim")))) - 1
    rows = rows.withColumn("large", F.col("most") > limit).withColumn("x", F.when(~F.col("large"), F.transform("raw", lambda v: F.floor(v * scale).cast("int"))))
    rows = scratch.save(rows.withColumn("raw", F.when(F.col("large"), F.col("raw"))).drop("most"))
    # The approximation file needs the range of all components; the lengths that vectors have are few.
    ranges = rows.groupBy("dim").agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"), F.sum(F.col("q").cast("int")).alias("asked"), F.max("large").alias("some_large")).collect()
    found = []
    for r in sorted(ranges):
        dim, low, width = r["dim"], r["low"] or 0, cell_width(r["low"] or 0, r["high"] or 0)
        if not r["asked"]:
            continue
        mine = rows.filter(F.col("dim") == dim)
        small = scratch.save(mine.filter("not large").select("rid", "id", F.transform("x", lambda v: (F.floor((v - low) / width) - CELLS // 2).cast("byte")).alias("cells"), "x"))
        large = mine.filter("large").select("rid", "id", "raw")
        each = max(1, min(queries_block, block_bytes // (8 * dim)))
        blocks = -(-r["asked"] // each)
        for block in range(blocks):
            asked = mine.filter("q").filter(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == block).select("rid", "id", "x", "raw").collect()  # one block
            if asked:
                parts = _search(spark, Queries([tuple(a) for a in asked], dim, scale, low, width), small, large if r["some_large"] else None, k, dim, scale)
                found += parts if blocks == 1 else [scratch.save(p) for p in parts]
    none = spark.createDataFrame([], FOUND)
    rank = F.row_number().over(Window.partitionBy("asks").orderBy(F.col("place").desc(), F.col("vec_id").asc_nulls_last(), "rid"))
    out = reduce(DataFrame.unionByName, found, none).withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


FOUND = "asks long, query_id long, vec_id long, rid long, score long, place string"


def _search(spark, queries: Queries, small: DataFrame, large: DataFrame | None, k: int, dim: int, scale: float) -> list[DataFrame]:
    """Each task's k best rows of a block of queries, by the two scans."""
    shared = spark.sparkContext.broadcast(queries)
    rows = max(64, (1 << 22) // max(len(queries.rid), dim))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = lower_bounds(q, k, dim, batches, rows)
        i, j = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, j])], ["i", "bound"])

    ranked = small.select("rid", "cells").mapInArrow(first, "i long, bound double").withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy(F.col("bound").desc())))
    for r in ranked.filter(F.col("n") == k).select("i", "bound").collect():  # a number a query of the block
        queries.floor[r["i"]] = r["bound"]
    known = spark.sparkContext.broadcast(queries)

    def result(f: Found) -> pa.RecordBatch:
        q, out = f.q, []
        for i, best in enumerate(f.best):
            out += [(int(q.rid[i]), int(q.id[i]), None if none else j, r, max(-LONG, min(LONG - 1, -s)), order_key(-s)) for s, none, j, r in best]
        kinds = [pa.int64()] * 5 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], ["asks", "query_id", "vec_id", "rid", "score", "place"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Found(known.value, k)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                f.read(part, dim)
                if f.q.large:
                    f.compare([(r, j, x) for r, j, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)], list(f.q.large))
        yield result(f)

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Found(known.value, k)
        for b in batches:
            f.compare([(r, j, whole(x, scale)) for r, j, x in zip(*[c.to_pylist() for c in b.columns], strict=True)], list(range(len(f.q.rid))))
        yield result(f)

    return [small.select("rid", "id", "cells", "x").mapInArrow(second, FOUND)] + ([large.mapInArrow(third, FOUND)] if large is not None else [])


def op5_vector_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON c.r <> q.r AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""
