"""Connected components over links: contraction in bounded blocks, then alternating large and small stars.

Tasks first contract blocks of at most `block` links by union and find, which leaves a star a component and block. If
all links fit one block, that is the answer. Otherwise stars of different blocks are joined, wholly in DataFrames, by
rounds of large and small stars, of which contracted links need few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


def stars(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The least node of its component for every node of some links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's links (u, v) as links of each node with its component's least node."""

    def pairs() -> Iterator[tuple[int, int]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

    found = {x: r for x, r in stars(pairs()).items() if x != r}
    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["u", "v"])


def _star(scratch: Scratch, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m): m is the least of u and its neighbours; and the table of minima, to be dropped after use.

    Minimum first, then a join, so no node's list is gathered. The minima are written first, which leaves plain
    exchanges on both sides of the join: adaptive execution can split the rows of a node with many links.
    """
    least = scratch.save(pairs.groupBy("u").agg(F.min("v").alias("m")))
    return pairs.hint("merge").join(least.hint("merge"), "u").withColumn("m", F.least("u", "m")), least


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(scratch: Scratch, links: DataFrame, rounds: int = 60, block: int = 1 << 18) -> DataFrame:
    """(node, label) of every node of links (u, v, both long): label is the least node of its component.

    Each round writes its links to the shared folder; the number of rounds grows with the logarithm of the longest
    path. Raises if they don't settle in the given rounds, rather than return halves of components.
    """
    first = scratch.save(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    blocks = -(-first.count() // block)
    # coalesce moves no rows: a task reads the written links of several others, block of them on average.
    now = scratch.save(first.coalesce(max(1, blocks)).mapInArrow(_contract, "u long, v long"))
    scratch.drop(first)
    mark = _mark(now) if blocks > 1 else (0,)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, most = _star(scratch, both)
        large = scratch.save(large.filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small, least = _star(scratch, large)
        step = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        then = scratch.save(step)
        scratch.drop(now, large, most, least)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
