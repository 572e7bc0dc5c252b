"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash of their content. A source's target is met by whole epochs over
all its blocks, then by whole blocks in a permuted order as far as they fit, then by documents of one last block in
hash order, so what is taken comes within half a document of the target. The block counts of each (source, epoch) are split among the
output shards by a binary tree: at each node a multivariate hypergeometric draw says how many blocks of each colour
go left. A shard's blocks are then disjoint runs of the permuted order, shuffled within the shard.

Everything random comes from the seed and from hashes of the rows, so reruns agree. The plan needs block sums only:
max_blocks rows at most, whatever the input, and a block a source at least; more sources than max_sources, a million,
raise, as the driver plans them one by one.

Defined cases: a null text has size 0; a null source is a source of its own, last in order. Rows of size 0 and
sources of size 0 take nothing. Repeated rows share a block and a place, and each counts. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, packed, power_of_two

WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> list[float]:
    """Shares of the sum of sizes by weights that repeat along the list, none above most times its own size.

    What a full source can't take is shared by weight among the others, until none is above its limit.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = sum(sizes) - sum(most * sizes[i] for i in range(len(sizes)) if i not in free)
        unit = rest / sum(w[i] for i in free)
        over = {i for i in free if unit * w[i] > most * sizes[i]}
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else unit * w[i]
        free = free - over if over else set()
    return out


def split_tree(colours: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, colours): how many of each colour's blocks each shard gets. shards: a power of two."""
    if shards == 1:
        return colours[None, :]
    left = rng.multivariate_hypergeometric(colours, int(colours.sum()) // 2, method="marginals")
    return np.concatenate([split_tree(left, shards // 2, rng), split_tree(colours - left, shards // 2, rng)])


def plan(blocks: dict[tuple[int, int], int], n_sources: int, per_source: int, shards: int, seed: int) -> tuple[list[float], list[int], list[tuple]]:
    """Targets, sizes, and a row for each (source, block): epochs' shards, and how many words of one more epoch.

    blocks: words by (source, block). The last field of a row is None (no further epoch), or the words to take of
    the block in the last, partial epoch; -1 stands for all of them.
    """
    by: list[dict[int, int]] = [{} for _ in range(n_sources)]
    for (s, b), n in blocks.items():
        by[s][b] = n
    sizes = [sum(x.values()) for x in by]
    goal = targets(sizes)
    orders, colours, rows = [], [], {}
    for s in range(n_sources):
        if not sizes[s]:
            continue
        known = sorted(by[s])
        full = int(goal[s] // sizes[s])
        rest = goal[s] - full * sizes[s]
        for epoch in range(full + 1):
            order = [known[i] for i in np.random.default_rng([seed, s, epoch]).permutation(len(known))]
            if epoch == full:
                taken, over = [], []
                for b in order:
                    if by[s][b] <= rest:
                        rows.setdefault((s, b), [[], None])[1] = -1
                        rest -= by[s][b]
                        taken.append(b)
                    else:
                        over.append(b)
                if over and rest > 0:
                    last = min(over, key=lambda b: by[s][b])
                    rows.setdefault((s, last), [[], None])[1] = int(round(rest))
                    taken.append(last)
                order = taken
            if order:
                orders.append((s, order))
                colours.append(len(order))
    if colours:
        cuts = np.cumsum(split_tree(np.array(colours, np.int64), shards, np.random.default_rng([seed])), axis=0)
        for k, (s, order) in enumerate(orders):
            shard = np.searchsorted(cuts[:, k], np.arange(len(order)), "right")
            for b, at in zip(order, shard.tolist(), strict=True):
                rows.setdefault((s, b), [[], None])[0].append(at)
    return goal, sizes, [(s, b, at, need) for (s, b), (at, need) in rows.items()]


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 20, max_blocks: int = 1 << 20, max_sources: int = 1_000_000, words_per_shard: int = 500_000, carry: bool = False) -> DataFrame:
    """One row for each row of df: key, size, source_size, target, taken, shards (of each copy), place; with carry
    also _row, all of df. A row's copies follow each other through the shards; place orders a shard's rows."""
    return _mix(df, text, key, source, seed, max_blocks, max_sources, words_per_shard, carry)[0]


def _mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 20, max_blocks: int = 1 << 20, max_sources: int = 1_000_000, words_per_shard: int = 500_000, carry: bool = False) -> tuple[DataFrame, int]:
    """mix(), and the number of shards."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    row = packed(df)
    at = {"_id": F.col(f"_row.{key}"), "_source": F.col(f"_row.{source}"), "_size": words(F.col(f"_row.{text}"))}
    rows = row.select(*[c.alias(n) for n, c in at.items()], F.xxhash64(F.lit(seed), F.col(f"_row.{key}"), F.col(f"_row.{text}")).alias("_place"), *["_row"] * carry)
    slim = scratch.save(rows.drop("_row"))
    totals = slim.groupBy("_source").agg(F.sum("_size").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names = sorted((r["_source"] for r in totals if r["_source"] is not None)) + [None] * any(r["_source"] is None for r in totals)
    per_source = min(1024, power_of_two(max(1, max_blocks // max(1, len(names)))) // 2 or 1)
    index = F.broadcast(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "_s int, _name string"))  # max_sources rows
    block = F.pmod(F.shiftrightunsigned("_place", 40), F.lit(per_source)).cast("int").alias("_block")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(index, F.col("_source").eqNullSafe(F.col("_name"))).drop("_source", "_name").withColumn("_block", block)

    blocks = {(r["_s"], r["_block"]): r["n"] for r in placed(slim).groupBy("_s", "_block").agg(F.sum("_size").alias("n")).collect()}  # max_blocks rows
    # The tree's leaves are a table of shards by colours on the driver: 4 million numbers at most.
    shards = min(power_of_two((1 << 21) // (4 * len(names) + 4) + 1), power_of_two(sum(blocks.values()) // words_per_shard + 1))
    goal, sizes, plans = plan(blocks, len(names), per_source, shards, seed)
    planned = F.broadcast(spark.createDataFrame(plans, "_s int, _block int, _shards array<int>, _need long"))  # max_blocks rows
    aims = F.broadcast(spark.createDataFrame([(i, goal[i], sizes[i]) for i in range(len(names))], "_s int, target double, source_size long"))
    # Documents of the one partly taken block of each source: in hash order while the sum stays nearest the words needed.
    partial = placed(slim).join(F.broadcast(spark.createDataFrame([(s, b, need) for s, b, _, need in plans if need is not None and need >= 0], "_s int, _block int, _part long")), ["_s", "_block"])
    upto = F.sum("_size").over(Window.partitionBy("_s", "_block").orderBy("_place", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0))
    chosen = scratch.save(partial.withColumn("_upto", upto).filter("_upto - _size / 2 <= _part").groupBy("_s", "_block").agg(F.max("_place").alias("_last")))
    out = placed(rows if carry else slim).join(planned, ["_s", "_block"], "left").join(F.broadcast(chosen), ["_s", "_block"], "left").join(aims, "_s")
    left_out = (F.col("_need") >= 0) & ~F.coalesce(F.col("_place") <= F.col("_last"), F.lit(False))
    shards_of = F.coalesce(F.when(left_out, F.slice("_shards", 1, F.greatest(F.size("_shards") - 1, F.lit(0)))).otherwise(F.col("_shards")), F.array().cast("array<int>"))
    out = out.withColumn("shards", F.when(F.col("_size") > 0, shards_of).otherwise(F.array().cast("array<int>")))
    return out.select(F.col("_id").alias(key), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.size("shards")).alias("taken"), "shards", F.col("_place").alias("place"), *["_row"] * carry), shards


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: df's rows, each as often as it is taken, gathered by shard and shuffled within it."""
    out, shards = _mix(df, carry=True, **options)
    each = out.select("_row", "place", F.posexplode("shards").alias("_epoch", "_shard"))
    # As many partitions as shards at least, so that few shards meet in one.
    tasks = max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return each.repartition(tasks, "_shard").sortWithinPartitions("_shard", F.xxhash64("place", "_epoch")).select("_row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
