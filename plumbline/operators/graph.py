"""Triples, nodes, edges, lookups and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import saved


def triples(df: DataFrame, subject: str, predicates: dict[str, str]) -> DataFrame:
    """(s, p, o) for each row and named column; predicates maps column to predicate. Null values give no triple."""
    cast = df.select(F.col(subject).cast("string").alias("s"), *[F.col(c).cast("string").alias(p) for c, p in predicates.items()])
    return cast.unpivot(["s"], list(predicates.values()), "p", "o").filter("o is not null")


def nodes(t: DataFrame, label: str) -> DataFrame:
    """One node a subject with its properties as a map; the least object wins where a predicate repeats."""
    one = t.groupBy("s", "p").agg(F.min("o").alias("o"))
    return one.groupBy(F.col("s").alias("id")).agg(F.lit(label).alias("label"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("props"))


def edges(resolved: DataFrame) -> DataFrame:
    """(src, rel, dst, value) of resolved dimensions (from, to, value)."""
    return resolved.select(F.col("from").alias("src"), F.lit("distance").alias("rel"), F.col("to").alias("dst"), F.col("value").cast("double").alias("value"))


def lookup(n: DataFrame, label: str, **props: str) -> DataFrame:
    """Nodes of a label whose properties have these values."""
    out = n.filter(F.col("label") == label)
    for k, v in props.items():
        out = out.filter(F.col("props")[k] == v)
    return out


def reachable(links: DataFrame, starts: DataFrame, max_hops: int, is_open: str | None = None) -> DataFrame:
    """(start, node, hops): the fewest hops, of max_hops at most, over the links (src, dst) from each start.

    is_open: a boolean column; links where it isn't true, such as closed doors, lead nowhere. Breadth first: each round
    joins the newest nodes only and drops what was reached before. Rounds are saved, so the plan of a round doesn't
    hold those before it, and the search ends early once nothing new is found.
    """
    if is_open is not None:
        links = links.filter(F.col(is_open))
    links = links.select("src", "dst").distinct()
    seen = front = saved(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hops")).filter("start is not null").distinct())
    for hop in range(1, max_hops + 1):
        step = front.join(links, front["node"] == links["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = saved(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
