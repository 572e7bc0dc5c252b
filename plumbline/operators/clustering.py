"""One-dimensional grouping by leaders, runs of consecutive rows, and columns of aligned points."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.proximity import each_pair, meet, places


def _led(df: DataFrame, by: list[str], value: str, ordinal: str, order: tuple[str, str], lead: Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """by, ordinal, value, group_no and anchor, by a fold over each key's rows in order.

    Rows are sorted by one exchange and streamed in Arrow batches; what is kept of a key is its fold's state, so a key
    of any length needs the memory of a batch. lead() makes a key's fold, from a run of values to groups and anchors.
    """
    rows = df.select(*by, F.col(ordinal).alias("_o"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    turn = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("_new", F.row_number().over(turn) == 1)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_v", "_new"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for b in batches:
            v, new = b.column("_v").to_numpy(), b.column("_new").to_numpy(zero_copy_only=False)
            cuts = sorted({0, len(v), *np.flatnonzero(new).tolist()})
            groups, anchors = np.empty(len(v), np.int32), np.empty(len(v))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                fold = lead() if new[i] else fold
                groups[i:j], anchors[i:j] = fold(v[i:j])
            keep = [*by, "_o", "_v"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(groups), pa.array(anchors)], [*keep, "group_no", "anchor"])

    out = rows.select(*by, "_o", "_v", "_new").mapInArrow(work, f"{kinds}, _v double, group_no int, anchor double")
    return out.select(*by, F.col("_o").alias(ordinal), F.col("_v").alias(value), "group_no", "anchor")


def leader_clusters(df: DataFrame, by: list[str], value: str, ordinal: str, tol: float = 20.0) -> DataFrame:
    """Groups whose members lie less than tol above the group's first value, in order of (value, ordinal).

    An anchor never moves, so this is not gap clustering. Returns by, ordinal, value, group_no (from 1) and anchor;
    null values have no row.
    """

    def lead() -> Callable:
        state = [0, -np.inf]

        def fold(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            groups, anchors, i = np.empty(len(v), np.int32), np.empty(len(v)), 0
            while i < len(v):
                if v[i] - state[1] >= tol:
                    state[:] = state[0] + 1, v[i]
                # The first place out of reach; the test itself is the difference, so the search's end is put right.
                j = max(i + 1, int(np.searchsorted(v, state[1] + tol)))
                while j < len(v) and v[j] - state[1] < tol:
                    j += 1
                while v[j - 1] - state[1] >= tol:
                    j -= 1
                groups[i:j], anchors[i:j] = state
                i = j
            return groups, anchors

        return fold

    return _led(df, by, value, ordinal, ("_v", "_o"), lead)


def leader_clusters_as_given(df: DataFrame, by: list[str], value: str, ordinal: str, tol: float = 20.0) -> DataFrame:
    """As leader_clusters, but values come in order of ordinal and join the earliest group in reach of its anchor.

    A key's anchors lie tol or more apart, so two at most are in reach of a value; they are kept sorted.
    """

    def lead() -> Callable:
        places: list[float] = []
        numbers: list[int] = []

        def fold(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            groups, anchors = np.empty(len(v), np.int32), np.empty(len(v))
            for k, x in enumerate(v.tolist()):
                at = bisect_left(places, x)
                near = [(numbers[i], places[i]) for i in range(max(0, at - 2), min(len(places), at + 2)) if abs(places[i] - x) < tol]
                if not near:
                    places.insert(at, x)
                    numbers.insert(at, len(numbers) + 1)
                    near = [(numbers[at], x)]
                groups[k], anchors[k] = min(near)
            return groups, anchors

        return fold

    return _led(df, by, value, ordinal, ("_o", "_v"), lead)


def row_bounded_groups(df: DataFrame, group: str, row: str, max_rows: int = 2) -> DataFrame:
    """Adds island and chunk: runs of consecutive row numbers in each group, cut after max_rows distinct rows.

    Window functions over (group, row) only. Raises on max_rows < 1; a null row number gets a null island.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    known = F.col(row).isNotNull()
    ranked = df.withColumn("island", F.when(known, F.col(row) - F.dense_rank().over(Window.partitionBy(group, known).orderBy(row))))
    first = F.min(row).over(Window.partitionBy(group, "island"))
    return ranked.withColumn("chunk", F.floor((F.col(row) - first) / max_rows))


def require_rows(circles: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Circles joined with their rows; raises with a count if any has none."""
    missing = circles.join(rows, key, "left_anti").count()
    if missing:
        raise KeyError(f"{missing} circles have no row")
    return circles.join(rows, key)


def gaps(df: DataFrame, by: list[str], value: str, ordinal: str, limit: float) -> DataFrame:
    """Adds gap (to the value before, in order of value and ordinal) and wide (gap over limit)."""
    gap = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(value, ordinal))
    return df.withColumn("gap", gap).withColumn("wide", F.coalesce(F.col("gap") > limit, F.lit(False)))


def column_links(points: DataFrame, key: str, x: str, y: str, x_tol: float, y_tol: float, between: str = "y") -> DataFrame:
    """(a, b, gap): pairs aligned within x_tol and nearer than y_tol in y, b above a, with no other point between them.

    The reference says "no other circle between them in X". Read literally (between='x') a third point whose x lies
    strictly between theirs parts them, wherever it is in y, and small jitter then breaks a column; so the default,
    between='y', takes the next aligned point above and parts a pair by an aligned third one between them in y.
    """
    if between == "y":
        return _links_above(points, key, x, y, x_tol, y_tol)
    if between != "x":
        raise ValueError("between is y or x")
    # The next greater x, as far as x_tol reaches: within the bin, or the least of the bin after. Bins are a little wider
    # than the tolerance, here and below, so rounding loses nothing.
    values = points.select(F.col(x).cast("double").alias("_x")).filter(F.abs("_x") < F.lit(float("inf"))).distinct().withColumn("_b", F.floor(F.col("_x") / (x_tol * 1.001)))
    least = values.groupBy("_b").agg(F.min("_x").alias("_least")).withColumn("_b", F.col("_b") - 1)
    following = values.withColumn("_n", F.lead("_x").over(Window.partitionBy("_b").orderBy("_x"))).join(least, "_b", "left").select(F.col("_x").alias("_link"), F.coalesce("_n", "_least").alias("_x"))
    before = following.filter(F.col("_x") - F.col("_link") < x_tol)
    at = places(points, key, x, y).withColumn("_by", F.floor(F.col("_y") / (y_tol * 1.001)))
    p = at.select(F.col("_x").alias("_link"), "_by", F.col("_y").alias("py"), F.col("_keys").alias("_p"))
    # Above a place of its own x, then on either side of one at the x before.
    own = at.withColumn("_s", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("_x").alias("_link"), (F.col("_by") - F.col("_s")).alias("_by"), F.col("_y").alias("qy"), F.col("_keys").alias("_q"), F.lit(True).alias("_own"))
    beside = at.join(before, "_x").withColumn("_s", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).select("_link", (F.col("_by") - F.col("_s")).alias("_by"), F.col("_y").alias("qy"), F.col("_keys").alias("_q"), F.lit(False).alias("_own"))
    up = F.col("py") <= F.col("qy")
    met = meet(p, own.unionByName(beside), ["_link", "_by"]).filter((up | ~F.col("_own")) & (F.abs(F.col("qy") - F.col("py")) < y_tol))
    level = F.col("py") == F.col("qy")
    met = met.select(F.when(up, F.col("_p")).otherwise(F.col("_q")).alias("_p"), F.when(up, F.col("_q")).otherwise(F.col("_p")).alias("_q"), level.alias("_level"), (level & F.col("_own")).alias("_same"), F.abs(F.col("qy") - F.col("py")).alias("gap"))
    return each_pair(met, ~F.col("_level"), F.col("_same"), ["gap"]).select("a", "b", "gap")


def _links_above(points: DataFrame, key: str, x: str, y: str, x_tol: float, y_tol: float) -> DataFrame:
    """(a, b, gap): of each point the least (y, key) above it that is aligned within x_tol, if nearer than y_tol in y.

    A sweep from the top in each cell of one bin of x and four y_tol in y, over rows streamed in Arrow batches; points
    just outside a cell that its own ones may reach are copied into it. Any two points of a bin are aligned, so there
    the last one met is the nearest. Of a bin beside, a point is kept until one met later is nearer in x too, so kept
    ones are sorted both by x and by age, and the last in reach is found by bisection. No pairs are made.
    """
    wide, high = x_tol * 0.999, y_tol * 4
    at = points.select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    far = F.lit(float("inf"))
    at = at.filter((F.abs("_x") < far) & (F.abs("_y") < far)).withColumns({"_bx": F.floor(F.col("_x") / wide), "_by": F.floor(F.col("_y") / high)})
    bins = lambda v, reach, side: F.sequence(F.floor((v - reach) / side), F.floor((v + reach) / side))
    at = at.withColumn("_gx", F.explode(bins(F.col("_x"), x_tol * 1.001, wide))).withColumn("_gy", F.explode(F.sequence(F.floor((F.col("_y") - y_tol * 1.001) / high), F.col("_by"))))
    # A null key is above or below by y alone: of one y it asks before, and is met after all others.
    at = at.withColumn("_turn", F.explode(F.when(F.col("_k").isNull(), F.array(F.lit(2), F.lit(0))).otherwise(F.array(F.lit(1)))))
    side = F.signum(F.col("_bx") - F.col("_gx")).cast("int")
    rows = at.select("_gx", "_gy", "_turn", "_k", "_x", "_y", side.alias("_side"), ((F.col("_bx") == F.col("_gx")) & (F.col("_by") == F.col("_gy")) & (F.col("_turn") > 0)).alias("_asks"))
    rows = rows.repartition(max(4 * points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_gx", "_gy")
    turn = Window.partitionBy("_gx", "_gy").orderBy(F.desc("_y"), F.desc("_turn"), F.desc("_k"))
    rows = rows.withColumns({"_new": F.row_number().over(turn) == 1, "_at": F.dense_rank().over(turn), "_met": F.col("_turn") < 2}).select("_new", "_at", "_k", "_x", "_y", "_side", "_asks", "_met")
    kind = rows.schema["_k"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept, waiting, now = None, {}, [], 0

        def admit() -> None:
            nonlocal last
            for s, hit in waiting:
                if s:
                    spots, hits = kept[s]
                    while spots and spots[-1] >= s * hit[1]:
                        spots.pop()
                        hits.pop()
                    spots.append(s * hit[1])
                    hits.append(hit)
                else:
                    last = hit
            waiting.clear()

        for b in batches:
            out = []
            for new, turn, k, v, y, s, asks, met in zip(*(b.column(c).to_pylist() for c in range(b.num_columns)), strict=True):
                if new:
                    last, kept, now = None, {-1: ([], []), 1: ([], [])}, 0
                    waiting.clear()
                if turn != now:
                    admit()
                    now = turn
                if asks:
                    best = last
                    for sign, (spots, hits) in kept.items():
                        # The last in reach; the test itself is the difference, so the search's end is put right.
                        i = bisect_left(spots, sign * v + x_tol)
                        while i < len(spots) and spots[i] - sign * v < x_tol:
                            i += 1
                        while i and spots[i - 1] - sign * v >= x_tol:
                            i -= 1
                        if i and (best is None or hits[i - 1][0] > best[0]):
                            best = hits[i - 1]
                    if best and best[2] - y < y_tol:
                        out.append((k, y, best[2], best[3]))
                if met:
                    waiting.append((s, (turn, v, y, k)))
            a, ay, by, to = zip(*out, strict=True) if out else ((), (), (), ())
            own = b.schema.field("_k").type
            yield pa.RecordBatch.from_arrays([pa.array(a, own), pa.array(ay, pa.float64()), pa.array(by, pa.float64()), pa.array(to, own)], ["a", "ay", "by", "b"])

    found = rows.mapInArrow(work, f"a {kind}, ay double, by double, b {kind}")
    return found.groupBy("a", "ay").agg(F.min(F.struct("by", "b")).alias("n")).select("a", F.col("n.b").alias("b"), (F.col("n.by") - F.col("ay")).alias("gap"))
