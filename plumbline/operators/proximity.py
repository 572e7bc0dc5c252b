"""Joins by distance. A band join keys both sides by floor(x / tol), so it shuffles by bin rather than by all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import line_distance


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tol: float, how: str = "inner", inclusive: bool = False) -> DataFrame:
    """Rows whose values lie less than tol apart (or tol at most). Columns of the two sides must differ by name.

    The left side is copied into the bins beside its own only for inner joins, else the right one is; either way
    each pair meets in one bin. Nulls match nothing. how: inner, left, left_semi or left_anti.
    """
    a, b = F.col(left_on), F.col(right_on)
    near = (F.abs(a - b) <= tol) if inclusive else (F.abs(a - b) < tol)
    one = left.withColumn("_bin", F.floor(a / tol))
    spread = right.filter(b.isNotNull()).withColumn("_bin2", F.explode(F.sequence(F.floor(b / tol) - 1, F.floor(b / tol) + 1)))
    joined = one.join(spread, (F.col("_bin") == F.col("_bin2")) & near, how)
    return joined.drop("_bin", "_bin2")


def _by_value(right: DataFrame, by: list[str], on: str, ordinal: str, keep: list[str]) -> DataFrame:
    """(by, _v, _row): of the right rows that share a value, the one with the lowest ordinal."""
    row = F.struct(F.col(ordinal).alias("o"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    known = right.withColumn("_v", F.col(on).cast("double")).filter("_v is not null and not isnan(_v)")
    return known.groupBy(*by, "_v").agg(F.min_by(row, F.col(ordinal)).alias("_row"))


def nearest_values(asked: DataFrame, right: DataFrame, by: list[str], right_on: str, ordinal: str, tol: float, keep: list[str]) -> DataFrame:
    """(by, _v, keep): for each distinct asked value _v the nearest right row under tol, if there is one.

    An as-of lookup: values and questions are sorted together within bins of width tol, each bin also holding the last
    value of the bin before and the first of the bin after. One pass up and one down give the neighbours on either
    side, so the work is that of two sorts however dense the values lie; no pairs are made.
    """
    bin_ = F.floor(F.col("_v") / tol)
    stored = _by_value(right, by, right_on, ordinal, keep).withColumn("_bin", bin_).withColumn("_hit", F.struct("_v", "_row"))
    ends = stored.groupBy(*by, "_bin").agg(F.min_by("_hit", "_v").alias("low"), F.max_by("_hit", "_v").alias("high"))
    ends = ends.select(*by, F.explode(F.array(F.struct((F.col("_bin") + 1).alias("_bin"), F.col("high").alias("_hit")), F.struct((F.col("_bin") - 1).alias("_bin"), F.col("low").alias("_hit")))).alias("e"))
    columns = [*by, "_bin", "_v", "_hit"]
    points = stored.select(*columns).unionByName(ends.select(*by, "e._bin", F.col("e._hit._v").alias("_v"), "e._hit"))
    questions = asked.filter("_v is not null and not isnan(_v)").select(*by, "_v").distinct().withColumn("_bin", bin_)
    both = questions.withColumn("_asks", F.lit(True)).unionByName(points.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    beside = Window.partitionBy(*by, "_bin")
    # Values equal to the one asked about are peers, and so within both frames.
    up, down = (beside.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("_v").asc(), F.col("_v").desc()))
    found = both.withColumn("_a", F.last("_hit", ignorenulls=True).over(up)).withColumn("_b", F.last("_hit", ignorenulls=True).over(down)).filter("_asks")
    da, db = F.col("_v") - F.col("_a._v"), F.col("_b._v") - F.col("_v")
    first = db.isNull() | (da < db) | ((da == db) & (F.col("_a._row.o") <= F.col("_b._row.o")))
    best = found.withColumn("_hit", F.when(first & da.isNotNull(), F.col("_a")).otherwise(F.col("_b"))).filter(F.abs(F.col("_hit._v") - F.col("_v")) < tol)
    return best.select(*by, "_v", *[F.col(f"_hit._row.k{i}").alias(c) for i, c in enumerate(keep)])


def nearest(left: DataFrame, right: DataFrame, left_key: str, left_on: str, right_on: str, ordinal: str, tol: float, keep: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """left, and keep of the nearest right row under tol (of equal by columns), ties to the lowest ordinal; null where
    none is in reach. Equal left values are asked about once."""
    asked = left.select(*by, F.col(left_on).cast("double").alias("_v"))
    best = nearest_values(asked, right, list(by), right_on, ordinal, tol, keep)
    return left.withColumn("_v", F.col(left_on).cast("double")).join(best, [*by, "_v"], "left").select(*left.columns, *keep)


def first_match(left: DataFrame, right: DataFrame, left_key: str, left_on: str, right_on: str, ordinal: str, tol: float, keep: list[str]) -> DataFrame:
    """As nearest, but the match in reach with the lowest ordinal wins, however far.

    Equal values fold to one on both sides. Within bins of width tol each value carries the least ordinal up to it and
    from it on; a question reads its own bin's, that of the bin after up to its reach, and that of the bin before from
    its reach on. So the work is that of a few sorts, and no pairs are made. keep columns must be sortable.
    """
    bin_ = F.floor(F.col("_v") / tol)
    stored = _by_value(right, [], right_on, ordinal, keep).withColumn("_bin", bin_)
    turn = Window.partitionBy("_bin")
    for name, order in (("up", F.col("_v").asc()), ("down", F.col("_v").desc())):
        rows = turn.orderBy(order)
        stored = stored.withColumn(f"{name}_with", F.min("_row").over(rows.rowsBetween(Window.unboundedPreceding, 0))).withColumn(f"{name}_less", F.min("_row").over(rows.rowsBetween(Window.unboundedPreceding, -1)))
    stored = stored.select("_bin", F.col("_v").alias("_at"), F.struct("_v", "up_with", "up_less", "down_with", "down_less").alias("_hit"))
    x = F.col("_v")
    ask = F.explode(F.array(*[F.struct((bin_ + step).alias("_bin"), at.alias("_at"), F.lit(step).alias("_step")) for step, at in ((0, F.lit(float("inf"))), (1, x + tol), (-1, x - tol))]))
    asked = left.select(F.col(left_on).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)").distinct().select("_v", ask.alias("q")).select("_v", "q.*")
    both = asked.unionByName(stored, allowMissingColumns=True)
    up, down = (turn.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("_at").asc(), F.col("_at").desc()))
    found = both.withColumns({"_a": F.last("_hit", ignorenulls=True).over(up), "_b": F.last("_hit", ignorenulls=True).over(down)}).filter("_step is not null")
    # _a is the last value up to the reach, _b the first from it on; which of them are in reach is told by the difference.
    above = F.when(F.col("_b._v") - x < tol, F.col("_b.up_with")).when(F.col("_a._v") - x < tol, F.col("_a.up_with")).otherwise(F.col("_a.up_less"))
    below = F.when(x - F.col("_a._v") < tol, F.col("_a.down_with")).when(x - F.col("_b._v") < tol, F.col("_b.down_with")).otherwise(F.col("_b.down_less"))
    best = found.groupBy("_v").agg(F.min(F.when(F.col("_step") == 0, F.col("_a.up_with")).when(F.col("_step") == 1, above).otherwise(below)).alias("_row"))
    best = best.select("_v", *[F.col(f"_row.k{i}").alias(c) for i, c in enumerate(keep)])
    return left.withColumn("_v", F.col(left_on).cast("double")).join(best, "_v", "left").select(*left.columns, *keep)


def snap_dimensions(dimensions: DataFrame, ends: tuple[str, str], rows: DataFrame, row: str, on: str, ordinal: str, tol: float, boundary: DataFrame | None = None) -> DataFrame:
    """dimensions with row_a and row_b: the row nearest to either end within tol, or null.

    boundary: further rows of the same columns, the drawing's edges; on equal distance a row comes before an edge.
    Both ends are looked up together.
    """
    lines = rows.select(F.struct(F.lit(0).alias("k"), F.col(ordinal).alias("o")).alias("_o"), F.col(row).alias("_r"), F.col(on).cast("double").alias("_y"))
    if boundary is not None:
        lines = lines.unionByName(boundary.select(F.struct(F.lit(1).alias("k"), F.col(ordinal).alias("o")).alias("_o"), F.col(row).alias("_r"), F.col(on).cast("double").alias("_y")))
    asked = dimensions.select(F.explode(F.array(*[F.col(e).cast("double") for e in ends])).alias("_v"))
    found = nearest_values(asked, lines, [], "_y", "_o", tol, ["_r"])
    out = dimensions
    for end, name in zip(ends, ("row_a", "row_b"), strict=True):
        out = out.withColumn("_v", F.col(end).cast("double")).join(found.withColumnRenamed("_r", name), "_v", "left").drop("_v")
    return out.select(*dimensions.columns, "row_a", "row_b")


def _cells(x: Column, y: Column, side: float, around: bool) -> Column:
    """The cell of a point, or it and the eight around it, as an array of struct(cx, cy)."""
    steps = (-1, 0, 1) if around else (0,)
    return F.array(*[F.struct((F.floor(x / side) + i).alias("cx"), (F.floor(y / side) + j).alias("cy")) for i in steps for j in steps])


def segment_matches(points: DataFrame, key: str, x: str, y: str, lines: DataFrame, line: str, ordinal: str, tol: float) -> DataFrame:
    """(key, line, ordinal, distance) of points less than tol from a segment (x1, y1, x2, y2 of lines).

    A segment enters the cells, of side 2 tol, that samples along it every tol or less fall in; a point asks its own
    and the eight around it, which hold every sample that is 1.5 tol away or nearer.
    """
    side = 2 * tol
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    steps = F.greatest(F.lit(1), F.ceil(length / tol)).cast("int")
    at = F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(F.floor((F.col("x1") + (F.col("x2") - F.col("x1")) * i / steps) / side).alias("cx"), F.floor((F.col("y1") + (F.col("y2") - F.col("y1")) * i / steps) / side).alias("cy")))
    known = lines.select(F.col(line).alias("_line"), F.col(ordinal).alias("_ordinal"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).dropna(subset=["x1", "y1", "x2", "y2"])
    spread = known.withColumn("_cell", F.explode(F.array_distinct(at)))
    asks = points.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).dropna(subset=["_px", "_py"])
    asks = asks.withColumn("_cell", F.explode(_cells(F.col("_px"), F.col("_py"), side, True)))
    distance = line_distance(F.col("_px"), F.col("_py"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    met = asks.join(spread, "_cell").withColumn("distance", distance).filter(F.col("distance") < tol)
    # A point and a segment may meet in several cells.
    out = met.groupBy("_key", "_line").agg(F.min("_ordinal").alias("_ordinal"), F.min("distance").alias("distance"))
    return out.select(F.col("_key").alias(key), F.col("_line").alias(line), F.col("_ordinal").alias(ordinal), "distance")


def clear_of(points: DataFrame, key: str, circles: DataFrame, tol: float) -> DataFrame:
    """The points (key, x, y) that lie tol or more from every circle's centre (x, y), by cells of side tol."""
    spread = circles.select(F.col("x").cast("double").alias("_cx"), F.col("y").cast("double").alias("_cy")).dropna().withColumn("_cell", F.explode(_cells(F.col("_cx"), F.col("_cy"), tol, True)))
    asks = points.withColumn("_own", _cells(F.col("x").cast("double"), F.col("y").cast("double"), tol, False)[0])
    near = F.hypot(F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")) < tol
    return asks.join(spread, (F.col("_own") == F.col("_cell")) & near, "left_anti").drop("_own")


def line_reference(points: DataFrame, key: str, x: str, y: str, lines: DataFrame, line: str, ordinal: str, tol: float = 20.0, circles: DataFrame | None = None, circle_tol: float = 30.0) -> DataFrame:
    """(key, line): the first line, by ordinal, less than tol from each point that has one.

    circles (x, y): only points that lie circle_tol or more from every one of them, which makes the line a datum.
    """
    found = segment_matches(points, key, x, y, lines, line, ordinal, tol).groupBy(key).agg(F.min_by(line, ordinal).alias(line))
    if circles is not None:
        free = clear_of(points.select(key, F.col(x).alias("x"), F.col(y).alias("y")), key, circles, circle_tol)
        found = found.join(free.select(key).distinct(), key, "left_semi")
    return found


def align_sources(sources: dict[str, DataFrame], key: str, x: str, y: str, cell: float) -> DataFrame:
    """(cx, cy, sources, n, and the least key of each source): what different sources say of one place.

    Rows of all sources fall into square cells; one row a cell. Counts and minima fold before the shuffle.
    """
    rows = [df.select(F.lit(name).alias("_source"), F.col(key).alias("_key"), F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy")) for name, df in sources.items()]
    every = reduce(DataFrame.unionByName, rows).filter("cx is not null and cy is not null")
    firsts = [F.min(F.when(F.col("_source") == name, F.col("_key"))).alias(name) for name in sources]
    out = every.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), *firsts)
    present = sum((F.col(name).isNotNull().cast("int") for name in sources), F.lit(0))
    return out.select("cx", "cy", present.alias("sources"), "n", *sources)


def surface(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """targets (x, y) with elevation and n: the mean of all points (x, y, elevation) within radius, weighted by
    1 / distance squared; where points lie on the target itself, their plain mean. Null without a point in reach.

    The reference names the goal, from contours to a surface, and no method; this is ours. Sums fold by target.
    """
    at = points.select(F.col("x").cast("double").alias("_px"), F.col("y").cast("double").alias("_py"), F.col("elevation").cast("double").alias("_e")).dropna().withColumn("_cell", F.explode(_cells(F.col("_px"), F.col("_py"), radius, True)))
    asks = targets.select("x", "y").distinct()
    own = asks.withColumn("_cell", _cells(F.col("x"), F.col("y"), radius, False)[0])
    d = F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    met = own.join(at, "_cell").withColumn("_d", d).filter(F.col("_d") <= radius)
    far = F.when(F.col("_d") > 0, 1 / (F.col("_d") * F.col("_d")))
    sums = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_d") == 0, F.col("_e"))).alias("_on"), F.sum(far * F.col("_e")).alias("_s"), F.sum(far).alias("_w"))
    found = sums.select("x", "y", F.coalesce("_on", F.col("_s") / F.col("_w")).alias("elevation"), "n")
    return asks.join(found, ["x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def contour_points(contours: DataFrame) -> DataFrame:
    """(x, y, elevation): a row for each vertex of contours (points array<array<double>>, elevation)."""
    return contours.select(F.explode("points").alias("p"), "elevation").select(F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "elevation")


def far_from_all(left: DataFrame, right: DataFrame, left_on: str, right_on: str, tol: float) -> DataFrame:
    """Left rows with no right value less than tol away."""
    return band_join(left, right.select(right_on), left_on, right_on, tol, "left_anti")


def places(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(_x, _y, _keys): one row a place, with the keys of all points there; coordinates that aren't finite have none."""
    at = points.select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    far = F.lit(float("inf"))
    return at.filter((F.abs("_x") < far) & (F.abs("_y") < far)).groupBy("_x", "_y").agg(F.transform(F.collect_list(F.struct("_k")), lambda k: k["_k"]).alias("_keys"))


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left and right joined on columns of few values each. The rows that come of it outnumber those that go in, so
    both sides are dealt by number, not by their size, and neither is broadcast for looking small as a file."""
    parts = max(8 * left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(parts, *on).hint("shuffle_merge").join(right.repartition(parts, *on), on)


def _slices(keys: str, size: int) -> Column:
    """An array of keys as an array of arrays of size keys at most."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(keys) - 1) / size).cast("int")), lambda i: F.slice(F.col(keys), i * size + 1, size))


def each_pair(pairs: DataFrame, ordered: Column, same: Column, keep: list[str], size: int = 64) -> DataFrame:
    """(a, b, keep): every pair of a key of _p with a key of _q, which are arrays.

    a is the key of _p where ordered, else the lesser one. Where same (_p and _q are one place), each pair comes once.
    A narrow step: what is kept was worked out a pair of places, however many points share them.

    Compiled code holds what all matches of a left row explode into until it returns to that row, which grew with the
    square of the points at a place. So keys are cut to size before, and the sort, whose order means nothing, parts the
    two steps: it takes the join's rows into pages that can spill, and gives one pair of slices at a time.
    """
    cut = pairs.withColumns({"_same": same, "_ordered": ordered}).withColumn("_p", F.explode(_slices("_p", size))).withColumn("_q", F.explode(_slices("_q", size)))
    keys = cut.sortWithinPartitions(F.element_at("_p", 1)).withColumn("_a", F.explode("_p")).withColumn("_b", F.explode("_q"))
    keys = keys.filter((~F.col("_same") & F.col("_ordered")) | (F.col("_a") < F.col("_b")) | (~F.col("_same") & (F.col("_a") > F.col("_b"))))
    turned = ~F.col("_ordered") & (F.col("_a") > F.col("_b"))
    a, b = F.when(turned, F.col("_b")).otherwise(F.col("_a")), F.when(turned, F.col("_a")).otherwise(F.col("_b"))
    return keys.select(a.alias("a"), b.alias("b"), turned.alias("_turned"), *keep)


def _near_places(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """(_p, _q, dx, dy, distance, _same): pairs of places within radius, each once, and each place with itself.

    A place meets its own cell and the four after it; cells are a little wider than radius, so rounding loses nothing.
    """
    side = radius * 1.001
    at = places(points, key, x, y).withColumns({"_cx": F.floor(F.col("_x") / side), "_cy": F.floor(F.col("_y") / side)})
    p = at.select(F.col("_x").alias("px"), F.col("_y").alias("py"), F.col("_keys").alias("_p"), "_cx", "_cy")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    q = at.withColumn("_s", F.explode(steps)).select(F.col("_x").alias("qx"), F.col("_y").alias("qy"), F.col("_keys").alias("_q"), (F.col("_cx") - F.col("_s.i")).alias("_cx"), (F.col("_cy") - F.col("_s.j")).alias("_cy"), ((F.col("_s.i") == 0) & (F.col("_s.j") == 0)).alias("_own"))
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    once = ~F.col("_own") | (F.col("px") < F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") <= F.col("qy")))
    met = meet(p, q, ["_cx", "_cy"]).filter(once & (F.hypot(dx, dy) <= radius))
    return met.select("_p", "_q", dx.alias("dx"), dy.alias("dy"), F.hypot(dx, dy).alias("distance"), ((dx == 0) & (dy == 0)).alias("_same"))


def near_pairs(points: DataFrame, key: str, x: str, y: str, radius: float, digits: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) with a < b and a Euclidean distance of radius at most, by cells of side radius.

    Points of one place fold before the join and are paired out after it, so distances (rounded to digits, if given) are
    worked out a pair of places. The keys of one place, and the places of one cell, are held by a task.
    """
    near = _near_places(points, key, x, y, radius)
    distance = F.col("distance") if digits is None else F.round("distance", digits)
    return each_pair(near.select("_p", "_q", "_same", distance.alias("distance")), F.lit(False), F.col("_same"), ["distance"]).drop("_turned")


def snap_to_grid(df: DataFrame, on: str, grid: DataFrame, value: str, ordinal: str, tol: float = 2.0, out: str = "snapped", max_broadcast: int = 1_000_000) -> DataFrame:
    """The nearest grid value within tol (inclusive, ties to the lowest ordinal), else the value itself.

    The grid becomes one row a bin of width tol with the few values in reach of it, so each row joins one row. That
    table is broadcast if it counts max_broadcast rows at most, else the join shuffles by bin.
    """
    spread = grid.select(F.col(value).cast("double").alias("v"), F.col(ordinal).alias("i")).filter("v is not null")
    bins = spread.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("v") / tol) - 2, F.floor(F.col("v") / tol) + 2))).groupBy("_bin").agg(F.collect_list(F.struct("i", "v")).alias("_near"))
    if grid.limit(max_broadcast // 5 + 1).count() <= max_broadcast // 5:
        bins = F.broadcast(bins)
    x: Column = F.col(on)
    best = F.array_min(F.transform("_near", lambda g: F.struct(F.abs(x - g["v"]).alias("d"), g["i"].alias("i"), g["v"].alias("v"))))
    return df.withColumn("_bin", F.floor(x / tol)).join(bins, "_bin", "left").withColumn(out, F.when(best["d"] <= tol, best["v"]).otherwise(x)).drop("_bin", "_near")


def beside(points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """near_pairs with the side on which b lies of a: right, left, above, below, or same; worked out a pair of places."""

    def side(dx: Column, dy: Column) -> Column:
        return F.when((dx == 0) & (dy == 0), "same").when(F.abs(dy) < F.abs(dx), F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "above").otherwise("below"))

    near = _near_places(points, key, x, y, radius).withColumns({"_to": side(F.col("dx"), F.col("dy")), "_back": side(-F.col("dx"), -F.col("dy"))})
    pairs = each_pair(near.select("_p", "_q", "_same", "distance", "_to", "_back"), F.lit(False), F.col("_same"), ["distance", "_to", "_back"])
    return pairs.select("a", "b", "distance", F.when(F.col("_turned"), F.col("_back")).otherwise(F.col("_to")).alias("side"))
