"""Dimension relations: resolving, checking, solving and applying them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import chebyshev, orientation
from plumbline.operators.proximity import band_join, clear_of, line_reference, nearest, segment_matches
from plumbline.storage import saved


def datum_assign(circles: DataFrame, datums: DataFrame, row: str, x: str, value: str, mode: str = "as_written", reference: str | None = None, key: str | None = None) -> DataFrame:
    """x of every circle of a row becomes the row's datum value; rows without a datum keep theirs.

    mode 'translate' moves the whole row so that its reference circle lands on the value. One datum a row.
    """
    joined = circles.join(datums, row, "left")
    if mode == "as_written":
        return joined.withColumn(x, F.coalesce(F.col(value).cast("double"), F.col(x))).drop(value)
    if mode != "translate" or not (reference and key):
        raise ValueError("mode is as_written, or translate with the names of the reference and key columns")
    base = circles.select(F.col(key).alias(reference), F.col(x).alias("_at"))
    moved = joined.join(base, reference, "left")
    return moved.withColumn(x, F.coalesce(F.col(x) + F.col(value) - F.col("_at"), F.col(x))).drop(value, "_at")


def ordered_shift(points: DataFrame, relations: DataFrame, row: str, ordinal: str, x: str) -> DataFrame:
    """Applies relations (row, seq, left_ordinal, right_ordinal, value) in order of seq within each row.

    Each one sets the right point value away from the left one by shifting every point beyond the left one; of points
    that share its x, those with greater ordinals lie beyond it. Later ones read what earlier ones left, so this is a
    fold. Rows stream sorted in Arrow batches; a task holds one row of a drawing, and one of n points and m relations
    costs m passes over an array of n.
    """
    none = F.lit(None)
    number = F.col(ordinal).cast("long")
    parts = points.select(F.col(row).alias("_row"), F.lit(0).alias("_kind"), number.alias("_a"), none.cast("long").alias("_b"), none.cast("long").alias("_c"), F.col(x).cast("double").alias("_v"), F.col(ordinal).alias("_o"))
    rules = relations.filter(F.col(row).isNotNull()).select(F.col(row).alias("_row"), F.lit(1).alias("_kind"), *[F.col(c).cast("int").cast("long").alias(n) for c, n in (("seq", "_a"), ("left_ordinal", "_b"), ("right_ordinal", "_c"))], F.col("value").cast("double").alias("_v"), none.cast(points.schema[ordinal].dataType).alias("_o"))
    turn = Window.partitionBy("_row").orderBy("_kind", "_a", "_b", "_c", "_v")
    rows = parts.unionByName(rules).withColumn("_new", F.row_number().over(turn) == 1)
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("_row", "_o")}

    def fold(t: pa.Table) -> pa.RecordBatch:
        kind = t.column("_kind").to_numpy()
        n = int(np.searchsorted(kind, 1))
        ps, rs = t.slice(0, n).combine_chunks(), t.slice(n)
        at, xs = ps.column("_v").to_numpy().copy(), ps.column("_v").is_null().to_numpy()
        # An ordinal's first point is the one that relations name; one without an ordinal lies before all others.
        numbers = ps.column("_a").fill_null(np.iinfo(np.int64).min).to_numpy()
        named = {}
        for i, o in enumerate(ps.column("_a").to_pylist()):
            named.setdefault(o, i)
        for left, right, value in zip(*(rs.column(c).to_pylist() for c in ("_b", "_c", "_v")), strict=True):
            i, j = (named.get(o) if o is not None else None for o in (left, right))
            if i is None or j is None or value is None or xs[i] or xs[j]:
                continue
            beyond = (at > at[i]) | ((at == at[i]) & (numbers > left))
            at[beyond] += at[i] + value - at[j]
        return pa.RecordBatch.from_arrays([ps.column("_row").combine_chunks(), ps.column("_o").combine_chunks(), pa.array(at, mask=xs)], ["_row", "_o", "_x"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            done, begun = [], 0
            for i in [*np.flatnonzero(b.column("_new").to_numpy(zero_copy_only=False)).tolist(), b.num_rows]:
                if i > begun:
                    held.append(b.slice(begun, i - begun))
                if i < b.num_rows and held:
                    done.append(fold(pa.Table.from_batches(held)))
                    held = []
                begun = i
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if held:
            yield fold(pa.Table.from_batches(held))

    out = rows.mapInArrow(work, f"_row {kinds['_row']}, _o {kinds['_o']}, _x double")
    return out.select(F.col("_row").alias(row), F.col("_o").alias(ordinal), F.col("_x").alias(x))


def conflicts(df: DataFrame, keys: list[str], value: str, eps: float = 0.0) -> DataFrame:
    """Keys that are given values more than eps apart, with the count, the least and the greatest value."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return out.filter(F.col("greatest") - F.col("least") > eps)


def redundant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that are given the same value more than once."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def measurement_conflicts(dimensions: DataFrame, dx: str, dy: str, measurement: str, eps: float) -> DataFrame:
    """Dimensions whose stated measurement is more than eps from their geometry."""
    actual = chebyshev(F.col(dx), F.col(dy))
    return dimensions.withColumn("actual", actual).filter(F.abs(F.col(measurement) - F.col("actual")) > eps)


def resolve_dimensions(
    dimensions: DataFrame, circles: DataFrame, circle_tol: float = 30.0, line_x: DataFrame | None = None, line_tol: float = 20.0, lines: DataFrame | None = None, source: str | None = None
) -> DataFrame:
    """Every dimension (handle, x2, y2, x3, y3, value) as a relation between circles, or with a boundary line.

    A horizontal dimension constrains x and its ends take the circle nearest in y; for a vertical one, or a diagonal
    tie, the axes are swapped. An end less than line_tol from a line, and circle_tol or more from every circle, is a
    datum end. Types: 'datum' (one such end, and a circle at the other), 'between_circles' (two different circles, in
    order along the axis), else 'unresolved'. lines: segments (x1, y1, x2, y2, ordinal); line_x: upright lines by x.
    The reference names the side on which the datum end lies. source: a view's name, returned with each row.
    """
    ends = dimensions.select("handle", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.col(f"x{e}").cast("double").alias("x"), F.col(f"y{e}").cast("double").alias("y")) for e in (2, 3)])).alias("p"))
    flat = orientation(F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")) == "horizontal"
    ends = ends.select(F.concat_ws(":", "handle", "p.e").alias("_end"), "handle", "p.*")
    ends = ends.join(dimensions.select("handle", flat.alias("_flat")), "handle")
    known = circles.select(F.col("circle_id").alias("_c"), F.col("x").cast("double").alias("_cx"), F.col("y").cast("double").alias("_cy"), F.col("ordinal").alias("_o"))
    across = F.when(F.col("_flat"), F.col("y")).otherwise(F.col("x"))
    # One lookup for both directions: each circle is stored by y for horizontal dimensions and by x for the others.
    stored = known.withColumn("_at", F.explode(F.array(F.struct(F.lit(True).alias("_flat"), F.col("_cy").alias("v"), F.col("_cx").alias("along")), F.struct(F.lit(False).alias("_flat"), F.col("_cx").alias("v"), F.col("_cy").alias("along")))))
    stored = stored.select("_c", "_o", "_at._flat", F.col("_at.v").alias("_cv"), F.col("_at.along").alias("_along"))
    found = nearest(ends.withColumn("_across", across), stored, "_end", "_across", "_cv", "_o", circle_tol, ["_c", "_along"], ("_flat",))
    near = []
    if lines is not None:
        near.append(line_reference(ends, "_end", "x", "y", lines.withColumn("_line", F.col("ordinal")), "_line", "ordinal", line_tol, circles, circle_tol).select("_end"))
    if line_x is not None:
        upright = band_join(ends.select("_end", "x", "y"), line_x.select(F.col("x").cast("double").alias("_lx")), "x", "_lx", line_tol, "left_semi")
        near.append(clear_of(upright, "_end", circles, circle_tol).select("_end"))
    found = found.join(reduce(DataFrame.unionByName, near).distinct().withColumn("_datum", F.lit(True)), "_end", "left") if near else found.withColumn("_datum", F.lit(None).cast("boolean"))
    end = F.struct(F.coalesce("_datum", F.lit(False)).alias("datum"), F.when(F.coalesce("_datum", F.lit(False)), None).otherwise(F.col("_c")).alias("c"), F.col("_along").alias("along"), F.when(F.col("_flat"), F.col("x")).otherwise(F.col("y")).alias("at"))
    pairs = found.groupBy("handle").agg(*[F.max(F.when(F.col("e") == e, end)).alias(f"_{e}") for e in (2, 3)])
    out = dimensions.withColumn("_flat", flat).join(pairs, "handle", "left")
    c2, c3, d2, d3 = F.col("_2.c"), F.col("_3.c"), F.coalesce("_2.datum", F.lit(False)), F.coalesce("_3.datum", F.lit(False))
    both = F.coalesce(c2 != c3, F.lit(False))
    datum = (d2 & c3.isNotNull()) | (d3 & c2.isNotNull())
    first = (F.col("_2.along") < F.col("_3.along")) | ((F.col("_2.along") == F.col("_3.along")) & (F.col("_2.at") <= F.col("_3.at")))
    low = F.when(d2, F.col("_2.at") <= F.col("_3.at")).otherwise(F.col("_3.at") <= F.col("_2.at"))
    side = F.when(F.col("_flat"), F.when(low, "left_boundary").otherwise("right_boundary")).otherwise(F.when(low, "bottom_boundary").otherwise("top_boundary"))
    return out.select(
        *([F.lit(source).alias("source")] if source else []),
        "handle",
        F.when(F.col("_flat"), "x").otherwise("y").alias("axis"),
        F.when(datum, "datum").when(both, "between_circles").otherwise("unresolved").alias("type"),
        "value",
        F.when(datum, F.coalesce(c2, c3)).alias("row_ref_circle"),
        F.when(datum, side).alias("reference"),
        F.when(both, F.when(first, c2).otherwise(c3)).alias("left_circle"),
        F.when(both, F.when(first, c3).otherwise(c2)).alias("right_circle"),
    )


def bind_annotations(annotations: DataFrame, lines: DataFrame, tol: float) -> DataFrame:
    """(annotation, entity, kind, value): each annotation (annotation, x, y, kind, value) bound to the nearest segment
    (entity, ordinal, x1, y1, x2, y2) less than tol away, ties to the lowest ordinal; entity is null if none is."""
    met = segment_matches(annotations, "annotation", "x", "y", lines, "entity", "ordinal", tol)
    best = met.groupBy("annotation").agg(F.min_by("entity", F.struct("distance", "ordinal")).alias("entity"))
    return annotations.join(best, "annotation", "left").select("annotation", "entity", "kind", "value")


def solve_offsets(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, x, hops): positions of all nodes that constraints (src, dst, value: x of dst less x of src) reach from
    roots (node, x).

    Constraints are read both ways and taken breadth first, a tree only: a node gets its x in the first round that
    reaches it, from the neighbour with the least number. Nothing is averaged; `offset_conflicts` names the
    constraints that don't fit. Each round joins the newest nodes only and is saved; raises beyond max_rounds.
    """
    both = saved(edges.select("src", "dst", F.col("value").cast("double").alias("value")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("value").cast("double")).alias("value"))).dropna())
    known = front = saved(roots.groupBy("node").agg(F.min(F.col("x").cast("double")).alias("x")).withColumn("hops", F.lit(0)))
    for hop in range(1, max_rounds + 1):
        step = front.join(both, front["node"] == both["src"]).select(F.col("dst").alias("node"), F.struct("src", "value", (F.col("x") + F.col("value")).alias("x")).alias("_from"))
        step = step.join(known.select("node"), "node", "left_anti").groupBy("node").agg(F.min("_from")["x"].alias("x"))
        front = saved(step.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    raise RuntimeError(f"constraints go on beyond {max_rounds} rounds")


def offset_conflicts(edges: DataFrame, solved: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(src, dst, value, actual): the constraints that the solved positions miss by more than eps."""
    out = edges.join(solved.select(F.col("node").alias("src"), F.col("x").alias("_a")), "src").join(solved.select(F.col("node").alias("dst"), F.col("x").alias("_b")), "dst")
    return out.withColumn("actual", F.col("_b") - F.col("_a")).filter(F.abs(F.col("actual") - F.col("value")) > eps).select("src", "dst", "value", "actual")


def solve_grid(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, raw, solved): the solved grid of one axis, from lines (label, raw) and spacings between them (src, dst,
    value).

    The line with the least raw coordinate (then label) is 0; solved is null where no spacing leads from it. The
    pairs (raw, solved) are what `snap_raw` takes.
    """
    root = lines.filter("raw is not null").agg(F.min(F.struct("raw", "label")).alias("m")).select(F.col("m.label").alias("node"), F.lit(0.0).alias("x")).filter("node is not null")
    return lines.join(solve_offsets(edges, root).select(F.col("node").alias("label"), F.col("x").alias("solved")), "label", "left").select("label", "raw", "solved")


#: Which view shows which coordinate, in order of trust.
VIEWS = {"x": ("top", "front"), "y": ("top", "left"), "z": ("front", "left")}


def reconcile_views(views: dict[str, DataFrame], key: str, eps: float) -> DataFrame:
    """(key, x, y, z, x_gap, y_gap, z_gap, views, consistent): coordinates of what several views show.

    views: top (key, x, y), front (key, x, z) and left (key, y, z), any of them. A coordinate comes from the first of
    its views that has it; its gap is the spread over all that do. consistent: no gap is over eps, none is missing.
    One exchange on the key, with partial folds, instead of outer joins.
    """
    rows = [df.select(F.col(key), F.lit(name).alias("_view"), *[F.col(c).cast("double").alias(c) if c in df.columns and name in VIEWS[c] else F.lit(None).cast("double").alias(c) for c in "xyz"]) for name, df in views.items()]
    every = reduce(DataFrame.unionByName, rows)
    folds = [F.count_distinct("_view").alias("views")]
    for c, names in VIEWS.items():
        rank = F.when(F.col("_view") == names[0], 0).otherwise(1)
        folds += [F.min(F.when(F.col(c).isNotNull(), F.struct(rank.alias("k"), F.col(c).alias("v"))))["v"].alias(c), (F.max(c) - F.min(c)).alias(f"{c}_gap")]
    out = every.groupBy(key).agg(*folds)
    fits = [F.coalesce(F.col(f"{c}_gap") <= eps, F.lit(False)) for c in "xyz"]
    return out.select(key, *"xyz", *[f"{c}_gap" for c in "xyz"], "views", (fits[0] & fits[1] & fits[2]).alias("consistent"))


def hole_coordinates(views: dict[str, DataFrame], key: str, eps: float) -> DataFrame:
    """(key, x, y, z) of the holes whose views leave no coordinate open."""
    return reconcile_views(views, key, eps).select(key, *"xyz").dropna(subset=[*"xyz"])


def minimise(df: DataFrame, residuals: Callable[[Sequence[float]], list[Column]], start: Sequence[float], rounds: int = 50, damping: float = 1e-3, step: float = 1e-4, close: float = 1e-12) -> list[float]:
    """Parameters that minimise the sum of squared residuals over all rows, by Levenberg and Marquardt.

    residuals maps parameters to columns. A round is one aggregation that sums the products of residuals and of their
    central differences; only those p * (p + 3) / 2 + 1 sums reach the driver. Rows with a null residual take no part.
    """

    def sums(at: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
        h = [step * max(1.0, abs(v)) for v in at]
        r = residuals(at)
        up, down = ([residuals([v + sign * (h[i] if i == k else 0) for i, v in enumerate(at)]) for k in range(len(at))] for sign in (1, -1))
        names = [[f"d{k}_{j}" for j in range(len(r))] for k in range(len(at))]
        rows = df.select(*[c.cast("double").alias(f"r{j}") for j, c in enumerate(r)], *[((up[k][j] - down[k][j]) / (2 * h[k])).alias(names[k][j]) for k in range(len(at)) for j in range(len(r))]).dropna()
        dot = lambda a, b: F.sum(reduce(Column.__add__, [F.col(x) * F.col(y) for x, y in zip(a, b, strict=True)]))
        own = [f"r{j}" for j in range(len(r))]
        pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
        got = [v or 0.0 for v in rows.agg(dot(own, own), *[dot(n, own) for n in names], *[dot(names[i], names[j]) for i, j in pairs]).first()]
        square = np.zeros((len(at), len(at)))
        for (i, j), v in zip(pairs, got[1 + len(at) :], strict=True):
            square[i, j] = square[j, i] = v
        return got[0], np.array(got[1 : 1 + len(at)]), square

    now = [float(v) for v in start]
    error, slope, square = sums(now)
    for _ in range(rounds):
        if not error or not np.any(slope):
            break
        move = np.linalg.lstsq(square + damping * np.diag(np.diag(square)), -slope, rcond=None)[0]
        then = (np.array(now) + move).tolist()
        tried = sums(then)
        if tried[0] < error:
            done = error - tried[0] <= close * error
            now, (error, slope, square), damping = then, tried, damping / 10
            if done:
                break
        elif damping > 1e8 or np.abs(move).max() <= 1e-12 * max(1.0, np.abs(now).max()):
            break
        else:
            damping *= 10
    return now
