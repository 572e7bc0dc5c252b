"""Column expressions on points, segments and vectors; all run inside generated code."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import pairwise

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def orientation(dx: Column, dy: Column) -> Column:
    """'horizontal' where abs(dy) < abs(dx), else 'vertical'; a tie is vertical, a null difference null."""
    return F.when(dx.isNull() | dy.isNull(), None).when(F.abs(dy) < F.abs(dx), "horizontal").otherwise("vertical")


def chebyshev(dx: Column, dy: Column) -> Column:
    """The larger of abs(dx) and abs(dy); null if either is null (greatest alone would skip nulls)."""
    return F.when(dx.isNotNull() & dy.isNotNull(), F.greatest(F.abs(dx), F.abs(dy)))


def span(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The segment a dimension covers on its own axis: struct(axis, fixed, lo, hi)."""
    axis = orientation(x2 - x1, y2 - y1)
    flat = axis == "horizontal"
    return F.struct(
        axis.alias("axis"),
        F.when(flat, y1).otherwise(x1).alias("fixed"),
        F.when(flat, F.least(x1, x2)).otherwise(F.least(y1, y2)).alias("lo"),
        F.when(flat, F.greatest(x1, x2)).otherwise(F.greatest(y1, y2)).alias("hi"),
    )


def line_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, infinite: bool = False) -> Column:
    """Distance from a point to a segment, or to the whole line; a segment of no length counts as its point."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    along = F.when(square > 0, ((px - x1) * dx + (py - y1) * dy) / square).otherwise(0.0)
    if not infinite:
        along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    return F.hypot(px - (x1 + along * dx), py - (y1 + along * dy))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _snap(x: Column, pairs: Sequence[tuple[float, float]], tol: float) -> Column:
    """The second of the pair whose first is nearest to x, if within tol (inclusive; first in the list wins a tie), else x.

    Bisection over the sorted list, so the work is that of its logarithm. A list whose distances may be equal by
    rounding (values closer than tol's own precision, or none that are finite) is compared value by value.
    """
    if not pairs:
        return x
    first = {}
    for i, (key, value) in enumerate(pairs):
        if not math.isnan(key):
            first.setdefault(float(key), (i, float(value)))
    keys = sorted(first)
    if not keys or not all(map(math.isfinite, (*keys, tol))) or any(b - a <= 2 * math.ulp(tol) for a, b in pairwise(keys)):
        grid = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, (k, v) in enumerate(pairs)])
        best = F.array_min(F.transform(grid, lambda g: F.struct(F.abs(x - g["k"]).alias("d"), g["i"].alias("i"), g["v"].alias("v"))))
        return F.when(best["d"] <= tol, best["v"]).otherwise(x)
    places, values, order = (F.lit(np.array(a)) for a in (keys, [first[k][1] for k in keys], [first[k][0] for k in keys]))
    halves = F.lit(np.array([1 << i for i in reversed(range(len(keys).bit_length()))], np.int32))

    def nearest(x: Column) -> Column:
        # The last place up to x, or -1; what lies outside the list is null.
        below = F.aggregate(halves, F.lit(-1), lambda at, step: F.when(F.get(places, at + step) <= x, at + step).otherwise(at))
        off = lambda at: F.abs(x - F.get(places, at))
        above = lambda at: off(at).isNull() | (off(at + 1) < off(at)) | ((off(at + 1) == off(at)) & (F.get(order, at + 1) < F.get(order, at)))
        return let(let(below, lambda at: F.when(above(at), at + 1).otherwise(at)), lambda at: F.when(off(at) <= tol, F.get(values, at)).otherwise(x))

    return let(x.cast("double"), nearest)


def snap_value(x: Column, solved: Sequence[float], tol: float = 2.0) -> Column:
    """The nearest of a short list of values if within tol (inclusive; first in the list wins a tie), else x."""
    return _snap(x, [(v, v) for v in solved], tol)


def snap_raw(x: Column, raw_to_solved: Sequence[tuple[float, float]], tol: float = 2.0) -> Column:
    """As snap_value, but x is matched with raw coordinates and becomes the solved one of the match."""
    return _snap(x, raw_to_solved, tol)


def snap_point(p: Column, columns: Sequence[float], rows: Sequence[float], tol: float = 2.0) -> Column:
    """Elements 0 and 1 of a point snapped to columns and rows, the others kept; shorter arrays stay as they are."""
    snapped = F.transform(p, lambda v, i: F.when(i == 0, snap_value(v, columns, tol)).when(i == 1, snap_value(v, rows, tol)).otherwise(v))
    return F.when(F.size(p) >= 2, snapped).otherwise(p)


def bearing_step(x: Column, y: Column, degrees: Column, distance: Column) -> Column:
    """The point reached from (x, y): degrees count counter-clockwise from the x axis."""
    angle = F.radians(degrees)
    return F.struct((x + distance * F.cos(angle)).alias("x"), (y + distance * F.sin(angle)).alias("y"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def project(point: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """Matrix times point, one array element for each row of the matrix."""
    return F.array(*[dot(F.array(*map(F.lit, row)), point) for row in matrix])


def projection_error(seen: Column, point: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """Euclidean norm of the projected point less the seen one."""
    return F.sqrt(F.aggregate(F.zip_with(project(point, matrix), seen, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
