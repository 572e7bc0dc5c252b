"""Snapping and running conflict checks over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import snap_value


def snap_stream(stream: DataFrame, column: str, solved: Sequence[float], tol: float = 2.0) -> DataFrame:
    """A stream with one column snapped; narrow, so it keeps no state."""
    return stream.withColumn(column, snap_value(F.col(column), solved, tol))


def conflict_stream(stream: DataFrame, keys: list[str], value: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Keys that are given more than one value within a window of event time; state goes once the watermark passes."""
    seen = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return seen.agg(F.min(value).alias("least"), F.max(value).alias("greatest")).filter("greatest > least")
