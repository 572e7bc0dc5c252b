"""Flows that chain operators from drawing files to corrected coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.clustering import leader_clusters
from plumbline.operators.constraints import conflicts, resolve_dimensions
from plumbline.operators.graph import edges
from plumbline.sources.drawing import read_entities, transform, typed


def snap_drawings(spark: SparkSession, path: str, columns: Sequence[float], rows: Sequence[float], tol: float = 2.0) -> DataFrame:
    """Reads drawing files and snaps them to a solved grid."""
    return typed(transform(read_entities(spark, path), columns, rows, tol))


def relations(dimensions: DataFrame, circles: DataFrame, tol: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Relations of a view's dimensions, and its circles with the row (group_no) each lies in."""
    rows = leader_clusters(circles.withColumn("view", F.lit("top")), ["view"], "y", "circle_id")
    return resolve_dimensions(dimensions, circles, tol), rows


def distance_graph(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of resolved dimensions, and the pairs that are given different distances."""
    e = edges(resolved)
    return e, conflicts(e, ["src", "dst"], "value")
