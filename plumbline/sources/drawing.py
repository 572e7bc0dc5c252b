"""Drawing files: JSON arrays of entities in, JSON and OBJ text out.

An entity stays a variant from reading to writing: snapping replaces the coordinates it moves and nothing else, so
handles, layers, radii, texts and fields nobody knows come out as they went in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.geometry import chebyshev, let, snap_value

# The point fields and the point-list fields of an entity's attributes.
POINTS = ("start", "end", "center", "insert_point", "location", "defpoint", "defpoint2", "defpoint3", "defpoint4", "defpoint5", "text_midpoint")
POINT_LISTS = ("vertices", "control_points")

OBJECT, LIST = "map<string,variant>", "array<variant>"


def parse_entities(df: DataFrame, value: str) -> DataFrame:
    """df's other columns and, for each element of the JSON array in value: ordinal, entity (variant), type, handle, attributes."""
    rows = df.withColumn("_list", F.try_variant_get(F.parse_json(value), "$", LIST))
    rows = rows.select(*[c for c in df.columns if c != value], F.posexplode("_list").alias("ordinal", "entity"))
    return _views(rows)


def _views(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "type": F.try_variant_get("entity", "$.type", "string"),
        "handle": F.try_variant_get("entity", "$.handle", "string"),
        "attributes": F.try_variant_get("entity", "$.attributes", "variant"),
    })


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, entity, type, handle, attributes): one row an element of each file's JSON array, in its order."""
    return parse_entities(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"), "value")


def typed(entities: DataFrame) -> DataFrame:
    """Adds a typed column for each known point field, point list, the INSERT sub-points and the measurement."""
    point = {c: F.try_variant_get("attributes", f"$.{c}", "array<double>") for c in POINTS}
    lists = {c: F.try_variant_get("attributes", f"$.{c}", "array<array<double>>") for c in POINT_LISTS}
    inserts = F.when(F.col("type") == "INSERT", F.try_variant_get("attributes", "$.attributes", "array<struct<insert:array<double>>>"))
    return entities.withColumns({**point, **lists, "inserts": inserts, "measurement": F.try_variant_get("attributes", "$.measurement", "double")})


def transform(entities: DataFrame, columns: Sequence, rows: Sequence, tol: float = 2.0, snap: Callable[[Column, Sequence, float], Column] = snap_value) -> DataFrame:
    """Snaps every point of entities to the grid, then restates the measurement of each DIMENSION.

    Narrow: no shuffle. columns and rows are what snap takes: solved values, or (raw, solved) pairs for snap_raw. What
    is no list of two or more stays as it is, as does a coordinate that no value is near; a DIMENSION without both
    points keeps its measurement.
    """

    def point(p: Column) -> Column:
        def moved(v: Column, grid: Sequence) -> Column:
            to = lambda x: let(snap(x, grid, tol), lambda y: F.when(y != x, y.cast("variant")).otherwise(v))
            return let(F.try_variant_get(v, "$", "double"), to)

        each = lambda parts: F.transform(parts, lambda v, i: F.when(i == 0, moved(v, columns)).when(i == 1, moved(v, rows)).otherwise(v))
        return let(F.try_variant_get(p, "$", LIST), lambda parts: F.when(F.size(parts) >= 2, F.to_variant_object(each(parts))).otherwise(p))

    def points(ps: Column) -> Column:
        return F.coalesce(F.to_variant_object(F.transform(F.try_variant_get(ps, "$", LIST), point)), ps)

    def inserted(a: Column) -> Column:
        fields = F.try_variant_get(a, "$", OBJECT)
        return F.coalesce(F.to_variant_object(F.transform_values(fields, lambda k, v: F.when(k == "insert", point(v)).otherwise(v))), a)

    def attribute(k: Column, v: Column) -> Column:
        inner = F.coalesce(F.to_variant_object(F.transform(F.try_variant_get(v, "$", LIST), inserted)), v)
        return F.when(k.isin(*POINTS), point(v)).when(k.isin(*POINT_LISTS), points(v)).when((k == "attributes") & (F.col("type") == "INSERT"), inner).otherwise(v)

    fields = F.transform_values(F.try_variant_get("attributes", "$", OBJECT), attribute)
    out = entities.withColumn("_fields", fields)
    a, b = (F.try_variant_get(F.try_element_at("_fields", F.lit(p)), "$", "array<double>") for p in ("defpoint2", "defpoint3"))
    size = F.when(F.col("type") == "DIMENSION", let(F.struct(a.alias("a"), b.alias("b")), lambda p: chebyshev(F.get(p["b"], 0) - F.get(p["a"], 0), F.get(p["b"], 1) - F.get(p["a"], 1))))
    out = out.withColumn("_size", size)
    size = F.col("_size")
    stated = F.map_concat(F.map_filter("_fields", lambda k, v: k != "measurement"), F.create_map(F.lit("measurement"), size.cast("variant")))
    out = out.withColumn("_fields", F.when(size.isNotNull(), stated).otherwise(F.col("_fields")))
    whole = F.transform_values(F.try_variant_get("entity", "$", OBJECT), lambda k, v: F.when((k == "attributes") & F.col("_fields").isNotNull(), F.to_variant_object("_fields")).otherwise(v))
    return _views(out.withColumn("entity", F.coalesce(F.to_variant_object(whole), "entity")).drop("_fields", "_size"))


def entity_json(entities: DataFrame) -> DataFrame:
    """(file, ordinal, value): each entity as one JSON object, with all its fields."""
    return entities.select("file", "ordinal", F.to_json("entity").alias("value"))


def write_json_lines(entities: DataFrame, path: str) -> None:
    """JSON Lines, one file a task."""
    entity_json(entities).select("value").write.text(path)


def write_json_arrays(entities: DataFrame, path: str) -> int:
    """One JSON array for each drawing file, in a folder file=<name>; the number of entities.

    A file is one ordered text, so one task writes it, a line an entity; its rows are sorted and streamed, not held.
    """
    seen, order = Observation(), Window.partitionBy("file").orderBy("ordinal")
    lines = entity_json(entities.observe(seen, F.count(F.lit(1)).alias("n"))).withColumns({"_at": F.row_number().over(order), "_next": F.lead("ordinal").over(order)})
    value = F.concat(F.when(F.col("_at") == 1, "[").otherwise(""), "value", F.when(F.col("_next").isNull(), "]").otherwise(","))
    lines.select("file", value.alias("value")).write.partitionBy("file").text(path)
    return seen.get["n"]


def vertex_line(x: Column, y: Column, z: Column) -> Column:
    return F.format_string("v %.6f %.6f %.6f", x, y, z)


def face_line(i: Column, j: Column, k: Column) -> Column:
    return F.format_string("f %d %d %d", i, j, k)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One mesh as OBJ text: vertices by idx, then faces. The format needs one ordered file, so one task writes it."""
    lines = vertices.select(F.lit(0).alias("part"), F.col("idx").alias("at"), vertex_line(F.col("x"), F.col("y"), F.col("z")).alias("value"))
    lines = lines.unionByName(faces.select(F.lit(1).alias("part"), F.col("i").alias("at"), face_line(F.col("i"), F.col("j"), F.col("k")).alias("value")))
    lines.coalesce(1).sortWithinPartitions("part", "at").select("value").write.text(path)
