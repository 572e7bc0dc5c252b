"""Numbers out of drawing labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def borehole(label: Column) -> Column:
    """struct(surface, floor, thickness) of 'a / b ° t' or 'a ° t / b'; fields that the label lacks are null.

    The thickness is the number after the degree sign, the surface the first number, and the floor the one after
    the slash, in either order.
    """
    number = r"([-+]?[0-9]+(?:\.[0-9]+)?)"

    def after(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(label, pattern + number, 1), F.lit("")).cast("double")

    return F.struct(after(r"^\s*").alias("surface"), after(r"/\s*").alias("floor"), after(r"°\s*").alias("thickness"))
