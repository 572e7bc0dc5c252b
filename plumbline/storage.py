"""Tables that cut lineage: written to the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, so that a loop's plan doesn't grow with its rounds.

    Spark takes the folder from spark.checkpoint.dir; a local session without one gets its own, any other raises.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file:///tmp/checkpoints/plumbline")
    return df.checkpoint()
