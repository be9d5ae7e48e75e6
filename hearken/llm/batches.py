"""How many rows Spark hands to Python at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with record batches of at most ROWS rows from now on, since rows here hold whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return df
