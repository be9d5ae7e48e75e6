"""Writers: published tables per run, lineage rows, report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, run_id: str) -> None:
    """Replace the rows of one run. The commit protocol makes the new files visible only when all
    of them are complete, and other runs are left alone."""
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def of_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def append_meta(meta: DataFrame, path: str) -> None:
    """Add lineage rows; history is kept."""
    meta.write.mode("append").parquet(path)


def report_csv(df: DataFrame, path: str, headers: dict[str, str]) -> None:
    """A report table as CSV under its published headers."""
    named = df.select(*[F.col(c).alias(h) for c, h in headers.items()])
    named.write.mode("overwrite").options(header=True, quoteAll=False, escape='"').csv(path)


def rows_csv(df: DataFrame, path: str) -> None:
    """Any flat table as CSV that `readers` gets back unchanged."""
    df.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        quoteAll=True, nullValue="", emptyValue='""',
    ).csv(path)


def save_weights(weights: DataFrame, path: str) -> None:
    """TF-IDF weights and their vocabulary as two long tables."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    written = weights.sparkSession.read.parquet(f"{path}/weights")
    vocab = written.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
