"""The star-schema mart: conforming, loading only passed runs, auditing, reporting."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearken.functions.numeric import round_even
from hearken.schemas import DEFAULT_APP, LANDED_AS, MART, NOT_NULL, OPTIONAL

PASSED = "passed"


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns, order and types of a mart table; cells that do not fit become NULL.

    A column is taken by its mart name or else by its landed name. Whole numbers written as text such as
    "1.0" are accepted. An absent column is an error unless the table may lack it.
    """
    cells, absent = [], []
    for field in StructType.fromDDL(MART[table]).fields:
        name, kind = field.name, field.dataType.simpleString()
        source = next((c for c in (name, LANDED_AS.get(table, {}).get(name)) if c in df.columns), None)
        if source is None:
            if name not in OPTIONAL.get(table, ()):
                absent.append(name)
            cell = F.lit(DEFAULT_APP if (table, name) == ("competitor_reviews", "app") else None)
        elif kind in ("smallint", "int"):
            cell = F.col(source).try_cast("double")
        else:
            cell = F.col(source)
        cells.append(cell.try_cast(kind).alias(name))
    if absent:
        raise ValueError(f"{table}: no column for {', '.join(absent)}")
    return df.select(*cells)


def new_runs(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Passed runs the mart does not know yet."""
    passed = candidates.filter(F.col("gate_status") == PASSED)
    return passed.join(existing.select("run_id"), "run_id", "left_anti")


def table_path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A mart table; one that was never loaded is empty."""
    try:
        return spark.read.schema(MART[table]).parquet(table_path(base, table))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MART[table])


def load(spark: SparkSession, base: str, runs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Load the passed runs among `runs` and their child rows; return rows per table.

    Child tables are partitioned by run and overwritten per partition, so loading a run again
    replaces its rows instead of doubling them. Rows of runs that did not pass never get in. Each task writes
    the rows it has, run by run: no row is shuffled, and a run has at most one file of each task.
    """
    fresh = new_runs(conform(runs, "runs"), read(spark, base, "runs"))
    fresh.write.mode("append").partitionBy("run_id").parquet(table_path(base, "runs"))
    # one row a run: whatever their estimated size, the child rows must not be shuffled to meet them
    passed = F.broadcast(runs.filter(F.col("gate_status") == PASSED).select("run_id"))
    for table, rows in tables.items():
        kept = conform(rows, table).join(passed, "run_id", "left_semi")
        (
            kept.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("run_id")
            .parquet(table_path(base, table))
        )
    return row_counts({t: read(spark, base, t) for t in ["runs", *tables]})


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def orphans(child: DataFrame, runs: DataFrame) -> DataFrame:
    """Child rows whose run is not in the mart."""
    return child.join(runs.select("run_id"), "run_id", "left_anti")


def constraint_violations(
    table: str, df: DataFrame, key: str = "run_id", runs: DataFrame | None = None
) -> DataFrame:
    """(table_name, rule, key, n) for every broken key, check, not-null or foreign-key rule."""
    checks: dict[str, Column] = {
        f"{c}_null": F.col(c).isNull() for c in NOT_NULL[table] if c in df.columns
    }
    if "rating" in df.columns:
        checks["rating_range"] = ~F.col("rating").between(1, 5)
    if "gate_status" in df.columns:
        checks["gate_not_passed"] = F.col("gate_status") != PASSED
    hits = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks.items()])
    )
    rows = df.select(F.col(key).alias("key"), F.explode(hits).alias("rule"))
    found = rows.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))
    if table == "runs":
        repeated = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.unionByName(repeated.withColumn("rule", F.lit("key_repeated")))
    if runs is not None:
        lost = orphans(df, runs).groupBy(F.col("run_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(lost.withColumn("rule", F.lit("run_missing")))
    return found.select(F.lit(table).alias("table_name"), "rule", "key", "n")


# --- reports ---------------------------------------------------------------------------------


def latest_passed(runs: DataFrame) -> Column:
    """The newest passed run id as a scalar subquery; on a partitioned table it prunes partitions."""
    return runs.filter(F.col("gate_status") == PASSED).agg(F.max("run_id")).scalar()


def of_latest(df: DataFrame, runs: DataFrame) -> DataFrame:
    return df.filter(F.col("run_id") == latest_passed(runs))


def top_painpoints(painpoints: DataFrame, runs: DataFrame, n: int = 5) -> DataFrame:
    """Pain points of the newest passed run by mention share."""
    return (
        of_latest(painpoints, runs)
        .orderBy(F.desc_nulls_first("mention_all_neg"), "topic")
        .limit(n)
        .select("topic", "freq", "mention_all_neg", "mention_assigned", "avg_rating")
    )


def rating_trend(own: DataFrame, rival: DataFrame, date: str = "review_date") -> DataFrame:
    """Monthly mean rating of both sides in one table."""

    def monthly(df: DataFrame) -> DataFrame:
        month = F.date_trunc("month", F.col(date)).cast("date")
        return (
            df.filter(F.col(date).isNotNull())
            .groupBy(month.alias("month"), "app")
            .agg(round_even(F.avg("rating"), 2).alias("avg_rating"), F.count(F.lit(1)).alias("n"))
        )

    return monthly(own).unionByName(monthly(rival)).orderBy("month", "app")


def run_history(runs: DataFrame, painpoints: DataFrame, prefix: str) -> DataFrame:
    """Mention share of the topics with a name prefix, run by run."""
    mine = painpoints.filter(F.col("topic").startswith(prefix))
    return mine.join(runs, "run_id").select("run_id", "created_at", "topic", "mention_all_neg")


def with_drift(history: DataFrame) -> DataFrame:
    """Change against the run before; one row per run and topic."""
    by_run = Window.partitionBy("topic").orderBy("created_at", "run_id")
    change = F.col("mention_all_neg") - F.lag("mention_all_neg").over(by_run)
    return history.withColumn("delta", round_even(change, 1))


def agents(runs: DataFrame, results: str = "agent_results") -> DataFrame:
    """One row per run and agent named in the JSON results."""
    return runs.withColumn("agent", F.explode(F.json_object_keys(results)))


def agent_status(runs: DataFrame, results: str = "agent_results") -> DataFrame:
    """How many agents of a run ended in which status."""
    parsed = F.from_json(results, "map<string,string>")
    pairs = runs.select("run_id", F.explode(parsed).alias("agent", "status"))
    return pairs.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


def head_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first rows for a report and how many were left out."""
    total = df.agg(F.count(F.lit(1))).scalar()
    omitted = F.greatest(total - F.lit(n), F.lit(0))
    return df.orderBy(*order).limit(n).withColumn("omitted_n", omitted)
