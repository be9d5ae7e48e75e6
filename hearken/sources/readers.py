"""Readers of landed files. Every reader has an explicit schema; a file that breaks its contract is
a named error or a violation row, never a silent NULL table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken import schemas
from hearken.functions import text
from hearken.functions.fixed_values import PAINPOINT_HEADERS
from hearken.operators.cleaning import first_per_key

# UTF-8 with or without byte-order mark, quoted fields with line breaks and doubled quotes.
CSV = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}


def reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REVIEWS).options(**CSV).csv(path)


def app_reviews(spark: SparkSession, path: str, app: str) -> DataFrame:
    """The crawl of one app with its name stamped on."""
    return reviews_csv(spark, path).withColumn("app", F.lit(app))


def survey_export(spark: SparkSession, path: str) -> DataFrame:
    """A form export: every column text, headers as exported."""
    return spark.read.options(**CSV, inferSchema=False).csv(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows; run the step that writes it again")
    return df


def painpoints_csv(spark: SparkSession, path: str) -> DataFrame:
    """The published pain-point file as text cells under internal names, ready for the range rules."""
    raw = spark.read.options(**CSV, inferSchema=False).csv(path)
    missing = [h for h in PAINPOINT_HEADERS.values() if h not in raw.columns]
    if missing:
        raise ValueError(f"pain-point file lacks the columns {missing}")
    cells = [F.col(f"`{header}`").alias(name) for name, header in PAINPOINT_HEADERS.items()]
    return require_rows(raw.select(*cells), "pain-point file")


def cx_scores(spark: SparkSession, path: str, axes: int = 5) -> DataFrame:
    """A score sheet (name, five axes) as (name, axis, score, valid); valid scores are 1..5."""
    raw = require_rows(spark.read.options(**CSV, inferSchema=False).csv(path), "score sheet")
    name, *scores = raw.columns
    if len(scores) != axes:
        raise ValueError(f"score sheet needs a name and {axes} axes, found {len(scores)}")
    long = raw.unpivot([name], scores, "axis", "cell")
    score = F.col("cell").try_cast("double")
    return long.select(
        F.col(f"`{name}`").alias("name"), "axis", score.alias("score"),
        F.coalesce(score.between(1, 5), F.lit(False)).alias("valid"),
    )


def lineage_metas(spark: SparkSession, path: str) -> DataFrame:
    """Lineage metas with their file; a file that is no JSON object keeps its text as corrupt."""
    metas = (
        spark.read.schema(schemas.LINEAGE_META)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    return metas.withColumn("file", F.input_file_name())


def run_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN_MANIFEST).option("multiLine", True).json(path)


def embedding_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Recorded manifests of vectors; a file that is no JSON object has NULL everywhere and admits nothing."""
    return spark.read.schema(schemas.EMBEDDING_MANIFEST).option("multiLine", True).json(path)


def newest_passed(manifests: DataFrame) -> DataFrame:
    """The manifest of the newest passed run."""
    passed = manifests.filter(F.col("gate_status") == "passed")
    newest = passed.agg(F.max_by(F.struct(*manifests.columns), "run_id").alias("m"))
    return newest.filter(F.col("m").isNotNull()).select("m.*")


def search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed search-API pages to hits: one row per item, title and description without markup."""
    pages = spark.read.schema(schemas.SEARCH_PAGE).json(path)
    title = F.coalesce("item.title", F.lit(""))
    body = F.coalesce("item.description", F.lit(""))
    return pages.select("axis", "query", "origin", F.explode("items").alias("item")).select(
        "axis", "query", "origin",
        F.col("item.link").alias("link"),
        text.strip_tags(F.concat_ws(" ", title, body)).alias("review"),
    )


def review_pages(spark: SparkSession, path: str, max_reviews: int | None = None) -> DataFrame:
    """Landed review batches without repeated reviews; with `max_reviews` only the newest so many are read."""
    pages = spark.read.schema(schemas.REVIEW_PAGE).json(path)
    named = pages.select(
        F.col("content").alias("review"), F.col("score").alias("rating"),
        F.col("at").alias("date"), F.col("thumbsUpCount").alias("likes"),
    )
    if max_reviews is not None:
        named = named.orderBy(F.desc("date"), "review").limit(max_reviews)
    return first_per_key(named, ["review", "date"], [F.desc_nulls_last("likes"), F.col("rating")])
