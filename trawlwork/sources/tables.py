"""Stored pages, place responses and ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlwork.plans.lineage import cut

PLACE_RESPONSE = (
    "searched_type string, status string, results array<struct<place_id:string, name:string, "
    "geometry:struct<location:struct<lat:double, lng:double>>, types:array<string>>>"
)


def read_page_archive(spark: SparkSession, path: str, html: str = "html", pdf: str | None = None) -> DataFrame:
    """Stored pages (parquet) that have html or pdf content."""
    pages = spark.read.parquet(path)
    present = F.col(html).isNotNull() if pdf is None else F.col(html).isNotNull() | F.col(pdf).isNotNull()
    return pages.filter(present)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """``(searched_type, place_id, name, lat, lon, types)`` from stored search responses (JSON lines).

    Responses without ``results`` are skipped; a place found under two types is two rows.
    """
    place = F.explode("results").alias("p")
    responses = spark.read.schema(PLACE_RESPONSE).json(path)
    return responses.select("searched_type", place).select(
        "searched_type",
        "p.place_id",
        "p.name",
        F.col("p.geometry.location.lat").alias("lat"),
        F.col("p.geometry.location.lng").alias("lon"),
        "p.types",
    )


def result_columns(matched: DataFrame) -> DataFrame:
    """Result rows as they are stored: quoted URLs, joined ingredients, scores as JSON."""
    return matched.select(
        F.concat(F.lit("'"), "google_url", F.lit("'")).alias("google_url"),
        F.concat(F.lit("'"), "establishment_url", F.lit("'")).alias("establishment_url"),
        "scraped_item",
        F.array_join("ingredients", ", ").alias("ingredients"),
        "combined_score",
        "attribute_scores",
    )


def _csv_column(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.to_json(name).alias(name) if kind in ("map", "struct", "array") else F.col(name)


def write_ranked_results(results: DataFrame, path: str, tie_breakers: list[str] | None = None) -> bool:
    """Write results as CSV with a header, best ``combined_score`` first; nothing is written when empty.

    The sort is a range partitioning: part files in name order are the ranking.
    """
    results = cut(results, "results")  # the emptiness test, the sort's sample and the sort read it
    if results.isEmpty():
        return False
    ties = tie_breakers or [c for c in ("establishment_url", "scraped_item") if c in results.columns]
    flat = results.select(*[_csv_column(results, c) for c in results.columns])
    flat.orderBy(F.col("combined_score").desc_nulls_last(), *ties).write.mode("overwrite").csv(
        path, header=True, escape='"'
    )
    return True
