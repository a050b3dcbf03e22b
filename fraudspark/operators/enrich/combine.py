"""Combination of all signals of a payment, and the stored enrichments of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.operators.skew import newest


def geo_check(df: DataFrame) -> DataFrame:
    """Adds ``geo_countries``, ``geo_score`` and ``geo_factors`` from ip_country, phone_country, card_country, expected_country."""
    names = ["ip_country", "phone_country", "card_country"]
    given = lambda c: F.when(F.col(c) != "", F.upper(c))
    derived = F.array_compact(F.array(*map(given, names)))
    everything = F.array_distinct(F.array_compact(F.array(*map(given, [*names, "expected_country"]))))
    n = F.size("geo_countries")
    absent = (F.col("expected_country") != "") & ~F.array_contains(F.col("geo_derived"), F.upper("expected_country"))
    absent = F.coalesce(absent, F.lit(False))
    return (
        df.withColumn("geo_derived", derived).withColumn("geo_countries", everything)
        .withColumn("geo_score", F.when(n >= 2, 25 + 10 * (n - 2) + F.when(absent, 10).otherwise(0)).otherwise(0))
        .withColumn(
            "geo_factors",
            F.when(n >= 2, F.array_compact(F.array(F.lit("geo_mismatch"), F.when(absent, F.lit("expected_country_absent")))))
            .otherwise(F.array().cast("array<string>")),
        )
        .drop("geo_derived")
    )


def combined_score(df: DataFrame, scores: Sequence[str], geo: str = "geo_score") -> DataFrame:
    """Mean of the scores that are present; the country check counts only where it found something."""
    present = F.array_compact(F.array(*[F.col(c).cast("double") for c in scores], F.when(F.col(geo) > 0, F.col(geo).cast("double"))))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn("combined_risk_score", F.bround(total / F.greatest(F.size(present), F.lit(1)), 1))


def entity_enrichments(enrichments: DataFrame) -> DataFrame:
    """Per entity the number of its stored results and all of them, the newest first, with their place."""
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("created_at"), F.desc("id")))
    rest = [c for c in enrichments.columns if c != "entity_id"]
    placed = enrichments.withColumn("__place", place)
    listed = F.array_sort(F.collect_list(F.struct(F.col("__place").alias("place"), *rest)))
    return placed.groupBy("entity_id").agg(F.count("*").alias("enrichment_count"), listed.alias("enrichments"))


def latest_enrichments(enrichments: DataFrame) -> DataFrame:
    """Newest row per entity and kind."""
    return newest(enrichments, ["entity_id", "enrichment_type"], ["created_at", "id"])
