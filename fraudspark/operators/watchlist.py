"""Watch-list feeds as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.text import normalized

# Identifier properties of an entity, and the schemas whose names are screened.
IDENTIFIER_TYPES = ["passportNumber", "idNumber", "taxNumber", "innCode"]
SCREENED_SCHEMAS = ["Person", "Company", "Organization", "LegalEntity"]


def entities(feed: DataFrame, dataset: str) -> DataFrame:
    return feed.filter(F.coalesce("id", F.lit("")) != "").select(
        "id", F.coalesce("schema", F.lit("Unknown")).alias("schema_type"), F.coalesce("caption", F.lit("")).alias("caption"),
        F.coalesce("datasets", F.array(F.lit(dataset))).alias("datasets"),
    )


def entity_names(feed: DataFrame) -> DataFrame:
    """Primary names and aliases, one row each."""
    tagged = lambda column, kind: F.transform(
        F.coalesce(F.col(f"properties.{column}"), F.array().cast("array<string>")),
        lambda n: F.struct(n.alias("name"), F.lit(kind).alias("name_type")),
    )
    both = F.concat(tagged("name", "primary"), tagged("alias", "alias"))
    return feed.select(F.col("id").alias("entity_id"), F.explode(both).alias("n")).select(
        "entity_id", "n.name", normalized(F.col("n.name")).alias("name_normalized"), "n.name_type"
    )


def _country() -> Column:
    return F.get(F.col("properties.country"), F.lit(0))


def _identifiers(kind: str) -> Column:
    values = F.coalesce(F.col(f"properties.{kind}"), F.array().cast("array<string>"))
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("id_type"), v.alias("id_value")))


def entity_identifiers(feed: DataFrame) -> DataFrame:
    found = F.concat(*map(_identifiers, IDENTIFIER_TYPES))
    return feed.select(F.col("id").alias("entity_id"), _country().alias("country"), F.explode(found).alias("i")).select(
        "entity_id", "i.id_type", "i.id_value", "country"
    )


def entity_addresses(feed: DataFrame) -> DataFrame:
    return feed.select(F.col("id").alias("entity_id"), F.explode("properties.address").alias("full_address"), _country().alias("country"))


def screened_names(feed: DataFrame) -> DataFrame:
    """Names only, of the schemas that are screened."""
    listed = feed.filter(F.col("schema").isin(SCREENED_SCHEMAS))
    return listed.select(F.col("id").alias("entity_id"), F.explode("properties.name").alias("name")).withColumn(
        "name_normalized", normalized(F.col("name"))
    )
