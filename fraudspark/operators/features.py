"""Keyed feature rows with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.operators.skew import micros, newest


def feature_key(*parts: str, prefix: str = "features") -> Column:
    """Key of scope, entity and window; a colon inside a part becomes an underscore."""
    return F.concat_ws(":", F.lit(prefix), *[F.translate(p, ":", "_") for p in parts])


def latest_features(features: DataFrame, as_of: Column) -> DataFrame:
    """Newest row per key of those which have not expired."""
    keyed = features.withColumn("feature_key", feature_key("scope", "entity_id", "feature_window"))
    now = F.unix_micros(as_of.cast("timestamp"))
    alive = keyed.filter(now < micros("put_at") + F.col("ttl_seconds") * 1_000_000)
    return newest(alive, ["feature_key"], ["put_at", "event_id"])
