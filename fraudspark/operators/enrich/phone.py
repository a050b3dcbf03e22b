"""Phone signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.operators.enrich.common import scored

# Prefixes of internet telephony and premium numbers.
VOIP_PREFIXES = ["1900", "1800", "1888", "1877", "1866"]
PREMIUM_PREFIXES = ["190", "0900"]


def phone_signals(contacts: DataFrame) -> DataFrame:
    """Adds ``phone_cleaned``, ``phone_factors`` and ``phone_score``."""
    base = contacts.withColumn("phone_cleaned", F.regexp_replace("phone", r"[^0-9+]", ""))
    cleaned = F.col("phone_cleaned")
    begins = lambda prefixes: cleaned.rlike("^(" + "|".join(prefixes) + ")")
    return scored(
        base,
        [("voip_number_detected", begins(VOIP_PREFIXES), 20), ("premium_rate_number", begins(PREMIUM_PREFIXES), 15)],
        "phone",
        ("invalid_phone_length", ~F.length(cleaned).between(7, 15), 25),
    )
