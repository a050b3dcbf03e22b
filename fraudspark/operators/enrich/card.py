"""Card issuer signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.operators.enrich.common import scored

# Number prefixes of the card schemes; the longest match wins.
SCHEME_PREFIXES = {
    "VISA": ["4"],
    "AMEX": ["34", "37"],
    "DINERS": ["300", "301", "302", "303", "304", "305", "36", "38", "39"],
    "MASTERCARD": [
        "51", "52", "53", "54", "55", "2221", "2222", "2223", "2224", "2225", "2226", "2227", "2228", "2229", "223",
        "224", "225", "226", "227", "228", "229", "23", "24", "25", "26", "270", "271", "2720",
    ],
    "DISCOVER": ["6011", "65", "644", "645", "646", "647", "648", "649"],
    "JCB": ["35"],
    "UNIONPAY": ["62"],
    "MAESTRO": ["50", "56", "57", "58", "63"],
    "MAESTROUK": ["67"],
}


def bin6(number: Column) -> Column:
    """First six digits; null where there are fewer."""
    digits = F.regexp_replace(number, r"[^0-9]", "")
    return F.when(F.length(digits) >= 6, F.substring(digits, 1, 6))


def scheme(first_six: Column) -> Column:
    """Scheme by longest prefix: lengths four to one, each a lookup in a fixed map."""
    found = []
    for length in (4, 3, 2, 1):
        pairs = [(p, name) for name, prefixes in SCHEME_PREFIXES.items() for p in prefixes if len(p) == length]
        lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
        found.append(F.try_element_at(lookup, F.substring(first_six, 1, length)))
    return F.coalesce(*found)


def card_signals(contacts: DataFrame, issuers: DataFrame) -> DataFrame:
    """Adds scheme, issuer columns, ``card_factors`` and ``card_score``.

    ``issuers``: bin6, bank, country_code, card_type, prepaid. ``contacts`` needs card_bin and
    expected_country.
    """
    base = contacts.withColumn("bin6", bin6(F.col("card_bin"))).withColumn("card_scheme", scheme(F.col("bin6")))
    joined = base.join(issuers, "bin6", "left")
    other = F.upper("expected_country") != F.upper("country_code")
    return scored(
        joined,
        [
            ("prepaid_card", F.col("prepaid"), 20),
            ("card_country_mismatch", (F.col("expected_country") != "") & (F.col("country_code") != "") & other, 25),
        ],
        "card",
        ("unknown_bin_scheme", F.col("card_scheme").isNull(), 10),
    )
