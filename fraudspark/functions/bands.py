"""Score bands and the amounts and weights attached to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the score bands, level and action names.
CRITICAL, HIGH, MEDIUM = 75, 50, 25

# Fixed values: (at least this many transactions, score), highest first.
VELOCITY_BANDS = [(10, 40.0), (5, 25.0), (3, 10.0)]

# Fixed values: (amount, score), highest first.
AMOUNT_BANDS = [(50000, 35.0), (10000, 20.0), (5000, 10.0)]

# Fixed values of the small-amount pattern.
SMALL_AMOUNT = 10
SMALL_AMOUNT_MIN_COUNT = 3
PATTERN_SCORE = 25.0
MAX_SCORE = 100.0


def banded(column: Column, names: tuple[str, str, str, str]) -> Column:
    return (
        F.when(column >= CRITICAL, names[0])
        .when(column >= HIGH, names[1])
        .when(column >= MEDIUM, names[2])
        .otherwise(names[3])
    )


def risk_level(score: Column) -> Column:
    return banded(score, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))


def risk_action(score: Column) -> Column:
    return banded(score, ("BLOCK", "SUSPEND", "FLAG", "ALLOW"))


def level_rank(level: Column) -> Column:
    """Ordinal of a level name, so that a maximum means the worst level."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ["LOW", "MEDIUM", "HIGH", "CRITICAL"])), level), F.lit(0))


def level_name(rank: Column) -> Column:
    return F.when(rank == 4, "CRITICAL").when(rank == 3, "HIGH").when(rank == 2, "MEDIUM").otherwise("LOW")


def velocity_score(count: Column) -> Column:
    (a, x), (b, y), (c, z) = VELOCITY_BANDS
    return F.when(count >= a, x).when(count >= b, y).when(count >= c, z).otherwise(0.0)


def amount_score(amount: Column, inclusive: bool = False) -> Column:
    """The batch scorer uses ``>``, the rolling scorer ``>=``."""
    over = (lambda bound: amount >= bound) if inclusive else (lambda bound: amount > bound)
    (a, x), (b, y), (c, z) = AMOUNT_BANDS
    return F.when(over(a), x).when(over(b), y).when(over(c), z).otherwise(0.0)
