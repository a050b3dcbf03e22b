"""Shared pieces of the enrichment operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored(df: DataFrame, parts: list[tuple[str, Column, int]], prefix: str, stop: tuple[str, Column, int] | None = None) -> DataFrame:
    """Adds ``<prefix>_factors`` and ``<prefix>_score``: the named parts that hold and their points, at most 100.

    Where the condition of ``stop`` holds, that part alone counts.
    """
    names = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok, _ in parts]))
    total = sum((F.when(F.coalesce(ok, F.lit(False)), F.lit(points)).otherwise(0) for _, ok, points in parts), F.lit(0))
    total = F.least(total, F.lit(100))
    if stop is not None:
        name, ok, points = stop
        ok = F.coalesce(ok, F.lit(False))
        names = F.when(ok, F.array(F.lit(name))).otherwise(names)
        total = F.when(ok, F.lit(points)).otherwise(total)
    return df.withColumn(f"{prefix}_factors", names).withColumn(f"{prefix}_score", total)


def more(df: DataFrame, parts: list[tuple[str, Column, int]], prefix: str) -> DataFrame:
    """Further parts on top of an existing score."""
    held = [F.coalesce(ok, F.lit(False)) for _, ok, _ in parts]
    names = F.array_compact(F.array(*[F.when(ok, F.lit(name)) for ok, (name, _, _) in zip(held, parts)]))
    total = sum((F.when(ok, F.lit(points)).otherwise(0) for ok, (_, _, points) in zip(held, parts)), F.col(f"{prefix}_score"))
    return df.withColumn(f"{prefix}_factors", F.concat(f"{prefix}_factors", names)).withColumn(
        f"{prefix}_score", F.least(total, F.lit(100))
    )


def flagged(df: DataFrame, values: DataFrame, column: str, flag: str) -> DataFrame:
    """Adds ``flag``: whether ``column`` is in the one-column table ``values``. Spark sizes the join at run time."""
    listed = values.toDF(column).distinct().withColumn(flag, F.lit(True))
    return df.join(listed, column, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
