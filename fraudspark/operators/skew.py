"""Building blocks which keep one hot key from landing in one task.

The three ideas used across the package:

* a key is always cut further by a slice of its order column, so that a group is (key, slice);
* what must cross a slice border travels as one small row per slice (prefix sums, head rows);
* a latest or first row per key is an aggregate or a limit before the shuffle, never a list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(column: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp column, with or without zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def slice_of(order: Column, width: int) -> Column:
    """Number of the slice of ``width`` microseconds an instant lies in."""
    return ((order - F.pmod(order, F.lit(width))) / F.lit(width)).cast("long")


def with_slices(df: DataFrame, key: str, order: Column, coarse: int, fine: int, dense_rows: int) -> DataFrame:
    """Adds ``slice``, the start of the slice of each row: coarse, but fine where a key is busy.

    A coarse slice of a key with more than ``dense_rows`` rows is cut further; ``coarse`` must be a
    multiple of ``fine``. Only the busy slices are listed, from an aggregate with map-side combine.
    """
    if coarse % fine:
        raise ValueError("a coarse slice must hold whole fine ones")
    start = lambda width: slice_of(order, width) * F.lit(width)
    keyed = df.withColumn("__coarse", start(coarse))
    busy = (
        keyed.groupBy(key, "__coarse").agg(F.count("*").alias("n")).filter(F.col("n") > dense_rows)
        .select(key, "__coarse", F.lit(True).alias("__busy"))
    )
    return (
        keyed.join(busy, [key, "__coarse"], "left")
        .withColumn("slice", F.when(F.col("__busy"), start(fine)).otherwise(F.col("__coarse")))
        .drop("__coarse", "__busy")
    )


def with_lookback(df: DataFrame, order: str, width: int, lookback: int) -> DataFrame:
    """Adds ``slice`` and ``is_context``.

    Each row appears in its own slice and, when it lies within ``lookback`` of the end of the
    slice, once more as context of the following one. ``lookback`` may not exceed ``width``.
    """
    if lookback > width:
        raise ValueError("lookback must fit in one slice")
    own = slice_of(F.col(order), width)
    near_end = (own + 1) * F.lit(width) - F.col(order) <= F.lit(lookback)
    targets = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("__own", own).withColumn("slice", F.explode(targets)).withColumn(
        "is_context", F.col("slice") != F.col("__own")
    ).drop("__own")


def running_balance(
    points: DataFrame,
    deltas: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    slice_column: str = "slice",
    inclusive: bool = True,
) -> DataFrame:
    """For each row of ``points``: the sum of every delta of its keys up to its order value.

    ``deltas`` holds keys, order, slice and the value columns. Sums are built in two levels, inside
    (keys, slice) and over the slice totals, so the cost of a hot key is spread over its slices.
    With ``inclusive`` a delta at exactly the order value of the point counts.
    """
    keys = list(keys)
    group = [*keys, slice_column]
    deltas = deltas.groupBy(*group, order).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)

    touched = points.select(*group).distinct().select(*group, *[F.lit(0).alias(v) for v in values])
    totals = deltas.select(*group, *values).unionByName(touched).groupBy(*group).agg(
        *[F.sum(v).alias(v) for v in values]
    )
    carried = totals.select(
        *group, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__carry_{v}") for v in values]
    )

    first, second = (0, 1) if inclusive else (1, 0)
    payload = [c for c in points.columns if c not in group + [order]]
    marked = points.withColumn("__rank", F.lit(second)).withColumn("__point", F.lit(True))
    moves = deltas.withColumn("__rank", F.lit(first)).withColumn("__point", F.lit(False))
    rows = marked.unionByName(moves, allowMissingColumns=True).join(carried, group, "left")
    so_far = Window.partitionBy(*group).orderBy(order, "__rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(
        *group, order, *payload, "__point",
        *[
            (F.coalesce(F.sum(v).over(so_far), F.lit(0)) + F.coalesce(F.col(f"__carry_{v}"), F.lit(0))).alias(v)
            for v in values
        ],
    )
    return summed.filter("__point").drop("__point")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the greatest by ``order``: an aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key. Spark cuts each partition to ``n`` per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
