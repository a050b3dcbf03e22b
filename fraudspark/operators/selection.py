"""Exact order statistics of large groups: values at given ranks, and ranks of given values.

A few ranks are found by selection: a mergeable sketch of the values between two bounds cuts them into pieces, counts
tell exactly which piece holds a rank, and the piece is cut again until it holds a stated number of rows or one value.
Values are only scanned and counted for that; what is sorted at the end is bounded.

Ranks of many values need an order of all of them: rows of equal values become one, Spark's range partitioning deals
them to pieces of a stated size, and running counts within pieces are set off by the counts of the pieces before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.session import cut_lineage

ROWS_AT_ONCE = 1_000_000


def _same(a: str, b: str, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _between(values: DataFrame, bounds: DataFrame, group: str, value: str) -> DataFrame:
    """Values strictly between the bounds of their group; a null bound is none."""
    low, high = F.col("__low"), F.col("__high")
    inside = (low.isNull() | (F.col(value) > low)) & (high.isNull() | (F.col(value) < high))
    return values.select(group, value).join(bounds, group).filter(inside)


def values_at_ranks(values: DataFrame, ranks: DataFrame, group: str, value: str, pieces: int = 32, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Exact values at 0-based ``rank`` positions of each group's sorted values; nulls have no place.

    ``ranks``: group, rank and any further columns; a rank beyond a group's values gives no row. Each round scans the
    values twice and cuts what is open into ``pieces``; no task sorts more than ``rows_at_once`` rows of a group.
    """
    values = values.filter(F.col(value).isNotNull())
    kind = values.schema[value].dataType.simpleString()
    none = F.lit(None).cast(kind)
    sizes = values.groupBy(group).agg(F.count("*").alias("__n"))
    wanted = ranks.join(sizes, group).filter((F.col("rank") >= 0) & (F.col("rank") < F.col("__n"))).select(
        *ranks.columns, none.alias("__low"), none.alias("__high"), F.lit(0).cast("long").alias("__start"), "__n", none.alias(value)
    )
    wanted = cut_lineage(wanted)
    bounds = [group, "__low", "__high"]
    while True:
        is_open = F.col(value).isNull() & (F.col("__n") > rows_at_once)
        if wanted.filter(is_open).isEmpty():
            break
        wanted = cut_lineage(_narrowed(values, wanted, is_open, bounds, group, value, pieces, kind))
    rest = wanted.filter(F.col(value).isNull()).drop(value)
    so_far = Window.partitionBy(*bounds).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counted = _between(values, rest.select(*bounds).distinct(), group, value).groupBy(*bounds, value).agg(F.count("*").alias("__times"))
    placed = counted.withColumn("__upto", F.sum("__times").over(so_far))
    within = F.col("w.rank") - F.col("w.__start")
    sorted_out = rest.alias("w").join(placed.alias("p"), _same("w", "p", bounds) & (within < F.col("p.__upto")) & (within >= F.col("p.__upto") - F.col("p.__times")))
    return (
        wanted.filter(F.col(value).isNotNull()).select(*ranks.columns, value)
        .unionByName(sorted_out.select(*[F.col(f"w.{c}") for c in ranks.columns], F.col(f"p.{value}").alias(value)))
    )


def _narrowed(values: DataFrame, wanted: DataFrame, is_open: Column, bounds: list[str], group: str, value: str, pieces: int, kind: str) -> DataFrame:
    """One round: open ranks move into the piece that holds them, between two cuts or at a cut itself."""
    still = wanted.filter(is_open)
    # A span that is open has more than a stated number of rows, so there are few. By group, all rows of one would meet in one task.
    inside = _between(values, F.broadcast(still.select(*bounds).distinct()), group, value)
    shares = [i / pieces for i in range(1, pieces)]
    cuts = inside.groupBy(*bounds).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, shares, 10 * pieces))).alias("__cuts"))
    below = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    place = 2 * below + F.array_contains("__cuts", F.col(value)).cast("int")
    # Only numbers are grouped here and the cuts are joined to the few counts: with an array beside them, Spark would sort all rows.
    counts = _between(values, F.broadcast(cuts), group, value).select(*bounds, place.alias("__place")).groupBy(*bounds, "__place").agg(F.count("*").alias("__n"))
    counts = counts.alias("n").join(cuts.alias("c"), _same("n", "c", bounds)).select("n.*", "c.__cuts")
    earlier = Window.partitionBy(*bounds).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.floor(F.col("__place") / 2).cast("int")
    is_cut = F.col("__place") % 2 == 1
    spans = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).select(
        *bounds, "__n", "__before",
        F.when(is_cut, F.get("__cuts", at)).cast(kind).alias("__value"),
        F.coalesce(F.get("__cuts", at - 1), F.col("__low")).alias("__new_low"), F.coalesce(F.get("__cuts", at), F.col("__high")).alias("__new_high"),
    )
    within = F.col("w.rank") - F.col("w.__start")
    moved = still.alias("w").join(
        spans.alias("s"), _same("w", "s", bounds) & (within >= F.col("s.__before")) & (within < F.col("s.__before") + F.col("s.__n"))
    )
    own = [c for c in wanted.columns if c not in ("__low", "__high", "__start", "__n", value)]
    moved = moved.select(
        *[F.col(f"w.{c}") for c in own], F.col("s.__new_low").alias("__low"), F.col("s.__new_high").alias("__high"),
        (F.col("w.__start") + F.col("s.__before")).alias("__start"), F.col("s.__n").alias("__n"), F.col("s.__value").alias(value),
    )
    return wanted.filter(~is_open).unionByName(moved)


def in_pieces(rows: DataFrame, group: str, value: str, pieces: int = 1, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """The rows with ``__piece``: pieces of about ``rows_at_once`` rows, in the order of group and value."""
    size = max(pieces, -(-rows.count() // rows_at_once), 1)
    return cut_lineage(rows.repartitionByRange(size, group, value).withColumn("__piece", F.spark_partition_id()))


def counts_below(points: DataFrame, values: DataFrame, group: str, value: str, pieces: int = 1, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(group, value, n, below) for each different value of either table: how many of ``values`` are equal to it, and smaller."""
    both = points.select(group, value, F.lit(0).alias("n")).unionByName(values.select(group, value, F.lit(1).alias("n")))
    each = both.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum("n").alias("n"))
    rows = in_pieces(each, group, value, pieces, rows_at_once)
    before = Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy(group, "__piece").agg(F.sum("n").alias("__sum")).select(group, "__piece", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__carry"))
    so_far = Window.partitionBy(group, "__piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("__within", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    return running.join(earlier, [group, "__piece"]).select(group, value, "n", (F.col("__carry") + F.col("__within")).alias("below"))
