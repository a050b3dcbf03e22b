"""Transaction counts per sender and receiver: tumbling windows and trailing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.functions.bands import SMALL_AMOUNT
from fraudspark.operators.skew import MICROS, micros, running_balance, slice_of, with_lookback

DAY = 86_400 * MICROS


def velocity_window(tx: DataFrame, width: str = "2 minutes") -> DataFrame:
    """Count and sum per sender and tumbling window."""
    return (
        tx.groupBy("sender_id", F.window("event_time", width).alias("w"))
        .agg(F.count("*").alias("txn_count_2min"), F.sum("amount").alias("total_amount_2min"))
        .select(
            "sender_id", "txn_count_2min", "total_amount_2min",
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        )
    )


def with_window_count(tx: DataFrame, width: str = "2 minutes") -> DataFrame:
    """Each event with the count of its own tumbling window.

    Counts are added up before the shuffle and joined back to the events, so the events of a hot sender never have to
    meet: Spark broadcasts a small table of counts, and splits a skewed partition of events otherwise.
    """
    keyed = tx.withColumn("__window", F.window("event_time", width).start)
    counts = keyed.groupBy(F.col("sender_id").alias("__sender"), F.col("__window").alias("__counted")).agg(F.count("*").alias("txn_count_2min"))
    same = F.col("sender_id").eqNullSafe(F.col("__sender")) & F.col("__window").eqNullSafe(F.col("__counted"))
    return keyed.join(counts, same).drop("__window", "__sender", "__counted")


def join_window_count(tx: DataFrame, velocity: DataFrame, width: str = "2 minutes") -> DataFrame:
    """The same as a join to stored window aggregates: equal on sender and window start, so no range join."""
    keyed = tx.withColumn("window_start", F.window("event_time", width).start)
    return keyed.join(velocity, ["sender_id", "window_start"])


def rolling_velocity(tx: DataFrame, seconds: int = 120, slice_seconds: int = 600) -> DataFrame:
    """Trailing count per sender including the event itself; an event exactly ``seconds`` old is out.

    Adds ``velocity_count``, ``prior_count`` (earlier events in the window) and ``prior_large``
    (those of them which are not small).
    """
    width, span = slice_seconds * MICROS, seconds * MICROS
    large = F.when(F.col("amount") >= SMALL_AMOUNT, 1).otherwise(0).cast("long")
    points = tx.withColumn("__t", micros("event_time")).withColumn("slice", slice_of(F.col("__t"), width))
    arrive = F.struct(F.col("__t").alias("__t"), F.lit(1).cast("long").alias("n"), large.alias("large"))
    leave = F.struct((F.col("__t") + span).alias("__t"), F.lit(-1).cast("long").alias("n"), (-large).alias("large"))
    deltas = (
        points.select("sender_id", F.explode(F.array(arrive, leave)).alias("d"))
        .select("sender_id", "d.*")
        .withColumn("slice", slice_of(F.col("__t"), width))
    )
    counted = running_balance(points, deltas, ["sender_id"], "__t", ["n", "large"])
    return (
        counted.withColumn("velocity_count", F.col("n"))
        .withColumn("prior_count", F.col("n") - 1)
        .withColumn("prior_large", F.col("large") - large)
        .drop("n", "large", "__t", "slice")
    )


def rapid_duplicates(
    tx: DataFrame, seconds: int = 120, tolerance_cents: int = 1, slice_seconds: int = 600
) -> DataFrame:
    """Ids of events whose amount, within one cent, was already sent in the trailing window.

    Amounts are cut into cells of one cent. Two amounts less than a cent apart share a cell or sit in
    neighbouring cells; an amount with a fraction is therefore shown once more to the cell above.
    """
    span = seconds * MICROS
    cell = F.floor(F.col("amount") * 100 / tolerance_cents).cast("long")
    fraction = (F.col("amount") * 10000 / tolerance_cents - cell * 100).cast("long")
    base = tx.select(
        "external_id", "sender_id", micros("event_time").alias("t"), cell.alias("cell"), fraction.alias("fraction")
    )
    seats = F.when(
        F.col("fraction") > 0,
        F.array(
            F.struct(F.col("cell").alias("seat"), F.lit(False).alias("guest")),
            F.struct((F.col("cell") + 1).alias("seat"), F.lit(True).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("cell").alias("seat"), F.lit(False).alias("guest"))))
    seated = with_lookback(
        base.select("external_id", "sender_id", "t", "fraction", F.explode(seats).alias("s")).select(
            "external_id", "sender_id", "t", "fraction", "s.*"
        ),
        "t", slice_seconds * MICROS, span,
    )
    here = Window.partitionBy("sender_id", "seat", "slice").orderBy("t", "external_id")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    trailing = Window.partitionBy("sender_id", "seat", "slice").orderBy("t").rangeBetween(-span + 1, 0)
    native_seen = F.last(F.when(~F.col("guest"), F.col("t")), ignorenulls=True).over(earlier)
    highest_guest = F.max(F.when(F.col("guest"), F.col("fraction"))).over(trailing)
    lowest_native = F.min(F.when(~F.col("guest"), F.col("fraction"))).over(trailing)
    hit = F.when(
        ~F.col("guest"), (native_seen > F.col("t") - span) | (highest_guest > F.col("fraction"))
    ).otherwise(lowest_native < F.col("fraction"))
    return (
        seated.withColumn("hit", F.coalesce(hit, F.lit(False)))
        .filter(F.col("hit") & ~F.col("is_context"))
        .select("external_id").distinct()
    )


def inbound_senders(tx: DataFrame, days: int = 30, slice_seconds: int = 600, merge_seconds: int = 86_400) -> DataFrame:
    """Distinct senders per receiver in the trailing window, as ``inbound_unique_senders``.

    A sender is present from an event until ``days`` after it. Presence is merged per (receiver,
    sender) from one row per ``merge_seconds``, which may not exceed the window; then entries and exits
    are summed over time. No set of senders is ever held for a receiver.
    """
    span, width = days * DAY, slice_seconds * MICROS
    if merge_seconds * MICROS > span:
        raise ValueError("merge_seconds must fit in the window")
    points = tx.withColumn("__t", micros("event_time")).withColumn("slice", slice_of(F.col("__t"), width))
    seen = (
        points.filter(F.col("receiver_id").isNotNull())
        .groupBy("receiver_id", "sender_id", slice_of(F.col("__t"), merge_seconds * MICROS).alias("slice"))
        .agg(F.min("__t").alias("first"), F.max("__t").alias("last"))
    )
    order = Window.partitionBy("receiver_id", "sender_id").orderBy("slice")
    stays = seen.withColumn("before", F.lag("last").over(order)).withColumn("after", F.lead("first").over(order))
    begins = F.col("before").isNull() | (F.col("before") + span <= F.col("first"))
    ends = F.col("after").isNull() | (F.col("after") >= F.col("last") + span)
    edges = F.array_compact(
        F.array(
            F.when(begins, F.struct(F.col("first").alias("__t"), F.lit(1).cast("long").alias("present"))),
            F.when(ends, F.struct((F.col("last") + span).alias("__t"), F.lit(-1).cast("long").alias("present"))),
        )
    )
    deltas = (
        stays.select("receiver_id", F.explode(edges).alias("e"))
        .select("receiver_id", "e.*")
        .withColumn("slice", slice_of(F.col("__t"), width))
    )
    counted = running_balance(points, deltas, ["receiver_id"], "__t", ["present"])
    return counted.withColumnRenamed("present", "inbound_unique_senders").drop("__t", "slice")


def escalated(amount: Column, velocity: Column, prior_count: Column, prior_large: Column) -> Column:
    """Only small amounts so far in the window, now a payment of at least 1000."""
    return (velocity >= 3) & (amount >= 1000) & (prior_count > 0) & (prior_large == 0)
