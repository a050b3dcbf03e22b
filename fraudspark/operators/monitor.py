"""Drift, calibration and feedback from analysts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.operators.selection import ROWS_AT_ONCE, counts_below, values_at_ranks

# Fixed values of the drift report and of the advice on factors.
PSI_BINS, PSI_FLOOR, PSI_MONITOR, PSI_ALERT = 10, 1e-6, 0.10, 0.20
MIN_SAMPLES, LOW_PRECISION, HIGH_PRECISION = 20, 0.30, 0.85


def quantile_edges(baseline: DataFrame, group: str, value: str, bins: int = PSI_BINS) -> DataFrame:
    """Per group the sorted distinct nearest-rank edges: lowest value, ``bins - 1`` inner ones, highest value."""
    totals = baseline.groupBy(group).agg(F.count(value).alias("total"))
    at = F.array(*[F.floor(F.lit(i) * F.col("total") / bins).cast("long") for i in range(bins)], F.col("total") - 1)
    ranks = totals.select(group, F.explode(F.array_distinct(at)).alias("rank"))
    edges = values_at_ranks(baseline, ranks, group, value).groupBy(group).agg(F.array_sort(F.collect_set(value)).alias("edges"))
    only = F.col("edges")[0]
    return edges.withColumn("edges", F.when(F.size("edges") < 2, F.array(only, only + 1e-9)).otherwise(F.col("edges")))


def psi_bins(baseline: DataFrame, recent: DataFrame, group: str = "model_name", value: str = "score", bins: int = PSI_BINS) -> DataFrame:
    """One row per group and bin: bounds, shares of both samples, contribution. Groups need both samples."""
    edges = quantile_edges(baseline, group, value, bins)
    tagged = baseline.select(group, value, F.lit(1).alias("old")).unionByName(recent.select(group, value, F.lit(0).alias("old")))
    last = F.size("edges") - 1
    place = F.least(F.greatest(F.size(F.filter("edges", lambda e: e <= F.col(value))), F.lit(1)), last)
    counts = (
        tagged.filter(F.col(value).isNotNull()).join(edges, group).withColumn("bin", place)
        .groupBy(group, "bin").agg(F.sum("old").alias("n_old"), F.sum(1 - F.col("old")).alias("n_new"))
    )
    all_bins = edges.select(group, "edges", F.explode(F.sequence(F.lit(1), last)).alias("bin"))
    whole = Window.partitionBy(group)
    shared = (
        all_bins.join(counts, [group, "bin"], "left").na.fill(0, ["n_old", "n_new"])
        .withColumn("n_baseline", F.sum("n_old").over(whole)).withColumn("n_recent", F.sum("n_new").over(whole))
        .filter(F.col("n_recent") > 0)
        .withColumn("baseline_frac", F.col("n_old") / F.col("n_baseline")).withColumn("recent_frac", F.col("n_new") / F.col("n_recent"))
    )
    safe = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(PSI_FLOOR)
    old, new = safe("baseline_frac"), safe("recent_frac")
    return shared.select(
        group, "bin", F.element_at("edges", F.col("bin")).alias("lo"), F.element_at("edges", F.col("bin") + 1).alias("hi"),
        "baseline_frac", "recent_frac", ((new - old) * F.log(new / old)).alias("psi_contribution"), "n_baseline", "n_recent",
    )


def drift_status(psi: Column, threshold: float = PSI_ALERT) -> Column:
    return F.when(psi >= threshold, "alert").when(psi >= PSI_MONITOR, "monitor").otherwise("stable")


def drift_report(baseline: DataFrame, recent: DataFrame, group: str = "model_name", value: str = "score", threshold: float = PSI_ALERT) -> DataFrame:
    """Per group: PSI and status; a group that lacks one of the samples is unavailable."""
    psi = psi_bins(baseline, recent, group, value).groupBy(group).agg(F.round(F.sum("psi_contribution"), 6).alias("psi"))
    sizes = (
        baseline.select(group, F.lit(1).alias("b"), F.lit(0).alias("r")).unionByName(recent.select(group, F.lit(0).alias("b"), F.lit(1).alias("r")))
        .groupBy(group).agg(F.sum("b").alias("n_baseline"), F.sum("r").alias("n_recent"))
    )
    return sizes.join(psi, group, "left").select(
        group, F.coalesce("psi", F.lit(0.0)).alias("psi"), F.when(F.col("psi").isNull(), "unavailable").otherwise(drift_status(F.col("psi"), threshold)).alias("status"),
        "n_baseline", "n_recent", F.lit(threshold).alias("threshold"),
    )


def recent_model_scores(model_scores: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Scores of the window the model itself has given; defaults after a timeout or error stay out."""
    kept = (F.col("created_at") >= as_of - F.expr(f"INTERVAL '{hours}' HOUR")) & (F.col("source") == "model") & F.col("model_score").isNotNull()
    return model_scores.filter(kept).select("model_name", F.col("model_score").alias("score"))


def percentiles(
    errors: DataFrame, calibration: DataFrame, group: str = "model_name", value: str = "score", pieces: int = 1, rows_at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """Adds ``percentile``: the share of the group's calibration below the error, or a sigmoid without any.

    Shares are worked out once per distinct value and joined back.
    """
    totals = calibration.groupBy(group).agg(F.count(value).alias("__total"))
    counted = counts_below(errors, calibration, group, value, pieces, rows_at_once).join(totals, group)
    ranked = counted.select(group, value, (F.col("below") / F.col("__total")).alias("percentile"))
    fallback = 1.0 / (1.0 + F.exp(-(F.col(value) - 1.0)))
    return (
        errors.join(ranked, [group, value], "left").withColumn("percentile", F.coalesce("percentile", fallback))
        .withColumn("is_anomaly", F.col("percentile") >= 0.95)
    )


def sorted_errors(errors: DataFrame, group: str = "model_name", value: str = "score") -> DataFrame:
    """The calibration file: each group's different errors with their numbers and first places in ascending order."""
    found = counts_below(errors, errors, group, value)
    return found.select(group, value, F.col("below").alias("first_place"), "n")


def calibration_percentiles(errors: DataFrame, points: Sequence[float] = (0.05, 0.5, 0.95, 0.99), group: str = "model_name", value: str = "score") -> DataFrame:
    """Exact nearest-rank percentiles of each group as (group, point, value)."""
    totals = errors.groupBy(group).agg(F.count(value).alias("total"))
    wanted = F.array(*[
        F.struct(F.lit(p).alias("point"), F.least(F.floor(F.lit(p) * F.col("total")).cast("long"), F.col("total") - 1).alias("rank")) for p in points
    ])
    ranks = totals.select(group, F.explode(wanted).alias("w")).select(group, "w.point", "w.rank")
    return values_at_ranks(errors, ranks, group, value).select(group, "point", value)


# --- analyst feedback ------------------------------------------------------------------------


def dispositions(alerts: DataFrame, scores: DataFrame, filings: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Alerts of the window as TP, FP or UNCLEAR, with the factors of their score."""
    filed = filings.filter(~F.col("status").isin("DRAFT", "REJECTED")).select(F.col("alert_id").alias("id")).distinct().withColumn("filed", F.lit(True))
    factors = scores.filter(F.col("factors").isNotNull()).select(F.col("id").alias("risk_score_id"), "factors")
    recent = alerts.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
    verdict = F.when(F.col("status") == "RESOLVED", "TP").when(F.col("status") == "DISMISSED", "FP").when(F.col("filed"), "TP").otherwise("UNCLEAR")
    return recent.join(factors, "risk_score_id").join(filed, "id", "left").select(
        F.col("id").alias("alert_id"), "factors", verdict.alias("disposition")
    )


def explode_factors(classified: DataFrame) -> DataFrame:
    """One row per factor of a decided alert, reduced to the factor name."""
    decided = classified.filter(F.col("disposition").isin("TP", "FP"))
    raw = F.explode(F.from_json("factors", "ARRAY<STRING>"))
    return decided.select("alert_id", raw.alias("raw"), "disposition").select("alert_id", F.split("raw", ":")[0].alias("factor"), "disposition")


def factor_precision(rows: DataFrame) -> DataFrame:
    """Hits, misses, precision and advice per factor."""
    counts = rows.groupBy("factor").agg(
        F.count_if(F.col("disposition") == "TP").alias("tp"), F.count_if(F.col("disposition") == "FP").alias("fp"),
        F.count_if(~F.col("disposition").isin("TP", "FP")).alias("unclear"),
    )
    decided = F.col("tp") + F.col("fp")
    precision = F.col("tp") / decided
    return counts.withColumn(
        "suggestion",
        F.when(decided < MIN_SAMPLES, "insufficient_data").when(precision < LOW_PRECISION, "loosen")
        .when(precision > HIGH_PRECISION, "tighten").otherwise("hold"),
    ).withColumn("precision", F.when(decided >= MIN_SAMPLES, F.round(precision, 3)))


def feedback_summary(stats: DataFrame) -> DataFrame:
    """Factors per advice, sorted. One name per factor: the lists are as short as the list of factors."""
    return stats.groupBy("suggestion").agg(F.count("*").alias("n_factors"), F.array_sort(F.collect_list("factor")).alias("factors"))


def training_labels(alerts: DataFrame, model_scores: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Labels signed by a person in the window, with every model score of the payment."""
    signed = alerts.filter(
        F.col("status").isin("RESOLVED", "DISMISSED") & F.col("resolved_by").isNotNull() & (F.col("resolved_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
    )
    scores = model_scores.select("transaction_id", "model_score", "model_name", "model_version")
    return signed.join(scores, "transaction_id", "left").select(
        F.col("id").alias("alert_id"), "transaction_id", F.when(F.col("status") == "RESOLVED", 1).otherwise(0).alias("label"), "resolved_by", "resolved_at",
        "model_score", "model_name", "model_version",
    )


def retrain_gate(labels: DataFrame, minimum: int = 200) -> DataFrame:
    """One row: whether a retraining may start, the reason if not, the number of labelled alerts and the number wanted."""
    counted = labels.agg(F.countDistinct("alert_id").alias("n_labels"))
    ready = F.col("n_labels") >= minimum
    return counted.select(
        F.when(ready, "retrain_started").otherwise("retrain_skipped").alias("event"), F.when(~ready, "insufficient_labels").alias("reason"),
        "n_labels", F.lit(minimum).alias("min_samples"),
    )


def enough_labels(labels: DataFrame, minimum: int = 200) -> bool:
    """Whether a retraining may start."""
    return retrain_gate(labels, minimum).head()["reason"] is None
