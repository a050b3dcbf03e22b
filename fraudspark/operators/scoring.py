"""Additive risk scores and the records made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.functions import bands
from fraudspark.operators.velocity import (
    escalated,
    inbound_senders,
    rapid_duplicates,
    rolling_velocity,
    with_window_count,
)

# Words in a name or id that raise the entity score.
ENTITY_KEYWORDS = ["test", "fraud", "blocked", "suspicious", "sanctioned"]

# Payee-verification reason codes and their weights.
COP_WEIGHTS = {
    "AC01": 40.0, "ANNM": 25.0, "IVCR": 20.0, "ACNS": 18.0, "MBAM": 12.0, "BAMM": 10.0,
    "PAMM": 10.0, "OPTO": 8.0, "BANM": 5.0, "CASS": 3.0, "SCNS": 2.0,
}
COP_UNMATCHED = 15.0

# Words of the local score and its thresholds.
LOCAL_KEYWORDS = ["crypto", "exchange", "betting", "gambling", "casino", "offshore"]


def score_transactions(tx: DataFrame) -> DataFrame:
    """Windowed score: velocity + amount + small-amount pattern, at most 100."""
    small = (F.col("amount") < bands.SMALL_AMOUNT) & (F.col("txn_count_2min") >= bands.SMALL_AMOUNT_MIN_COUNT)
    return (
        with_window_count(tx)
        .withColumn("velocity_score", bands.velocity_score(F.col("txn_count_2min")))
        .withColumn("amount_score", bands.amount_score(F.col("amount")))
        .withColumn("pattern_score", F.when(small, bands.PATTERN_SCORE).otherwise(0.0))
        .withColumn(
            "risk_score",
            F.least(F.col("velocity_score") + F.col("amount_score") + F.col("pattern_score"), F.lit(bands.MAX_SCORE)),
        )
    )


def pattern_label(fallback: str = "NONE") -> Column:
    small = (F.col("amount") < bands.SMALL_AMOUNT) & (F.col("txn_count_2min") >= bands.SMALL_AMOUNT_MIN_COUNT)
    return F.when(small, "TESTING_THE_WATERS").when(F.col("txn_count_2min") >= 10, "VELOCITY_BURST").otherwise(fallback)


def _score2(column: str = "risk_score") -> Column:
    return F.col(column).cast("decimal(5,2)")


def transactions_out(scored: DataFrame, processed_at: Column) -> DataFrame:
    return scored.select(
        F.col("external_id").alias("id"), "external_id", "sender_id", "receiver_id", "amount", "currency",
        "sender_iban", "receiver_iban", "transaction_type", F.lit("PENDING").alias("status"), "iso20022_msg_type",
        F.lit("{}").alias("metadata"), F.col("event_time").alias("created_at"),
        F.col("event_time").alias("updated_at"), processed_at.alias("processed_at"),
    )


def scored_events(scored: DataFrame, scored_at: Column) -> DataFrame:
    return scored.select(
        "external_id", "sender_id", "amount", "currency", _score2().alias("risk_score"),
        bands.risk_level(F.col("risk_score")).alias("risk_level"), "txn_count_2min",
        F.lit(False).alias("sanctions_match"), pattern_label().alias("pattern_detected"), scored_at.alias("scored_at"),
    )


def risk_scores(scored: DataFrame, scored_at: Column, model_version: str = "v1.0-stream") -> DataFrame:
    return scored.select(
        F.col("external_id").alias("transaction_id"), F.col("sender_id").alias("entity_id"),
        _score2().alias("risk_score"), bands.risk_level(F.col("risk_score")).alias("risk_level"),
        F.lit("[]").alias("factors"), _score2("velocity_score").alias("velocity_score"),
        F.lit(0).cast("decimal(5,2)").alias("sanctions_score"), _score2("pattern_score").alias("pattern_score"),
        F.lit(model_version).alias("model_version"), scored_at.alias("scored_at"),
    )


def interdictions(scored: DataFrame, issued_at: Column) -> DataFrame:
    reason = F.concat(
        F.lit("Auto-interdiction: Risk score "), _score2().cast("string"), F.lit(" | Velocity: "),
        F.col("txn_count_2min").cast("string"), F.lit(" txns/2min | Amount: "), F.col("amount").cast("string"),
        F.lit(" "), F.col("currency"),
    )
    return scored.filter(F.col("risk_score") >= bands.HIGH).select(
        "external_id", "sender_id", bands.risk_action(F.col("risk_score")).alias("action"), reason.alias("reason"),
        _score2().alias("risk_score"), issued_at.alias("issued_at"),
    )


def alert_type(score: Column) -> Column:
    return F.when(score >= bands.CRITICAL, "CRITICAL_RISK").when(score >= bands.HIGH, "HIGH_RISK").otherwise("VELOCITY_ANOMALY")


def alerts(scored: DataFrame, created_at: Column) -> DataFrame:
    title = F.concat(
        F.lit("High-risk transaction detected: "), F.col("external_id"), F.lit(" ("),
        F.col("amount").cast("string"), F.lit(" "), F.col("currency"), F.lit(")"),
    )
    description = F.concat(
        F.lit("Sender: "), F.col("sender_id"), F.lit(" | Risk Score: "), _score2().cast("string"),
        F.lit(" | Velocity: "), F.col("txn_count_2min").cast("string"), F.lit(" txns/2min | Pattern: "),
        pattern_label("AMOUNT_ANOMALY"),
    )
    return scored.filter(F.col("risk_score") >= bands.MEDIUM).select(
        F.col("external_id").alias("transaction_id"), alert_type(F.col("risk_score")).alias("alert_type"),
        bands.risk_level(F.col("risk_score")).alias("severity"), title.alias("title"), description.alias("description"),
        F.lit("OPEN").alias("status"), created_at.alias("created_at"), created_at.alias("updated_at"),
    )


def cop_weight(reason: Column, matched: Column) -> Column:
    """Weight of a payee verification: by reason code, else 15 where the name did not match."""
    known = F.when(F.lit(False), F.lit(0.0))
    for code, weight in COP_WEIGHTS.items():
        known = known.when(reason == code, weight)
    return F.coalesce(known, F.when(matched == F.lit(False), COP_UNMATCHED), F.lit(0.0))


def cop_scores(tx: DataFrame, verifications: DataFrame, sequence: str = "seq") -> DataFrame:
    """Adds ``cop_reason`` and ``cop_score``; of several verifications of an account the last one counts."""
    last = verifications.groupBy("account_id").agg(
        F.max_by(F.struct("reason_code", "matched"), sequence).alias("v")
    ).select(
        F.col("account_id").alias("receiver_account_id"), F.col("v.reason_code").alias("cop_code"),
        F.col("v.matched").alias("cop_matched"), F.lit(True).alias("cop_known"),
    )
    known = F.coalesce(F.col("cop_known"), F.lit(False))
    joined = tx.join(last, "receiver_account_id", "left").withColumn(
        "cop_score", F.when(known, cop_weight(F.col("cop_code"), F.col("cop_matched"))).otherwise(0.0)
    )
    listed = F.col("cop_code").isin(list(COP_WEIGHTS))
    return joined.withColumn(
        "cop_reason",
        F.when(F.col("cop_score") > 0, F.when(listed, F.col("cop_code")).otherwise("UNMATCHED")),
    ).drop("cop_code", "cop_matched", "cop_known")


def suspicious_names(*columns: str) -> Column:
    """The values among ``columns`` that contain a keyword, in the order of the columns."""
    pattern = "|".join(ENTITY_KEYWORDS)
    return F.array_compact(
        F.array(*[F.when(F.lower(F.col(c)).rlike(pattern), F.col(c)) for c in columns])
    )


def advisory_gate(score: Column, is_anomaly: Column, rule_sum: Column, factor: float, cap: float = 10.0) -> Column:
    """Contribution of a model: only when it says anomaly and the rules stay under 25."""
    return F.when(is_anomaly & (rule_sum < bands.MEDIUM), F.least(score * factor, F.lit(cap))).otherwise(0.0)


def _plus(label: Column | str, score: str) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.when(
        F.col(score) > 0, F.concat(label, F.lit("(+"), F.format_string("%.1f", F.col(score)), F.lit(")"))
    )


def realtime_score(
    tx: DataFrame, verifications: DataFrame, model: DataFrame | None = None, seconds: int = 120,
    inbound_days: int = 30, inbound_minimum: int = 30,
) -> DataFrame:
    """Full additive score over trailing windows: one column per part, factor strings, level and action.

    ``model`` may hold ``external_id``, ``anomaly_score`` (0-100), ``is_anomaly``, ``graph_score`` (0-1)
    and ``graph_is_anomaly``; without it the two advisory parts are zero.
    """
    rolled = inbound_senders(rolling_velocity(tx, seconds), inbound_days)
    duplicates = rapid_duplicates(tx, seconds).withColumn("is_duplicate", F.lit(True))
    joined = cop_scores(rolled.join(duplicates, "external_id", "left"), verifications)
    if model is not None:
        joined = joined.join(model, "external_id", "left")
    else:
        for name, value in (("anomaly_score", 0.0), ("is_anomaly", False), ("graph_score", 0.0), ("graph_is_anomaly", False)):
            joined = joined.withColumn(name, F.lit(value))

    count, amount = F.col("velocity_count"), F.col("amount")
    small = (amount < bands.SMALL_AMOUNT) & (count >= bands.SMALL_AMOUNT_MIN_COUNT)
    grown = escalated(amount, count, F.col("prior_count"), F.col("prior_large"))
    parts = (
        joined.withColumn("velocity_part", bands.velocity_score(count))
        .withColumn("amount_part", bands.amount_score(amount, inclusive=True))
        .withColumn(
            "pattern_detected",
            F.when(small, "TESTING_THE_WATERS").when(grown, "ESCALATION_SMALL_TO_LARGE")
            .when(count >= 10, "VELOCITY_BURST").otherwise("NONE"),
        )
        .withColumn("pattern_part", F.when(small | grown, bands.PATTERN_SCORE).otherwise(0.0))
        .withColumn("duplicate_part", F.when(F.col("is_duplicate"), 15.0).otherwise(0.0))
        .withColumn("named", suspicious_names("sender_name", "receiver_name", "sender_id", "receiver_id"))
        .withColumn("entity_part", F.when(F.size("named") > 0, 10.0).otherwise(0.0))
        .withColumn("inbound_part", F.when(F.col("inbound_unique_senders") >= inbound_minimum, 45.0).otherwise(0.0))
        .withColumn("income_part", F.when(amount.cast("double") > F.col("sender_salary"), 30.0).otherwise(0.0))
    )
    rule_parts = ["velocity_part", "amount_part", "pattern_part", "duplicate_part", "entity_part", "cop_score",
                  "inbound_part", "income_part"]
    rule_sum = sum((F.col(c) for c in rule_parts[1:]), F.col(rule_parts[0]))
    gated = (
        parts.withColumn("rule_sum", rule_sum)
        .withColumn("anomaly_part", advisory_gate(F.col("anomaly_score"), F.col("is_anomaly"), F.col("rule_sum"), 0.15))
        .withColumn("graph_part", advisory_gate(F.col("graph_score"), F.col("graph_is_anomaly"), F.col("rule_sum"), 10.0))
        .withColumn(
            "risk_score",
            F.least(F.col("rule_sum") + F.col("anomaly_part") + F.col("graph_part"), F.lit(bands.MAX_SCORE)),
        )
    )
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    factors = F.array_compact(
        F.concat(
            F.array(
                _plus(text("VELOCITY:", count.cast("string"), "txns/2min"), "velocity_part"),
                _plus(text("AMOUNT:", F.format_string("%.2f", amount.cast("double"))), "amount_part"),
                _plus(text("PATTERN:", F.col("pattern_detected")), "pattern_part"),
                F.when((F.col("pattern_detected") == "VELOCITY_BURST"), "PATTERN:VELOCITY_BURST"),
                _plus("DUPLICATE:same_amount_rapid", "duplicate_part"),
            ),
            F.transform("named", lambda n: F.concat(F.lit("ENTITY:suspicious_name("), n, F.lit(")(+10.0)"))),
            F.array(
                _plus(text("COP:", F.col("cop_reason")), "cop_score"),
                _plus(f"VELOCITY_INBOUND_BURST:{inbound_minimum}+senders/month", "inbound_part"),
                _plus("AMOUNT_EXCEEDS_INCOME:spent>salary", "income_part"),
                _plus(text("ML_ANOMALY:iforest(", F.format_string("%.1f", F.col("anomaly_score")), ")"), "anomaly_part"),
                _plus(text("ML_GRAPH:gnn(", F.format_string("%.2f", F.col("graph_score")), ")"), "graph_part"),
            ),
        )
    )
    return (
        gated.withColumn("factors", factors)
        .withColumn("risk_level", bands.risk_level(F.col("risk_score")))
        .withColumn("interdiction_action", bands.risk_action(F.col("risk_score")))
        .drop("named", "is_duplicate", "prior_count", "prior_large")
    )


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row: average and highest score, count per level and per action, zeros included."""
    level, action = bands.risk_level(F.col("risk_score")), bands.risk_action(F.col("risk_score"))
    return scored.agg(
        F.count("*").alias("total"),
        F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("avg_risk"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("max_risk"),
        *[F.count_if(level == x).alias(f"level_{x.lower()}") for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")],
        *[F.count_if(action == x).alias(f"action_{x.lower()}") for x in ("ALLOW", "FLAG", "SUSPEND", "BLOCK")],
    )


def engine_totals(scored: DataFrame) -> DataFrame:
    """Counters per action as (name, n) rows; alerts and interdictions are counted apart."""
    action, score = bands.risk_action(F.col("risk_score")), F.col("risk_score")
    one = scored.agg(
        F.count("*").alias("total_scored"),
        F.count_if(action == "ALLOW").alias("total_allowed"), F.count_if(action == "FLAG").alias("total_flagged"),
        F.count_if(action == "SUSPEND").alias("total_suspended"), F.count_if(action == "BLOCK").alias("total_blocked"),
        F.count_if(score >= bands.MEDIUM).alias("total_alerts"), F.count_if(score >= bands.HIGH).alias("total_interdictions"),
    )
    return one.unpivot([], one.columns, "name", "n")


def busiest_senders(tx: DataFrame, as_of: Column, seconds: int = 120, top: int = 10) -> DataFrame:
    """Senders with the most events in the window that ends at ``as_of``."""
    recent = tx.filter(F.col("event_time") > as_of - F.expr(f"INTERVAL '{seconds}' SECOND"))
    return recent.groupBy("sender_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender_id").limit(top)


def local_score(tx: DataFrame, matches: DataFrame, as_of: Column) -> DataFrame:
    """Alternative additive score: scaled amount, micro amounts, words, watch-list similarity, velocity.

    ``matches`` holds entity_id and best similarity (at least 0.6) of each screened id.
    """
    amount = F.col("amount").cast("double")
    names = F.lower(F.concat(F.col("sender_id"), F.coalesce(F.col("receiver_id"), F.lit(""))))
    recent = (
        tx.filter(F.col("event_time") > as_of - F.expr("INTERVAL '2' MINUTE"))
        .groupBy("sender_id").agg(F.count("*").alias("recent_count"))
    )
    side = lambda key, out: matches.select(F.col("entity_id").alias(key), F.col("similarity").alias(out))
    joined = (
        tx.join(side("sender_id", "s_sim"), "sender_id", "left")
        .join(side("receiver_id", "r_sim"), "receiver_id", "left")
        .join(recent, "sender_id", "left")
    )
    hit = lambda c: F.coalesce(F.least(F.lit(40.0), F.col(c).cast("double") * 40.0), F.lit(0.0))
    scored = (
        joined.withColumn(
            "amount_part",
            F.when(amount > 50000, F.least(F.lit(35.0), (amount - 50000) / 50000 * 35)).when(amount < 1, 15.0).otherwise(0.0),
        )
        .withColumn("entity_part", F.when(names.rlike("|".join(LOCAL_KEYWORDS)), 10.0).otherwise(0.0))
        .withColumn("sanctions_part", hit("s_sim") + hit("r_sim"))
        .withColumn(
            "velocity_part",
            F.when(F.col("recent_count") > 5, F.least(F.lit(40.0), F.col("recent_count") * 4.0)).otherwise(0.0),
        )
    )
    total = F.col("amount_part") + F.col("entity_part") + F.col("sanctions_part") + F.col("velocity_part")
    return (
        scored.withColumn("risk_score", F.least(F.lit(100.0), total))
        .withColumn("risk_level", bands.risk_level(F.col("risk_score")))
        .withColumn("recommended_action", bands.risk_action(F.col("risk_score")))
    )
