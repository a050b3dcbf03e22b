"""Parsing, checking and shaping of payment records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.schemas import MODEL_FEATURES, PAYMENT_PAYLOAD, RISK_LEVELS, RULE_ACTIONS, TRANSACTION_TYPES


def parse_transactions(raw: DataFrame) -> DataFrame:
    """Typed columns from the JSON ``payload``; records without id, sender or a numeric amount are dropped."""
    record = F.from_json("payload", PAYMENT_PAYLOAD, {"mode": "PERMISSIVE"})
    parsed = raw.withColumn("r", record).select("r.*", F.col("payload").alias("raw_payload"), "event_time")
    return parsed.withColumn("amount", F.col("amount").try_cast("decimal(18,4)")).filter(
        F.col("external_id").isNotNull() & F.col("sender_id").isNotNull() & F.col("amount").isNotNull()
    )


def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold; a check on a null value does not hold."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    )


def _optional_length(column: str, most: int) -> Column:
    return F.col(column).isNull() | (F.length(column) <= most)


def check_transactions(raw: DataFrame) -> DataFrame:
    """Adds ``failed``: the contract checks each record breaks. Empty means valid."""
    amount = F.col("amount").try_cast("decimal(38,10)")
    return raw.withColumn(
        "failed",
        failed_checks({
            "external_id_length": F.length("external_id").between(1, 255),
            "sender_id_length": F.length("sender_id").between(1, 255),
            "receiver_id_length": _optional_length("receiver_id", 255),
            "amount_positive": amount > 0,
            "amount_decimals": amount == F.round(amount, 4),
            "currency_format": F.col("currency").rlike("^[A-Z]{3}$"),
            "sender_iban_length": _optional_length("sender_iban", 34),
            "transaction_type_known": F.col("transaction_type").isin(TRANSACTION_TYPES),
        }),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine)."""
    clean = F.size("failed") == 0
    return checked.filter(clean).drop("failed"), checked.filter(~clean)


def check_scores(scores: DataFrame) -> DataFrame:
    return scores.withColumn(
        "failed",
        failed_checks({
            "score_range": F.col("risk_score").between(0, 100),
            "level_known": F.col("risk_level").isin(RISK_LEVELS),
        }),
    )


def check_rules(rules: DataFrame) -> DataFrame:
    return rules.withColumn(
        "failed",
        failed_checks({
            "action_known": F.col("action").isin(RULE_ACTIONS),
            "severity_known": F.col("severity").isin(RISK_LEVELS),
        }),
    )


def ingest_records(valid: DataFrame, ingested_at: Column) -> DataFrame:
    """Message for the raw topic: amount as text, metadata never null, keyed by sender."""
    return valid.select(
        F.col("sender_id").alias("key"), "external_id", "sender_id", "receiver_id",
        F.col("amount").cast("string").alias("amount"), "currency", "sender_iban", "transaction_type",
        F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"), ingested_at.alias("ingested_at"),
    )


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Key and JSON value columns, ready for a topic or file sink."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), value)


def model_record(raw: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Adds ``record``, a struct of text fields: null unless the payload is a JSON object.

    The parsed struct passes through a generator, so that it is computed once per row and not again for
    every field taken from it.
    """
    wanted = list(dict.fromkeys(["transaction_id", "external_id", "sender_id", "event_time", "created_at", *MODEL_FEATURES, *fields]))
    schema = ", ".join(f"`{name}` STRING" for name in wanted) + ", `_bad` STRING"
    value = F.col("payload").cast("string")
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    once = raw.withColumn("record", F.explode(F.array(F.when(F.trim(value).startswith("{"), parsed))))
    return once.withColumn("record", F.when(F.col("record._bad").isNull(), F.col("record")))


def model_features(parsed: DataFrame) -> DataFrame:
    """The ten contract features as doubles; missing or not numeric becomes 0."""
    return parsed.select(
        *[c for c in parsed.columns if c != "record"],
        *[F.coalesce(F.col(f"record.{name}").try_cast("double"), F.lit(0.0)).alias(name) for name in MODEL_FEATURES],
    )


def anomaly_row(features: DataFrame) -> DataFrame:
    """Amount on a log scale; hour 0 and a missing hour both read as 12."""
    hour = F.when(F.coalesce(F.col("hour_of_day"), F.lit(0.0)) == 0, 12.0).otherwise(F.col("hour_of_day"))
    return features.withColumn("amount_log", F.log1p(F.greatest(F.col("amount"), F.lit(0.0)))).withColumn(
        "hour_of_day", hour
    ).drop("amount")


def model_messages(scored: DataFrame) -> DataFrame:
    """Emitted model score: the join keys of the source record and the model's answer."""
    r = lambda name: F.col(f"record.{name}")
    filled = lambda a, b: F.when(F.coalesce(r(a), F.lit("")) != "", r(a)).otherwise(r(b))
    return scored.select(
        F.to_json(
            F.struct(
                filled("transaction_id", "external_id").alias("transaction_id"), r("external_id").alias("external_id"),
                r("sender_id").alias("sender_id"), filled("event_time", "created_at").alias("event_time"),
                F.coalesce("model_score", F.lit(0.0)).alias("model_score"),
                F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
                F.coalesce(F.col("reason_codes"), F.array().cast("array<string>")).alias("reason_codes"),
                "source", F.coalesce("model_version", F.lit("unknown")).alias("model_version"),
                F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("value")
    )
