"""Counts of decision records and report packages go beyond the rows that are shown."""

from datetime import datetime, timedelta

from fraudspark.operators import investigate, reports

NOW = datetime(2024, 1, 1)
TX = (
    "id STRING, external_id STRING, sender_id STRING, receiver_id STRING, amount DECIMAL(12,2), currency STRING, transaction_type STRING, "
    "sender_iban STRING, receiver_iban STRING, created_at TIMESTAMP_NTZ"
)
SCORES = (
    "id STRING, transaction_id STRING, risk_score DOUBLE, risk_level STRING, factors ARRAY<STRING>, velocity_score DOUBLE, sanctions_score DOUBLE, "
    "pattern_score DOUBLE"
)


def payments(spark):
    senders = ["hot"] * 33 + ["calm"] * 2 + ["none"]
    return spark.createDataFrame([(f"t{i}", f"x{i}", s, "r", None, "EUR", "WIRE", "a", "b", NOW + timedelta(minutes=i)) for i, s in enumerate(senders)], TX)


def test_all_patterns_of_a_sender_count_and_the_newest_ten_are_shown(spark):
    hits = [("hot", f"P{i % 3}", NOW + timedelta(minutes=i)) for i in range(25)] + [("calm", "P0", NOW)]
    record = investigate.debug_transactions(
        payments(spark), spark.createDataFrame([], SCORES), spark.createDataFrame([], "entity_id STRING, enrichment_type STRING, risk_score DOUBLE"),
        spark.createDataFrame([], "transaction_id STRING, rule_name STRING"),
        spark.createDataFrame(hits, "sender_id STRING, pattern_type STRING, detected_at TIMESTAMP_NTZ"),
    )
    found = {r.sender_id: r for r in record.collect()}
    assert {s: r.cep_patterns for s, r in found.items()} == {"hot": 25, "calm": 1, "none": 0}
    assert [p.detected_at for p in found["hot"].newest_patterns] == [NOW + timedelta(minutes=i) for i in range(24, 14, -1)]
    assert len(found["calm"].newest_patterns) == 1 and found["none"].newest_patterns == []
    assert "CEP patterns: 25 pattern(s) detected" in found["hot"].decision_path
    assert not any(x.startswith("CEP") for x in found["none"].decision_path)


def test_a_package_has_the_number_of_all_related_payments(spark):
    alerts = spark.createDataFrame([("a0", "t0", "s0", "title", "text")], "id STRING, transaction_id STRING, risk_score_id STRING, title STRING, description STRING")
    package = reports.sar_packages(alerts, payments(spark), spark.createDataFrame([], SCORES)).first()
    assert (package.related_total, package.related_count, len(package.related_transactions)) == (33, 20, 20)
