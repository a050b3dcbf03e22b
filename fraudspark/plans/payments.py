"""Parsing, velocity, scoring and row patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import patterns, records, scoring, velocity
from fraudspark.plans.registry import query
from fraudspark.schemas import MODEL_FEATURES



def audit_time():
    """A fixed audit time: a clock would make the results differ from run to run."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


AUDIT_SQL = "TIMESTAMP '2024-02-01 00:00:00'"

LEVEL_SQL = "CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
ACTION_SQL = "CASE WHEN risk_score >= 75 THEN 'BLOCK' WHEN risk_score >= 50 THEN 'SUSPEND' WHEN risk_score >= 25 THEN 'FLAG' ELSE 'ALLOW' END"
SCORE_TEXT = "CAST(CAST(risk_score AS DECIMAL(5,2)) AS VARCHAR)"

VELOCITY_CTE = """velocity AS (SELECT sender_id, count(*) AS n, sum(amount) AS total,
    time_bucket(INTERVAL '2 minutes', event_time) AS ws FROM {tx} GROUP BY ALL)"""
PARTS_CTE = """parts AS (SELECT t.*, v.n AS txn_count_2min,
    CASE WHEN v.n >= 10 THEN 40.0 WHEN v.n >= 5 THEN 25.0 WHEN v.n >= 3 THEN 10.0 ELSE 0.0 END AS velocity_score,
    CASE WHEN amount > 50000 THEN 35.0 WHEN amount > 10000 THEN 20.0 WHEN amount > 5000 THEN 10.0 ELSE 0.0 END AS amount_score,
    CASE WHEN amount < 10 AND v.n >= 3 THEN 25.0 ELSE 0.0 END AS pattern_score
  FROM {tx} t JOIN velocity v ON t.sender_id = v.sender_id AND t.event_time >= v.ws AND t.event_time < v.ws + INTERVAL '2 minutes')"""
SCORED_CTE = """scored AS (SELECT *, CAST(least(velocity_score + amount_score + pattern_score, 100.0) AS DOUBLE) AS risk_score FROM parts)"""
SCORED = (VELOCITY_CTE, PARTS_CTE, SCORED_CTE)

PATTERN_SQL = "CASE WHEN amount < 10 AND txn_count_2min >= 3 THEN 'TESTING_THE_WATERS' WHEN txn_count_2min >= 10 THEN 'VELOCITY_BURST' ELSE '{}' END"


@query("velocity_window", "SELECT sender_id, n AS txn_count_2min, CAST(total AS DOUBLE) AS total_amount_2min, ws AS window_start, ws + INTERVAL '2 minutes' AS window_end FROM velocity", VELOCITY_CTE)
def _(t):
    return velocity.velocity_window(t.tx)


@query("velocity_join", "SELECT external_id, t.sender_id, ws AS window_start, n AS txn_count_2min, CAST(total AS DOUBLE) AS total_amount_2min FROM {tx} t JOIN velocity v ON t.sender_id = v.sender_id AND t.event_time >= v.ws AND t.event_time < v.ws + INTERVAL '2 minutes'", VELOCITY_CTE)
def _(t):
    tx = t.tx
    return velocity.join_window_count(tx, velocity.velocity_window(tx)).select(
        "external_id", "sender_id", "window_start", "txn_count_2min", "total_amount_2min"
    )


@query("score_transactions", "SELECT external_id, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, event_time, txn_count_2min, CAST(velocity_score AS DOUBLE) AS velocity_score, CAST(amount_score AS DOUBLE) AS amount_score, CAST(pattern_score AS DOUBLE) AS pattern_score, risk_score, " + LEVEL_SQL + " AS risk_level, " + ACTION_SQL + " AS action FROM scored", *SCORED)
def _(t):
    from fraudspark.functions.bands import risk_action, risk_level
    return scoring.score_transactions(t.tx).select(
        "external_id", "sender_id", "receiver_id", "amount", "event_time", "txn_count_2min", "velocity_score",
        "amount_score", "pattern_score", "risk_score", risk_level(F.col("risk_score")).alias("risk_level"),
        risk_action(F.col("risk_score")).alias("action"),
    )


@query("transactions_out", f"SELECT external_id AS id, external_id, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, currency, sender_iban, receiver_iban, transaction_type, 'PENDING' AS status, iso20022_msg_type, '{{}}' AS metadata, event_time AS created_at, event_time AS updated_at, {AUDIT_SQL} AS processed_at FROM scored", *SCORED)
def _(t):
    return scoring.transactions_out(scoring.score_transactions(t.tx), audit_time())


@query("scored_events", f"SELECT external_id, sender_id, CAST(amount AS DOUBLE) AS amount, currency, risk_score, {LEVEL_SQL} AS risk_level, txn_count_2min, FALSE AS sanctions_match, {PATTERN_SQL.format('NONE')} AS pattern_detected, {AUDIT_SQL} AS scored_at FROM scored", *SCORED)
def _(t):
    return scoring.scored_events(scoring.score_transactions(t.tx), audit_time())


@query("risk_scores", f"SELECT external_id AS transaction_id, sender_id AS entity_id, risk_score, {LEVEL_SQL} AS risk_level, '[]' AS factors, CAST(velocity_score AS DOUBLE) AS velocity_score, CAST(0 AS DOUBLE) AS sanctions_score, CAST(pattern_score AS DOUBLE) AS pattern_score, 'v1.0-stream' AS model_version, {AUDIT_SQL} AS scored_at FROM scored", *SCORED)
def _(t):
    return scoring.risk_scores(scoring.score_transactions(t.tx), audit_time())


@query("interdictions", f"SELECT external_id, sender_id, {ACTION_SQL} AS action, 'Auto-interdiction: Risk score ' || {SCORE_TEXT} || ' | Velocity: ' || txn_count_2min || ' txns/2min | Amount: ' || amount || ' ' || currency AS reason, risk_score, {AUDIT_SQL} AS issued_at FROM scored WHERE risk_score >= 50", *SCORED)
def _(t):
    return scoring.interdictions(scoring.score_transactions(t.tx), audit_time())


@query("alerts", f"""SELECT external_id AS transaction_id,
  CASE WHEN risk_score >= 75 THEN 'CRITICAL_RISK' WHEN risk_score >= 50 THEN 'HIGH_RISK' ELSE 'VELOCITY_ANOMALY' END AS alert_type,
  {LEVEL_SQL} AS severity, 'High-risk transaction detected: ' || external_id || ' (' || amount || ' ' || currency || ')' AS title,
  'Sender: ' || sender_id || ' | Risk Score: ' || {SCORE_TEXT} || ' | Velocity: ' || txn_count_2min || ' txns/2min | Pattern: ' || {PATTERN_SQL.format('AMOUNT_ANOMALY')} AS description,
  'OPEN' AS status, {AUDIT_SQL} AS created_at, {AUDIT_SQL} AS updated_at FROM scored WHERE risk_score >= 25""", *SCORED)
def _(t):
    return scoring.alerts(scoring.score_transactions(t.tx), audit_time())


@query("batch_summary", f"""SELECT count(*) AS total, round(avg(risk_score), 6) AS avg_risk, max(risk_score) AS max_risk,
  {', '.join(f"count(*) FILTER (WHERE {LEVEL_SQL} = '{x}') AS level_{x.lower()}" for x in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'))},
  {', '.join(f"count(*) FILTER (WHERE {ACTION_SQL} = '{x}') AS action_{x.lower()}" for x in ('ALLOW', 'FLAG', 'SUSPEND', 'BLOCK'))} FROM scored""", *SCORED)
def _(t):
    return scoring.batch_summary(scoring.score_transactions(t.tx)).withColumn("avg_risk", F.round("avg_risk", 6))


# --- parsing and shaping -----------------------------------------------------------------------

PARSED_CTE = """parsed AS (SELECT *, j ->> '$.external_id' AS external_id, j ->> '$.sender_id' AS sender_id, j ->> '$.receiver_id' AS receiver_id,
    TRY_CAST(j ->> '$.amount' AS DECIMAL(18,4)) AS amount, j ->> '$.currency' AS currency, j ->> '$.transaction_type' AS transaction_type
  FROM (SELECT *, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM {tx_payload}) p)"""


@query("parse_transactions", "SELECT external_id, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, currency, j ->> '$.sender_iban' AS sender_iban, j ->> '$.receiver_iban' AS receiver_iban, transaction_type, j ->> '$.iso20022_msg_type' AS iso20022_msg_type, payload AS raw_payload, event_time FROM parsed WHERE external_id IS NOT NULL AND sender_id IS NOT NULL AND amount IS NOT NULL", PARSED_CTE)
def _(t):
    return records.parse_transactions(t.tx_payload)


CHECKS_SQL = {
    "external_id_length": "length(external_id) BETWEEN 1 AND 255",
    "sender_id_length": "length(sender_id) BETWEEN 1 AND 255",
    "receiver_id_length": "receiver_id IS NULL OR length(receiver_id) <= 255",
    "amount_positive": "TRY_CAST(amount AS DECIMAL(38,10)) > 0",
    "amount_decimals": "TRY_CAST(amount AS DECIMAL(38,10)) = round(TRY_CAST(amount AS DECIMAL(38,10)), 4)",
    "currency_format": "regexp_matches(currency, '^[A-Z]{3}$')",
    "sender_iban_length": "sender_iban IS NULL OR length(sender_iban) <= 34",
    "transaction_type_known": "transaction_type IN ('SEND_MONEY','ADD_MONEY','DIRECT_DEBIT','EXCHANGE','CARD_PAYMENT','WIRE','TRANSFER','WITHDRAWAL')",
}


@query("validate_transactions", "SELECT event_id, coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce({c}, FALSE) THEN NULL ELSE '{n}' END" for n, c in CHECKS_SQL.items()) + "], lambda x: x IS NOT NULL), ','), '') AS failed FROM {tx_raw}")
def _(t):
    return records.check_transactions(t.tx_raw).select("event_id", F.array_join("failed", ",").alias("failed"))


@query("validate_scores", """SELECT transaction_id, array_to_string(list_filter([CASE WHEN changed BETWEEN 0 AND 100 THEN NULL ELSE 'score_range' END,
    CASE WHEN level IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN NULL ELSE 'level_known' END], lambda x: x IS NOT NULL), ',') AS failed
  FROM (SELECT transaction_id, risk_score::DOUBLE * 2 - 20 AS changed, CASE WHEN risk_level = 'LOW' THEN 'low' ELSE risk_level END AS level FROM {scores}) s""")
def _(t):
    changed = t.scores.withColumn("risk_score", F.col("risk_score").cast("double") * 2 - 20)
    level = F.when(F.col("risk_level") == "LOW", "low").otherwise(F.col("risk_level"))
    return records.check_scores(changed.withColumn("risk_level", level)).select("transaction_id", F.array_join("failed", ",").alias("failed"))


@query("validate_rules", """SELECT rule_id, array_to_string(list_filter([CASE WHEN action IN ('BLOCK', 'SUSPEND', 'FLAG') THEN NULL ELSE 'action_known' END,
    CASE WHEN severity IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN NULL ELSE 'severity_known' END], lambda x: x IS NOT NULL), ',') AS failed
  FROM (SELECT rule_id, CASE WHEN risk_score_adjustment < 10 THEN lower(action) ELSE action END AS action, CASE WHEN risk_score_adjustment > 50 THEN NULL ELSE severity END AS severity FROM {rule_table}) r""")
def _(t):
    action = F.when(F.col("risk_score_adjustment") < 10, F.lower("action")).otherwise(F.col("action"))
    severity = F.when(F.col("risk_score_adjustment") <= 50, F.col("severity"))
    checked = records.check_rules(t.rule_table.withColumn("action", action).withColumn("severity", severity))
    return checked.select("rule_id", F.array_join("failed", ",").alias("failed"))


@query("ingest_record", f"SELECT sender_id AS key, external_id, sender_id, receiver_id, amount, currency, sender_iban, transaction_type, coalesce(metadata, '{{}}') AS metadata, {AUDIT_SQL} AS ingested_at FROM {{tx_raw}} WHERE " + " AND ".join(f"coalesce({c}, FALSE)" for c in CHECKS_SQL.values()))
def _(t):
    valid, _ = records.split_valid(records.check_transactions(t.tx_raw))
    return records.ingest_records(valid, audit_time())


@query("model_parse", "SELECT kafka_offset, coalesce(json_type(j) = 'OBJECT', FALSE) AS is_record, coalesce(CASE WHEN json_type(j) = 'OBJECT' THEN external_id END, '') AS external_id FROM parsed", PARSED_CTE)
def _(t):
    return records.model_record(t.tx_payload).select(
        "kafka_offset", F.col("record").isNotNull().alias("is_record"),
        F.coalesce("record.external_id", F.lit("")).alias("external_id"),
    )


FEATURE_SQL = ", ".join(f"coalesce(TRY_CAST(j ->> '$.{n}' AS DOUBLE), 0) AS {n}" for n in MODEL_FEATURES)


@query("model_features", f"SELECT kafka_offset, {FEATURE_SQL} FROM parsed WHERE json_type(j) = 'OBJECT'", PARSED_CTE)
def _(t):
    parsed = records.model_record(t.tx_payload).filter(F.col("record").isNotNull())
    return records.model_features(parsed.select("kafka_offset", "record"))


@query("anomaly_features", "SELECT kafka_offset, velocity_count, CASE WHEN hour_of_day = 0 THEN 12 ELSE hour_of_day END AS hour_of_day, is_weekend, entity_risk, ip_risk, phone_risk, email_risk, cop_reason, geo_mismatch, round(ln(1 + greatest(amount, 0)), 6) AS amount_log FROM f", PARSED_CTE, f"f AS (SELECT kafka_offset, {FEATURE_SQL} FROM parsed WHERE json_type(j) = 'OBJECT')")
def _(t):
    parsed = records.model_record(t.tx_payload).filter(F.col("record").isNotNull())
    row = records.anomaly_row(records.model_features(parsed.select("kafka_offset", "record")))
    return row.withColumn("amount_log", F.round("amount_log", 6))


@query("model_emit", "SELECT external_id AS transaction_id, external_id, coalesce(sender_id, '') AS sender_id, round(coalesce(TRY_CAST(j ->> '$.ip_risk' AS DOUBLE), 0) / 100, 6) AS model_score, coalesce(TRY_CAST(j ->> '$.ip_risk' AS DOUBLE), 0) > 90 AS is_anomaly, 'model' AS source, 'v1' AS model_version FROM parsed WHERE json_type(j) = 'OBJECT'", PARSED_CTE)
def _(t):
    parsed = records.model_record(t.tx_payload).filter(F.col("record").isNotNull())
    risk = F.coalesce(F.col("record.ip_risk").try_cast("double"), F.lit(0.0))
    answered = parsed.select(
        "record", (risk / 100).alias("model_score"), (risk > 90).alias("is_anomaly"),
        F.array().cast("array<string>").alias("reason_codes"), F.lit("model").alias("source"),
        F.lit("v1").alias("model_version"), F.lit(1.0).alias("latency_ms"),
    )
    back = "transaction_id STRING, external_id STRING, sender_id STRING, model_score DOUBLE, is_anomaly BOOLEAN, source STRING, model_version STRING"
    return records.model_messages(answered).select(F.from_json("value", back).alias("m")).select("m.*").withColumn(
        "model_score", F.round("model_score", 6)
    ).withColumn("sender_id", F.coalesce("sender_id", F.lit("")))


@query("sink_json", f"SELECT external_id AS key, external_id, risk_score, {LEVEL_SQL} AS risk_level, txn_count_2min FROM scored", *SCORED)
def _(t):
    messages = records.as_messages(scoring.scored_events(scoring.score_transactions(t.tx), audit_time()), "external_id")
    back = "external_id STRING, risk_score DOUBLE, risk_level STRING, txn_count_2min BIGINT"
    return messages.select("key", F.from_json("value", back).alias("m")).select("key", "m.*")


# --- trailing windows ------------------------------------------------------------------------

ROLLING_CTE = """rolling AS (SELECT *, count(*) OVER w AS velocity_count, count(*) OVER w - 1 AS prior_count,
    count(*) FILTER (WHERE amount >= 10) OVER w - CASE WHEN amount >= 10 THEN 1 ELSE 0 END AS prior_large
  FROM (SELECT *, epoch_us(event_time) AS us FROM {tx_rich}) x
  WINDOW w AS (PARTITION BY sender_id ORDER BY us RANGE BETWEEN 119999999 PRECEDING AND CURRENT ROW))"""
DUPLICATE_CTE = """dup AS (SELECT DISTINCT a.external_id FROM {tx} a JOIN {tx} b ON a.sender_id = b.sender_id AND a.external_id <> b.external_id
    AND b.event_time <= a.event_time AND b.event_time > a.event_time - INTERVAL '120 seconds' AND abs(a.amount - b.amount) < 0.01)"""
INBOUND_CTE = """inbound AS (SELECT a.external_id, count(DISTINCT b.sender_id) AS inbound_unique_senders
    FROM {tx} a JOIN (SELECT receiver_id, sender_id, min(event_time) AS first_time FROM {tx} GROUP BY ALL) b
    ON a.receiver_id = b.receiver_id AND b.first_time <= a.event_time GROUP BY a.external_id)"""


@query("rolling_velocity", "SELECT external_id, sender_id, velocity_count, prior_count, CAST(prior_large AS BIGINT) AS prior_large FROM rolling", ROLLING_CTE)
def _(t):
    return velocity.rolling_velocity(t.tx).select("external_id", "sender_id", "velocity_count", "prior_count", "prior_large")


@query("rapid_duplicate", "SELECT external_id FROM dup", DUPLICATE_CTE)
def _(t):
    return velocity.rapid_duplicates(t.tx)


@query("escalation", "SELECT external_id, sender_id, velocity_count FROM rolling WHERE velocity_count >= 3 AND amount >= 1000 AND prior_large = 0", ROLLING_CTE)
def _(t):
    rolled = velocity.rolling_velocity(t.tx)
    hit = velocity.escalated(F.col("amount"), F.col("velocity_count"), F.col("prior_count"), F.col("prior_large"))
    return rolled.filter(hit).select("external_id", "sender_id", "velocity_count")


# All events lie inside 30 days, so a sender counts from its first event on; the moving edge of the
# window is tested on hand-made rows.
@query("inbound_burst", "SELECT external_id, inbound_unique_senders, CASE WHEN inbound_unique_senders >= 30 THEN 45.0 ELSE 0.0 END::DOUBLE AS inbound_score FROM inbound", INBOUND_CTE)
def _(t):
    counted = velocity.inbound_senders(t.tx)
    score = F.when(F.col("inbound_unique_senders") >= 30, 45.0).otherwise(0.0)
    return counted.select("external_id", "inbound_unique_senders", score.alias("inbound_score"))


COP_CTE = """cop AS (SELECT account_id, reason_code, matched FROM {verifications} QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY seq DESC) = 1)"""
COP_SCORE = "CASE reason_code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.COP_WEIGHTS.items()) + " ELSE CASE WHEN matched = FALSE THEN 15.0 ELSE 0.0 END END"


@query("cop_score", f"SELECT external_id, receiver_account_id, CAST(coalesce({COP_SCORE}, 0) AS DOUBLE) AS cop_score FROM {{tx_rich}} LEFT JOIN cop ON receiver_account_id = account_id", COP_CTE)
def _(t):
    return scoring.cop_scores(t.tx_rich, t.verifications).select("external_id", "receiver_account_id", "cop_score")


WORDS = "|".join(scoring.ENTITY_KEYWORDS)
REALTIME = (ROLLING_CTE, DUPLICATE_CTE, INBOUND_CTE, COP_CTE, f"""rt AS (SELECT r.*, i.inbound_unique_senders,
    CASE WHEN velocity_count >= 10 THEN 40 WHEN velocity_count >= 5 THEN 25 WHEN velocity_count >= 3 THEN 10 ELSE 0 END AS velocity_part,
    CASE WHEN amount >= 50000 THEN 35 WHEN amount >= 10000 THEN 20 WHEN amount >= 5000 THEN 10 ELSE 0 END AS amount_part,
    CASE WHEN amount < 10 AND velocity_count >= 3 THEN 'TESTING_THE_WATERS'
         WHEN velocity_count >= 3 AND amount >= 1000 AND prior_large = 0 THEN 'ESCALATION_SMALL_TO_LARGE'
         WHEN velocity_count >= 10 THEN 'VELOCITY_BURST' ELSE 'NONE' END AS pattern_detected,
    CASE WHEN d.external_id IS NULL THEN 0 ELSE 15 END AS duplicate_part,
    CASE WHEN regexp_matches(lower(sender_name || '|' || receiver_name || '|' || sender_id || '|' || receiver_id), '{WORDS}') THEN 10 ELSE 0 END AS entity_part,
    CAST(coalesce({COP_SCORE}, 0) AS DOUBLE) AS cop_part,
    CASE WHEN inbound_unique_senders >= 30 THEN 45 ELSE 0 END AS inbound_part,
    CASE WHEN CAST(amount AS DOUBLE) > sender_salary THEN 30 ELSE 0 END AS income_part
  FROM rolling r LEFT JOIN dup d ON r.external_id = d.external_id JOIN inbound i ON i.external_id = r.external_id
  LEFT JOIN cop ON cop.account_id = r.receiver_account_id)""",
  """rt2 AS (SELECT *, CASE WHEN pattern_detected IN ('TESTING_THE_WATERS', 'ESCALATION_SMALL_TO_LARGE') THEN 25 ELSE 0 END AS pattern_part FROM rt)""",
  """rt3 AS (SELECT *, velocity_part + amount_part + pattern_part + duplicate_part + entity_part + cop_part + inbound_part + income_part AS rule_sum FROM rt2)""")

# The advisory inputs, made from the payment itself.
MODEL_SQL = """m AS (SELECT external_id, CAST(substr(external_id, 2) AS BIGINT) % 101 AS s FROM {tx})"""


def _model(tx):
    s = F.substring("external_id", 2, 20).cast("long") % 101
    return tx.select(
        "external_id", s.cast("double").alias("anomaly_score"), (s > 60).alias("is_anomaly"),
        (s / 100).alias("graph_score"), (s > 90).alias("graph_is_anomaly"),
    )


@query("realtime_score", f"""SELECT external_id, velocity_count, pattern_detected, CAST(rule_sum AS DOUBLE) AS rule_sum,
   round(anomaly_part, 6) AS anomaly_part, round(graph_part, 6) AS graph_part, round(risk_score, 6) AS risk_score, {LEVEL_SQL} AS risk_level, {ACTION_SQL} AS interdiction_action, n_factors
   FROM (SELECT *, least(rule_sum + anomaly_part + graph_part, 100.0)::DOUBLE AS risk_score,
     (velocity_part > 0)::INT + (amount_part > 0)::INT + (pattern_detected <> 'NONE')::INT + (duplicate_part > 0)::INT
     + (entity_part > 0)::INT * (regexp_matches(lower(sender_name), '{WORDS}')::INT + regexp_matches(lower(receiver_name), '{WORDS}')::INT)
     + (cop_part > 0)::INT + (inbound_part > 0)::INT + (income_part > 0)::INT + (anomaly_part > 0)::INT + (graph_part > 0)::INT AS n_factors
     FROM (SELECT rt3.*, CASE WHEN s > 60 AND rule_sum < 25 THEN least(s * 0.15, 10.0) ELSE 0.0 END::DOUBLE AS anomaly_part,
                  CASE WHEN s > 90 AND rule_sum < 25 THEN least(s / 100 * 10.0, 10.0) ELSE 0.0 END::DOUBLE AS graph_part
           FROM rt3 JOIN m USING (external_id)) a) b""", *REALTIME, MODEL_SQL)
def _(t):
    tx = t.tx_rich
    scored = scoring.realtime_score(tx, t.verifications, _model(tx))
    return scored.select(
        "external_id", "velocity_count", "pattern_detected", "rule_sum", F.round("anomaly_part", 6).alias("anomaly_part"),
        F.round("graph_part", 6).alias("graph_part"), F.round("risk_score", 6).alias("risk_score"), "risk_level",
        "interdiction_action", F.size("factors").alias("n_factors"),
    )


@query("advisory_gate", f"""SELECT external_id, risk_score AS rule_score, CASE WHEN s > 60 AND risk_score < 25 THEN least(s * 0.15, 10.0) ELSE 0.0 END::DOUBLE AS anomaly_part,
   CASE WHEN s > 90 AND risk_score < 25 THEN least(s / 10, 10.0) ELSE 0.0 END::DOUBLE AS graph_part FROM scored JOIN m USING (external_id)""", *SCORED, MODEL_SQL)
def _(t):
    tx = t.tx
    joined = scoring.score_transactions(tx).join(_model(tx), "external_id")
    gate = scoring.advisory_gate
    return joined.select(
        "external_id", F.col("risk_score").alias("rule_score"),
        F.round(gate(F.col("anomaly_score"), F.col("is_anomaly"), F.col("risk_score"), 0.15), 6).alias("anomaly_part"),
        F.round(gate(F.col("graph_score"), F.col("graph_is_anomaly"), F.col("risk_score"), 10.0), 6).alias("graph_part"),
    )


@query("engine_state", f"""SELECT * FROM (
    SELECT 'total_scored' AS name, count(*) AS n FROM scored
    UNION ALL SELECT 'total_allowed', count(*) FROM scored WHERE risk_score < 25
    UNION ALL SELECT 'total_flagged', count(*) FROM scored WHERE risk_score >= 25 AND risk_score < 50
    UNION ALL SELECT 'total_suspended', count(*) FROM scored WHERE risk_score >= 50 AND risk_score < 75
    UNION ALL SELECT 'total_blocked', count(*) FROM scored WHERE risk_score >= 75
    UNION ALL SELECT 'total_alerts', count(*) FROM scored WHERE risk_score >= 25
    UNION ALL SELECT 'total_interdictions', count(*) FROM scored WHERE risk_score >= 50
    UNION ALL (SELECT 'window:' || sender_id, count(*) AS n FROM {{tx}} WHERE event_time > (SELECT max(event_time) FROM {{tx}}) - INTERVAL '120 seconds'
       GROUP BY sender_id ORDER BY n DESC, sender_id LIMIT 10)) x""", *SCORED)
def _(t):
    tx = t.tx
    as_of = tx.agg(F.max("event_time")).scalar()
    busy = scoring.busiest_senders(tx, as_of).select(F.concat(F.lit("window:"), "sender_id").alias("name"), "n")
    return scoring.engine_totals(scoring.score_transactions(tx)).unionByName(busy)


# --- row patterns ----------------------------------------------------------------------------

S2L_CTES = (
    """s0 AS (SELECT *, epoch_us(event_time) AS us, CASE WHEN amount < 500 THEN 'A' WHEN amount > 10000 THEN 'B' ELSE '-' END AS kind FROM {tx})""",
    """s1 AS (SELECT *, coalesce(count(*) FILTER (WHERE kind <> 'A') OVER (PARTITION BY sender_id ORDER BY us, external_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM s0)""",
    """s2l AS (SELECT b.sender_id AS matched_sender, arg_min(a.external_id, (a.us, a.external_id)) AS first_small_txn, arg_max(a.external_id, (a.us, a.external_id)) AS last_small_txn,
        b.external_id AS large_txn, count(*) AS small_count, avg(CAST(a.amount AS DOUBLE)) AS avg_small_amount, sum(a.amount) AS small_sum, b.amount AS large_amount, b.currency, b.event_time AS detected_at
      FROM s1 b JOIN s1 a ON a.sender_id = b.sender_id AND a.run = b.run AND a.kind = 'A' AND b.us - a.us < 1800000000
      WHERE b.kind = 'B' GROUP BY b.sender_id, b.external_id, b.amount, b.currency, b.event_time HAVING count(*) >= 2)""",
)
PAIR_CTES = (
    """p0 AS (SELECT *, epoch_us(event_time) AS us, row_number() OVER w AS rn, lead(external_id) OVER w AS b_id, lead(amount) OVER w AS b_amount,
        lead(transaction_type) OVER w AS b_type, lead(event_time) OVER w AS b_time FROM {tx} WINDOW w AS (PARTITION BY sender_id ORDER BY event_time, external_id))""",
    """p1 AS (SELECT * FROM p0 WHERE transaction_type IN ('SEND_MONEY','WIRE','TRANSFER') AND b_type IN ('ADD_MONEY','TRANSFER')
        AND abs(b_amount - amount) < amount * 0.1 AND epoch_us(b_time) - us < 900000000)""",
    """p2 AS (SELECT *, rn - row_number() OVER (PARTITION BY sender_id ORDER BY rn) AS isle FROM p1)""",
    """trips AS (SELECT sender_id AS matched_sender, external_id AS outbound_txn, b_id AS inbound_txn, amount AS out_amount, b_amount AS in_amount,
        receiver_id AS intermediary, currency, b_time AS detected_at FROM p2 QUALIFY row_number() OVER (PARTITION BY sender_id, isle ORDER BY rn) % 2 = 1)""",
)


def _greedy(prefix, view, key, length, condition):
    n = length - 1
    return (
        f"""{prefix}0 AS (SELECT *, epoch_us(event_time) AS us, row_number() OVER w AS rn, {', '.join(f'lead(amount, {i}) OVER w AS amount{i}' for i in range(1, length))},
            lead(external_id, {n}) OVER w AS last_id, lead(event_time, {n}) OVER w AS last_time FROM {{{view}}} WINDOW w AS (PARTITION BY {key} ORDER BY event_time, external_id))""",
        f"""{prefix}1 AS (SELECT {key}, rn FROM {prefix}0 WHERE last_id IS NOT NULL AND {condition})""",
        f"""{prefix}2 AS (SELECT {key}, min(rn) AS rn FROM {prefix}1 GROUP BY {key}
            UNION ALL SELECT c.{key}, (SELECT min(d.rn) FROM {prefix}1 d WHERE d.{key} = c.{key} AND d.rn >= c.rn + {length}) FROM {prefix}2 c WHERE c.rn IS NOT NULL)""",
        f"""{prefix}3 AS (SELECT f.* FROM {prefix}0 f JOIN {prefix}2 g ON f.{key} = g.{key} AND f.rn = g.rn)""",
    )


BURST_CTES = (*_greedy("b", "tx", "sender_id", 5, "epoch_us(last_time) - us < 180000000"),
    """bursts AS (SELECT sender_id AS matched_sender, external_id AS first_txn, last_id AS last_txn, CAST(5 AS BIGINT) AS burst_count,
       amount + amount1 + amount2 + amount3 + amount4 AS burst_total, currency, last_time AS detected_at FROM b3)""")
TRIPLE_CTES = (*_greedy("d", "tx_round", "receiver_id", 3, "amount = amount1 AND amount = amount2 AND epoch_us(last_time) - us < 2592000000000"),
    """triples AS (SELECT receiver_id AS matched_receiver, external_id AS first_txn, last_id AS third_txn, amount AS duplicate_amount, currency, last_time AS detected_at FROM d3)""")


@query("cep_small_to_large", "SELECT matched_sender, first_small_txn, last_small_txn, large_txn, small_count, round(avg_small_amount, 6) AS avg_small_amount, CAST(large_amount AS DOUBLE) AS large_amount, currency, detected_at FROM s2l", *S2L_CTES)
def _(t):
    return patterns.small_to_large(t.tx).withColumn("avg_small_amount", F.round(F.col("avg_small_amount").cast("double"), 6))


@query("cep_round_trip", "SELECT * REPLACE (CAST(out_amount AS DOUBLE) AS out_amount, CAST(in_amount AS DOUBLE) AS in_amount) FROM trips", *PAIR_CTES)
def _(t):
    return patterns.round_trips(t.tx)


@query("cep_burst", "SELECT * REPLACE (CAST(burst_total AS DOUBLE) AS burst_total) FROM bursts", *BURST_CTES)
def _(t):
    return patterns.velocity_bursts(t.tx)


@query("cep_duplicates", "SELECT * REPLACE (CAST(duplicate_amount AS DOUBLE) AS duplicate_amount) FROM triples", *TRIPLE_CTES)
def _(t):
    return patterns.duplicate_amounts(t.tx_round)


def _money(c):
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


@query("cep_alerts", f"""
  SELECT 'SMALL_TO_LARGE' AS pattern_type, matched_sender AS sender_id,
    'Escalation: ' || small_count || ' small txns → large txn ' || large_txn || ' (' || {_money('large_amount')} || ' ' || currency || ')' AS details,
    'HIGH' AS severity, 35 AS risk_adjustment, detected_at FROM s2l
  UNION ALL SELECT 'RAPID_ROUND_TRIP', matched_sender, 'Layering: out=' || outbound_txn || ' (' || {_money('out_amount')} || ' ' || currency || ') → in=' || inbound_txn || ' (' || {_money('in_amount')} || ') via ' || intermediary, 'CRITICAL', 45, detected_at FROM trips
  UNION ALL SELECT 'VELOCITY_BURST', matched_sender, 'Burst: ' || burst_count || ' txns totalling ' || {_money('burst_total')} || ' ' || currency || ' in <3min', CASE WHEN burst_count >= 10 THEN 'CRITICAL' ELSE 'HIGH' END, CASE WHEN burst_count >= 10 THEN 45 ELSE 30 END, detected_at FROM bursts
  UNION ALL SELECT 'DUPLICATE_INBOUND_AMOUNTS', matched_receiver, '30-Day Duplicate: 3x received identical amount ' || {_money('duplicate_amount')} || ' ' || currency, 'HIGH', 40, detected_at FROM triples""",
  *S2L_CTES, *PAIR_CTES, *BURST_CTES, *TRIPLE_CTES)
def _(t):
    tx = t.tx
    found = patterns.pattern_alerts(
        patterns.small_to_large(tx), patterns.round_trips(tx), patterns.velocity_bursts(tx), patterns.duplicate_amounts(t.tx_round)
    )
    # The two engines round averages of decimals differently, so the average stays out of the comparison.
    return found.withColumn("details", F.regexp_replace("details", r" \(avg [0-9.]+\)", "")).drop("audit")
