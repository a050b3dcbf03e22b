"""Reports, filings, searches and entity summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import investigate, maintenance, reports
from fraudspark.plans.payments import AUDIT_SQL, audit_time
from fraudspark.plans.registry import query

AS_OF = "(SELECT max(created_at) FROM {otx})"


def _as_of(t):
    return t.otx.agg(F.max("created_at")).scalar()


def _executions(t):
    """Stored rule executions: one per blocked or suspended payment."""
    return t.otx.filter(F.col("status").isin("BLOCKED", "SUSPENDED")).select(
        F.when(F.col("status") == "BLOCKED", F.col("id")).otherwise(F.col("external_id")).alias("transaction_id"),
        F.concat(F.lit("rule_"), F.lower("status")).alias("rule_name"), "created_at",
    )


EXECUTIONS = "executions AS (SELECT CASE WHEN status = 'BLOCKED' THEN id ELSE external_id END AS transaction_id, 'rule_' || lower(status) AS rule_name, created_at FROM {otx} WHERE status IN ('BLOCKED', 'SUSPENDED'))"
DAY = f"created_at > {AS_OF} - INTERVAL '24 hours'"


@query("daily_report", f"""SELECT 'transactions' AS section, 'total' AS key, count(*)::DOUBLE AS n FROM {{otx}} WHERE {DAY}
  UNION ALL SELECT 'transactions', 'blocked', count(*) FILTER (WHERE status = 'BLOCKED')::DOUBLE FROM {{otx}} WHERE {DAY}
  UNION ALL SELECT 'transactions', 'suspended', count(*) FILTER (WHERE status = 'SUSPENDED')::DOUBLE FROM {{otx}} WHERE {DAY}
  UNION ALL SELECT 'transactions', 'total_volume', coalesce(sum(amount), 0)::DOUBLE FROM {{otx}} WHERE {DAY}
  UNION ALL SELECT 'transactions', 'avg_amount', round(coalesce(avg(amount::DOUBLE), 0), 6) FROM {{otx}} WHERE {DAY}
  UNION ALL SELECT 'risk_distribution', risk_level, count(*)::DOUBLE FROM {{scores}} WHERE scored_at > {AS_OF} - INTERVAL '24 hours' GROUP BY risk_level
  UNION ALL SELECT 'alerts', status, count(*)::DOUBLE FROM {{alerts}} GROUP BY status
  UNION ALL SELECT 'sar_filings', status, count(*)::DOUBLE FROM {{filings}} GROUP BY status
  UNION ALL SELECT 'detection_rules', 'active', count(*)::DOUBLE FROM {{rule_table}} WHERE active
  UNION ALL SELECT 'detection_rules', 'matches', count(*)::DOUBLE FROM executions WHERE {DAY}""", EXECUTIONS)
def _(t):
    report = reports.daily_report(t.otx, t.scores, t.alerts, t.filings, t.rule_table, _executions(t), _as_of(t))
    return report.withColumn("n", F.round("n", 6))


@query("dashboard_stats", f"""SELECT 'total' AS name, count(*)::DOUBLE AS value FROM {{otx}} WHERE {DAY}
  UNION ALL SELECT 'blocked', count(*) FILTER (WHERE status = 'BLOCKED')::DOUBLE FROM {{otx}} WHERE {DAY}
  UNION ALL SELECT 'per_minute', round(count(*) / 1440.0, 6) FROM {{otx}} WHERE {DAY}
  UNION ALL SELECT 'open_alerts', count(*)::DOUBLE FROM {{alerts}} WHERE status = 'OPEN'
  UNION ALL SELECT 'critical_alerts', count(*)::DOUBLE FROM {{alerts}} WHERE status = 'OPEN' AND severity = 'CRITICAL'
  UNION ALL SELECT 'avg_risk', round(coalesce(avg(risk_score::DOUBLE), 0), 6) FROM {{scores}} WHERE scored_at > {AS_OF} - INTERVAL '24 hours'""")
def _(t):
    return reports.dashboard_stats(t.otx, t.scores, t.alerts, _as_of(t)).withColumn("value", F.round("value", 6))


@query("reporting_stats", """SELECT 'total' AS section, '' AS key, count(*)::DOUBLE AS n FROM {filings} UNION ALL SELECT 'by_status', status, count(*)::DOUBLE FROM {filings} GROUP BY status
  UNION ALL SELECT 'by_format', filing_format, count(*)::DOUBLE FROM {filings} GROUP BY filing_format UNION ALL SELECT 'by_type', filing_type, count(*)::DOUBLE FROM {filings} GROUP BY filing_type""")
def _(t):
    return reports.reporting_stats(t.filings)


STALE = f"""stale AS (SELECT * FROM (SELECT id, title, severity, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 24 ELSE 72 END AS sla_hours,
   (epoch_us({AS_OF}) - epoch_us(created_at)) / 3600000000 AS age_hours FROM {{alerts}} WHERE status = 'OPEN') x WHERE age_hours > sla_hours)"""


@query("stale_alerts", "SELECT id, title, severity, sla_hours, round(age_hours, 6) AS age_hours FROM stale", STALE)
def _(t):
    return reports.stale_alerts(t.alerts, _as_of(t)).withColumn("age_hours", F.round("age_hours", 6))


@query("audit_rows", "SELECT 'ESCALATION' AS event_type, 'alert' AS entity_type, id AS entity_id, 'escalation-job' AS actor, 'SLA_BREACH' AS action, severity, CAST(sla_hours AS BIGINT) AS sla_hours, title FROM stale", STALE)
def _(t):
    rows = maintenance.audit_rows(
        reports.stale_alerts(t.alerts, _as_of(t)), "ESCALATION", "alert", "id", "escalation-job", "SLA_BREACH", ["severity", "sla_hours", "title", "age_hours"]
    )
    back = F.from_json("details", "severity STRING, sla_hours BIGINT, title STRING")
    return rows.withColumn("d", back).select("event_type", "entity_type", "entity_id", "actor", "action", "d.*")


FORMAT = "CASE severity WHEN 'CRITICAL' THEN 'FinCEN_BSA' WHEN 'HIGH' THEN 'FCA_UK' WHEN 'MEDIUM' THEN 'BaFin_DE' ELSE 'OTHER' END"


@query("sar_draft", f"""SELECT 'SAR-' || substr(sha256(id || '|' || f), 1, 16) AS id, id AS alert_id, f AS filing_format, 'DRAFT' AS status, id AS alert_reference,
   CASE f WHEN 'FinCEN_BSA' THEN 'FinCEN SAR' WHEN 'FCA_UK' THEN 'FCA STR' WHEN 'BaFin_DE' THEN 'BaFin Verdachtsmeldung' ELSE '' END AS form_type,
   CASE f WHEN 'OTHER' THEN '' ELSE 'Example Fintech Ltd' END AS firm FROM (SELECT id, {FORMAT} AS f FROM {{alerts}}) a""")
def _(t):
    severity = F.col("severity")
    fmt = F.when(severity == "CRITICAL", "FinCEN_BSA").when(severity == "HIGH", "FCA_UK").when(severity == "MEDIUM", "BaFin_DE").otherwise("OTHER")
    drafts = reports.sar_drafts(t.alerts, fmt, audit_time())
    get = lambda path: F.get_json_object("structured_data", path)
    return drafts.select(
        "id", "alert_id", "filing_format", "status", get("$.alert_reference").alias("alert_reference"),
        F.coalesce(get("$.form_type"), F.lit("")).alias("form_type"),
        F.coalesce(get("$.part_i.filing_institution"), get("$.reporter.firm_name"), get("$.melder.name"), F.lit("")).alias("firm"),
    )


@query("sar_export", """SELECT id, CASE filing_format WHEN 'FinCEN_BSA' THEN 'FinCEN_BSA_XML' WHEN 'FCA_UK' THEN 'FCA_UK_CSV' ELSE 'BaFin_DE_XML' END AS format,
   CASE filing_format WHEN 'FCA_UK' THEN 'text/csv' ELSE 'application/xml' END AS content_type, subject_name AS subject, narrative, status FROM {filings} WHERE filing_format <> 'OTHER'""")
def _(t):
    get = lambda *paths: F.coalesce(*[F.get_json_object("data", p) for p in paths])
    return reports.sar_exports(t.filings).select(
        "id", "format", "content_type",
        get("$.BSAReport.Activity.Subject", "$.subject", "$.Verdachtsmeldung.Betreff").alias("subject"),
        get("$.BSAReport.Activity.Narrative", "$.narrative", "$.Verdachtsmeldung.Beschreibung").alias("narrative"),
        get("$.BSAReport.Status", "$.status", "$.Verdachtsmeldung.Status").alias("status"),
    )


@query("sar_transitions", f"""SELECT id, new_status, CASE WHEN ok THEN 'updated' ELSE 'rejected' END AS outcome, CASE WHEN ok THEN new_status ELSE status END AS status,
   CASE WHEN ok THEN 'note' ELSE narrative END AS narrative, strftime(CASE WHEN ok AND new_status = 'FILED' THEN {AUDIT_SQL} ELSE coalesce(filed_at, TIMESTAMP '1970-01-01') END, '%Y-%m-%d') AS filed_on
   FROM (SELECT f.*, a.new_status, (f.status = 'DRAFT' AND new_status IN ('PENDING_REVIEW','REJECTED')) OR (f.status = 'PENDING_REVIEW' AND new_status IN ('APPROVED','REJECTED','DRAFT'))
      OR (f.status = 'APPROVED' AND new_status IN ('FILED','REJECTED')) OR (f.status = 'REJECTED' AND new_status = 'DRAFT') AS ok
   FROM {{filings}} f JOIN (SELECT 'F' || o_orderkey AS id, CASE o_orderpriority[1] WHEN '1' THEN 'FILED' WHEN '2' THEN 'PENDING_REVIEW' WHEN '3' THEN 'APPROVED' WHEN '4' THEN 'REJECTED' ELSE 'DRAFT' END AS new_status FROM {{orders}}) a USING (id)) x""")
def _(t):
    first = F.substring("o_orderpriority", 1, 1)
    wanted = F.when(first == "1", "FILED").when(first == "2", "PENDING_REVIEW").when(first == "3", "APPROVED").when(first == "4", "REJECTED").otherwise("DRAFT")
    requests = t.orders.select(
        F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("id"), wanted.alias("new_status"), F.lit("note").alias("narrative")
    )
    done = reports.apply_status_changes(t.filings, requests, audit_time())
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return done.withColumn("filed_on", F.date_format(F.coalesce("filed_at", epoch), "yyyy-MM-dd")).drop("filed_at")


CHAIN = """chain AS (SELECT a.id, a.severity, a.title, a.description, a.status, t.sender_id, t.receiver_id, t.amount, t.currency, t.created_at AS tx_time, s.risk_score, s.risk_level
   FROM {alerts} a LEFT JOIN {otx} t ON a.transaction_id = t.id LEFT JOIN {scores} s ON a.risk_score_id = s.id)"""


@query("alert_detail", "SELECT id, severity, title, status, sender_id, receiver_id, CAST(amount AS DOUBLE) AS amount, currency, tx_time, CAST(risk_score AS DOUBLE) AS risk_score, risk_level FROM chain", CHAIN)
def _(t):
    return investigate.alert_chain(t.alerts, t.otx, t.scores).select(
        "id", "severity", "title", "status", "sender_id", "receiver_id", "amount", "currency", "tx_time", "risk_score", "risk_level"
    )


@query("sar_package", """SELECT c.id AS alert_reference, sender_id AS subject, receiver_id AS counterparty, n AS related_count, related_total, ids AS related_ids,
   'Subject ' || sender_id || ' sent ' || currency || ' ' || amount || ' to ' || receiver_id || '. Risk score: ' || risk_score || ' (' || risk_level || '). Alert: ' || title || '. ' || description || ' There are ' || n || ' related transactions from this sender.' AS narrative_prompt
   FROM chain c JOIN rel USING (sender_id) JOIN (SELECT sender_id, count(*) AS related_total FROM {otx} GROUP BY sender_id) n USING (sender_id)""", CHAIN,
  "rel AS (SELECT sender_id, CAST(count(*) AS INTEGER) AS n, string_agg(id, ',' ORDER BY created_at DESC, id) AS ids FROM (SELECT * FROM {otx} QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY created_at DESC, id) <= 20) x GROUP BY sender_id)")
def _(t):
    ids = F.array_join(F.transform("related_transactions", lambda r: r["id"]), ",")
    return reports.sar_packages(t.alerts, t.otx, t.scores).select(
        "alert_reference", F.col("subject.name").alias("subject"), F.col("counterparty.name").alias("counterparty"), "related_count", "related_total",
        ids.alias("related_ids"), "narrative_prompt",
    )


@query("search_transactions", "SELECT id, sender_id, CAST(amount AS DOUBLE) AS amount, status, created_at FROM {otx} WHERE amount >= 100000 AND amount <= 400000 AND status = 'SUCCESS' ORDER BY created_at DESC, id LIMIT 200")
def _(t):
    found = investigate.search_transactions(t.otx, min_amount=100000, max_amount=400000, status="SUCCESS", limit=500)
    return found.select("id", "sender_id", "amount", "status", "created_at")


@query("list_alerts", "SELECT id, severity, status, created_at FROM {alerts} WHERE status = 'OPEN' AND severity = 'HIGH' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def _(t):
    return investigate.list_page(t.alerts, 50, 100, status="OPEN", severity="HIGH").select("id", "severity", "status", "created_at")


@query("lookup_transaction", "SELECT id, external_id, sender_id, CAST(amount AS DOUBLE) AS amount FROM {otx} WHERE id = 'X77' OR external_id = 'X77'")
def _(t):
    return investigate.lookup(t.otx, "X77").select("id", "external_id", "sender_id", "amount")


DOUBLED = "doubled AS (SELECT id, sender_id AS entity, receiver_id AS counterparty, 'out' AS direction, amount, created_at FROM {otx} UNION ALL SELECT id, receiver_id, sender_id, 'in', amount, created_at FROM {otx} WHERE receiver_id <> sender_id)"


@query("recent_n", "SELECT entity, id, direction, CAST(row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, id) AS INTEGER) AS rn FROM doubled QUALIFY rn <= 50", DOUBLED)
def _(t):
    return investigate.recent_payments(t.otx, 50).select("entity", "id", "direction", "rn")


@query("investigate_entity", """SELECT 'score' AS part, sender_id AS entity, transaction_id AS item, CAST(row_number() OVER (PARTITION BY sender_id ORDER BY scored_at DESC, transaction_id) AS INTEGER) AS rn FROM {scores} s JOIN {otx} t ON s.transaction_id = t.id QUALIFY rn <= 20
  UNION ALL SELECT 'alert', entity, a.id, CAST(row_number() OVER (PARTITION BY entity ORDER BY a.created_at DESC, a.id) AS INTEGER) AS rn FROM {alerts} a JOIN doubled d ON a.transaction_id = d.id QUALIFY rn <= 20""", DOUBLED)
def _(t):
    scores = investigate.recent_scores(t.otx, t.scores).select(F.lit("score").alias("part"), "entity", F.col("transaction_id").alias("item"), "rn")
    alerts = investigate.recent_alerts(t.otx, t.alerts).select(F.lit("alert").alias("part"), "entity", F.col("id").alias("item"), "rn")
    return scores.unionByName(alerts)


@query("latest_score", "SELECT transaction_id, model_name, model_version, model_score, source, created_at FROM {model_scores} QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY created_at DESC, model_version DESC, model_name DESC) = 1")
def _(t):
    return investigate.latest_score(t.model_scores)


@query("entity_stats", "SELECT sender_id AS entity, count(*) AS total_txns, CAST(sum(amount) AS DOUBLE) AS total_amount, round(avg(amount::DOUBLE), 6) AS avg_amount, CAST(max(amount) AS DOUBLE) AS max_amount, min(created_at) AS first_seen, max(created_at) AS last_seen FROM {otx} GROUP BY sender_id")
def _(t):
    return investigate.entity_stats(t.otx).withColumn("avg_amount", F.round("avg_amount", 6))


def _devices(t):
    n = F.length("user_agent") % 4
    level = F.when(n == 0, "LOW").when(n == 1, "MEDIUM").when(n == 2, "HIGH").otherwise("CRITICAL")
    return t.device.select(
        F.concat(F.lit("C"), F.substring("user_id", 2, 6)).alias("user_id"), F.concat("canvas_hash", "platform").alias("device_hash"), level.alias("risk_level")
    )


@query("entity_summary", """SELECT c.entity AS entity_id, round(coalesce(avg_risk, 0), 6) AS risk_score,
   CASE WHEN avg_risk >= 75 THEN 'CRITICAL' WHEN avg_risk >= 50 THEN 'HIGH' WHEN avg_risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
   ['LOW','MEDIUM','HIGH','CRITICAL'][coalesce(worst, 1)] AS max_risk_level, coalesce(device_count, 0) AS device_count, ['LOW','MEDIUM','HIGH','CRITICAL'][coalesce(worst_device, 1)] AS device_risk,
   transaction_count, coalesce(alert_count, 0) AS alert_count, coalesce(kyc_level, 'UNKNOWN') AS kyc_level, coalesce(pep_status, FALSE) AS pep_status, coalesce(results, '') AS enrichments
   FROM (SELECT entity, count(*) AS transaction_count FROM doubled GROUP BY entity) c
   LEFT JOIN (SELECT sender_id AS entity, count(*) AS alert_count FROM {alerts} a JOIN {otx} t ON a.transaction_id = t.id GROUP BY sender_id) a USING (entity)
   LEFT JOIN (SELECT entity_id AS entity, avg(risk_score::DOUBLE) AS avg_risk, max(list_position(['LOW','MEDIUM','HIGH','CRITICAL'], risk_level)) AS worst FROM {scores} GROUP BY entity_id) r USING (entity)
   LEFT JOIN (SELECT 'C' || substr(user_id, 2, 6) AS entity, count(DISTINCT canvas_hash || platform) AS device_count, max(length(user_agent) % 4 + 1) AS worst_device FROM {device} GROUP BY 1) d USING (entity)
   LEFT JOIN (SELECT 'C' || substr(user_id, 2) AS entity, kyc_level, pep_status FROM {profiles} WHERE user_id[1] = 'U') p USING (entity)
   LEFT JOIN (SELECT entity_id AS entity, string_agg(enrichment_type || '=' || risk_score || '@' || epoch_us(created_at), ',' ORDER BY enrichment_type) AS results
      FROM (SELECT * FROM {enrichments} QUALIFY row_number() OVER (PARTITION BY entity_id, enrichment_type ORDER BY created_at DESC, id DESC) = 1) x GROUP BY entity_id) e USING (entity)""", DOUBLED)
def _(t):
    profiles = t.profiles.filter(F.col("user_id").startswith("U")).withColumn("user_id", F.concat(F.lit("C"), F.substring("user_id", 2, 20)))
    card = investigate.entity_summary(t.otx, t.alerts, t.scores, profiles, _devices(t), t.enrichments)
    spelled = lambda e: F.concat(e["type"], F.lit("="), e["risk_score"].cast("string"), F.lit("@"), F.unix_micros(e["created_at"].cast("timestamp")).cast("string"))
    return card.withColumn("risk_score", F.round("risk_score", 6)).withColumn("enrichments", F.array_join(F.transform("enrichments", spelled), ","))


# Pattern matches as stored rows: one per large order.
PATTERN_HITS = "hits AS (SELECT sender_id, 'VELOCITY_BURST' AS pattern_type, created_at AS detected_at FROM {otx} WHERE amount > 450000)"


def _records(t):
    tx = t.otx
    hits = tx.filter("amount > 450000").select("sender_id", F.lit("VELOCITY_BURST").alias("pattern_type"), F.col("created_at").alias("detected_at"))
    return investigate.debug_transactions(tx, t.scores, t.enrichments, _executions(t), hits)


# The children of the decision records of large payments, a row each, with their place in their list.
@query("debug_children", """SELECT transaction_id, part, name, happened_at, CAST(row_number() OVER (PARTITION BY transaction_id, part ORDER BY happened_at DESC, name, score) AS INTEGER) AS place, score FROM (
    SELECT t.external_id AS transaction_id, 'enrichment' AS part, enrichment_type AS name, e.created_at AS happened_at, CAST(e.risk_score AS INTEGER) AS score FROM {otx} t JOIN {enrichments} e ON e.entity_id = t.sender_id WHERE amount > 400000
    UNION ALL SELECT t.external_id, 'rule', x.rule_name, x.created_at, 0 FROM {otx} t JOIN executions x ON x.transaction_id = t.id OR x.transaction_id = t.external_id WHERE amount > 400000
    UNION ALL SELECT t.external_id, 'pattern', pattern_type, detected_at, 0 FROM {otx} t JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY detected_at DESC) <= 10) h USING (sender_id) WHERE amount > 400000) x""", EXECUTIONS, PATTERN_HITS)
def _(t):
    record = _records(t).filter("amount > 400000")

    def rows(part: str, column: str, name: str, at: str, score):
        found = record.select("transaction_id", F.posexplode(column).alias("i", "c"))
        return found.select("transaction_id", F.lit(part).alias("part"), F.col(f"c.{name}").alias("name"), F.col(f"c.{at}").alias("happened_at"), (F.col("i") + 1).alias("place"), score.alias("score"))

    none = F.lit(0)
    return (
        rows("enrichment", "enrichments", "type", "created_at", F.col("c.risk_score").cast("int")).unionByName(rows("rule", "rules", "rule_name", "matched_at", none))
        .unionByName(rows("pattern", "newest_patterns", "pattern_type", "detected_at", none))
    )


@query("debug_transaction", """SELECT t.external_id AS transaction_id, t.sender_id, CAST(t.amount AS DOUBLE) AS amount, final AS final_risk_score, s.risk_level AS final_risk_level,
   CASE WHEN final >= 75 THEN 'BLOCK' WHEN final >= 50 THEN 'SUSPEND' WHEN final >= 25 THEN 'FLAG' ELSE 'ALLOW' END AS final_action,
   coalesce(r.n, 0) AS rule_matches, coalesce(h.n, 0) AS cep_patterns, CAST(least(coalesce(h.n, 0), 10) AS INTEGER) AS patterns_shown, coalesce(e.n, 0) AS enrichment_signals, CAST((a_part > 0)::INT + (velocity_score > 0)::INT + (sanctions_score > 0)::INT + (pattern_score > 0)::INT AS INTEGER) AS triggered,
   CAST(4 + (a_part > 0)::INT + (velocity_score > 0)::INT + (sanctions_score > 0)::INT + (pattern_score > 0)::INT + (r.n > 0 AND r.n IS NOT NULL)::INT + (h.n IS NOT NULL)::INT + (e.n IS NOT NULL)::INT AS INTEGER) AS path_length
   FROM (SELECT *, CASE WHEN amount > 50000 THEN 35 WHEN amount > 10000 THEN 20 WHEN amount > 5000 THEN 10 ELSE 0 END AS a_part FROM {otx}) t
   JOIN (SELECT *, NULL AS x FROM {scores}) s ON s.transaction_id = t.id
   LEFT JOIN (SELECT CASE WHEN status = 'BLOCKED' THEN id ELSE id END AS id, 1::BIGINT AS n FROM {otx} WHERE status IN ('BLOCKED','SUSPENDED')) r ON r.id = t.id
   LEFT JOIN (SELECT sender_id, count(*) AS n FROM hits GROUP BY sender_id) h ON h.sender_id = t.sender_id
   LEFT JOIN (SELECT entity_id, count(*) AS n FROM {enrichments} GROUP BY entity_id) e ON e.entity_id = t.sender_id,
   LATERAL (SELECT CASE WHEN s.risk_score = 0 THEN least(a_part + velocity_score + sanctions_score + pattern_score, 100)::DOUBLE ELSE s.risk_score::DOUBLE END AS final) f""", PATTERN_HITS)
def _(t):
    record = _records(t)
    triggered = F.size(F.filter("score_factors", lambda f: f["triggered"]))
    return record.select(
        "transaction_id", "sender_id", "amount", "final_risk_score", "final_risk_level", "final_action", "rule_matches",
        "cep_patterns", F.size("newest_patterns").alias("patterns_shown"), "enrichment_signals", triggered.alias("triggered"), F.size("decision_path").alias("path_length"),
    )
