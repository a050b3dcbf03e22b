"""Rules, watch-lists and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import maintenance, rules, screening, watchlist
from fraudspark.plans.payments import AUDIT_SQL, LEVEL_SQL, audit_time
from fraudspark.plans.registry import query

RULE_MATCH = """SELECT rule_id, rule_name, external_id, sender_id, CAST(amount AS DOUBLE) AS amount, field AS matched_field, value AS matched_value,
  action AS action_taken, risk_score_adjustment AS risk_adjustment, {stamp} AS matched_at FROM {{tx}} t CROSS JOIN {{rules}} r WHERE r.active AND (
    (field = 'amount' AND operator = 'gt' AND amount > TRY_CAST(value AS DECIMAL(18,4)))
    OR (field = 'amount' AND operator = 'lt' AND amount < TRY_CAST(value AS DECIMAL(18,4)))
    OR (field = 'currency' AND operator = 'eq' AND currency = value) OR (field = 'sender_id' AND operator = 'eq' AND sender_id = value)
    OR (field = 'transaction_type' AND operator = 'eq' AND transaction_type = value)
    OR (field = 'sender_id' AND operator = 'contains' AND contains(sender_id, value))
    OR (field = 'receiver_id' AND operator = 'contains' AND contains(receiver_id, value)))"""


@query("rule_match", RULE_MATCH.format(stamp=AUDIT_SQL))
def _(t):
    return rules.stream_matches(t.tx, t.rules, audit_time())


NIGHTLY = """matched AS (SELECT t.id, r.*, t.current_score, t.factors FROM (
    SELECT o.*, s.risk_score AS current_score, s.factors FROM {otx} o LEFT JOIN {scores} s ON s.transaction_id = o.id
    WHERE o.created_at > (SELECT max(created_at) FROM {otx}) - INTERVAL '720 hours') t CROSS JOIN {rules} r
  WHERE r.active AND CASE operator
      WHEN 'gt' THEN TRY_CAST(v(field, t) AS DOUBLE) > TRY_CAST(value AS DOUBLE) WHEN 'lt' THEN TRY_CAST(v(field, t) AS DOUBLE) < TRY_CAST(value AS DOUBLE)
      WHEN 'eq' THEN v(field, t) = value WHEN 'neq' THEN v(field, t) <> value WHEN 'contains' THEN contains(lower(v(field, t)), lower(value))
      WHEN 'in' THEN list_contains(list_transform(string_split(value, ','), lambda x: trim(x)), v(field, t)) ELSE FALSE END)"""
FIELD_VALUE = "(CASE field " + " ".join(
    f"WHEN '{f}' THEN CAST(t.{f} AS VARCHAR)" for f in
    ("external_id", "sender_id", "receiver_id", "sender_iban", "receiver_iban", "transaction_type", "currency", "amount", "status", "current_score")
) + " END)"
NIGHTLY = NIGHTLY.replace("v(field, t)", FIELD_VALUE)


def _rescored(t):
    tx = t.otx
    return rules.rescore(tx, t.rules, t.scores, tx.agg(F.max("created_at")).scalar(), hours=720)


@query("rescore_rules", f"""SELECT id, CAST(adjustment AS BIGINT) AS adjustment, names AS matched_rules, risk_score, {LEVEL_SQL} AS risk_level, n_factors FROM (
    SELECT id, sum(risk_score_adjustment) AS adjustment, string_agg(rule_name, ',' ORDER BY rule_name) AS names,
      least(100.0, coalesce(CAST(max(current_score) AS DOUBLE), 0) + sum(risk_score_adjustment))::DOUBLE AS risk_score,
      count(*) + len(from_json(any_value(factors), '["VARCHAR"]')) AS n_factors FROM matched GROUP BY id) x WHERE adjustment > 0""", NIGHTLY)
def _(t):
    rescored, _ = _rescored(t)
    return rescored.select(
        "id", "adjustment", F.array_join("matched_rules", ",").alias("matched_rules"), "risk_score", "risk_level",
        F.size("factors").cast("long").alias("n_factors"),
    )


@query("rule_executions", "SELECT rule_id, rule_name, id AS transaction_id, TRUE AS matched, risk_score_adjustment AS risk_adjustment_applied, action AS action_taken FROM matched", NIGHTLY)
def _(t):
    return _rescored(t)[1]


CONDITIONS = [
    {"field": "amount", "operator": "gt", "value": "1000"},
    {"field": "sender_kyc_level", "operator": "in", "value": "NONE, BASIC"},
    {"field": "receiver_pep", "operator": "is_false", "value": ""},
    {"field": "sender_email", "operator": "contains", "value": "MACH"},
    {"field": "sender_card_status", "operator": "neq", "value": "FROZEN"},
    {"field": "no_such_field", "operator": "eq", "value": "x"},
]
BACKTEST = """bt AS (SELECT t.*, sp.risk_rating, t.amount > 1000 AND sp.kyc_level IN ('NONE', 'BASIC') AND rp.pep_status = FALSE
      AND contains(lower(sp.email), 'mach') AND sc.card_status <> 'FROZEN' AS is_match
  FROM {tx} t LEFT JOIN {profiles} sp ON t.sender_id = sp.user_id LEFT JOIN {profiles} rp ON t.receiver_id = rp.user_id LEFT JOIN {cards} sc ON t.sender_id = sc.user_id)"""


def _payments(t):
    return t.tx.withColumn("id", F.col("external_id")).withColumn("created_at", F.col("event_time"))


@query("backtest_rule", "SELECT external_id, sender_id, CAST(amount AS DOUBLE) AS amount FROM bt WHERE is_match", BACKTEST)
def _(t):
    flagged = rules.backtest(_payments(t), t.scores, t.profiles, t.cards, CONDITIONS)
    return flagged.filter("is_match").select("external_id", "sender_id", "amount")


@query("backtest_summary", """SELECT 'total_transactions' AS name, (SELECT count(*) FROM {otx})::DOUBLE AS value
  UNION ALL SELECT 'total_matched', count(*)::DOUBLE FROM b2 UNION ALL SELECT 'match_rate', round(count(*) / (SELECT count(*) FROM {otx}) * 100, 2) FROM b2
  UNION ALL SELECT 'level:' || risk_level, count(*)::DOUBLE FROM b2 GROUP BY risk_level""",
  """b2 AS (SELECT o.*, s.risk_level FROM {otx} o LEFT JOIN {scores} s ON s.transaction_id = o.id WHERE s.risk_score > 40 OR s.risk_level = 'LOW' OR o.currency = 'EUR')""")
def _(t):
    conditions = [
        {"field": "risk_score", "operator": "gt", "value": "40"}, {"field": "risk_level", "operator": "eq", "value": "LOW"},
        {"field": "currency", "operator": "eq", "value": "EUR"},
    ]
    tx = t.otx
    return rules.backtest_summary(rules.backtest(tx, t.scores, t.profiles, t.cards, conditions, "OR"), tx)


def _condition_rows(t):
    number = F.substring("rule_id", 2, 20).cast("long")
    return t.rule_table.select(
        F.concat(F.lit("multi_"), F.floor(number / 3).cast("string")).alias("rule_name"), number.alias("position"), "field", "operator", "value"
    )


MULTI = "cond AS (SELECT 'multi_' || CAST(CAST(substr(rule_id, 2) AS BIGINT) // 3 AS VARCHAR) AS rule_name, CAST(substr(rule_id, 2) AS BIGINT) AS position, field, operator, value FROM {rule_table})"


@query("rule_multi", """SELECT rule_name, CASE WHEN count(*) > 1 THEN string_agg(field, ' + ' ORDER BY position) ELSE any_value(field) END AS field,
   CASE WHEN count(*) > 1 THEN 'multi' ELSE any_value(operator) END AS operator,
   CASE WHEN count(*) > 1 THEN string_agg(field || ' ' || operator || ' ' || value, ' AND ' ORDER BY position) ELSE any_value(value) END AS value FROM cond GROUP BY rule_name""", MULTI)
def _(t):
    return rules.condition_text(rules.collect_conditions(_condition_rows(t), ["rule_name"], "position"))


@query("rule_multi_match", """SELECT external_id, rule_name FROM (SELECT t.external_id, c.rule_name, bool_and(CASE field WHEN 'sender_id' THEN t.sender_id = value WHEN 'currency' THEN t.currency = value
    ELSE t.amount > CAST(value AS DOUBLE) END) AS ok FROM {tx} t CROSS JOIN cond c GROUP BY ALL) x WHERE ok""", MULTI)
def _(t):
    grouped = rules.collect_conditions(_condition_rows(t), ["rule_name"], "position")
    return rules.match_rules(t.tx, grouped, rules.nightly_condition).select("external_id", F.col("rule.rule_name").alias("rule_name"))


INCOMING_SQL = """incoming AS (SELECT 'N' || s_suppkey AS rule_id, CASE WHEN s_suppkey % 2 = 0 THEN 'watch_' || lower(c_mktsegment) || '_' || c_custkey ELSE 'watch_new_' || s_suppkey END AS rule_name,
   'From ' || s_name AS description, 'amount' AS field, 'gt' AS operator, CAST(s_suppkey AS VARCHAR) AS value, 'FLAG' AS action, CAST(7 AS INTEGER) AS risk_score_adjustment, 'LOW' AS severity, 'feed' AS created_by
   FROM {supplier} JOIN {customer} ON c_custkey = s_suppkey * 3)"""
RULE_COLUMNS = ["description", "field", "operator", "value", "action", "risk_score_adjustment", "severity"]


@query("rule_upsert", "SELECT coalesce(o.rule_id, n.rule_id) AS rule_id, coalesce(o.rule_name, n.rule_name) AS rule_name, "
  + ", ".join(f"CASE WHEN n.rule_name IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c in RULE_COLUMNS)
  + ", coalesce(o.active, TRUE) AS active, coalesce(o.created_by, n.created_by) AS created_by, CASE WHEN o.rule_name IS NULL THEN 1 WHEN n.rule_name IS NULL THEN o.version ELSE o.version + 1 END AS version FROM {rule_table} o FULL JOIN incoming n ON o.rule_name = n.rule_name", INCOMING_SQL)
def _(t):
    paired = t.supplier.join(t.customer, F.col("c_custkey") == F.col("s_suppkey") * 3)
    key = F.col("s_suppkey").cast("string")
    incoming = paired.select(
        F.concat(F.lit("N"), key).alias("rule_id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("watch_"), F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string")))
        .otherwise(F.concat(F.lit("watch_new_"), key)).alias("rule_name"),
        F.concat(F.lit("From "), "s_name").alias("description"), F.lit("amount").alias("field"), F.lit("gt").alias("operator"),
        key.alias("value"), F.lit("FLAG").alias("action"), F.lit(7).alias("risk_score_adjustment"), F.lit("LOW").alias("severity"),
        F.lit("feed").alias("created_by"),
    )
    return rules.upsert_rules(t.rule_table, incoming)


@query("rule_apply_changes", """SELECT o.rule_id, o.rule_name, coalesce(c.description, o.description) AS description, o.field, o.operator, o.value, coalesce(c.action, o.action) AS action,
   coalesce(c.risk_score_adjustment, o.risk_score_adjustment) AS risk_score_adjustment, o.severity, coalesce(c.active, o.active) AS active, o.created_by,
   CASE WHEN c.rule_id IS NOT NULL THEN o.version + 1 ELSE o.version END AS version FROM {rule_table} o LEFT JOIN {rule_changes} c ON o.rule_id = c.rule_id""")
def _(t):
    return rules.apply_rule_changes(t.rule_table, t.rule_changes)


@query("rule_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE created_by = 'ai-agent') AS agent_made, round(avg(risk_score_adjustment), 6) AS mean_adjustment FROM {rule_table}")
def _(t):
    return rules.rule_stats(t.rule_table).withColumn("mean_adjustment", F.round("mean_adjustment", 6))


# --- watch-list ------------------------------------------------------------------------------


def _feed(t):
    """The watch-list feed in its nested form."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(F.col(c).isNull(), none).otherwise(F.array(c))
    return t.entities.select(
        "id", F.col("schema_type").alias("schema"), "caption", F.array("dataset").alias("datasets"),
        F.struct(
            listed("name").alias("name"), listed("alias").alias("alias"), listed("passport").alias("passportNumber"),
            none.alias("idNumber"), none.alias("taxNumber"), none.alias("innCode"), listed("country").alias("country"), listed("address").alias("address"),
        ).alias("properties"),
    )


@query("watchlist_names", "SELECT id AS entity_id, name, lower(trim(name)) AS name_normalized FROM {entities} WHERE schema_type IN ('Person','Company','Organization','LegalEntity')")
def _(t):
    return watchlist.screened_names(_feed(t))


@query("watchlist_tables", """SELECT 'entity' AS part, id AS entity_id, schema_type AS kind, caption AS value FROM {entities}
  UNION ALL SELECT 'name', entity_id, name_type, name_normalized FROM {entity_names}
  UNION ALL SELECT 'identifier', id, 'passportNumber:' || coalesce(country, ''), passport FROM {entities}
  UNION ALL SELECT 'address', id, coalesce(country, ''), address FROM {entities}""")
def _(t):
    feed = _feed(t)
    row = lambda df, part, key, kind, value: df.select(
        F.lit(part).alias("part"), F.col(key).alias("entity_id"), kind.alias("kind"), F.col(value).alias("value")
    )
    country = F.coalesce("country", F.lit(""))
    return (
        row(watchlist.entities(feed, "all"), "entity", "id", F.col("schema_type"), "caption")
        .unionByName(row(watchlist.entity_names(feed), "name", "entity_id", F.col("name_type"), "name_normalized"))
        .unionByName(row(watchlist.entity_identifiers(feed), "identifier", "entity_id", F.concat_ws(":", "id_type", country), "id_value"))
        .unionByName(row(watchlist.entity_addresses(feed), "address", "entity_id", country, "full_address"))
    )


STORED_ENTITIES = "SELECT id, schema_type, caption, dataset, '{\"name\":[\"' || name || '\"]}' AS properties, TIMESTAMP '2023-01-01 00:00:00' AS seen FROM {entities} WHERE schema_type <> 'Vessel'"


@query("watchlist_upsert", f"""SELECT coalesce(o.id, n.id) AS id, coalesce(o.schema_type, n.schema_type) AS schema_type, coalesce(n.caption, o.caption) AS caption, coalesce(n.dataset, o.dataset) AS datasets,
   coalesce(o.seen, {AUDIT_SQL}) AS first_seen, CASE WHEN n.id IS NOT NULL THEN {AUDIT_SQL} ELSE o.seen END AS last_seen,
   CASE WHEN n.id IS NOT NULL THEN {AUDIT_SQL} ELSE o.seen END AS last_change, CASE WHEN n.id IS NOT NULL THEN n.properties ELSE o.properties END AS properties,
   coalesce(o.seen, {AUDIT_SQL}) AS created_at, CASE WHEN n.id IS NOT NULL THEN {AUDIT_SQL} ELSE o.seen END AS updated_at FROM stored o FULL JOIN fresh n ON o.id = n.id""",
  f"stored AS ({STORED_ENTITIES})", "fresh AS (SELECT id, schema_type, caption || ' (new)' AS caption, dataset, '{\"name\":[\"' || alias || '\"]}' AS properties FROM {entities} WHERE dataset = 'us_ofac')")
def _(t):
    past = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    base = t.entities.withColumn("datasets", F.array("dataset"))
    named = lambda c: F.to_json(F.struct(F.array(c).alias("name")))
    times = [past.alias(c) for c in ("first_seen", "last_seen", "last_change", "created_at", "updated_at")]
    stored = base.filter("schema_type <> 'Vessel'").select("id", "schema_type", "caption", "datasets", named("name").alias("properties"), *times)
    fresh = base.filter("dataset = 'us_ofac'").select(
        "id", "schema_type", F.concat("caption", F.lit(" (new)")).alias("caption"), "datasets", named("alias").alias("properties"), audit_time().alias("last_change")
    )
    return maintenance.upsert_entities(stored, fresh, audit_time()).withColumn("datasets", F.array_join("datasets", ","))


@query("watchlist_delta", """SELECT n.entity_id, n.name, n.name_type FROM {entity_names} n WHERE n.entity_id NOT IN (SELECT id FROM {entities} WHERE dataset = 'us_ofac')
  UNION ALL SELECT id, caption, 'reloaded' FROM {entities} WHERE dataset = 'us_ofac'""")
def _(t):
    entities = t.entities.withColumn("datasets", F.array("dataset"))
    fresh = entities.filter("dataset = 'us_ofac'").select(F.col("id").alias("entity_id"), F.col("caption").alias("name"), F.lit("reloaded").alias("name_type"))
    return maintenance.reload_children(t.entity_names.select("entity_id", "name", "name_type"), entities, fresh, "us_ofac")


@query("insert_if_absent", """SELECT entity, first_amount FROM s UNION ALL SELECT receiver_id, CAST(arg_min(amount, (event_time, external_id)) AS DOUBLE) FROM {tx} WHERE receiver_id NOT IN (SELECT entity FROM s) GROUP BY receiver_id""",
  "s AS (SELECT DISTINCT 'M' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS entity, -1.0::DOUBLE AS first_amount FROM {supplier} WHERE s_acctbal > 5000)")
def _(t):
    stored = t.supplier.filter("s_acctbal > 5000").select(
        F.concat(F.lit("M"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("entity"), F.lit(-1.0).alias("first_amount")
    )
    incoming = t.tx.select(F.col("receiver_id").alias("entity"), F.col("amount").cast("double").alias("first_amount"), "event_time", "external_id")
    return maintenance.insert_if_absent(stored, incoming, ["entity"], ["event_time", "external_id"])


@query("sync_status", f"""SELECT dataset_name, coalesce(n, 0) AS records_count, CASE WHEN n IS NULL THEN 'PENDING' WHEN err IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status, coalesce(substr(err, 1, 500), '') AS error_message,
   CASE WHEN n IS NULL THEN TIMESTAMP '2023-01-01 00:00:00' ELSE {AUDIT_SQL} END AS last_sync_at, CASE WHEN n IS NULL THEN TIMESTAMP '2023-01-01 00:00:00' ELSE {AUDIT_SQL} END AS updated_at,
   CAST(CASE WHEN n IS NULL THEN 0 ELSE 95 END AS INTEGER) AS sync_duration_seconds FROM (SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'us_ofac' WHEN 1 THEN 'eu_fsf' WHEN 2 THEN 'gb_hmt' ELSE n_name END AS dataset_name FROM {{nation}} QUALIFY row_number() OVER (PARTITION BY dataset_name ORDER BY n_nationkey) = 1) s
   LEFT JOIN (SELECT dataset, count(*) AS n, max(CASE WHEN dataset = 'gb_hmt' THEN rpad('bad line ', 900, 'x') END) AS err FROM {{entities}} GROUP BY dataset) c ON c.dataset = s.dataset_name""")
def _(t):
    m = F.col("n_nationkey") % 4
    named = F.when(m == 0, "us_ofac").when(m == 1, "eu_fsf").when(m == 2, "gb_hmt").otherwise(F.col("n_name"))
    stored = t.nation.select(named.alias("dataset_name")).distinct().select(
        "dataset_name", F.lit(0).cast("long").alias("records_count"), F.lit("PENDING").alias("status"), F.lit("").alias("error_message"),
        F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("last_sync_at"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
        F.lit(0).alias("sync_duration_seconds"),
    )
    error = F.when(F.col("dataset_name") == "gb_hmt", F.rpad(F.lit("bad line "), 900, "x"))
    synced = maintenance.sync_status(stored, t.entities.withColumnRenamed("dataset", "dataset_name"), audit_time(), audit_time() - F.expr("INTERVAL '95.5' SECOND"), error)
    return synced.withColumn("error_message", F.coalesce("error_message", F.lit("")))


@query("sink_upsert", """SELECT sender_id, external_id, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, 1 AS round FROM {tx} UNION ALL SELECT *, 0 AS round FROM {tx} WHERE status = 'BLOCKED') x
   QUALIFY row_number() OVER (PARTITION BY sender_id ORDER BY round DESC, event_time DESC, external_id DESC) = 1""")
def _(t):
    tx = t.tx.select("sender_id", "external_id", "amount", "event_time", "status")
    stored = maintenance.upsert(tx.limit(0), tx.filter("status = 'BLOCKED'"), ["sender_id"], ["event_time", "external_id"])
    return maintenance.upsert(stored, tx, ["sender_id"], ["event_time", "external_id"]).select("sender_id", "external_id", "amount")


# --- screening -------------------------------------------------------------------------------

TRIGRAM = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, CAST(length(w) AS BIGINT) + 2)] for w in regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+') if w <> '']))"


def _similar(query_sql, threshold, top):
    return (
        "q0 AS (" + query_sql + ")",
        "q1 AS (SELECT text, " + TRIGRAM.format("text") + " AS g FROM (SELECT DISTINCT text FROM q0) q)",
        "w1 AS (SELECT text, " + TRIGRAM.format("text") + " AS g FROM (SELECT DISTINCT name_normalized AS text FROM {entity_names}) w)",
        f"""sim AS (SELECT q1.text AS l_text, w1.text AS r_text, len(list_intersect(q1.g, w1.g)) / (len(q1.g) + len(w1.g) - len(list_intersect(q1.g, w1.g))) AS similarity FROM q1, w1
            WHERE len(list_intersect(q1.g, w1.g)) / (len(q1.g) + len(w1.g) - len(list_intersect(q1.g, w1.g))) >= {threshold})""",
        f"""hits AS (SELECT query_id, entity_id, name AS matched_name, round(similarity, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim.similarity DESC, entity_id, name) AS match_rank
            FROM q0 JOIN sim ON sim.l_text = q0.text JOIN (SELECT DISTINCT entity_id, name, name_normalized FROM {{entity_names}}) e ON e.name_normalized = sim.r_text QUALIFY match_rank <= {top})""",
    )


@query("screen_names", "SELECT query_id, entity_id, matched_name, similarity, CAST(match_rank AS INTEGER) AS match_rank FROM hits", *_similar("SELECT query_id, lower(trim(name)) AS text FROM {names}", 0.5, 5))
def _(t):
    return screening.screen_names(t.names, t.entity_names, 0.5, 5)


ENTITY_SQL = "SELECT DISTINCT entity AS query_id, lower(trim(entity)) AS text FROM (SELECT sender_id AS entity FROM {tx} WHERE event_time > (SELECT max(event_time) FROM {tx}) - INTERVAL '7 days' UNION SELECT receiver_id FROM {tx} WHERE event_time > (SELECT max(event_time) FROM {tx}) - INTERVAL '7 days') u"


def _recent(t):
    tx = t.tx
    return screening.recent_entities(tx, tx.agg(F.max("event_time")).scalar())


@query("entity_union", "SELECT query_id AS entity FROM (" + ENTITY_SQL + ") e")
def _(t):
    return _recent(t)


@query("screen_entities", "SELECT query_id AS entity_name, entity_id AS matched_entity_id, matched_name, similarity FROM hits WHERE match_rank = 1", *_similar(ENTITY_SQL, 0.5, 5))
def _(t):
    return screening.screen_entities(_recent(t), t.entity_names)
