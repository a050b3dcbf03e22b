"""Graph, models, monitoring, features and file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudspark.operators import features, graph, investigate, models, monitor, records, rules, scoring, screening
from fraudspark.plans.payments import ACTION_SQL, LEVEL_SQL, PARSED_CTE, SCORED, FEATURE_SQL
from fraudspark.plans.registry import query
from fraudspark.plans.watch import _similar
from fraudspark.schemas import MODEL_FEATURES
from fraudspark.session import cut_lineage
from fraudspark.sources import readers

# --- graph -----------------------------------------------------------------------------------


@query("edge_aggregate", "SELECT sender_id, receiver_id, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS tx_count, max(currency) AS currency FROM {edges} GROUP BY ALL")
def _(t):
    return graph.edge_aggregate(t.edges)


YEARS = 24 * 365 * 3
GRAPH = f"""gf AS (SELECT entity, count(*)::DOUBLE AS graph_1hop_degree, count(DISTINCT cp)::DOUBLE AS graph_1hop_unique_counterparties, coalesce(sum(amount) FILTER (WHERE o), 0)::DOUBLE AS graph_1hop_amount_sum,
    round(coalesce(sum(amount) FILTER (WHERE o), 0)::DOUBLE / greatest(count(*) FILTER (WHERE o), 1), 6) AS graph_1hop_amount_mean, coalesce(max(amount) FILTER (WHERE o), 0)::DOUBLE AS graph_1hop_amount_max,
    least(count(DISTINCT cp) * greatest(count(*) FILTER (WHERE NOT o), 1), 2500)::DOUBLE AS graph_2hop_fanout, round(count(*) FILTER (WHERE risk_score >= 50) / count(*), 6) AS graph_2hop_flagged_fraction,
    CASE WHEN count(*) FILTER (WHERE o) > 0 THEN count(*) FILTER (WHERE NOT o) / count(*) FILTER (WHERE o) ELSE 1.0 END::DOUBLE AS graph_in_out_ratio,
    CASE WHEN count(*) FILTER (WHERE NOT o) >= 3 AND count(*) FILTER (WHERE o) >= 1 AND count(*) FILTER (WHERE NOT o) / count(*) FILTER (WHERE o) BETWEEN 0.3 AND 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS graph_is_bridge, 1.0::DOUBLE AS graph_present
  FROM (SELECT sender_id AS entity, receiver_id AS cp, TRUE AS o, amount, risk_score, event_time FROM {{edges}} UNION ALL SELECT receiver_id, sender_id, FALSE, amount, risk_score, event_time FROM {{edges}}) e
  WHERE event_time >= (SELECT max(event_time) FROM {{edges}}) - INTERVAL '{YEARS} hours' GROUP BY entity)"""


def _graph(t):
    edges = t.edges
    found = graph.graph_features(edges, edges.agg(F.max("event_time")).scalar(), YEARS)
    return found.withColumn("graph_1hop_amount_mean", F.round("graph_1hop_amount_mean", 6)).withColumn(
        "graph_2hop_flagged_fraction", F.round("graph_2hop_flagged_fraction", 6)
    )


@query("graph_features", "SELECT * FROM gf", GRAPH)
def _(t):
    return _graph(t)


@query("graph_features_rolling", """SELECT entity, (outs + ins)::DOUBLE AS graph_1hop_degree, uniq::DOUBLE AS graph_1hop_unique_counterparties, round(total, 6) AS graph_1hop_amount_sum,
   round(CASE WHEN outs > 0 THEN total / outs ELSE 0 END, 6) AS graph_1hop_amount_mean, top AS graph_1hop_amount_max, least(out_ids * in_ids, 2500)::DOUBLE AS graph_2hop_fanout, 0.0::DOUBLE AS graph_2hop_flagged_fraction,
   CASE WHEN outs > 0 THEN ins / outs WHEN ins > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS graph_in_out_ratio, CASE WHEN ins >= 3 AND outs >= 1 AND ins / outs BETWEEN 0.3 AND 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS graph_is_bridge, 1.0::DOUBLE AS graph_present
   FROM (SELECT entity, count(oid) AS outs, count(iid) AS ins, count(DISTINCT oid) AS out_ids, count(DISTINCT iid) AS in_ids, count(DISTINCT coalesce(oid, iid)) AS uniq, coalesce(sum(amount), 0)::DOUBLE AS total, coalesce(max(amount), 0)::DOUBLE AS top FROM (
      SELECT sender_id AS entity, external_id AS oid, NULL AS iid, amount FROM {tx} WHERE event_time > (SELECT max(event_time) FROM {tx}) - INTERVAL '120 seconds'
      UNION ALL SELECT receiver_id, NULL, sender_id, NULL FROM {tx} WHERE event_time > (SELECT max(event_time) FROM {tx}) - INTERVAL '30 days') r GROUP BY entity) x""")
def _(t):
    tx = t.tx
    found = graph.rolling_features(tx, tx.agg(F.max("event_time")).scalar())
    return found.withColumn("graph_1hop_amount_sum", F.round("graph_1hop_amount_sum", 6)).withColumn("graph_1hop_amount_mean", F.round("graph_1hop_amount_mean", 6))


@query("fund_flow", """SELECT entity, coalesce(sum(amount) FILTER (WHERE NOT o), 0)::DOUBLE AS total_in, coalesce(sum(amount) FILTER (WHERE o), 0)::DOUBLE AS total_out, count(*) FILTER (WHERE NOT o) AS count_in, count(*) FILTER (WHERE o) AS count_out,
   (coalesce(sum(amount) FILTER (WHERE NOT o), 0) - coalesce(sum(amount) FILTER (WHERE o), 0))::DOUBLE AS net_flow FROM (SELECT sender_id AS entity, TRUE AS o, amount FROM {edges} UNION ALL SELECT receiver_id, FALSE, amount FROM {edges}) e GROUP BY entity""")
def _(t):
    return graph.fund_flow(t.edges)


@query("feature_merge", "SELECT o.id, " + ", ".join(["CAST(amount AS DOUBLE) AS amount", "0.0::DOUBLE AS velocity_count", "hour(created_at)::DOUBLE AS hour_of_day", "(isodow(created_at) >= 6)::INT::DOUBLE AS is_weekend", "0.0::DOUBLE AS entity_risk", "0.0::DOUBLE AS cop_reason"]
   + [f"coalesce({c}, 0.0)::DOUBLE AS {c}" for c in graph.GRAPH_FEATURES]) + " FROM {otx} o LEFT JOIN gf ON gf.entity = o.sender_id", GRAPH)
def _(t):
    weekend = F.when(F.dayofweek("created_at").isin(1, 7), 1).otherwise(0)
    zero = F.lit(0.0)
    payments = t.otx.select(
        "id", "sender_id", "amount", zero.alias("velocity_count"), F.hour("created_at").alias("hour_of_day"), weekend.alias("is_weekend"),
        zero.alias("entity_risk"), zero.alias("cop_reason"),
    )
    return graph.merge_features(payments, _graph(t)).drop("sender_id")


LINKS = """pairs AS (SELECT DISTINCT a, b FROM (SELECT sender_id AS a, receiver_id AS b FROM {links} UNION ALL SELECT receiver_id, sender_id FROM {links}) x WHERE a <> b)"""
HOPS = """hops AS (SELECT DISTINCT sender_id AS root, sender_id AS node, 0 AS d FROM {links} UNION SELECT h.root, p.b, h.d + 1 FROM hops h JOIN pairs p ON p.a = h.node WHERE h.d < 3)"""


FIGURES = """figures AS (SELECT node, CAST(sum(c) AS BIGINT) AS n, sum(a) AS total FROM (SELECT sender_id AS node, count(*) AS c, sum(amount) AS a FROM {links} GROUP BY 1
    UNION ALL SELECT receiver_id, count(*), sum(CASE WHEN sender_id <> receiver_id THEN amount ELSE 0 END) FROM {links} GROUP BY 1) x GROUP BY node)"""


@query("khop_network", """SELECT 'node' AS part, root, node AS item, min(d) AS distance, any_value(n) AS transaction_count, CAST(any_value(total) AS DOUBLE) AS total_amount FROM hops LEFT JOIN figures USING (node) GROUP BY root, node
   UNION ALL SELECT 'edge', root, e.sender_id || '>' || e.receiver_id, -1, e.n, e.total
     FROM (SELECT DISTINCT h.root, l.sender_id, l.receiver_id FROM hops h JOIN {links} l ON (h.node = l.sender_id OR h.node = l.receiver_id) WHERE h.d <= 2) x
     JOIN (SELECT sender_id, receiver_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM {links} GROUP BY ALL) e ON e.sender_id = x.sender_id AND e.receiver_id = x.receiver_id""", LINKS, HOPS, FIGURES)
def _(t):
    links = t.links
    nodes, edges = graph.khop_network(graph.edge_aggregate(links), links.select(F.col("sender_id").alias("root")).distinct(), 2)
    total = F.col("total_amount").cast("double").alias("total_amount")
    return nodes.select(F.lit("node").alias("part"), "root", F.col("node").alias("item"), "distance", "transaction_count", total).unionByName(
        edges.select(
            F.lit("edge").alias("part"), "root", F.concat_ws(">", "sender_id", "receiver_id").alias("item"), F.lit(-1).alias("distance"),
            F.col("tx_count").alias("transaction_count"), total,
        )
    )


REACH = """reach AS (SELECT DISTINCT sender_id AS node, sender_id AS other FROM {links} UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other)"""
COMPONENT = "comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"


@query("communities", """SELECT component, size, tx_count, total_amount FROM (SELECT component, count(*) AS size FROM comp GROUP BY component HAVING count(*) > 1) s
   JOIN (SELECT component, count(*) AS tx_count, CAST(sum(amount) AS DOUBLE) AS total_amount FROM {links} JOIN comp ON node = sender_id GROUP BY component) x USING (component)""", LINKS, REACH, COMPONENT)
def _(t):
    links = t.links
    return graph.communities(links, graph.component_labels(links))


@query("community_members", "SELECT node, component FROM comp", LINKS, REACH, COMPONENT)
def _(t):
    return graph.component_labels(t.links)


# --- feedback --------------------------------------------------------------------------------

ALERT_TIME = "(SELECT max(created_at) FROM {alerts})"
VERDICT = f"""verdicts AS (SELECT a.id AS alert_id, s.factors, CASE WHEN a.status = 'RESOLVED' THEN 'TP' WHEN a.status = 'DISMISSED' THEN 'FP'
    WHEN EXISTS (SELECT 1 FROM {{filings}} f WHERE f.alert_id = a.id AND f.status NOT IN ('DRAFT', 'REJECTED')) THEN 'TP' ELSE 'UNCLEAR' END AS disposition
  FROM {{alerts}} a JOIN {{scores}} s ON s.id = a.risk_score_id WHERE a.created_at >= {ALERT_TIME} - INTERVAL '3650 days')"""
EXPLODED = """facts AS (SELECT alert_id, split_part(f, ':', 1) AS factor, disposition FROM (SELECT alert_id, unnest(from_json(factors, '["VARCHAR"]')) AS f, disposition FROM verdicts WHERE disposition IN ('TP', 'FP')) x)"""
PRECISION = """prec AS (SELECT factor, tp, fp, 0::BIGINT AS unclear, CASE WHEN tp + fp < 20 THEN 'insufficient_data' WHEN tp / (tp + fp) < 0.3 THEN 'loosen' WHEN tp / (tp + fp) > 0.85 THEN 'tighten' ELSE 'hold' END AS suggestion, round(tp / (tp + fp), 3) AS precision
  FROM (SELECT factor, count(*) FILTER (WHERE disposition = 'TP') AS tp, count(*) FILTER (WHERE disposition = 'FP') AS fp FROM facts GROUP BY factor) x)"""


def _verdicts(t):
    return monitor.dispositions(t.alerts, t.scores, t.filings, t.alerts.agg(F.max("created_at")).scalar(), 3650)


@query("feedback_dispositions", "SELECT alert_id, factors, disposition FROM verdicts", VERDICT)
def _(t):
    return _verdicts(t)


@query("factor_explode", "SELECT alert_id, factor, disposition FROM facts", VERDICT, EXPLODED)
def _(t):
    return monitor.explode_factors(_verdicts(t))


@query("feedback_precision", "SELECT factor, tp, fp, unclear, suggestion, precision FROM prec", VERDICT, EXPLODED, PRECISION)
def _(t):
    return monitor.factor_precision(monitor.explode_factors(_verdicts(t)))


@query("feedback_summary", "SELECT suggestion, count(*) AS n_factors, string_agg(factor, ',' ORDER BY factor) AS factors FROM prec GROUP BY suggestion", VERDICT, EXPLODED, PRECISION)
def _(t):
    summary = monitor.feedback_summary(monitor.factor_precision(monitor.explode_factors(_verdicts(t))))
    return summary.withColumn("factors", F.array_join("factors", ","))


@query("retrain_labels", """SELECT a.id AS alert_id, a.transaction_id, CAST(CASE a.status WHEN 'RESOLVED' THEN 1 ELSE 0 END AS INTEGER) AS label, resolved_by, resolved_at, coalesce(model_score, -1) AS model_score, coalesce(model_name, '') AS model_name, coalesce(model_version, '') AS model_version
   FROM {alerts} a LEFT JOIN {model_scores} m ON m.transaction_id = a.transaction_id WHERE a.status IN ('RESOLVED', 'DISMISSED') AND resolved_by IS NOT NULL AND resolved_at >= (SELECT max(resolved_at) FROM {alerts}) - INTERVAL '900 days'""")
def _(t):
    labels = monitor.training_labels(t.alerts, t.model_scores, t.alerts.agg(F.max("resolved_at")).scalar(), 900)
    none = F.lit("")
    return labels.withColumn("model_score", F.coalesce("model_score", F.lit(-1.0))).withColumn("model_name", F.coalesce("model_name", none)).withColumn(
        "model_version", F.coalesce("model_version", none)
    )


@query("retrain_gate", """SELECT CASE WHEN n >= 200 THEN 'retrain_started' ELSE 'retrain_skipped' END AS event, CASE WHEN n >= 200 THEN '' ELSE 'insufficient_labels' END AS reason, n AS n_labels, CAST(200 AS INTEGER) AS min_samples
   FROM (SELECT count(DISTINCT id) AS n FROM {alerts} WHERE status IN ('RESOLVED', 'DISMISSED') AND resolved_by IS NOT NULL AND resolved_at >= (SELECT max(resolved_at) FROM {alerts}) - INTERVAL '900 days') x""")
def _(t):
    labels = monitor.training_labels(t.alerts, t.model_scores, t.alerts.agg(F.max("resolved_at")).scalar(), 900)
    return monitor.retrain_gate(labels).withColumn("reason", F.coalesce("reason", F.lit("")))


# --- drift and calibration -------------------------------------------------------------------

RECENT = "recent AS (SELECT model_name, model_score AS score FROM {model_scores} WHERE source = 'model' AND created_at >= (SELECT max(created_at) FROM {model_scores}) - INTERVAL '720 hours')"
SORTED = "sorted AS (SELECT model_name, list(score ORDER BY score) AS v, count(*) AS n FROM {calibration} GROUP BY model_name)"
EDGES = "edge_lists AS (SELECT model_name, list_sort(list_distinct(list_concat([v[CAST(floor(i * n / 10) AS BIGINT) + 1] for i in range(0, 10)], [v[n]]))) AS e FROM sorted)"
BINNED = """binned AS (SELECT model_name, old, least(greatest(len(list_filter(e, lambda x: x <= score)), 1), len(e) - 1) AS bin, e FROM (SELECT model_name, score, TRUE AS old FROM {calibration} UNION ALL SELECT model_name, score, FALSE FROM recent) s JOIN edge_lists USING (model_name))"""
PSI = """psi_rows AS (SELECT model_name, bin, e[bin] AS lo, e[bin + 1] AS hi, no / tot_o AS baseline_frac, nr / tot_r AS recent_frac,
   (CASE WHEN nr > 0 THEN nr / tot_r ELSE 1e-6 END - CASE WHEN no > 0 THEN no / tot_o ELSE 1e-6 END) * ln(CASE WHEN nr > 0 THEN nr / tot_r ELSE 1e-6 END / CASE WHEN no > 0 THEN no / tot_o ELSE 1e-6 END) AS c, tot_o, tot_r
   FROM (SELECT g.model_name, g.bin, g.e, coalesce(b.no, 0) AS no, coalesce(b.nr, 0) AS nr, sum(coalesce(b.no, 0)) OVER (PARTITION BY g.model_name) AS tot_o, sum(coalesce(b.nr, 0)) OVER (PARTITION BY g.model_name) AS tot_r
      FROM (SELECT model_name, e, unnest(range(1, len(e))) AS bin FROM edge_lists) g LEFT JOIN (SELECT model_name, bin, count(*) FILTER (WHERE old) AS no, count(*) FILTER (WHERE NOT old) AS nr FROM binned GROUP BY model_name, bin) b ON b.model_name = g.model_name AND b.bin = g.bin) x)"""


def _recent(t):
    scores = t.model_scores
    return monitor.recent_model_scores(scores, scores.agg(F.max("created_at")).scalar(), 720)


@query("psi_bins", "SELECT model_name, CAST(bin AS INTEGER) AS bin, lo, hi, round(baseline_frac, 6) AS baseline_frac, round(recent_frac, 6) AS recent_frac, round(c, 6) AS psi_contribution FROM psi_rows", RECENT, SORTED, EDGES, BINNED, PSI)
def _(t):
    rows = monitor.psi_bins(t.calibration, _recent(t)).drop("n_baseline", "n_recent")
    return rows.select("model_name", "bin", "lo", "hi", *[F.round(c, 6).alias(c) for c in ("baseline_frac", "recent_frac", "psi_contribution")])


@query("psi_report", "SELECT model_name, round(sum(c), 6) AS psi, CASE WHEN sum(c) >= 0.2 THEN 'alert' WHEN sum(c) >= 0.1 THEN 'monitor' ELSE 'stable' END AS status, CAST(any_value(tot_o) AS BIGINT) AS n_baseline, CAST(any_value(tot_r) AS BIGINT) AS n_recent, 0.2::DOUBLE AS threshold FROM psi_rows GROUP BY model_name", RECENT, SORTED, EDGES, BINNED, PSI)
def _(t):
    return monitor.drift_report(t.calibration, _recent(t))


@query("sink_drift", "SELECT model_name AS key, model_name, round(sum(c), 6) AS psi, CASE WHEN sum(c) >= 0.2 THEN 'alert' WHEN sum(c) >= 0.1 THEN 'monitor' ELSE 'stable' END AS status FROM psi_rows GROUP BY model_name", RECENT, SORTED, EDGES, BINNED, PSI)
def _(t):
    messages = records.as_messages(monitor.drift_report(t.calibration, _recent(t)), "model_name")
    return messages.select("key", F.from_json("value", "model_name STRING, psi DOUBLE, status STRING").alias("m")).select("key", "m.*")


@query("anomaly_percentile", """SELECT transaction_id, m.model_name, model_version, m.model_score AS score, round(c.below / c.n, 6) AS percentile, c.below / c.n >= 0.95 AS is_anomaly FROM {model_scores} m
   JOIN (SELECT q.model_name, q.s, (SELECT n FROM sorted WHERE sorted.model_name = q.model_name) AS n, count(k.score) AS below FROM (SELECT DISTINCT model_name, model_score AS s FROM {model_scores}) q LEFT JOIN {calibration} k ON k.model_name = q.model_name AND k.score < q.s GROUP BY q.model_name, q.s) c
   ON c.model_name = m.model_name AND c.s = m.model_score""", SORTED)
def _(t):
    errors = t.model_scores.select("transaction_id", "model_name", "model_version", F.col("model_score").alias("score"))
    return monitor.percentiles(errors, t.calibration).withColumn("percentile", F.round("percentile", 6))


@query("calibration_build", "SELECT model_name, point, v[least(CAST(floor(point * n) AS BIGINT), n - 1) + 1] AS score FROM sorted, (SELECT unnest([0.05, 0.5, 0.95, 0.99]::DOUBLE[]) AS point) p", SORTED)
def _(t):
    return monitor.calibration_percentiles(t.calibration)


@query("calibration_errors", "SELECT model_name, score, CAST(sum(n) OVER (PARTITION BY model_name ORDER BY score) - n AS BIGINT) AS first_place, n FROM (SELECT model_name, score, count(*) AS n FROM {calibration} GROUP BY ALL) x")
def _(t):
    return monitor.sorted_errors(t.calibration)


# A model that answers with the mean vector of the row's label; rows of even ids are its calibration.
REBUILT = """cells AS (SELECT vec_id, label, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS x FROM {embeddings}),
  means AS (SELECT label, place, avg(x) AS m FROM cells GROUP BY ALL),
  vae AS (SELECT vec_id, label % 2 AS model, avg((x - m) * (x - m)) AS error FROM cells JOIN means USING (label, place) GROUP BY ALL)"""


@query("reconstruction_error", """SELECT a.vec_id, round(a.error, 6) AS reconstruction_error, round(count(*) FILTER (WHERE c.error < a.error) / count(*), 4) AS percentile,
   count(*) FILTER (WHERE c.error < a.error) / count(*) >= 0.95 AS is_anomaly FROM vae a JOIN vae c ON c.model = a.model AND c.vec_id % 2 = 0 WHERE a.vec_id % 2 = 1 GROUP BY a.vec_id, a.error""", REBUILT)
def _(t):
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("place", "x"))
    means = cells.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("m"))
    answers = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda c: c["m"]).alias("reconstruction"))
    rebuilt = t.embeddings.join(answers, "label").select("vec_id", F.col("embedding").alias("features"), "reconstruction", (F.col("label") % 2).cast("string").alias("model_name"))
    errors = rebuilt.filter("vec_id % 2 = 0").select("model_name", models.reconstruction_error(F.col("features"), F.col("reconstruction")).alias("score"))
    found = models.reconstruction_scores(rebuilt.filter("vec_id % 2 = 1"), errors)
    return found.select("vec_id", F.round("reconstruction_error", 6).alias("reconstruction_error"), F.round("percentile", 4).alias("percentile"), "is_anomaly")


@query("src_calibration", "SELECT model_name, score FROM {calibration}")
def _(t):
    grouped = t.calibration.groupBy("model_name", "vec_id").agg(F.collect_list("score").alias("reconstruction_errors"))
    texts = F.concat(F.transform("reconstruction_errors", lambda s: s.cast("string")), F.array(F.lit("n/a")))
    files = grouped.select(F.to_json(F.struct("model_name", texts.alias("reconstruction_errors"))).alias("value"))
    return readers.calibration_values(files)


# --- models ----------------------------------------------------------------------------------

VECTOR = f"vec AS (SELECT kafka_offset, {FEATURE_SQL} FROM parsed WHERE json_type(j) = 'OBJECT')"
MEAN = "(" + " + ".join(MODEL_FEATURES) + ") / 10"


def _vectors(t):
    parsed = records.model_record(t.tx_payload).filter(F.col("record").isNotNull())
    return records.model_features(parsed.select("kafka_offset", "record"))


@query("vector_score", f"SELECT kafka_offset, round(1 / (1 + exp(-{MEAN})), 6) AS model_score, 1 / (1 + exp(-{MEAN})) >= 0.5 AS is_anomaly FROM vec", PARSED_CTE, VECTOR)
def _(t):
    scored = models.vector_score(_vectors(t), MODEL_FEATURES)
    return scored.select("kafka_offset", F.round("model_score", 6).alias("model_score"), "is_anomaly")


WEIGHTS = {"amount": 0.001, "velocity_count": -2.0, "hour_of_day": 0.5}
RANKED_SQL = " UNION ALL ".join(
    f"SELECT kafka_offset, '{n}' AS feature, {i} AS pos, {n} * {WEIGHTS.get(n, 1.0)} AS c FROM vec" for i, n in enumerate(MODEL_FEATURES)
)


@query("explain_linear", "SELECT kafka_offset, CAST(row_number() OVER w AS INTEGER) AS place, feature, round(c, 4) + 0.0 AS contribution FROM r WINDOW w AS (PARTITION BY kafka_offset ORDER BY abs(c) DESC, pos) QUALIFY row_number() OVER w <= 5", PARSED_CTE, VECTOR, f"r AS ({RANKED_SQL})")
def _(t):
    return models.explain_linear(_vectors(t), "kafka_offset", MODEL_FEATURES, WEIGHTS, 5).select("kafka_offset", "place", "feature", "contribution")


@query("iforest_score")
def _(t):
    vectors = records.anomaly_row(_vectors(t))
    names = ["amount_log", *MODEL_FEATURES[1:]]
    forest = models.fit_forest(vectors, "kafka_offset", names)
    scored = cut_lineage(models.forest_score(vectors, forest, names))  # scored once, read for the cut-off and the decision
    offset = scored.agg(F.percentile_approx("isolation", 0.95, 10_000)).scalar()
    return models.forest_decision(scored, offset).select("kafka_offset", "anomaly_score", "anomaly_raw", "is_anomaly")


FEATURE_CASE = "CASE prefix " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in models.RULE_FEATURES.items()) + " ELSE lower(prefix) END"
REASONS = (
    """raw AS (SELECT id, unnest(fs) AS f, unnest(range(1, len(fs) + 1)) AS pos FROM (SELECT id, from_json(factors, '["VARCHAR"]') AS fs FROM {scores}) s)""",
    """p1 AS (SELECT *, split_part(f, ':', 1) AS prefix, coalesce(TRY_CAST(nullif(regexp_extract(f, '\\(\\s*\\+?(-?\\d+(?:\\.\\d+)?)\\s*\\)\\s*$', 1), '') AS DOUBLE), 0) AS c0 FROM raw)""",
    f"p2 AS (SELECT *, {FEATURE_CASE} AS feature FROM p1)",
    "p3 AS (SELECT *, CASE WHEN c0 = 0 AND pos = min(pos) OVER (PARTITION BY id, feature) AND feature = 'cop_verification' THEN 25.0 ELSE c0 END AS c FROM p2)",
    "p4 AS (SELECT * FROM p3 QUALIFY row_number() OVER (PARTITION BY id, feature ORDER BY abs(c) DESC, pos) = 1)",
    "codes AS (SELECT id, string_agg(feature || '=' || CAST(CAST(c AS DECIMAL(10,1)) AS VARCHAR), ',' ORDER BY abs(c) DESC, pos) AS codes FROM p4 GROUP BY id)",
)


def _codes(t):
    breakdown = F.create_map(F.lit("cop"), F.lit(25.0))
    return t.scores.select("id", models.reason_codes(F.from_json("factors", "ARRAY<STRING>"), breakdown).alias("codes"))


def _spelled(codes):
    return F.array_join(F.transform(codes, lambda r: F.concat(r["feature"], F.lit("="), r["contribution"].cast("decimal(10,1)").cast("string"))), ",")


@query("reason_codes", "SELECT id, codes FROM codes", *REASONS)
def _(t):
    return _codes(t).select("id", _spelled(F.col("codes")).alias("codes"))


@query("reason_merge", "SELECT id, 'velocity_2min=9.0' || CASE WHEN rest IS NULL THEN '' ELSE ',' || rest END AS codes FROM {scores} LEFT JOIN (SELECT id, string_agg(feature || '=' || CAST(CAST(c AS DECIMAL(10,1)) AS VARCHAR), ',' ORDER BY abs(c) DESC, pos) AS rest FROM p4 WHERE feature <> 'velocity_2min' GROUP BY id) r USING (id)", *REASONS)
def _(t):
    model = F.array(F.struct(F.lit("velocity_2min").alias("feature"), F.lit(9.0).alias("contribution"), F.lit("model").alias("source"), F.lit("m").alias("description")))
    return _codes(t).select("id", _spelled(models.merge_reasons(model, F.col("codes"))).alias("codes"))


BUCKET = "CAST(CAST('0x' || substr(sha256('s1|' || {0}), 1, 16) AS UBIGINT) % 100 AS INTEGER)"


@query("canary_bucket", "SELECT DISTINCT sender_id, " + BUCKET.format("sender_id") + " AS bucket FROM {tx}")
def _(t):
    return t.tx.select("sender_id").distinct().select("sender_id", models.canary_bucket(F.col("sender_id"), "s1").alias("bucket"))


@query("hybrid_escalate", f"""SELECT external_id, CASE WHEN up THEN 'HIGH' ELSE {LEVEL_SQL} END AS risk_level, CASE WHEN up THEN 'SUSPEND' ELSE {ACTION_SQL} END AS action, up AS escalated, round(CASE WHEN looked THEN p ELSE 0 END, 4)::DOUBLE AS model_probability, bucket AS canary_bucket
   FROM (SELECT *, looked AND p >= 0.85 AS up FROM (SELECT *, bucket < 60 AND risk_score >= 25 AND risk_score < 50 AS looked, greatest(s / 100, (s * 7 % 101) / 100.0) AS p FROM (
     SELECT scored.*, least(CAST(substr(external_id, 2) AS BIGINT) % 101, 100) AS s, {BUCKET.format('sender_id')} AS bucket FROM scored) a) b) c""", *SCORED)
def _(t):
    from fraudspark.functions.bands import risk_action, risk_level
    s = F.least(F.substring("external_id", 2, 20).cast("long") % 101, F.lit(100))
    scored = (
        scoring.score_transactions(t.tx).withColumn("risk_level", risk_level(F.col("risk_score"))).withColumn("action", risk_action(F.col("risk_score")))
        .withColumn("factors", F.array(F.lit("AMOUNT:1(+10.0)"))).withColumn("anomaly_score", s.cast("double")).withColumn("graph_score", (s * 7 % 101) / 100)
    )
    return models.escalate(scored, "canary", percent=60, salt="s1").select("external_id", "risk_level", "action", "escalated", "model_probability", "canary_bucket")


@query("feature_latest", """SELECT feature_key, feature_value, put_at FROM (SELECT *, 'features:' || replace(scope, ':', '_') || ':' || entity_id || ':' || feature_window AS feature_key FROM {features}) f
   WHERE (SELECT max(put_at) FROM {features}) < put_at + to_seconds(ttl_seconds) QUALIFY row_number() OVER (PARTITION BY feature_key ORDER BY put_at DESC, event_id DESC) = 1""")
def _(t):
    rows = t.features
    return features.latest_features(rows, rows.agg(F.max("put_at")).scalar()).select("feature_key", "feature_value", "put_at")


LOCAL_IDS = "SELECT DISTINCT e AS query_id, lower(e) AS text FROM (SELECT sender_id AS e FROM {tx} UNION SELECT receiver_id FROM {tx}) u"
KEYWORDS = "|".join(scoring.LOCAL_KEYWORDS)


@query("local_score", f"""SELECT external_id, round(risk_score, 2) AS risk_score, {LEVEL_SQL} AS risk_level, {ACTION_SQL} AS recommended_action FROM (SELECT external_id, least(100.0,
     CASE WHEN a > 50000 THEN least(35.0, (a - 50000) / 50000 * 35) WHEN a < 1 THEN 15.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(t.sender_id || t.receiver_id), '{KEYWORDS}') THEN 10 ELSE 0 END
     + coalesce(least(40.0, s1.similarity * 40), 0) + coalesce(least(40.0, s2.similarity * 40), 0) + CASE WHEN n > 5 THEN least(40.0, n * 4.0) ELSE 0 END)::DOUBLE AS risk_score
   FROM (SELECT *, amount::DOUBLE AS a FROM {{tx}}) t LEFT JOIN hits s1 ON s1.query_id = t.sender_id AND s1.match_rank = 1 LEFT JOIN hits s2 ON s2.query_id = t.receiver_id AND s2.match_rank = 1
   LEFT JOIN (SELECT sender_id, count(*) AS n FROM {{tx}} WHERE event_time > (SELECT max(event_time) FROM {{tx}}) - INTERVAL '2 minutes' GROUP BY sender_id) r ON r.sender_id = t.sender_id) x""", *_similar(LOCAL_IDS, 0.6, 3))
def _(t):
    tx = t.tx
    ids = tx.select(F.col("sender_id").alias("entity")).union(tx.select("receiver_id")).distinct()
    matches = screening.screen_entities(ids, t.entity_names, 0.6).select(F.col("entity_name").alias("entity_id"), "similarity")
    scored = scoring.local_score(tx, matches, tx.agg(F.max("event_time")).scalar())
    return scored.select("external_id", F.round("risk_score", 2).alias("risk_score"), "risk_level", "recommended_action")


# --- feeds -----------------------------------------------------------------------------------


@query("src_rules", "SELECT rule_id, rule_name, field, operator, value, action, risk_score_adjustment, severity, active, created_by, version + 1 AS version FROM {rule_table}")
def _(t):
    table = t.rule_table.withColumn("version", F.explode(F.array(F.col("version"), F.col("version") + 1)))
    message = F.struct(
        "rule_id", "rule_name", F.struct("field", "operator", "value").alias("condition"), "action", "risk_score_adjustment", "severity", "active", "created_by", "version"
    )
    values = table.select(F.to_json(message).alias("value"))
    noise = t.rule_table.select(F.concat(F.lit("not json "), "rule_name").alias("value")).union(t.rule_table.select(F.lit('{"rule_name": "no id"}').alias("value")))
    latest = rules.latest_versions(readers.rule_messages(values.union(noise)))
    return latest.select(
        "rule_id", "rule_name", "condition.field", "condition.operator", "condition.value", "action", "risk_score_adjustment", "severity", "active", "created_by", "version"
    )


@query("src_watchlist", "SELECT id, schema_type AS schema, caption, dataset AS datasets, name FROM {entities}")
def _(t):
    from fraudspark.plans.watch import _feed
    entities = _feed(t)
    lines = entities.select(F.to_json(F.struct(*entities.columns)).alias("value"))
    noise = t.entities.select(F.explode(F.array(F.lit("  "), F.concat(F.lit('{"id": "broken'), "id"))).alias("value"))
    feed = readers.watchlist_lines(lines.union(noise))
    return feed.select("id", "schema", "caption", F.array_join("datasets", ",").alias("datasets"), F.col("properties.name")[0].alias("name"))


@query("debug_either_key", """SELECT t.id AS parent_id, e.rule_name FROM (SELECT CASE WHEN status = 'BLOCKED' THEN id ELSE external_id END AS transaction_id, 'rule_' || lower(status) AS rule_name FROM {otx} WHERE status IN ('BLOCKED', 'SUSPENDED')) e
   JOIN {otx} t ON e.transaction_id = t.id OR e.transaction_id = t.external_id""")
def _(t):
    from fraudspark.plans.cases import _executions
    return investigate.by_either_key(_executions(t), t.otx).select("parent_id", "rule_name")
