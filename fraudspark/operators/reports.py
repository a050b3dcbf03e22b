"""Reports, dashboards and regulatory filings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.operators.skew import first_n

# Hours an open alert may wait, by severity.
SLA_HOURS = {"CRITICAL": 1, "HIGH": 4, "MEDIUM": 24, "LOW": 72}

# Allowed status changes of a filing.
FILING_TRANSITIONS = {
    "DRAFT": ["PENDING_REVIEW", "REJECTED"],
    "PENDING_REVIEW": ["APPROVED", "REJECTED", "DRAFT"],
    "APPROVED": ["FILED", "REJECTED"],
    "FILED": [],
    "REJECTED": ["DRAFT"],
}

# Form type of each filing format.
FORM_TYPES = {"FinCEN_BSA": "FinCEN SAR", "FCA_UK": "FCA STR", "BaFin_DE": "BaFin Verdachtsmeldung"}
FIRM = "Example Fintech Ltd"


def since(column: str, as_of: Column, hours: int) -> Column:
    return F.col(column) > as_of - F.expr(f"INTERVAL '{hours}' HOUR")


def _choice(column: Column, values: Mapping[str, Column | str | int]) -> Column:
    chain = None
    for key, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(column == key, value) if chain is None else chain.when(column == key, value)
    return chain


def section_counts(df: DataFrame, section: str, key: str) -> DataFrame:
    """(section, key, n); a null key counts as unknown."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key")).agg(
        F.count("*").cast("double").alias("n")
    ).select(F.lit(section).alias("section"), "key", "n")


def daily_report(
    tx: DataFrame, scores: DataFrame, alerts: DataFrame, filings: DataFrame, rules: DataFrame, executions: DataFrame,
    as_of: Column, hours: int = 24,
) -> DataFrame:
    """All figures of the daily compliance report as (section, key, n)."""
    recent = tx.filter(since("created_at", as_of, hours))
    totals = recent.agg(
        F.count("*").cast("double").alias("total"),
        F.count_if(F.col("status") == "BLOCKED").cast("double").alias("blocked"),
        F.count_if(F.col("status") == "SUSPENDED").cast("double").alias("suspended"),
        F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("total_volume"),
        F.coalesce(F.avg(F.col("amount").cast("double")), F.lit(0.0)).alias("avg_amount"),
    )
    tx_part = totals.unpivot([], totals.columns, "key", "n").select(F.lit("transactions").alias("section"), "key", "n")
    rule_part = rules.agg(F.count_if("active").cast("double").alias("n")).select(
        F.lit("detection_rules").alias("section"), F.lit("active").alias("key"), "n"
    )
    hits = executions.filter(since("created_at", as_of, hours)).agg(F.count("*").cast("double").alias("n")).select(
        F.lit("detection_rules").alias("section"), F.lit("matches").alias("key"), "n"
    )
    return (
        tx_part.unionByName(section_counts(scores.filter(since("scored_at", as_of, hours)), "risk_distribution", "risk_level"))
        .unionByName(section_counts(alerts, "alerts", "status"))
        .unionByName(section_counts(filings, "sar_filings", "status"))
        .unionByName(rule_part).unionByName(hits)
    )


def dashboard_stats(tx: DataFrame, scores: DataFrame, alerts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Dashboard figures as (name, value): one conditional aggregate per table."""
    recent = tx.filter(since("created_at", as_of, hours)).agg(
        F.count("*").cast("double").alias("total"), F.count_if(F.col("status") == "BLOCKED").cast("double").alias("blocked"),
        (F.count("*") / F.lit(hours * 60.0)).alias("per_minute"),
    )
    opened = F.col("status") == "OPEN"
    alert_part = alerts.agg(
        F.count_if(opened).cast("double").alias("open_alerts"),
        F.count_if(opened & (F.col("severity") == "CRITICAL")).cast("double").alias("critical_alerts"),
    )
    risk = scores.filter(since("scored_at", as_of, hours)).agg(
        F.coalesce(F.avg(F.col("risk_score").cast("double")), F.lit(0.0)).alias("avg_risk")
    )
    flat = lambda df: df.unpivot([], df.columns, "name", "value")
    return flat(recent).unionByName(flat(alert_part)).unionByName(flat(risk))


def reporting_stats(filings: DataFrame) -> DataFrame:
    total = filings.agg(F.count("*").cast("double").alias("n")).select(F.lit("total").alias("section"), F.lit("").alias("key"), "n")
    parts = [section_counts(filings, f"by_{name}", column) for name, column in
             (("status", "status"), ("format", "filing_format"), ("type", "filing_type"))]
    return total.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])


def stale_alerts(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Open alerts older than the limit of their severity, with that limit and the age in hours."""
    limit = _choice(F.col("severity"), SLA_HOURS)
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3_600_000_000
    return (
        alerts.filter(F.col("status") == "OPEN").withColumn("sla_hours", limit).withColumn("age_hours", age)
        .filter(F.col("age_hours") > F.col("sla_hours"))
        .select("id", "title", "severity", "sla_hours", "age_hours")
    )


def sar_drafts(alerts: DataFrame, filing_format: Column, generated_at: Column) -> DataFrame:
    """Draft filing of each alert; ``structured_data`` holds the empty sections of its format as JSON."""
    empty = F.struct()
    institution = F.struct(F.lit(FIRM).alias("filing_institution"), F.lit("").alias("ein"))
    base = [F.col("id").alias("alert_reference"), generated_at.cast("string").alias("generated_at")]
    form = lambda name: F.lit(FORM_TYPES[name]).alias("form_type")
    shapes = {
        "FinCEN_BSA": F.struct(
            *base, form("FinCEN_BSA"), institution.alias("part_i"),
            F.struct(empty.alias("subject"), empty.alias("address")).alias("part_ii"),
            F.struct(empty.alias("suspicious_activity")).alias("part_iii"),
            F.struct(empty.alias("financial_institution")).alias("part_iv"), F.struct(F.lit("").alias("narrative")).alias("part_v"),
        ),
        "FCA_UK": F.struct(
            *base, form("FCA_UK"), F.struct(F.lit(FIRM).alias("firm_name"), F.lit("").alias("frn")).alias("reporter"),
            empty.alias("subject"), empty.alias("activity"),
        ),
        "BaFin_DE": F.struct(
            *base, form("BaFin_DE"), F.struct(F.lit(FIRM).alias("name")).alias("melder"),
            empty.alias("verdaechtige_person"), empty.alias("transaktion"),
        ),
    }
    structured = F.coalesce(
        _choice(F.col("filing_format"), {k: F.to_json(v) for k, v in shapes.items()}), F.to_json(F.struct(*base))
    )
    return alerts.withColumn("filing_format", filing_format).select(
        F.concat(F.lit("SAR-"), F.substring(F.sha2(F.concat_ws("|", "id", "filing_format"), 256), 1, 16)).alias("id"),
        F.col("id").alias("alert_id"), F.lit("SAR").alias("filing_type"), "filing_format", F.lit("DRAFT").alias("status"),
        structured.alias("structured_data"), generated_at.alias("created_at"),
    )


def sar_exports(filings: DataFrame) -> DataFrame:
    """Export of each filing in the shape of its format; other formats are left out."""
    text = lambda c: F.coalesce(c, F.lit(""))
    bsa = F.struct(
        F.struct(
            F.struct(
                F.col("alert_id").alias("AlertRef"), F.col("subject_name").alias("Subject"), text(F.col("narrative")).alias("Narrative")
            ).alias("Activity"),
            F.col("filed_at").cast("string").alias("FilingDate"), F.col("status").alias("Status"),
        ).alias("BSAReport")
    )
    fca = F.struct(
        F.lit("STR").alias("report_type"), F.lit(FIRM).alias("firm"), F.col("subject_name").alias("subject"),
        text(F.col("narrative")).alias("narrative"), F.col("status"),
    )
    bafin = F.struct(
        F.struct(
            F.lit(FIRM).alias("Melder"), F.col("subject_name").alias("Betreff"), text(F.col("narrative")).alias("Beschreibung"),
            F.col("status").alias("Status"),
        ).alias("Verdachtsmeldung")
    )
    fmt = F.col("filing_format")
    return filings.select(
        "id", "filing_format",
        _choice(fmt, {"FinCEN_BSA": "FinCEN_BSA_XML", "FCA_UK": "FCA_UK_CSV", "BaFin_DE": "BaFin_DE_XML"}).alias("format"),
        _choice(fmt, {"FinCEN_BSA": "application/xml", "FCA_UK": "text/csv", "BaFin_DE": "application/xml"}).alias("content_type"),
        _choice(fmt, {"FinCEN_BSA": F.to_json(bsa), "FCA_UK": F.to_json(fca), "BaFin_DE": F.to_json(bafin)}).alias("data"),
    ).filter(F.col("format").isNotNull())


def apply_status_changes(filings: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """One row per request: the outcome and the filing after it. ``requests``: id, new_status, narrative."""
    allowed = F.create_map(
        *[x for k, v in FILING_TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]
    )
    asked = requests.select(
        "id", "new_status", F.col("narrative").alias("new_narrative")
    )
    joined = asked.join(filings, "id", "left")
    ok = F.col("new_status").isNull() | F.coalesce(
        F.array_contains(F.coalesce(allowed[F.col("status")], F.array().cast("array<string>")), F.col("new_status")), F.lit(False)
    )
    outcome = F.when(F.col("status").isNull(), "not_found").when(ok, "updated").otherwise("rejected")
    done = F.col("outcome") == "updated"
    return joined.withColumn("outcome", outcome).select(
        "id", "new_status", "outcome",
        F.when(done & F.col("new_status").isNotNull(), F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.when(done & F.col("new_narrative").isNotNull(), F.col("new_narrative")).otherwise(F.col("narrative")).alias("narrative"),
        F.when(done & (F.col("new_status") == "FILED"), now).otherwise(F.col("filed_at")).alias("filed_at"),
    )


def alert_chain(alerts: DataFrame, tx: DataFrame, scores: DataFrame) -> DataFrame:
    """Alert with its payment and its score, where they exist."""
    payment = tx.select(
        F.col("id").alias("transaction_id"), "sender_id", "receiver_id", "amount", "currency", "transaction_type",
        "sender_iban", "receiver_iban", F.col("created_at").alias("tx_time"),
    )
    score = scores.select(
        F.col("id").alias("risk_score_id"), "risk_score", "risk_level", F.col("factors").alias("risk_factors"),
        "velocity_score", "sanctions_score", "pattern_score",
    )
    return alerts.join(payment, "transaction_id", "left").join(score, "risk_score_id", "left")


def sar_packages(alerts: DataFrame, tx: DataFrame, scores: DataFrame, related: int = 20) -> DataFrame:
    """Report package of every alert: subject, activity, counterparty, newest related payments, narrative seed.

    ``related_count`` and the narrative speak of the payments shown, at most ``related``; ``related_total`` counts all.
    """
    newest = first_n(tx, ["sender_id"], [F.desc("created_at"), F.col("id")], related)
    item = F.struct("rn", "id", "external_id", "receiver_id", "amount", "currency", "transaction_type", "created_at")
    per_sender = newest.groupBy("sender_id").agg(F.array_sort(F.collect_list(item)).alias("related_transactions"))
    totals = tx.groupBy("sender_id").agg(F.count("*").alias("related_total"))
    joined = alert_chain(alerts, tx, scores).join(per_sender, "sender_id", "left").join(totals, "sender_id", "left")
    count = F.greatest(F.coalesce(F.size("related_transactions"), F.lit(0)), F.lit(0))
    narrative = F.format_string(
        "Subject %s sent %s %s to %s. Risk score: %s (%s). Alert: %s. %s There are %d related transactions from this sender.",
        F.col("sender_id"), F.col("currency"), F.col("amount").cast("string"), F.col("receiver_id"),
        F.col("risk_score").cast("string"), F.col("risk_level"), F.col("title"), F.coalesce("description", F.lit("")), count,
    )
    return joined.select(
        F.col("id").alias("alert_reference"), F.lit("SAR").alias("report_type"), F.lit("FinCEN_BSA").alias("filing_format"),
        F.struct(F.col("sender_id").alias("name"), F.col("sender_iban").alias("account_iban")).alias("subject"),
        F.struct(
            F.col("tx_time").alias("date"), "amount", "currency", F.col("transaction_type").alias("type"), "risk_score", "risk_level", "risk_factors"
        ).alias("suspicious_activity"),
        F.struct(F.col("receiver_id").alias("name"), F.col("receiver_iban").alias("account_iban")).alias("counterparty"),
        "related_transactions", count.alias("related_count"), F.coalesce("related_total", F.lit(0)).cast("long").alias("related_total"), narrative.alias("narrative_prompt"),
    )
