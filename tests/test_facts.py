"""Facts the operators must keep: thresholds, truth tables, distributions, small examples."""

import hashlib
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fraudspark.functions import bands
from fraudspark.functions.net import is_ipv4, is_ipv6, is_private
from fraudspark.operators import graph, maintenance, models, monitor, records, reports, rules
from fraudspark.operators.enrich import card, combine, device, email, ip, phone


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("score, level, action", [
    (0, "LOW", "ALLOW"), (24.99, "LOW", "ALLOW"), (25, "MEDIUM", "FLAG"), (50, "HIGH", "SUSPEND"), (75, "CRITICAL", "BLOCK"), (100, "CRITICAL", "BLOCK"),
])
def test_bands(spark, score, level, action):
    row = spark.range(1).select(bands.risk_level(F.lit(score)), bands.risk_action(F.lit(score))).first()
    assert tuple(row) == (level, action)


def test_amount_bands_are_exclusive_or_inclusive(spark):
    row = spark.range(1).select(bands.amount_score(F.lit(50000)), bands.amount_score(F.lit(50000), inclusive=True)).first()
    assert tuple(row) == (20.0, 35.0)


# --- escalation gate -------------------------------------------------------------------------


def gate(spark, mode="hybrid", score=30.0, level="MEDIUM", factors=("A:1(+30.0)",), anomaly=90.0, graph_score=0.0, sender="user-1", **kw):
    df = spark.createDataFrame(
        [(score, level, "FLAG", list(factors), sender, anomaly, graph_score)],
        "risk_score DOUBLE, risk_level STRING, action STRING, factors ARRAY<STRING>, sender_id STRING, anomaly_score DOUBLE, graph_score DOUBLE",
    )
    return one(models.escalate(df, mode, **kw))


@pytest.mark.parametrize("change, escalated", [
    ({}, True), ({"mode": "off"}, False), ({"mode": "shadow"}, False), ({"mode": "autonomous"}, False), ({"anomaly": 84.9}, False),
    ({"anomaly": 0.0, "graph_score": 0.85}, True), ({"score": 24.0}, False), ({"score": 50.0}, False), ({"level": "HIGH"}, False),
    ({"factors": ()}, False), ({"anomaly": 500.0}, True), ({"mode": "canary", "percent": 100}, True), ({"mode": "canary", "percent": 0}, False),
    ({"mode": "canary", "percent": 100, "sender": ""}, False),
])
def test_escalation_truth_table(spark, change, escalated):
    row = gate(spark, **change)
    assert row["escalated"] is escalated
    assert (row["risk_level"], row["action"]) == (("HIGH", "SUSPEND") if escalated else (change.get("level", "MEDIUM"), "FLAG"))
    assert row["risk_score"] == change.get("score", 30.0)


def test_canary_buckets(spark):
    ids = [f"user-{i}" for i in range(10_000)]
    df = spark.createDataFrame([(i,) for i in ids], "id STRING").withColumn("b", models.canary_bucket(F.col("id")))
    buckets = {r["id"]: r["b"] for r in df.collect()}
    want = lambda s: int.from_bytes(hashlib.sha256(f"|{s}".encode()).digest()[:8], "big") % 100
    assert all(buckets[i] == want(i) for i in ids[:200])
    counts = [list(buckets.values()).count(b) for b in range(100)]
    assert min(counts) >= 60 and max(counts) <= 140
    assert 400 <= sum(b < 5 for b in buckets.values()) <= 600
    assert spark.range(1).select(models.canary_bucket(F.lit(""))).first()[0] == 100


# --- reason codes ----------------------------------------------------------------------------


def codes(spark, factors, breakdown=None):
    df = spark.createDataFrame([(factors,)], "f ARRAY<STRING>")
    mapped = F.create_map(*[F.lit(x) for kv in breakdown.items() for x in kv]) if breakdown else None
    return [(r["feature"], r["contribution"], r["description"]) for r in df.select(models.reason_codes(F.col("f"), mapped).alias("r")).first()["r"]]


def test_reason_codes_sort_and_parse(spark):
    got = codes(spark, ["VELOCITY:5txns/2min(+25.0)", "AMOUNT:60000.00(+35.0)", "NEW_RULE:x(-40.5)", "odd text"])
    assert got[0] == ("new_rule", -40.5, "x")
    assert got[1] == ("amount_threshold", 35.0, "60000.00")
    assert got[2] == ("velocity_2min", 25.0, "5txns/2min")
    assert got[3][:2] == ("odd text", 0.0)


def test_reason_codes_keep_the_larger_duplicate_and_fill_from_breakdown(spark):
    assert codes(spark, ["COP:A(+5.0)", "COP:B(+25.0)"]) == [("cop_verification", 25.0, "B")]
    assert codes(spark, ["COP:ANNM"], {"cop": 12.0}) == [("cop_verification", 12.0, "ANNM")]


# --- drift -----------------------------------------------------------------------------------


def values(spark, numbers):
    return spark.createDataFrame([("m", float(n)) for n in numbers], "model_name STRING, score DOUBLE")


def direct_psi(baseline, recent, bins=10):
    s, n = sorted(baseline), len(baseline)
    edges = []
    for e in [s[0], *[s[math.floor(i * n / bins)] for i in range(1, bins)], s[-1]]:
        if not edges or e > edges[-1]:
            edges.append(e)
    if len(edges) < 2:
        edges.append(edges[0] + 1e-9)
    def shares(v):
        c = [0] * (len(edges) - 1)
        for x in v:
            c[min(max(sum(e <= x for e in edges) - 1, 0), len(c) - 1)] += 1
        return [k / len(v) for k in c]
    return sum((max(r, 1e-6) - max(b, 1e-6)) * math.log(max(r, 1e-6) / max(b, 1e-6)) for b, r in zip(shares(baseline), shares(recent)))


@pytest.mark.parametrize("mean, spread, low, high", [(0.5, 0.1, 0.0, 0.1), (0.55, 0.1, 0.1, 1.0), (0.9, 0.2, 0.25, 50.0)])
def test_psi_grows_with_the_shift(spark, mean, spread, low, high):
    rng = random.Random(7)
    baseline, recent = [rng.gauss(0.5, 0.1) for _ in range(2000)], [rng.gauss(mean, spread) for _ in range(1500)]
    row = one(monitor.drift_report(values(spark, baseline), values(spark, recent)))
    assert row["psi"] == pytest.approx(direct_psi(baseline, recent), abs=1e-5)
    assert low <= row["psi"] <= high
    assert row["status"] == ("alert" if row["psi"] >= 0.2 else "monitor" if row["psi"] >= 0.1 else "stable")


def test_psi_with_ties_and_missing_sample(spark):
    tied = [0.0] * 95 + [1.0] * 5
    assert one(monitor.drift_report(values(spark, tied), values(spark, tied)))["psi"] == 0.0
    constant = [0.3] * 50
    assert one(monitor.drift_report(values(spark, constant), values(spark, constant)))["psi"] == 0.0
    assert one(monitor.drift_report(values(spark, tied), values(spark, tied).limit(0)))["status"] == "unavailable"


def test_values_at_ranks_are_exact(spark):
    rng = random.Random(9)
    numbers = [round(rng.lognormvariate(0, 2), 3) for _ in range(3000)]
    ranks = spark.createDataFrame([("m", r) for r in (0, 1, 57, 1500, 2998, 2999)], "model_name STRING, rank LONG")
    got = {r["rank"]: r["score"] for r in monitor.values_at_ranks(values(spark, numbers), ranks, "model_name", "score", pieces=16).collect()}
    assert got == {r: sorted(numbers)[r] for r in got} and len(got) == 6


def test_percentile_counts_smaller_errors_or_falls_back(spark):
    calibration = values(spark, [1, 2, 2, 3])
    errors = spark.createDataFrame([("a", "m", 2.0), ("b", "m", 0.5), ("c", "m", 9.0), ("d", "none", 1.0)], "id STRING, model_name STRING, score DOUBLE")
    got = {r["id"]: (r["percentile"], r["is_anomaly"]) for r in monitor.percentiles(errors, calibration, pieces=3).collect()}
    assert got == {"a": (0.25, False), "b": (0.0, False), "c": (1.0, True), "d": (0.5, False)}


def test_factor_advice(spark):
    rows = [("few", "TP")] * 19 + [("bad", "FP")] * 15 + [("bad", "TP")] * 5 + [("good", "TP")] * 19 + [("good", "FP")] + [("mid", "TP")] * 10 + [("mid", "FP")] * 10
    stats = monitor.factor_precision(spark.createDataFrame(rows, "factor STRING, disposition STRING"))
    assert {r["factor"]: r["suggestion"] for r in stats.collect()} == {"few": "insufficient_data", "bad": "loosen", "good": "tighten", "mid": "hold"}


# --- graph -----------------------------------------------------------------------------------


def payments(spark, rows):
    return spark.createDataFrame(
        [(s, r, float(a), "GBP", 0.0, datetime(2024, 1, 1)) for s, r, a in rows],
        "sender_id STRING, receiver_id STRING, amount DOUBLE, currency STRING, risk_score DOUBLE, event_time TIMESTAMP_NTZ",
    )


def test_bridge_example(spark):
    tx = payments(spark, [("a", "x", 1), ("b", "x", 1), ("c", "x", 1), ("x", "d", 100), ("x", "e", 200)])
    row = one(graph.graph_features(tx, F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")).filter("entity = 'x'"))
    assert (row["graph_1hop_degree"], row["graph_1hop_amount_sum"], row["graph_1hop_amount_max"], row["graph_is_bridge"]) == (5.0, 300.0, 200.0, 1.0)
    assert row["graph_in_out_ratio"] == 1.5


def test_components_on_a_long_path_and_a_star(spark):
    path = [(f"p{i:03d}", f"p{i + 1:03d}", 1) for i in range(120)]
    star = [("hub", f"s{i:03d}", 1) for i in range(200)]
    labels = graph.component_labels(payments(spark, path + star + [("alone", "alone", 1)]))
    sizes = {r["component"]: r["count"] for r in labels.groupBy("component").count().collect()}
    assert sizes == {"p000": 121, "hub": 201, "alone": 1}
    summary = {r["component"]: (r["size"], r["tx_count"]) for r in graph.communities(payments(spark, path + star), labels).collect()}
    assert summary == {"p000": (121, 120), "hub": (201, 200)}


def test_khop_stops_at_depth(spark):
    edges = graph.edge_aggregate(payments(spark, [(f"n{i}", f"n{i + 1}", 1) for i in range(6)]))
    nodes, touching = graph.khop_network(edges, spark.createDataFrame([("n0",)], "root STRING"), depth=2)
    assert {(r["node"], r["distance"]) for r in nodes.collect()} == {("n0", 0), ("n1", 1), ("n2", 2), ("n3", 3)}
    assert {(r["sender_id"], r["receiver_id"]) for r in touching.collect()} == {("n0", "n1"), ("n1", "n2"), ("n2", "n3")}


# --- rules -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rule_frames(spark):
    tx = spark.createDataFrame(
        [(f"e{i}", f"u{i % 7}", f"m{i % 3}", float(i * 100), "GBP" if i % 2 else "EUR", "WIRE" if i % 5 else "TRANSFER", "OK") for i in range(200)],
        "external_id STRING, sender_id STRING, receiver_id STRING, amount DOUBLE, currency STRING, transaction_type STRING, status STRING",
    )
    rng = random.Random(11)
    conditions = []
    for i in range(40):
        for _ in range(rng.randint(1, 3)):
            conditions.append((f"rule{i:02d}", len(conditions), *rng.choice([
                ("amount", "gt", str(rng.randint(0, 20000))), ("amount", "lt", "abc"), ("sender_id", "eq", f"u{rng.randint(0, 8)}"),
                ("currency", "eq", "GBP"), ("transaction_type", "contains", "wir"), ("receiver_id", "in", "m1, m2"), ("status", "neq", "OK"), ("nothing", "eq", "1"),
            ])))
    rows = spark.createDataFrame(conditions, "rule_name STRING, pos INT, field STRING, operator STRING, value STRING")
    return tx, rows, conditions


def holds(tx, field, operator, value):
    actual = tx.get(field)
    if actual is None:
        return False
    if operator in ("gt", "lt"):
        try:
            return float(actual) > float(value) if operator == "gt" else float(actual) < float(value)
        except ValueError:
            return False
    return {
        "eq": str(actual) == value, "neq": str(actual) != value, "contains": value.lower() in str(actual).lower(),
        "in": str(actual) in [v.strip() for v in value.split(",")],
    }[operator]


@pytest.mark.parametrize("logic", ["AND", "OR"])
@pytest.mark.parametrize("piece_limit", [5000, 7])
def test_rule_matching_equals_the_loop(rule_frames, logic, piece_limit):
    tx, rows, conditions = rule_frames
    grouped = rules.collect_conditions(rows, ["rule_name"], "pos", logic)
    pairs = rules.match_rules(tx, grouped, rules.nightly_condition, piece_limit).select("external_id", "rule.rule_name")
    got = sorted(map(tuple, pairs.collect()))
    combine_all = all if logic == "AND" else any
    names = sorted({c[0] for c in conditions})
    want = sorted(
        (t["external_id"], n) for t in (r.asDict() for r in tx.collect()) for n in names
        if combine_all(holds(t, *c[2:]) for c in conditions if c[0] == n)
    )
    assert got == want


def test_backtest_without_valid_condition_matches_nothing(rule_frames):
    tx, _, _ = rule_frames
    flagged = rules.backtest(tx.withColumn("id", F.col("external_id")), tx, tx, tx, [{"field": "no", "operator": "eq", "value": "1"}])
    assert flagged.filter("is_match").count() == 0


def test_backtest_joins_only_what_is_named(rule_frames):
    tx, _, _ = rule_frames
    flagged = rules.backtest(tx.withColumn("id", F.col("external_id")), None, None, None, [{"field": "amount", "operator": "gt", "value": "100"}])
    assert "Join" not in flagged._jdf.queryExecution().optimizedPlan().toString()


# --- enrichment ------------------------------------------------------------------------------


@pytest.mark.parametrize("text, v4, v6, private", [
    ("8.8.8.8", True, False, False), ("10.1.2.3", True, False, True), ("172.32.0.1", True, False, False), ("172.31.0.1", True, False, True),
    ("127.0.0.1", True, False, True), ("256.1.1.1", False, False, False), ("01.2.3.4", False, False, False), ("1.2.3", False, False, False),
    ("::1", False, True, True), ("2001:db8::5", False, True, True), ("2a00:1450::8", False, True, False), ("fe80::1", False, True, True),
    ("1::2::3", False, False, False), (":1:2", False, False, False), ("::ffff:1.2.3.4", False, True, True), ("abc", False, False, False),
    ("1:2:3:4:5:6:7:8", False, True, False), ("1:2:3:4:5:6:7", False, False, False),
])
def test_addresses(spark, text, v4, v6, private):
    c = F.lit(text)
    assert tuple(spark.range(1).select(is_ipv4(c), is_ipv6(c), is_private(c)).first()) == (v4, v6, private)


def test_longest_network_wins(spark):
    nets = spark.createDataFrame([("vpn", "60.0.0.0/8"), ("vpn", "60.1.0.0/16"), ("vpn", "0.0.0.0/0"), ("datacentre", "60.1.2.3/32"), ("vpn", "bad")], "kind STRING, value STRING")
    ips = spark.createDataFrame([("60.1.2.3",), ("60.2.0.1",), ("9.9.9.9",), ("junk",)], "ip_address STRING")
    got = {(r["ip_address"], r["kind"]): r["prefix_length"] for r in ip.longest_network(ips, nets).collect()}
    assert got == {("60.1.2.3", "vpn"): 16, ("60.1.2.3", "datacentre"): 32, ("60.2.0.1", "vpn"): 8, ("9.9.9.9", "vpn"): 0}


def contact(spark, address, breaches=0, profiles=-1):
    df = spark.createDataFrame([("u", address, breaches, profiles)], "entity_id STRING, email STRING, known_breaches INT, registered_social_profiles INT")
    return one(email.email_signals(df, spark.createDataFrame([("listed.example",)], "value STRING")))


@pytest.mark.parametrize("address, breaches, profiles, score", [
    ("jane.doe@gmail.com", 0, -1, 5), ("nope", 0, -1, 40), ("someone@mailinator.com", 0, -1, 35), ("someone@listed.example", 0, -1, 35),
    ("ab+1@gmail.com", 12, 0, 5 + 10 + 30 + 25), ("abc@corp.example", 3, 2, 5 + 8), ("1234567a@corp.example", 0, -1, 10),
])
def test_email_scores(spark, address, breaches, profiles, score):
    assert contact(spark, address, breaches, profiles)["email_score"] == score


@pytest.mark.parametrize("number, score", [("+44 7700 900123", 0), ("123", 25), ("1-800-555-0100", 20), ("1900 555 0100", 35), ("0900 123456", 15)])
def test_phone_scores(spark, number, score):
    assert one(phone.phone_signals(spark.createDataFrame([(number,)], "phone STRING")))["phone_score"] == score


@pytest.mark.parametrize("number, scheme", [
    ("411111", "VISA"), ("371234", "AMEX"), ("300123", "DINERS"), ("272099", "MASTERCARD"), ("270100", "MASTERCARD"), ("601100", "DISCOVER"),
    ("670000", "MAESTROUK"), ("990000", None), ("222100", "MASTERCARD"), ("222000", None),
])
def test_card_schemes(spark, number, scheme):
    assert spark.range(1).select(card.scheme(F.lit(number))).first()[0] == scheme


def test_geo_check(spark):
    df = spark.createDataFrame([("GB", "gb", "GB", "GB"), ("GB", "", "US", "FR"), ("", "", "", "GB"), ("GB", "", "", "US")], "ip_country STRING, phone_country STRING, card_country STRING, expected_country STRING")
    assert [r["geo_score"] for r in combine.geo_check(df).collect()] == [0, 45, 0, 35]


def test_typing_entropy_edges(spark):
    df = spark.createDataFrame([([1.0] * 4,), ([2.0] * 9,), ([float(i) for i in range(10)],)], "c ARRAY<DOUBLE>")
    assert [r[0] for r in df.select(device.typing_entropy(F.col("c"))).collect()] == [0.0, 0.0, round(math.log2(10), 3)]


# --- records, reports, maintenance -----------------------------------------------------------


def test_model_record_accepts_only_objects(spark):
    rows = [('{"amount": 5, "hour_of_day": "7", "x": 1}',), ("[1]",), ("{broken",), (None,), ('"text"',)]
    parsed = records.model_record(spark.createDataFrame(rows, "payload STRING"))
    assert [r["record"] is not None for r in parsed.collect()] == [True, False, False, False, False]
    row = one(records.model_features(parsed.limit(1)))
    assert (row["amount"], row["hour_of_day"], row["ip_risk"]) == (5.0, 7.0, 0.0)


def test_filing_transitions(spark):
    filings = spark.createDataFrame([(s, s, "n", None) for s in reports.FILING_TRANSITIONS], "id STRING, status STRING, narrative STRING, filed_at TIMESTAMP")
    asked = [(s, n, None) for s in reports.FILING_TRANSITIONS for n in reports.FILING_TRANSITIONS] + [("missing", "FILED", None)]
    requests = spark.createDataFrame(asked, "id STRING, new_status STRING, narrative STRING")
    done = reports.apply_status_changes(filings, requests, F.current_timestamp()).collect()
    for r in done:
        if r["id"] == "missing":
            assert r["outcome"] == "not_found"
        else:
            assert r["outcome"] == ("updated" if r["new_status"] in reports.FILING_TRANSITIONS[r["id"]] else "rejected")
            assert (r["filed_at"] is not None) == (r["outcome"] == "updated" and r["new_status"] == "FILED")


def test_upsert_keeps_the_last_and_the_others(spark):
    stored = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k STRING, v INT, at INT")
    incoming = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "k STRING, v INT, at INT")
    got = {r["k"]: r["v"] for r in maintenance.upsert(stored, incoming, ["k"], ["at"]).collect()}
    assert got == {"a": 1, "b": 6, "c": 7}


def test_forest_separates_outliers(spark):
    rng = random.Random(13)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(2000)] + [(9000 + i, 9.0 + i, -9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id LONG, a DOUBLE, b DOUBLE")
    forest = models.fit_forest(df, "id", ["a", "b"], trees=50)
    scored = models.forest_score(df, forest, ["a", "b"])
    worst = {r["id"] for r in scored.orderBy(F.desc("isolation")).limit(5).collect()}
    assert worst == {9000, 9001, 9002, 9003, 9004}
