"""Streams against the batch operators on the same rows."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fraudspark.operators import patterns, records, scoring, velocity
from fraudspark.sources import readers, writers
from fraudspark.streaming import pipeline

START = datetime(2024, 1, 1)


def payload(i, sender, receiver, amount, kind, second):
    body = {"external_id": f"E{i:05d}", "sender_id": sender, "receiver_id": receiver, "amount": str(amount), "currency": "GBP", "transaction_type": kind}
    return json.dumps(body), START + timedelta(seconds=second)


def sample(n=400, seed=1):
    rng = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rng.randint(1, 30)
        rows.append(payload(
            i, rng.choice(["hot", "hot", "a", "b"]), rng.choice("xy"), rng.choice([5, 5, 100, 105, 1500, 20000]),
            rng.choice(["TRANSFER", "ADD_MONEY", "WIRE"]), clock,
        ))
    return rows


# A last event far ahead moves the watermark past everything that is tested.
SENTINEL = payload(99999, "sentinel", "none", 1, "OTHER", 10_000_000)


def write_batches(spark, folder, batches):
    for rows in batches:
        frame = spark.createDataFrame(rows, "payload STRING, event_time TIMESTAMP")
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)


def replay(spark, folder):
    return readers.payload_stream(spark, "parquet", path=str(folder), maxFilesPerTrigger="1")


def finish(spark, stream, tmp_path, name):
    query = pipeline.run_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-progress"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name)), query


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("payloads")
    rows = sample()
    write_batches(spark, folder, [rows[:150], rows[150:290], rows[290:], [SENTINEL]])
    batch = records.parse_transactions(spark.createDataFrame(rows, "payload STRING, event_time TIMESTAMP"))
    return folder, batch


def test_windowed_score_equals_batch(spark, source, tmp_path):
    folder, batch = source
    counted = pipeline.with_window_count(records.parse_transactions(replay(spark, folder)))
    out, _ = finish(spark, pipeline.score_counted(counted).select("external_id", "txn_count_2min", "risk_score"), tmp_path, "scored")
    want = scoring.score_transactions(batch).select("external_id", "txn_count_2min", "risk_score")
    assert sorted(map(tuple, out.filter("external_id <> 'E99999'").collect())) == sorted(map(tuple, want.collect()))


def test_rolling_equals_batch(spark, source, tmp_path):
    folder, batch = source
    out, _ = finish(spark, pipeline.rolling(records.parse_transactions(replay(spark, folder))), tmp_path, "rolling")
    rolled = velocity.rolling_velocity(batch).join(velocity.rapid_duplicates(batch).withColumn("dup", F.lit(True)), "external_id", "left")
    hit = velocity.escalated(F.col("amount"), F.col("velocity_count"), F.col("prior_count"), F.col("prior_large"))
    want = rolled.select("external_id", "velocity_count", F.coalesce("dup", F.lit(False)), hit)
    got = out.filter("external_id <> 'E99999'").select("external_id", "velocity_count", "is_duplicate", "is_escalation")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_patterns_equal_batch(spark, source, tmp_path):
    folder, batch = source
    parsed = records.parse_transactions(replay(spark, folder))
    by_sender, _ = finish(spark, pipeline.sender_patterns(parsed), tmp_path, "senders")
    by_receiver, _ = finish(spark, pipeline.receiver_patterns(records.parse_transactions(replay(spark, folder))), tmp_path, "receivers")
    got = sorted((r["pattern_type"], r["first_id"], r["last_id"]) for r in by_sender.unionByName(by_receiver).collect())
    want = (
        [("SMALL_TO_LARGE", r["first_small_txn"], r["large_txn"]) for r in patterns.small_to_large(batch).collect()]
        + [("RAPID_ROUND_TRIP", r["outbound_txn"], r["inbound_txn"]) for r in patterns.round_trips(batch).collect()]
        + [("VELOCITY_BURST", r["first_txn"], r["last_txn"]) for r in patterns.velocity_bursts(batch).collect()]
        + [("DUPLICATE_INBOUND_AMOUNTS", r["first_txn"], r["third_txn"]) for r in patterns.duplicate_amounts(batch).collect()]
    )
    assert got == sorted(want) and len({k for k, _, _ in got}) == 4


def test_late_rows_of_closed_windows_are_dropped_and_counted(spark, tmp_path):
    folder = tmp_path / "late"
    write_batches(spark, folder, [
        [payload(1, "s", "x", 5, "WIRE", 10), payload(2, "s", "x", 5, "WIRE", 400)],
        [payload(3, "s", "x", 5, "WIRE", 401)],
        [payload(4, "s", "x", 5, "WIRE", 20), payload(5, "s", "x", 5, "WIRE", 398)],
        [SENTINEL],
    ])
    out, query = finish(spark, velocity.velocity_window(records.parse_transactions(replay(spark, folder))), tmp_path, "late-out")
    counts = {r["window_start"]: r["txn_count_2min"] for r in out.filter("sender_id = 's'").collect()}
    assert counts == {START: 1, START + timedelta(seconds=360): 3}
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1


def test_all_sinks_and_a_repeated_batch(spark, source, tmp_path):
    folder, batch = source
    base = str(tmp_path / "sinks")
    stamp = lambda: F.lit(START).cast("timestamp")
    pipeline.run_pipeline(replay(spark, folder), base, str(tmp_path / "progress"), stamp).awaitTermination()
    scored = scoring.score_transactions(batch)
    stored = lambda name: writers.current(spark, f"{base}/{name}")
    assert stored("transactions").filter("id <> 'E99999'").count() == batch.count()
    assert stored("alerts").count() == scored.filter("risk_score >= 25").count()
    before = stored("risk_scores").count()
    pipeline.write_all_sinks(scored, 0, base, stamp())
    assert stored("risk_scores").count() == before
    messages = spark.read.text(f"{base}/interdictions").count()
    assert messages >= scored.filter("risk_score >= 50").count()


def test_rules_are_read_again_for_every_batch(spark, source, tmp_path):
    folder, batch = source
    def rule(value, version):
        return [("r1", "big", "amount", "gt", value, "FLAG", 5, "LOW", True, "t", version, "2024")]
    schema = "rule_id STRING, rule_name STRING, field STRING, operator STRING, value STRING, action STRING, risk_score_adjustment INT, severity STRING, active BOOLEAN, created_by STRING, version INT, created_at STRING"
    calls = []
    def read():
        calls.append(1)
        return spark.createDataFrame(rule("1000", 1) + rule("10000", 2), schema)
    out = str(tmp_path / "hits")
    pipeline.match_rules_per_batch(records.parse_transactions(replay(spark, folder)), read, out, str(tmp_path / "rules-progress")).awaitTermination()
    assert len(calls) >= 4
    assert spark.read.parquet(out).count() == batch.filter("amount > 10000").count()


def test_model_branch_answers_every_record(spark, tmp_path):
    folder = tmp_path / "model"
    rows = [('{"external_id": "a", "sender_id": "s", "amount": 2}', START), ("[1]", START), ("{oops", START), ('{"transaction_id": "t", "external_id": "b", "created_at": "now"}', START)]
    write_batches(spark, folder, [rows])
    out, _ = finish(spark, pipeline.model_scores(replay(spark, folder)), tmp_path, "model-out")
    got = sorted((json.loads(r["value"]) for r in out.collect()), key=lambda m: (m["source"], m["transaction_id"] or ""))
    assert [m["source"] for m in got] == ["error", "error", "model", "model"]
    assert got[2]["transaction_id"] == "a" and got[3]["transaction_id"] == "t" and got[3]["event_time"] == "now"
    assert got[0]["model_score"] == 0.0 and got[0]["model_version"] == "unknown"


# --- file readers ----------------------------------------------------------------------------


def test_readers_skip_bad_lines(spark, tmp_path):
    (tmp_path / "watch.jsonl").write_text('{"id": "1", "schema": "Person", "caption": "A", "properties": {"name": ["A", "B"]}}\n\n{broken\n{"schema": "Person"}\n')
    (tmp_path / "rules.jsonl").write_text('{"rule_id": "r", "condition": {"field": "amount", "operator": "gt", "value": "5"}}\nnot json\n{"rule_name": "x"}\n')
    (tmp_path / "calibration.json").write_text('{\n "model_name": "m",\n "baseline_scores": [1, 2.5, "x", null]\n}')
    (tmp_path / "list.txt").write_text("# note\n\n Foo.Example \nfoo.example\n")
    from fraudspark.operators import watchlist
    from fraudspark.operators.enrich.ip import clean_list
    feed = readers.read_watchlist(spark, str(tmp_path / "watch.jsonl"))
    assert [r["name"] for r in watchlist.entity_names(feed).orderBy("name").collect()] == ["A", "B"]
    assert [r["rule_id"] for r in readers.read_rules(spark, str(tmp_path / "rules.jsonl")).collect()] == ["r"]
    assert sorted(r["score"] for r in readers.read_calibration(spark, str(tmp_path / "calibration.json")).collect()) == [1.0, 2.5]
    assert [r["value"] for r in clean_list(readers.read_list(spark, str(tmp_path / "list.txt"), "disposable"), "disposable").collect()] == ["foo.example"]


def test_keyed_table_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    write = lambda rows, version: writers.upsert_table(spark.createDataFrame(rows, "k STRING, v INT"), path, ["k"], ["v"], version)
    write([("a", 1), ("b", 1)], 1)
    write([("b", 2), ("c", 2)], 2)
    write([("a", 9)], 2)
    assert {r["k"]: r["v"] for r in writers.current(spark, path).collect()} == {"a": 1, "b": 2, "c": 2}
