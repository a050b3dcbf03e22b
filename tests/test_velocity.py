"""Trailing windows against direct counting, over short slices so that borders matter."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from fraudspark.operators import velocity

START = datetime(2024, 1, 1)


def frame(spark, rows):
    data = [(f"E{i:05d}", s, r, Decimal(a), START + timedelta(seconds=t)) for i, (s, r, a, t) in enumerate(rows)]
    return spark.createDataFrame(data, "external_id STRING, sender_id STRING, receiver_id STRING, amount DECIMAL(18,4), event_time TIMESTAMP")


def sample(seed, n=400, hot=0.5, step=60):
    rng = random.Random(seed)
    rows, clock = [], 0
    for _ in range(n):
        clock += rng.randint(1, step)
        sender = "hot" if rng.random() < hot else rng.choice("abcd")
        rows.append((sender, rng.choice("xyz"), rng.choice(["1", "5.0050", "5.0149", "9.9999", "10", "2000", "2000.0099"]), clock))
    return rows


@pytest.mark.parametrize("slice_seconds", [120, 600])
def test_rolling_counts(spark, slice_seconds):
    rows = sample(1)
    got = {
        r["external_id"]: (r["velocity_count"], r["prior_count"], r["prior_large"])
        for r in velocity.rolling_velocity(frame(spark, rows), 120, slice_seconds).collect()
    }
    for i, (s, _, _, t) in enumerate(rows):
        before = [r for j, r in enumerate(rows) if j != i and r[0] == s and t - 120 < r[3] <= t]
        assert got[f"E{i:05d}"] == (len(before) + 1, len(before), sum(Decimal(r[2]) >= 10 for r in before))


def test_boundary_of_the_window_is_out(spark):
    rows = [("s", "x", "1", 0), ("s", "x", "1", 120), ("s", "x", "1", 121)]
    got = {r["external_id"]: r["velocity_count"] for r in velocity.rolling_velocity(frame(spark, rows)).collect()}
    assert got == {"E00000": 1, "E00001": 1, "E00002": 2}


@pytest.mark.parametrize("slice_seconds", [120, 600])
def test_rapid_duplicates(spark, slice_seconds):
    rows = sample(2)
    got = {r["external_id"] for r in velocity.rapid_duplicates(frame(spark, rows), 120, slice_seconds=slice_seconds).collect()}
    want = {
        f"E{i:05d}" for i, (s, _, a, t) in enumerate(rows)
        if any(r[0] == s and j < i and r[3] > t - 120 and abs(Decimal(r[2]) - Decimal(a)) < Decimal("0.01") for j, r in enumerate(rows))
    }
    assert got == want and want


def test_inbound_senders_leave_the_window(spark):
    day = 86_400
    rng = random.Random(3)
    rows, clock = [], 0
    for _ in range(300):
        clock += rng.randint(1, day)
        rows.append((rng.choice("abcdefgh"), rng.choice("xy"), "1", clock))
    got = {r["external_id"]: r["inbound_unique_senders"] for r in velocity.inbound_senders(frame(spark, rows), 10).collect()}
    for i, (_, receiver, _, t) in enumerate(rows):
        assert got[f"E{i:05d}"] == len({r[0] for r in rows if r[1] == receiver and t - 10 * day < r[3] <= t})


def test_many_senders_burst(spark):
    rows = [(f"s{i:02d}", "x", "1", i) for i in range(31)]
    got = {r["external_id"]: r["inbound_unique_senders"] for r in velocity.inbound_senders(frame(spark, rows)).collect()}
    assert got["E00028"] == 29 and got["E00029"] == 30


def test_escalation_after_small_amounts(spark):
    rows = [("s", "x", "1", 0), ("s", "x", "2", 10), ("s", "x", "5000", 20), ("t", "x", "1", 0), ("t", "x", "50", 10), ("t", "x", "5000", 20)]
    from pyspark.sql import functions as F
    rolled = velocity.rolling_velocity(frame(spark, rows))
    hit = velocity.escalated(F.col("amount"), F.col("velocity_count"), F.col("prior_count"), F.col("prior_large"))
    assert [r["external_id"] for r in rolled.filter(hit).collect()] == ["E00002"]
