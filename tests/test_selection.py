"""Selection and ranks by pieces against sorted lists, with limits small enough to cut again and again."""

import random

import pytest
from pyspark.sql import functions as F

from fraudspark.operators import models, monitor, selection


def frame(spark, rows):
    return spark.createDataFrame(rows, "model_name STRING, score DOUBLE")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    hot = [("hot", round(rng.lognormvariate(0, 3), 2)) for _ in range(1500)] + [("hot", 7.0)] * 1500  # half of all is one value
    return hot + [("cold", float(i % 5)) for i in range(40)] + [("cold", None), ("one", -0.5)]


@pytest.mark.parametrize(("pieces", "rows_at_once"), [(2, 50), (4, 20), (32, 1_000_000)])
def test_values_at_ranks(spark, rows, pieces, rows_at_once):
    by_group = {g: sorted(v for k, v in rows if k == g and v is not None) for g in ("hot", "cold", "one")}
    asked = [(g, r, f"{g}{r}") for g, v in by_group.items() for r in {0, len(v) // 3, len(v) // 2, len(v) - 1, len(v), -1}]
    ranks = spark.createDataFrame(asked, "model_name STRING, rank LONG, tag STRING")
    got = selection.values_at_ranks(frame(spark, rows), ranks, "model_name", "score", pieces, rows_at_once).collect()
    assert sorted((r.model_name, r["rank"], r.tag, r.score) for r in got) == sorted((g, r, t, by_group[g][r]) for g, r, t in asked if 0 <= r < len(by_group[g]))


def test_no_piece_of_a_hot_group_is_large(spark, rows):
    values = frame(spark, [("hot", float(i) / 7) for i in range(20_000)] + rows)
    each = values.filter("score IS NOT NULL").groupBy("model_name", "score").agg(F.count("*").alias("n"))
    pieces = selection.in_pieces(each, "model_name", "score", rows_at_once=1000)
    sizes = [r["count"] for r in pieces.groupBy("__piece").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2500


@pytest.mark.parametrize("pieces", [1, 7])
def test_counts_below(spark, rows, pieces):
    got = {(r.model_name, r.score): (r.n, r.below) for r in selection.counts_below(frame(spark, rows), frame(spark, rows), "model_name", "score", pieces).collect()}
    for (group, score), (n, below) in got.items():
        own = [v for k, v in rows if k == group and v is not None]
        assert (n, below) == (own.count(score), sum(v < score for v in own))
    assert len(got) == len({r for r in rows if r[1] is not None})


def test_sorted_errors_and_percentiles_agree(spark, rows):
    table = frame(spark, rows)
    places = {(r.model_name, r.score): r.first_place for r in monitor.sorted_errors(table).collect()}
    total = {g: sum(k == g and v is not None for k, v in rows) for g in ("hot", "cold", "one")}
    for r in monitor.percentiles(table.filter("score IS NOT NULL").distinct(), table).collect():
        assert r.percentile == pytest.approx(places[r.model_name, r.score] / total[r.model_name])


def test_reconstruction_scores(spark):
    rows = [("a", "m", [1.0, 2.0], [1.0, 4.0]), ("b", "m", [1.0, 2.0], [3.0]), ("c", "other", [0.0], [1.0]), ("d", "m", None, [1.0]), ("e", "m", [1.0], None), ("f", "m", [None], [1.0])]
    rebuilt = spark.createDataFrame(rows, "id STRING, model_name STRING, features ARRAY<DOUBLE>, reconstruction ARRAY<DOUBLE>")
    got = {r.id: r for r in models.reconstruction_scores(rebuilt, frame(spark, [("m", 1.0), ("m", 2.0), ("m", 2.5), ("m", 9.0)])).collect()}
    assert {k: (r.reconstruction_error, r.percentile, r.is_anomaly) for k, r in got.items()} == {"a": (2.0, 0.25, False), "b": (3.0, 0.75, False), "c": (1.0, 0.5, False)}
    assert got["b"].anomaly_score == 75.0


def test_rounds_of_a_selection_do_not_sort_the_values(spark, rows, monkeypatch):
    plans, real = [], selection.cut_lineage
    monkeypatch.setattr(selection, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    ranks = spark.createDataFrame([("hot", 1000)], "model_name STRING, rank LONG")
    got = selection.values_at_ranks(frame(spark, rows), ranks, "model_name", "score", 4, 20).head()["score"]
    assert got == sorted(v for k, v in rows if k == "hot")[1000]
    rounds = plans[1:]
    assert rounds and all("ObjectHashAggregate" in p and "SortAggregate" not in p for p in rounds)
    assert all("SortMergeJoin" not in p.split("percentile_approx")[-1] for p in rounds)
