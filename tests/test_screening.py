"""Screening against comparison of every pair, on a small set of names."""

import random
import re
from difflib import SequenceMatcher

import pytest

from fraudspark.functions.text import trigrams
from fraudspark.operators import screening


def grams(text):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    return {("  " + w + " ")[i:i + 3] for w in words for i in range(len(w) + 1)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def names():
    rng = random.Random(5)
    words = ["ivan", "petrov", "petrow", "maria", "marie", "söder", "soder", "li", "trading", "ltd", "co", "müller", "o'neil", "x"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    return [f"{make()}" for _ in range(60)], [make() for _ in range(80)]


@pytest.fixture(scope="module")
def frames(spark, names):
    left, right = names
    queries = spark.createDataFrame([(f"q{i}", " " + n.upper()) for i, n in enumerate(left)], "query_id STRING, name STRING")
    watch = spark.createDataFrame([(f"w{i:03d}", n, n.lower().strip()) for i, n in enumerate(right)], "entity_id STRING, name STRING, name_normalized STRING")
    return queries, watch


def test_known_similarity(spark):
    row = spark.createDataFrame([("word", "two words")], "a STRING, b STRING").select(trigrams("a"), trigrams("b")).first()
    shared = len(set(row[0]) & set(row[1]))
    assert (shared, len(set(row[0]) | set(row[1]))) == (4, 11)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_screen_names_equals_all_pairs(frames, names, threshold):
    left, right = names
    got = {}
    for r in screening.screen_names(*frames, threshold=threshold, top=5).collect():
        got.setdefault(r["query_id"], []).append((r["match_rank"], r["entity_id"], r["similarity"]))
    for i, q in enumerate(left):
        scored = sorted((-similarity(q, w), f"w{j:03d}") for j, w in enumerate(right) if similarity(q, w) >= threshold)[:5]
        want = [(k + 1, e, pytest.approx(-s, abs=5e-5)) for k, (s, e) in enumerate(scored)]
        assert sorted(got.get(f"q{i}", [])) == want


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_screen_ratio_equals_all_pairs(frames, names, threshold):
    left, right = names
    got = {(r["query_id"], r["entity_id"]) for r in screening.screen_ratio(*frames, threshold=threshold).collect()}
    want = {
        (f"q{i}", f"w{j:03d}") for i, q in enumerate(left) for j, w in enumerate(right)
        if SequenceMatcher(None, (" " + q.upper()), w.upper()).ratio() >= threshold
    }
    assert got == want and want
