"""Networks of many roots: near roots share rows, and a node is found at its distance."""

import random

from pyspark.sql import functions as F

from fraudspark.operators import graph


def test_near_roots_share_the_rows_of_a_mask(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"n{i:05d}" for i in range(1200)]
    chains = [rng.sample(names[i : i + 6], 6) for i in range(0, len(names), 6)]  # names of a network are near each other
    pairs = [(a, b) for chain in chains for a, b in zip(chain, chain[1:])]
    edges = spark.createDataFrame([(a, b, 1.0, 1, "GBP") for a, b in pairs], "sender_id STRING, receiver_id STRING, total_amount DOUBLE, tx_count LONG, currency STRING")
    roots = edges.select(F.explode(F.array("sender_id", "receiver_id")).alias("root")).distinct()
    kept, real = [], graph.kept_table
    monkeypatch.setattr(graph, "kept_table", lambda df, name: (kept.append((name, real(df, name))), kept[-1][1])[1])
    nodes, touched = graph.khop_network(edges, roots, 2)
    want = {(x, y, abs(i - j)) for chain in chains for i, x in enumerate(chain) for j, y in enumerate(chain) if abs(i - j) <= 3}
    assert {(r["root"], r["node"], r["distance"]) for r in nodes.collect()} == want
    inside = {(x, chain[j], chain[j + 1]) for chain in chains for i, x in enumerate(chain) for j in range(5) if min(abs(i - j), abs(i - j - 1)) <= 2}
    assert {(r["root"], r["sender_id"], r["receiver_id"]) for r in touched.collect()} == inside
    rows = sum(df.count() for name, df in kept if name == "khop-reached")
    assert rows < 0.8 * (len(want) - len(names))  # a row for each root and node where none is shared; for each node and distance at least
