"""Centroid clustering against Lloyd's rounds with Python numbers."""

import hashlib

import numpy as np
import pytest

from fraudspark.llm import clusters


def plain(rows, k, rounds, scale=1024, seed=3):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centroids = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        labels = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, labels, strict=True) if m == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in found)


@pytest.mark.parametrize(("dimension", "block", "chunk"), [(5, 2, 7), (6, 6, 100), (3, 1, 1)])
def test_rounds_against_plain_numbers(spark, dimension, block, chunk):
    rng = np.random.default_rng(dimension)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 4, 0.4, dimension)]) for i in range(60)]
    rows += [(100 + i, list(rows[i][1])) for i in range(5)]  # ties
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    found = clusters.cluster(df, dimension=dimension, k=4, rounds=3, block_columns=block, chunk_rows=chunk)
    assert sorted(map(tuple, found.collect())) == plain(rows, 4, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (None, [-0.5, 3.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = clusters.cluster(df, dimension=2, k=8, rounds=2).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in found) == [(0, 0), (1, 0), (1, 0)]
    assert {r.inertia for r in found} == {0}
    assert clusters.cluster(df.limit(0), dimension=2).count() == 0
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(spark.createDataFrame([(1, [1e30, 0.0])], df.schema), dimension=2)
