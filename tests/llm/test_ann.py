"""Nearest neighbours against all distances."""

import math

import numpy as np
import pytest

from fraudspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, query_id long, score int"


def plain(rows, queries, k):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i in queries:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i)[:k]
            out[i] = near
    return out


def rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 16)).astype(np.float32)
    v[100:250] = v[min(100, n - 1)]  # a large group of equal vectors
    out = [(int(i), [float(x) for x in v[i]], 1, 2) for i in range(n)]
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, [1.0] * 3), (n + 5, []), (n + 6, [float("inf")] * 16), (None, [1.0] * 16)]
    return out + [(*r, 1, 2) for r in odd]


@pytest.mark.parametrize("hold,block", [(0.98, 20_000), (1.0, 20)])
def test_recall_and_exact_scores(spark, monkeypatch, hold, block):
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", block)
    monkeypatch.setattr(ann, "SHARD_ROWS", 150)
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    found = ann.search(df, df.filter("vec_id % 10 = 0"), k=10, hold=hold).collect()
    wanted = plain(given, {i for i, *_ in given if i is not None and i % 10 == 0}, 10)
    by_query = {}
    for r in sorted(found, key=lambda r: r.rank):
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert by_query.keys() == wanted.keys() and all(len(v) == 10 for v in by_query.values())
    assert all(v == sorted(v) for v in by_query.values())
    vectors = {i: np.array(v) for i, v, *_ in given[:600]}
    assert all(s == np.sqrt(((vectors[q] - vectors[j]) ** 2).sum()) for q, v in by_query.items() for s, j in v)
    hits = [len({j for _, j in wanted[q]} & {j for _, j in v}) / 10 for q, v in by_query.items()]
    assert np.mean(hits) >= 0.9


def test_few_rows_and_none(spark):
    few = rows(4)
    df = spark.createDataFrame(few[:4], SCHEMA)
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, df, k=10).collect())
    wanted = plain(few[:4], range(4), 10)
    assert found == sorted((q, n, j, s) for q, near in wanted.items() for n, (s, j) in enumerate(near, 1))
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    useless = spark.createDataFrame([(1, None, 1, 1), (2, [0.0], 1, 1)], SCHEMA)
    assert ann.search(useless, useless).count() == 0


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    codes[:500] = codes[0] ^ (np.uint64(1) << rng.integers(0, 63, 500, dtype=np.uint64))
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 3, 4, 7, 22, 30, 64):
        for q in (0, 1, 2000):
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[q]) <= radius).tolist()


def test_query_recall(spark):
    from fraudspark.llm.queries import QUERIES

    rows_ = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    vectors, ids = np.stack(rows_.embedding).astype(float), rows_.vec_id.to_numpy()
    found = QUERIES["op8_neighbours"](spark, "/root/testdata/sf0.1").toPandas()
    hits = []
    for q, own in found.groupby("query_id"):
        distance = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(axis=1))
        distance[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, distance))[:10]]) & set(own.vec_id)) / 10)
    assert len(hits) == (ids % 100 == 0).sum() and np.mean(hits) >= 0.9
