"""Quality classifier: its tables against the convolution written out, and accuracy on held-out rows."""

import zlib

import numpy as np
import pytest

from fraudspark.llm import quality

SCHEMA = "doc_id long, text string, score double, lang string"


def plain_score(net, text):
    """Convolution, max per chunk, mean over chunks, logistic unit, one window after the other."""
    v = net.values
    data = text.encode() + bytes(max(0, quality.WIDTH - len(text.encode())))
    windows = [data[i : i + quality.WIDTH] for i in range(len(data) - quality.WIDTH + 1)]
    chunks = [windows[i : i + quality.STEP] for i in range(0, len(windows), quality.STEP)]
    features = []
    for n, chunk in enumerate(chunks):
        if n == len(chunks) - 1:  # the last chunk is filled up with zero bytes
            tail = data[n * quality.STEP :] + bytes(quality.CHUNK - len(data[n * quality.STEP :]))
            chunk = [tail[i : i + quality.WIDTH] for i in range(quality.STEP)]
        response = [sum(v["bytes"][b] @ v["filters"][w] for w, b in enumerate(window)) for window in chunk]
        features.append(np.maximum(np.max(response, axis=0) + v["bias"], 0))
    return 1 / (1 + np.exp(-(np.mean(features, axis=0) @ v["weights"] + v["base"][0])))


@pytest.mark.parametrize("size", [0, 3, 6, 7, 511, 512, 513, 1019, 1020, 2600])
def test_tables_hold_the_convolution(size):
    net = quality.ByteConvNet(3)
    net.values["bias"][:] = np.linspace(-1, 1, quality.FILTERS)
    text = ("aé9 " * 1000)[:size]
    assert net.scorer()([text.encode()])[0] == pytest.approx(plain_score(net, text), abs=1e-5)


def test_gradient_against_differences():
    net = quality.ByteConvNet(1)
    texts = [quality.chunks_of(t) for t in (b"hello world, hello", b"$$$ ### $$$" * 80, b"")]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.scorer()([b"hello world, hello", b"$$$ ### $$$" * 80, b""])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    gradient = net._gradient(texts, labels)
    for name in ("weights", "base", "bias"):
        for at in range(0, net.values[name].size, 5):
            flat = net.values[name].reshape(-1)
            old = flat[at]
            flat[at] = old + 1e-2
            up = loss()
            flat[at] = old - 1e-2
            down = loss()
            flat[at] = old
            assert gradient[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_scores(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.93
    assert (held[held.quality == 1].predicted == 1).mean() >= 0.97


def test_held_out_labels_are_never_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (quality.quality_scores(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None, 0.5, "clash"), (2, "", 0.5, "clash"), (2, "", 0.5, "clash"), (None, "no id", None, None), (4, "long " * 50_000, 1.0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, labels).collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 1, 2, 2, 4] and {r.score for r in found} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_scores(docs.limit(0), labels.limit(0)).count() == 0
