"""Quality classifier: a convolutional network over bytes, in numpy.

A byte is a learned vector, and a filter looks at ``WIDTH`` bytes in a row. The whole text is cut into chunks that
overlap by ``WIDTH`` - 1 bytes, so every window of it is seen once; a filter's largest response in a chunk is kept
(max pooling), the chunks' responses are averaged, and one logistic unit gives the probability of label 1.
The network is fitted on a bounded sample of labelled rows; every text is scored in full. Scoring adds up table
rows for byte pairs, which holds the same sums as the convolution.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import fold, per_batch, set_apart, whole_text

WIDTH, VECTOR, FILTERS = 6, 8, 16
CHUNK = 512
STEP = CHUNK - WIDTH + 1  # windows of a chunk
ACCEPT = 0.7
#: Bounds of the training sample: rows of each label, and chunks of a text (evenly spread over it).
ROWS_PER_LABEL, CHUNKS_PER_TEXT = 1500, 10
BLOCK = 32  # chunks convolved at once


def chunks_of(text: bytes) -> np.ndarray:
    """(chunks, CHUNK) bytes, padded with zeros at the end; one chunk for an empty text."""
    count = max(1, -(-(len(text) - WIDTH + 1) // STEP))
    padded = np.zeros(count * STEP + WIDTH - 1, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (count, CHUNK), (STEP, 1))


class ByteConvNet:
    """Parameters of the network, their gradient, and the scores of texts."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.values = {
            "bytes": rng.normal(0, 0.5, (256, VECTOR)), "filters": rng.normal(0, 0.3, (WIDTH, VECTOR, FILTERS)),
            "bias": np.zeros(FILTERS), "weights": rng.normal(0, 0.3, FILTERS), "base": np.zeros(1),
        }

    def table(self) -> np.ndarray:
        """Response of each filter to each byte at each place of the window: (WIDTH, 256, FILTERS)."""
        return np.einsum("bv,wvf->wbf", self.values["bytes"], self.values["filters"]).astype(np.float32)

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam on the logistic loss; only the window with the largest response gets a gradient."""
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.values.items()}
        second = {k: np.zeros_like(v) for k, v in self.values.items()}
        while step < steps:
            order = rng.permutation(len(texts))
            for at in range(0, min(len(order), (steps - step) * batch), batch):
                some = order[at : at + batch]
                step += 1
                for name, gradient in self._gradient([texts[i] for i in some], labels[some]).items():
                    first[name] += 0.1 * (gradient - first[name])
                    second[name] += 0.001 * (gradient**2 - second[name])
                    self.values[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        v, table = self.values, self.table()
        chunks = np.concatenate(texts)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        share = 1 / np.bincount(owner)
        top, where = np.empty((len(chunks), FILTERS)), np.empty((len(chunks), FILTERS), np.int64)
        for at in range(0, len(chunks), BLOCK):
            part = chunks[at : at + BLOCK]
            response = table[0][part[:, :STEP]]
            for w in range(1, WIDTH):
                response += table[w][part[:, w : w + STEP]]
            where[at : at + BLOCK] = response.argmax(axis=1)
            top[at : at + BLOCK] = response.max(axis=1)
        pooled = np.maximum(top + v["bias"], 0)
        features = np.zeros((len(texts), FILTERS))
        np.add.at(features, owner, pooled)
        features *= share[:, None]
        error = (1 / (1 + np.exp(-(features @ v["weights"] + v["base"]))) - labels) / len(labels)
        out = {"weights": features.T @ error + 1e-4 * v["weights"], "base": np.array([error.sum()])}
        down = (error * share)[owner][:, None] * v["weights"] * (pooled > 0)
        out["bias"] = down.sum(axis=0)
        out["filters"], out["bytes"] = np.zeros_like(v["filters"]), np.zeros_like(v["bytes"])
        rows = np.arange(len(chunks))[:, None]
        for w in range(WIDTH):
            seen = chunks[rows, where + w]  # (chunks, FILTERS)
            out["filters"][w] = np.einsum("cfv,cf->vf", v["bytes"][seen], down)
            np.add.at(out["bytes"], seen, down[:, :, None] * v["filters"][w].T[None])
        return out

    def scorer(self):
        """A function of a list of byte strings: probability of label 1 for each."""
        table = self.table()
        pairs = [np.ascontiguousarray((table[w][:, None] + table[w + 1][None]).reshape(-1, FILTERS)) for w in range(0, WIDTH, 2)]
        bias, weights, base = (self.values[k].astype(np.float32) for k in ("bias", "weights", "base"))

        def pooled(chunks: np.ndarray) -> np.ndarray:
            two = chunks[:, :-1].astype(np.uint16) << 8 | chunks[:, 1:]
            response = pairs[0].take(two[:, :STEP], axis=0)
            for k in range(1, len(pairs)):
                response += pairs[k].take(two[:, 2 * k : 2 * k + STEP], axis=0)
            return np.maximum(response.max(axis=1) + bias, 0)

        def score(texts: list[bytes]) -> np.ndarray:
            out, waiting, held = np.empty(len(texts)), [], 0

            def flush():
                chunks = np.concatenate([c for _, c in waiting])
                responses = np.concatenate([pooled(chunks[a : a + BLOCK]) for a in range(0, len(chunks), BLOCK)])
                starts = np.cumsum([0] + [len(c) for _, c in waiting[:-1]])
                means = np.add.reduceat(responses, starts, axis=0) / np.array([[len(c)] for _, c in waiting])
                out[[i for i, _ in waiting]] = 1 / (1 + np.exp(-(means @ weights + base).astype(np.float64)))

            for i, text in enumerate(texts):
                waiting.append((i, chunks_of(text)))
                held += len(waiting[-1][1])
                if held >= 4096:  # about 2 MB of text at a time
                    flush()
                    waiting, held = [], 0
            if waiting:
                flush()
            return out

        return score


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> tuple[list[np.ndarray], np.ndarray]:
    """Chunks and labels of a bounded sample, chosen by a hash of the id, without the held-out ids.

    An id with several labels counts by the smallest. At most ``CHUNKS_PER_TEXT`` chunks of a text travel to the driver.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold("doc_id", 4, 2))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = None
    for label in (0, 1):
        own = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label)
        sample = own if sample is None else sample.unionByName(own)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by rows_per_label

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for text in batch["text"].to_pylist():
            chunks = chunks_of(text.encode("utf-8", "surrogatepass"))
            kept.append(chunks[np.unique(np.linspace(0, len(chunks) - 1, CHUNKS_PER_TEXT).round().astype(int))].tobytes())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"].cast(pa.int32()), pa.array(kept, pa.binary())], names=["doc_id", "quality", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(per_batch(pick), f"doc_id {kind}, quality int, chunks binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["chunks"]))
    texts = [np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in found]
    return texts, np.array([r["quality"] for r in found], np.float64)


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> ByteConvNet:
    """The fitted network, its base moved from the sample's share of label 1 to that of all labelled rows.

    Without rows of both labels it stays as it starts, with weights of zero: all scores are 0.5.
    """
    texts, wanted = training_rows(docs, labels, rows_per_label)
    net = ByteConvNet()
    if not 0 < wanted.sum() < len(wanted):
        net.values["weights"][:] = 0
        return net
    net.fit(texts, wanted)
    counts = dict(labels.filter(F.col("quality").isin(0, 1) & ~fold("doc_id", 4, 2)).groupBy("quality").count().collect())
    net.values["base"] += np.log(counts[1] / counts[0]) - np.log(wanted.sum() / (len(wanted) - wanted.sum()))
    return net


def with_score(docs: DataFrame, net: ByteConvNet, name: str = "score") -> DataFrame:
    """``docs`` and the probability of label 1 of each whole text; null counts as empty."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        score = shared.value.scorer()
        for batch in batches:
            if batch.num_rows:
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(texts))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; only doc_id and text are read."""
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Documents that score ``accept`` or more, with the columns of ``docs``, whatever their names."""
    packed, restore = set_apart(docs, "text")
    return restore(with_score(packed, train(docs, labels), "_quality").filter(F.col("_quality") >= accept))
