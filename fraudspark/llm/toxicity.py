"""Toxic spans and document scores by a linear-chain conditional random field over words.

A word (a run of letters and digits, lower-cased) is toxic or not. What speaks for toxic is a sum of weights of the
word, its first letters and last ones, and its neighbours, found by hash; three weights stand for the changes of state.
Forward and backward ratios of the two states give each word's marginal: a chain is a product of fractional linear
maps, so all chains of a batch are computed side by side, in pieces that are joined afterwards. Words of a marginal of
a half or more make up the spans; a document's score is a logistic function of its largest marginal and of the sum of
squared marginals, by itself and by word.

Labels belong to documents, so the labelled words are derived: a word of a toxic document is labelled toxic if it, or a start of
it that comes twice there, is in more toxic documents than chance allows (a tail bound over all words and starts of the
sample, near copies sharing one vote).
Learning sees the whole texts of at most ``ROWS_PER_LABEL`` rows of each label, chosen by a hash of the id. The chains
are dealt to shards of bounded size by hash; a round learns in all shards, and their weights are averaged, so the
result does not depend on partitions. Every text is scored in full.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import fold, stored, whole_text

ACCEPT = 0.7
ROWS_PER_LABEL = 1500  # the bound of the training sample: rows of each label
CHANCE = 0.01  # units that may be found toxic by chance, over all units of the sample
UNIT_STARTS = (4, 5, 6, 7)
CHAIN = 512  # words of a chain in training; longer texts are several chains
SHARD_WORDS = 150_000  # words of a shard in training
ROUNDS, PASSES, BATCH, RATE, SHRINK = 4, 2, 64, 0.5, 1e-6
BITS = 18
PLACES = 1 << BITS  # of the weight table
BASE, ENTER, LEAVE, STAY = range(PLACES, PLACES + 4)  # weights beside the table
STARTS = (3, 4, 5, 6)
OWN = len(STARTS) + 2  # weights of a word by itself
PARTS = OWN + 2  # and with its neighbours
PIECE = 128  # words of a piece in the joined computation
KNOWN_BYTES = 16 << 20  # of words whose weights a worker remembers
TOKENS_AT_ONCE = 400_000

WORD = re.compile(r"[^\W_]+")


def lowered(text: str) -> str:
    """Lower case of the same length: letters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def places_of(word: str) -> list[int]:
    """Places of the word's own weights (word, first three to six letters, last three), then of those it has for the next and the previous word."""
    code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    parts = [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % PLACES for n in STARTS]
    end = zlib.crc32(word[-3:].encode("utf-8", "surrogatepass"), 99) % PLACES
    return [code % PLACES, *parts, end, (code * 0x9E3779B1 + 3) % (1 << 32) >> (32 - BITS), (code * 0x85EBCA6B + 4) % (1 << 32) >> (32 - BITS)]


def ratios(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] + b[t] x[t-1]) / (c[t] + d[t] x[t-1]), from x[-1] = 0.

    The maps are put together within pieces, all pieces at once; then the pieces follow one another; then all places of
    the pieces are filled in.
    """
    size = len(a)
    pieces = -(-size // PIECE)

    def cut(values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(pieces * PIECE, fill)
        out[:size] = values
        return np.ascontiguousarray(out.reshape(pieces, PIECE).T)

    a, b, c, d = cut(a, 0.0), cut(b, 1.0), cut(c, 1.0), cut(d, 0.0)
    p, q, r, s = a[0], b[0], c[0], d[0]
    for t in range(1, PIECE):
        p, q, r, s = a[t] * r + b[t] * p, a[t] * s + b[t] * q, c[t] * r + d[t] * p, c[t] * s + d[t] * q
        scale = 1 / np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    x, before = 0.0, np.empty(pieces)
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        before[i] = x
        x = (pi + qi * x) / (ri + si * x)
    out = np.empty((PIECE, pieces))
    for t in range(PIECE):
        before = out[t] = (a[t] + b[t] * before) / (c[t] + d[t] * before)
    return out.T.reshape(-1)[:size]


class Chains:
    """Forward and backward ratios of the chains of a batch; ``first`` and ``last`` mark their ends."""

    def __init__(self, log_odds: np.ndarray, first: np.ndarray, last: np.ndarray, moves: np.ndarray):
        enter, leave, stay = np.exp(np.clip(moves, -15, 15))
        odds = np.exp(np.clip(log_odds, -30, 30))
        inner = ~first
        self.forward = ratios(odds * enter, odds * stay * inner, np.ones(len(odds)), leave * inner)
        following = np.r_[odds[1:], 0.0]
        open_end = ~last
        back = ratios(
            np.where(last, 1.0, leave)[::-1], (stay * following * open_end)[::-1], np.ones(len(odds)), (enter * following * open_end)[::-1]
        )
        self.backward = back[::-1]
        both = self.forward * self.backward
        self.marginal = both / (1 + both)
        self.odds, self.moves, self.inner = odds, (enter, leave, stay), inner

    def pairs(self) -> np.ndarray:
        """Expected number of moves to toxic, from it, and within it."""
        enter, leave, stay = self.moves
        before = np.r_[0.0, self.forward[:-1]] * self.inner
        to = self.odds * self.backward
        weights = np.stack([enter * to, before * leave, before * stay * to])
        return (weights / (1 + weights.sum(axis=0))).sum(axis=1)


def learn(chains: list[np.ndarray], tags: list[np.ndarray], weights: np.ndarray, seed: int) -> np.ndarray:
    """Steps along the gradient of the chains' log-likelihood, each weight at a rate of its own; a chain is (words, PARTS) places."""
    weights, squares = weights.copy(), np.full(len(weights), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            words, tag = np.concatenate([chains[i] for i in some]), np.concatenate([tags[i] for i in some])
            ends = np.cumsum([len(tags[i]) for i in some])
            first, last = np.zeros(len(tag), bool), np.zeros(len(tag), bool)
            first[np.r_[0, ends[:-1]]] = True
            last[ends - 1] = True
            state = Chains(weights[words].sum(axis=1) + weights[BASE], first, last, weights[[ENTER, LEAVE, STAY]])
            gap = tag - state.marginal
            gradient = np.bincount(words.ravel(), np.repeat(gap, PARTS), len(weights))
            before = np.r_[0, tag[:-1]] * ~first
            seen = np.array([(tag * (1 - before)).sum(), ((1 - tag) * before).sum(), (tag * before).sum()])
            gradient[BASE], gradient[[ENTER, LEAVE, STAY]] = gap.sum(), seen - state.pairs()
            gradient[NOTHING] = 0
            gradient -= SHRINK * len(tag) * weights
            squares += gradient**2
            weights += RATE * gradient / np.sqrt(squares)
    return weights


NOTHING = PLACES + 4  # a weight that stays zero: the neighbour beyond an end
SIZE = PLACES + 5


def chain_places(words: list[str]) -> np.ndarray:
    """(words, PARTS) places: the word's own, that of the word before, that of the word after."""
    own = np.array([places_of(w) for w in words], np.int64).reshape(len(words), PARTS)
    out = np.full((len(words), PARTS), NOTHING)
    out[:, :OWN] = own[:, :OWN]
    out[1:, OWN], out[:-1, OWN + 1] = own[:-1, OWN], own[1:, OWN + 1]
    return out


class Tagger:
    """Marginals of all words of texts; a word's weights are summed once and remembered."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sums, self.held = np.zeros((4096, 3)), 0

    def _learn(self, words: set[str]) -> None:
        new = list(words)
        places = np.array([places_of(w) for w in new], np.int64)
        start = len(self.known)
        while len(self.sums) < start + len(new):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        w = self.weights
        self.sums[start : start + len(new)] = np.stack([w[places[:, :OWN]].sum(axis=1), w[places[:, OWN]], w[places[:, OWN + 1]]], axis=1)
        self.known.update(zip(new, range(start, start + len(new)), strict=True))
        self.held += sum(map(len, new)) + 120 * len(new)

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the marginals of its words, in order."""
        if self.held > KNOWN_BYTES:
            self._forget()
        per_text = [WORD.findall(lowered(t)) for t in texts]
        numbers = []
        for words in per_text:
            try:
                numbers.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
            except KeyError:
                self._learn({w for w in words if w not in self.known})
                numbers.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        sizes = np.array([len(n) for n in numbers])
        if not sizes.sum():
            return [np.zeros(0) for _ in texts]
        number, ends = np.concatenate(numbers), np.cumsum(sizes)
        first, last = np.zeros(len(number), bool), np.zeros(len(number), bool)
        some = sizes > 0
        first[(ends - sizes)[some]] = True
        last[ends[some] - 1] = True
        own, to_next, to_previous = self.sums[number].T
        odds = own + self.weights[BASE]
        odds[1:] += np.where(first[1:], 0, to_next[:-1])
        odds[:-1] += np.where(last[:-1], 0, to_previous[1:])
        return np.split(Chains(odds, first, last, self.weights[[ENTER, LEAVE, STAY]]).marginal, ends[:-1])


def batches_of(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``TOKENS_AT_ONCE`` words, at least one text."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text) // 5
        if held >= TOKENS_AT_ONCE:
            yield part
            part, held = [], 0
    if part:
        yield part


def spans_of(text: str, marginal: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, largest marginal) of runs of words with a marginal of a half or more; code points, end exclusive."""
    out: list[tuple[int, int, float]] = []
    if not len(marginal) or marginal.max() < 0.5:
        return out
    toxic, previous = marginal >= 0.5, -2
    for i, found in enumerate(WORD.finditer(lowered(text))):
        if toxic[i]:
            if previous == i - 1:
                start, _, most = out.pop()
                out.append((start, found.end(), max(most, float(marginal[i]))))
            else:
                out.append((found.start(), found.end(), float(marginal[i])))
            previous = i
    return out


SUMMARY = ("most", "mass", "density")


def summary(marginal: np.ndarray) -> list[float]:
    """What a document's score is made of: log odds of the largest marginal, and logs of the sum of squared marginals and of its share."""
    most = min(max(marginal.max(), 1e-4), 1 - 1e-4) if len(marginal) else 1e-4
    mass = float((marginal**2).sum())
    return [math.log(most / (1 - most)), math.log(mass + 0.1), math.log(mass / max(len(marginal), 1) + 1e-3)]


# --- learning --------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_label: int) -> DataFrame:
    """(doc_id, toxic, text) of a bounded sample without held-out ids; an id with several labels counts as toxic if one says so."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold("doc_id", 3, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = None
    for label in (0, 1):
        own = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label)
        sample = own if sample is None else sample.unionByName(own)
    texts = docs.select("doc_id", whole_text().alias("text"))
    return stored(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text"), "toxicity-sample")  # bounded by rows_per_label


def marks(words: list[str]) -> list[int]:
    """Three smallest hashes of runs of four words, each of another hash: near copies mostly share one."""
    runs = {zlib.crc32(" ".join(words[i : i + 4]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 3))}
    return [min((r * k + k) % 4294967291 for r in runs) * 3 + i for i, k in enumerate((1, 2654435761, 2246822519))]


def units(words: list[str]) -> set[str]:
    """What may mark a toxic word: the word itself, or a start of four to seven letters that occurs twice in the text."""
    starts = Counter(w[:n] for w in words for n in UNIT_STARTS if len(w) > n)
    return {*words, *(f"{start}*" for start, n in starts.items() if n > 1)}


def toxic_units(sample: DataFrame) -> set[str]:
    """Units that are in more toxic documents of the sample than chance allows, and in few others."""
    def marked(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [marks(WORD.findall(lowered(t))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "marks"])

    def counted(batches: Iterator[pa.RecordBatch]):
        toxic, all_of, documents = Counter(), Counter(), [0.0, 0.0]
        for batch in batches:
            for text, label, n in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), batch["n"].to_pylist(), strict=True):
                documents[label] += 1 / n
                for unit in units(WORD.findall(lowered(text))):
                    all_of[unit] += 1 / n
                    if label:
                        toxic[unit] += 1 / n
            if len(all_of) > 400_000:
                yield rows(toxic, all_of)
                toxic, all_of = Counter(), Counter()
        yield rows(toxic, all_of)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([documents[1]]), pa.array([sum(documents)])], names=["unit", "toxic", "all"])

    def rows(toxic: Counter, all_of: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(all_of), pa.string()), pa.array([toxic[u] for u in all_of], pa.float64()), pa.array(list(all_of.values()), pa.float64())], names=["unit", "toxic", "all"]
        )

    numbered = stored(
        sample.select("toxic", "text").mapInArrow(marked, "toxic int, text string, marks array<long>").withColumn("row", F.monotonically_increasing_id()), "toxicity-marks"
    )
    each = numbered.select("row", "toxic", F.explode("marks").alias("mark"))
    size = each.join(each.groupBy("toxic", "mark").agg(F.count("*").alias("n")), ["toxic", "mark"]).groupBy("row").agg(F.max("n").alias("n"))
    votes = numbered.join(size, "row").select("toxic", "text", "n").mapInArrow(counted, "unit string, toxic double, all double")
    counts = stored(votes.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all")), "toxicity-units")
    whole = counts.filter("unit IS NULL").head()
    share = whole["toxic"] / whole["all"]
    own = F.least(F.col("toxic") / F.col("all"), F.lit(1 - 1e-9))
    excess = F.col("all") * (own * F.log(own / share) + (1 - own) * F.log((1 - own) / (1 - share)))
    tried = counts.count()
    found = counts.filter(F.col("unit").isNotNull() & (F.col("toxic") > 0) & (own >= max(0.75, (1 + share) / 2)) & (excess > math.log(tried / CHANCE)))
    return {r["unit"] for r in found.select("unit").collect()}


def is_toxic(word: str, found: set[str]) -> bool:
    return word in found or any(f"{word[:n]}*" in found for n in UNIT_STARTS if len(word) > n)


def chains(sample: DataFrame, found: set[str]) -> DataFrame:
    """(shard, key, places, tags) of all chains of the sample."""
    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row, (text, toxic) in enumerate(zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True)):
                words = WORD.findall(lowered(text))
                base = zlib.crc32(f"{batch['doc_id'][row].as_py()} {len(text)}".encode())
                for at in range(0, len(words), CHAIN):
                    some = words[at : at + CHAIN]
                    tags = np.array([toxic == 1 and is_toxic(w, found) for w in some], np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([base << 24 | at // CHAIN], pa.int64()), pa.array([len(some)], pa.int64()), pa.array([chain_places(some).astype(np.int32).tobytes()], pa.binary()), pa.array([tags.tobytes()], pa.binary())],
                        names=["key", "words", "places", "tags"],
                    )

    rows = stored(sample.mapInArrow(cut, "key long, words long, places binary, tags binary"), "toxicity-chains")
    shards = rows.agg(F.ceil(F.coalesce(F.sum("words"), F.lit(0)) / SHARD_WORDS)).head()[0]
    return rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, shards))).cast("int"))


def fitted_weights(rows: DataFrame) -> np.ndarray:
    """Rounds of learning in every shard; a weight becomes the mean of its values over the shards, by words."""
    def learner(start: np.ndarray, n: int):
        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for batch in batches:
                held += zip(batch["key"].to_pylist(), batch["places"].to_pylist(), batch["tags"].to_pylist(), strict=True)
            held.sort()
            places = [np.frombuffer(p, np.int32).reshape(-1, PARTS).astype(np.int64) for _, p, _ in held]
            tags = [np.frombuffer(t, np.uint8).astype(np.float64) for _, _, t in held]
            moved = learn(places, tags, start, n) - start
            at = np.flatnonzero(moved)
            size = float(sum(map(len, tags)))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1], pa.int32()), pa.array(np.r_[moved[at] * size, size])], names=["place", "value"])

        return run

    weights = np.zeros(SIZE)
    weights[[BASE, ENTER]] = -2.0
    for n in range(ROUNDS):
        moves = rows.groupBy("shard").applyInArrow(learner(weights, n), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
        sums = {r["place"]: r["value"] for r in moves.collect()}  # at most SIZE
        total = sums.pop(-1, 1.0)
        weights = weights.copy()
        weights[list(sums)] += np.array(list(sums.values())) / total
    return weights.astype(np.float32).astype(np.float64)


def scored(docs: DataFrame, weights: np.ndarray, kept: list[str]) -> DataFrame:
    """Columns ``kept`` with the summary and the spans of each row of (``kept``, text)."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in SUMMARY), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        tagger = Tagger(shared.value)
        for batch in batches:
            at = 0
            for texts in batches_of(batch["text"].to_pylist()):
                found = tagger.marginals(texts)
                facts = [pa.array(c) for c in zip(*map(summary, found), strict=True)]
                spans = [[dict(zip(("start", "end", "probability"), s, strict=True)) for s in spans_of(t, m)] for t, m in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(at, len(texts)) for c in kept), *facts, pa.array(spans, kind)], names=[*kept, *SUMMARY, "spans"]
                )
                at += len(texts)

    return docs.select(*kept, "text").mapInArrow(run, schema)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic function, none but the constant below zero; Newton's steps with a little shrinking."""
    use = list(range(x.shape[1]))
    while True:
        rows = np.c_[np.ones(len(x)), x[:, use]]
        w = np.zeros(rows.shape[1])
        shrink = np.diag([1e-6, *[1e-2] * len(use)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + shrink, rows.T @ (weight * (y - p)) - shrink @ w)
            w += np.clip(step, -2, 2)
        out = np.zeros(x.shape[1] + 1)
        out[[0, *(i + 1 for i in use)]] = w
        if not len(use) or w[1:].min() >= 0:
            return out
        use.pop(int(w[1:].argmin()))


class Model:
    """Weights of the field, and of the document's score."""

    def __init__(self, weights: np.ndarray, score: np.ndarray):
        self.weights, self.score = weights, score


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Model | None:
    """The fitted model; None without rows of both labels. Shares of labels are set right to those of all labelled rows."""
    sample = training_rows(docs, labels, rows_per_label)
    if sample.select("toxic").distinct().count() < 2:
        return None
    weights = fitted_weights(chains(sample, toxic_units(sample)))
    rows = scored(sample, weights, ["toxic"]).select("toxic", *SUMMARY).collect()  # bounded by rows_per_label, save for repeated ids
    rows.sort()
    y = np.array([r["toxic"] for r in rows], np.float64)
    counts = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold("doc_id", 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = dict(counts.groupBy("toxic").count().collect())
    weight = np.where(y == 1, size[1] / y.sum(), size[0] / (len(y) - y.sum())) * len(y) / (size[0] + size[1])
    return Model(weights, logistic(np.array([[r[c] for c in SUMMARY] for r in rows]), y, weight))


def toxicity(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of ``docs``; only doc_id and text are read.

    ``spans``: start and end (code points, end exclusive) and largest marginal of each run of toxic words. A null text is
    empty; an empty text has no words and gets the score of no evidence. Repeated rows are scored each, a null id is not
    held out. Labels other than 0 and 1 and labels of null ids are ignored. Without rows of both labels all scores are 0.5.
    """
    model = train(docs, labels, rows_per_label)
    weights, score = (model.weights, model.score) if model else (np.r_[np.zeros(PLACES), -15.0, -15.0, 0.0, 0.0, 0.0], np.zeros(4))
    rows = docs.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), whole_text().alias("text"))
    log_odds = sum((F.col(c) * float(w) for c, w in zip(SUMMARY, score[1:], strict=True)), F.lit(float(score[0])))
    return scored(rows, weights, ["doc_id", "held_out"]).withColumn("score", 1 / (1 + F.exp(-log_odds))).select(
        "doc_id", "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"), "spans"
    )
