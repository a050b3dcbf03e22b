"""Toxicity: marginals against all labellings, the gradient against differences, and accuracy on held-out rows."""

import itertools
import zlib

import numpy as np
import pytest

from fraudspark.llm import toxicity

SCHEMA = "doc_id long, text string, score double, spans string"


def plain(log_odds, moves):
    """Marginals, expected moves and log sum of weights, over all labellings of one chain."""
    enter, leave, stay = moves
    step = {(0, 0): 0.0, (0, 1): enter, (1, 0): leave, (1, 1): stay}
    total, marginal, pairs = 0.0, np.zeros(len(log_odds)), np.zeros(3)
    for labels in itertools.product((0, 1), repeat=len(log_odds)):
        path = list(zip((0, *labels), labels, strict=False))
        weight = np.exp(sum(step[p] for p in path) + sum(e for e, y in zip(log_odds, labels, strict=True) if y))
        total += weight
        marginal += weight * np.array(labels)
        pairs += weight * np.array([path.count((0, 1)), path.count((1, 0)), path.count((1, 1))])
    return marginal / total, pairs / total, np.log(total)


def ends(sizes):
    first, last = np.zeros(sum(sizes), bool), np.zeros(sum(sizes), bool)
    stops = np.cumsum(sizes)
    first[stops - sizes], last[stops - 1] = True, True
    return first, last


@pytest.mark.parametrize("piece", [1, 3, 128])
def test_marginals_and_moves_against_all_labellings(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rng = np.random.default_rng(piece)
    sizes, moves = [1, 4, 9, 1, 7], np.array([-1.0, 0.7, 1.5])
    log_odds = rng.normal(0, 2, sum(sizes))
    state = toxicity.Chains(log_odds, *ends(sizes), moves)
    found = [plain(part, moves) for part in np.split(log_odds, np.cumsum(sizes)[:-1])]
    assert state.marginal == pytest.approx(np.concatenate([m for m, _, _ in found]))
    assert state.pairs() == pytest.approx(sum(p for _, p, _ in found))


def test_long_chains_stay_finite():
    log_odds = np.tile([40.0, -40.0, 0.0], 50_000)
    state = toxicity.Chains(log_odds, *ends([len(log_odds)]), np.array([-3.0, 2.0, 5.0]))
    assert np.isfinite(state.marginal).all() and (state.marginal >= 0).all() and (state.marginal <= 1).all()


def test_learning_follows_the_likelihood():
    rng = np.random.default_rng(2)
    tags = [np.array([0, 1, 1, 0, 0]), np.array([1]), np.array([0, 0, 0])]
    chains = [toxicity.chain_places([f"w{rng.integers(3)}{y}" for y in t]) for t in tags]
    weights = np.zeros(toxicity.SIZE)
    state = [plain(weights[c].sum(axis=1), weights[[toxicity.ENTER, toxicity.LEAVE, toxicity.STAY]]) for c in chains]
    before = -sum(s[2] for s in state)
    weights = toxicity.learn(chains, [t.astype(float) for t in tags], weights, 1)
    moves = weights[[toxicity.ENTER, toxicity.LEAVE, toxicity.STAY]]

    def log_likelihood(chain, tag):
        log_odds = weights[chain].sum(axis=1) + weights[toxicity.BASE]
        path = list(zip((0, *tag), tag, strict=False))
        return (log_odds * tag).sum() + np.dot([path.count((0, 1)), path.count((1, 0)), path.count((1, 1))], moves) - plain(log_odds, moves)[2]

    assert sum(map(log_likelihood, chains, tags)) > before + 1 and weights[toxicity.NOTHING] == 0


def test_tagger_equals_chains_one_by_one():
    weights = np.random.default_rng(5).normal(0, 1, toxicity.SIZE)
    weights[toxicity.NOTHING] = 0
    texts = ["Shut up, you IDIOT!", "", "one", "İstanbul ẞ a_b 12", "no words: !!", "x " * 300]
    texts = [t if t != "no words: !!" else "!!" for t in texts]
    found = toxicity.Tagger(weights).marginals(texts)
    for text, marginal in zip(texts, found, strict=True):
        words = toxicity.WORD.findall(toxicity.lowered(text))
        assert len(marginal) == len(words)
        if words:
            log_odds = weights[toxicity.chain_places(words)].sum(axis=1) + weights[toxicity.BASE]
            alone = toxicity.Chains(log_odds, *ends([len(words)]), weights[[toxicity.ENTER, toxicity.LEAVE, toxicity.STAY]])
            assert marginal == pytest.approx(alone.marginal)


def test_spans_are_code_points():
    text = "Ä é, you bad bad man"
    assert toxicity.spans_of(text, np.array([0, 0, 0, 0.9, 0.6, 0])) == [(9, 16, 0.9)]
    assert text[9:16] == "bad bad"


def test_held_out_accuracy_and_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.toxicity(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held[held.toxic == 0].predicted == 0).mean() >= 0.98
    order = held.score.rank()
    toxic, clean = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (order[held.toxic == 1].sum() - toxic * (toxic + 1) / 2) / (toxic * clean) >= 0.75
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    again = toxicity.toxicity(docs, turned).toPandas()
    assert rows.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_planted_words_are_found_with_their_places(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{n}" for n in rng.integers(0, 300, 40)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[5], words[20] = "scumbag", ["lowlife", "scumbag"][i % 8 // 4]
        rows.append((i, " ".join(words), None, None))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, SCHEMA)
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in found:
        text = rows[r.doc_id][1]
        assert r.predicted == labels[r.doc_id][2]
        assert {text[s.start : s.end] for s in r.spans} <= {"scumbag", "lowlife"}
        assert bool(r.spans) == bool(r.predicted)


def test_odd_rows(spark):
    rows = [(1, None, 0.5, "x"), (2, "", 0.5, "x"), (2, "", 0.5, "x"), (None, "no id", None, None), (4, "long " * 50_000, 1.0, "x"), (5, "x" * 100_000, 1.0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (4, None, 0), (5, 1, 7)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 1, 2, 2, 4, 5] and {r.score for r in found} == {0.5}
    both = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (4, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity.toxicity(docs, both).collect()} == {None, 1, 2, 4, 5}
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.toxicity(docs.limit(0), both).count() == 0
