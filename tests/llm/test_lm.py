"""Language-model scores: the base against counting, the model as a probability, and its cache."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from fraudspark.llm import lm

SCHEMA = "doc_id long, text string, score double, n_tokens string"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(rows):
    counts, ends = Counter(), 0
    for doc_id, text, *_ in rows:
        if not held(doc_id):
            counts.update((text or "").encode().lower().split())
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().lower().split()
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((ends + 1) / (total + distinct + 1))
        out.append((str(doc_id), held(doc_id), len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), total, round(score, 6)))
    return sorted(out)


def rows(n=150):
    rng = random.Random(8)
    words = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    out = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=rng.randint(0, 60))), 1.0, "clash") for i in range(n)]
    return [*out, out[0], (None, "no id", None, None), (500, None, 1.0, ""), (501, "", 1.0, ""), (502, "long word " * 30_000, 1.0, ""), (503, "x" * 300_000, 1.0, "")]


@pytest.mark.parametrize("frequent", [0, 20, 200_000])
def test_base_against_counting(spark, frequent, monkeypatch):
    given = rows()
    monkeypatch.setattr(lm.frequent_words, "__defaults__", (frequent,))
    found = lm.score_texts(spark.createDataFrame(given, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == base_scores(given)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def model():
    texts = [t.encode() for _, t, *_ in rows() if t and len(t) < 1000]
    found = list(lm.slot_counts(*lm.merge(list(lm.counted(texts)))))
    entries = {k: tuple(np.concatenate(x) for x in zip(*[(s, n) for o, s, n in found if o == k], strict=True)) for k in lm.ORDERS}
    predictors, mixer = lm.Predictors(entries), lm.Mixer()
    for keys, times in lm.counted(texts):
        for at in range(0, len(keys), 500):
            mixer.learn(*predictors.odds(keys[at : at + 500], 1), times[at : at + 500])
    return predictors, mixer


def test_the_256_bytes_share_one_probability():
    predictors, mixer = model()
    for start in (b"w1 w2", b"", b"\xff\x00zz"):
        words = []
        for byte in range(256):
            data = b"\xff" * 7 + start + bytes([byte])
            key = int.from_bytes(data[-lm.WINDOW :], "big")
            hashes = lm.word_hashes(np.frombuffer(data, np.uint8))
            words.append(key | int(hashes[-1]) << (8 * lm.WINDOW))
        cost = mixer.cost(*predictors.odds(np.array(words, np.uint64)), mixer.refinement())
        assert np.exp2(-cost).sum() == pytest.approx(1, abs=1e-4)


def test_windows_are_the_bytes_before():
    texts = [b"ab cd", b"", b"\xc3\xa9 Ab"]
    keys, starts = lm.windows(texts)
    assert starts.tolist() == [0, 6, 7, 13]
    at, hashes = 0, {}
    for text in texts:
        data = b"\xff" * 5 + text + b"\xff"
        for i in range(5, len(data)):
            assert int(keys[at]) & ((1 << 48) - 1) == int.from_bytes(data[i - 5 : i + 1], "big")
            before = data[5:i].lower()
            word = before[max(before.rfind(b" "), -1) + 1 :]
            assert hashes.setdefault(word, int(keys[at]) >> 48) == int(keys[at]) >> 48
            at += 1
    assert len(set(hashes.values())) == len(hashes)


def test_a_text_costs_the_same_in_any_company():
    predictors, mixer = model()
    texts = [t.encode() for _, t, *_ in rows() if t is not None]
    together = lm.Scorer(predictors, mixer).bits(texts)
    alone = [lm.Scorer(predictors, mixer).bits([t])[0] for t in texts[:5]]
    assert np.allclose(together[:5], alone, rtol=1e-6)


def test_training_helps_and_held_out_texts_do_not_train(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = lm.score_texts(docs).toPandas().set_index("doc_id")
    kept = found[found.held_out]
    assert kept.score.sum() / kept.base_score.sum() < 1.1
    assert (kept.bits_per_byte < 4).mean() > 0.95
    without = lm.score_texts(docs.filter(~lm.fold("doc_id", 7, 2))).toPandas().set_index("doc_id")
    assert np.allclose(found.loc[without.index].score, without.score, rtol=1e-6)


def test_empty_table_and_no_training_rows(spark):
    assert lm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [r for r in rows() if held(r[0])][:3]
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_texts(spark.createDataFrame(only, SCHEMA)).collect()) == base_scores(only)


def plain_counts(texts):
    keys = lm.windows(texts)[0]
    return {k: Counter((lm.context(keys, k) << 8 | (keys & np.uint64(255)).astype(np.int64)).tolist()) for k in lm.ORDERS}


def test_counts_travel_as_a_row_per_block_of_contexts(spark):
    given = [(i, t, s, n) for i, t, s, n in rows() if t and len(t) < 1000 and not held(i)]
    partials = lm.partial_counts(spark.createDataFrame(given, SCHEMA).repartition(2))
    wanted = plain_counts([t.encode() for _, t, *_ in given])
    blocks = len({(k, slot >> 16) for k in lm.ORDERS for slot in wanted[k]})
    assert blocks <= partials.filter("kind >= 0").count() <= 2 * blocks < sum(map(len, wanted.values()))
    found = lm.context_counts(partials)
    assert {k: dict(zip(s.tolist(), n.tolist(), strict=True)) for k, (s, n) in found.items()} == wanted


@pytest.mark.parametrize("own", [0, 1])
def test_odds_against_counting(own):
    texts = [t.encode() for _, t, *_ in rows(40) if t and len(t) < 1000]
    counts, keys = plain_counts(texts), lm.windows(texts)[0]
    entries = {k: (np.array(list(c), np.int64), np.array(list(c.values()))) for k, c in counts.items()}
    x, gates, byte = lm.Predictors(entries).odds(keys, own)
    assert byte.tolist() == [b for t in texts for b in t + b"\xff"]
    for i in range(0, len(keys), 97):
        state = [0] * 8
        for at, k in enumerate(lm.ORDERS):
            row = int(lm.context(keys[i : i + 1], k)[0]) << 8
            for d in range(8):
                with_bit = [sum(counts[k][row | b] for b in range(256) if b >> 7 - d == int(byte[i]) >> 7 - d ^ other) for other in (0, 1)]
                same, other = with_bit[0] - own, with_bit[1]
                sign = 1 if int(byte[i]) >> 7 - d & 1 else -1
                assert x[at][i, d] == pytest.approx(sign * math.log((same + lm.PRIOR) / (other + lm.PRIOR)), abs=1e-5)
                if k in lm.STEPS:
                    state[d] = state[d] * (len(lm.STEPS[k]) + 1) + sum(same + other >= s for s in lm.STEPS[k])
        assert gates[i].tolist() == [s * 8 + d for d, s in enumerate(state)]


def test_slots_are_looked_up_once_and_in_order(monkeypatch):
    keys = lm.windows([t.encode() for _, t, *_ in rows() if t and len(t) < 1000])[0]
    asked, real = {}, lm.Predictors.slot_odds
    monkeypatch.setattr(lm.Predictors, "slot_odds", lambda self, k, slots, own: asked.__setitem__(k, slots) or real(self, k, slots, own))
    lm.Predictors({}).odds(keys)
    assert all((np.diff(s) > 0).all() for s in asked.values())
    assert sum(map(len, asked.values())) < len(keys) * len(lm.ORDERS) / 2


def test_windows_that_share_a_place_of_the_cache_cost_their_own(monkeypatch):
    predictors, mixer = model()
    texts = [t.encode() for _, t, *_ in rows() if t and len(t) < 1000]
    wanted = lm.Scorer(predictors, mixer).bits(texts)
    monkeypatch.setattr(lm, "CACHE_BITS", 3)
    crowded = lm.Scorer(predictors, mixer)
    assert np.allclose(crowded.bits(texts), wanted, rtol=1e-6)
    assert np.allclose(crowded.bits(texts[::-1]), wanted[::-1], rtol=1e-6)


def test_merged_lists_are_counts_of_all():
    rng = np.random.default_rng(4)
    given = [np.unique(rng.integers(0, 500, size).astype(np.uint64), return_counts=True) for size in (1, 300, 40, 900)]
    kept = [n.copy() for _, n in given]
    keys, n = lm.merge(given)
    wanted = sum((Counter(dict(zip(k.tolist(), c.tolist(), strict=True))) for k, c in given), Counter())
    assert list(zip(keys.tolist(), n.tolist(), strict=True)) == sorted(wanted.items())
    assert all((a == b).all() for a, (_, b) in zip(kept, given, strict=True))


def test_a_worker_keeps_the_tables_and_not_the_arrays():
    model = lm.Model({}, lm.Mixer(), {})
    scorer = model.unfolded()
    assert model.entries is None and model.unfolded() is scorer
