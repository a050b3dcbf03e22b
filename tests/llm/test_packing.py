"""Packing: plans against exhaustive search, tokens against the tokenizer itself, and an exact round trip."""

import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fraudspark.llm import packing
from fraudspark.llm.common import tokenizer_path
from fraudspark.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, piece string, offset int"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def fewest_bins(lengths, size):
    """By trying every way to put one length after the other."""
    best = len(lengths)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best and rest:
            return
        if not rest:
            best = min(best, len(bins))
            return
        for i, room in enumerate(bins):
            if room >= rest[0] and room not in bins[:i]:
                place(rest[1:], [*bins[:i], room - rest[0], *bins[i + 1 :]])
        place(rest[1:], [*bins, size - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_fewest_sequences(lengths):
    counts = np.bincount(lengths, minlength=21)
    plan = packing.plan_bins(counts, 20)
    used = np.zeros(21, int)
    for filling, n in plan:
        assert sum(filling) <= 20
        np.add.at(used, list(filling), n)
    assert (used == counts).all()
    assert sum(n for _, n in plan) == fewest_bins(lengths, 20)


def test_fillings_that_are_not_greedy_are_tried():
    """1088+400+280+280 and 1068+340+320+320; greedy takes 400+340 after 1088. Also as a part of a larger plan."""
    lengths = [1088, 1068, 400, 340, 320, 320, 280, 280]
    for more in ([], [2048] * 50, [1500, 548] * 3):
        plan = packing.plan_bins(np.bincount([*lengths, *more], minlength=2049), 2048)
        assert sorted(x for f, n in plan for x in f * n) == sorted([*lengths, *more])
        assert sum(n for _, n in plan) == sum([*lengths, *more]) // 2048


def test_a_filling_may_follow_less_often_than_its_lengths_last():
    rng = np.random.default_rng(1)
    for _ in range(400):
        lengths = rng.choice(rng.integers(3, 60, 4), 9)
        plan = packing.plan_bins(np.bincount(lengths, minlength=101), 100, choices=1)
        assert sum(n for _, n in plan) == fewest_bins(lengths.tolist(), 100)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7), st.integers(1, 20))
def test_completions_are_all_undominated_fillings(lengths, room):
    subsets = {tuple(sorted(c, reverse=True)) for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if sum(c) <= room}
    above = lambda a, b: a != b and len(a) <= len(b) and all(x <= y for x, y in zip(a, b, strict=False))
    found = list(packing.completions(np.bincount(lengths, minlength=21), room, lambda: room, [10**6]))
    assert len(found) == len(set(found)) and set(found) == {a for a in subsets if not any(above(a, b) for b in subsets)}


def test_many_equal_lengths_need_no_more_than_the_bound():
    counts = np.zeros(2049, int)
    counts[[2048, 1500, 548, 700, 648]] = [1000, 300, 300, 80, 40]
    assert sum(n for _, n in packing.plan_bins(counts, 2048)) == packing.lower_bound(counts, 2048)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB'sStTrevmld09²½ªµÀÿß×÷Łſ İŉé\t\n\r.,!?-_~ ¡\x85\x1c\u4e2d\u0301😀", max_size=30))
def test_parts_have_the_ids_of_the_whole(encoder, text):
    assert encoder.encode(text) == encoder.whole([text])[0]


def test_special_names_in_texts(encoder):
    for text in ("<|endoftext|>", "a<|startoftext|>b c", "a <|endoftext| > b"):
        assert encoder.encode(text) == encoder.whole([text])[0]


def test_round_trip(spark, encoder):
    texts = [None, "", "One two three.", "One two three.", "word " * 3000, "x" * 500, "Ends<|endoftext|>"]
    rows = [(i, t, "clash", 9) for i, t in enumerate(texts)] + [(2, "One two three.", "clash", 9), (None, "no id", "clash", 9)]
    packed = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), tokenizer_path(), size=64, with_ids=True)
    found = packed.collect()
    ids = {}
    for r in found:
        assert r.length <= 64 and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        ids.setdefault(r.doc_id, []).append((r.start, r.piece, bytes(r.ids)))
    for doc_id, text, *_ in rows:
        parts = sorted(set(ids[doc_id]))
        assert b"".join(p for _, _, p in parts) == encoder.whole([text or ""])[0] + bytes(4)
        assert [p for _, p, _ in parts] == list(range(len(parts)))
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == [0, *itertools.accumulate(n for _, n in sorted(places)[:-1])] if len(places) > 1 else places[0][0] == 0
        assert sum(n for _, n in places) <= 64
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in found:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == np.frombuffer(r.ids, "<u4").tolist()
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_query_packs_every_document(spark, sf_dir):
    from fraudspark.llm.queries import QUERIES

    rows = QUERIES["op1_packing"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows.doc_id.nunique() == docs.count()
    total = rows.length.sum()
    assert rows.sequence_id.nunique() <= -(-total // 2048) + 2


def test_caches_turn_over_without_losing_what_recurs(monkeypatch):
    from fraudspark.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_BYTES", 1 << 18)
    encode, plain = tokens.Encoder(tokenizer_path()), tokens.Encoder(tokenizer_path())
    encoded, real = [], encode.pieces_only

    class Counted:
        def encode_batch_fast(self, texts, **options):
            encoded.extend(texts[0].split())
            return real.encode_batch_fast(texts, **options)

    encode.pieces_only = Counted()
    usual = [f"usual{chr(97 + i)}word" for i in range(20)]
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    for n in range(400):
        text = " ".join([*usual, *(f"once{letters(n * 50 + i)}" for i in range(50))])
        assert encode.encode(text) == plain.whole([text])[0]
    assert all(encoded.count(w) == 1 for w in usual[:4])  # 20,000 words have come since, and the caches turned over
    held = [sum(tokens.ENTRY_BYTES + len(k) + len(v) for k, v in g.items()) for c in (encode.parts, encode.pieces) for g in (c.young, c.old)]
    assert max(held) <= tokens.CACHED_BYTES + (1 << 15)


def test_long_texts_are_cut_at_white_space_only(encoder, monkeypatch):
    from fraudspark.llm import tokens

    monkeypatch.setattr(tokens, "TOGETHER", 64)
    texts = ["", "Don't  stop. " * 40, "x" * 300, "é½ aéb!\n" * 30, " ", "中 " * 50, "<|endoftext|> a " * 20, "tail"]
    assert tokens.Encoder(tokenizer_path()).encode_all(texts) == encoder.whole(texts)


def test_the_cache_holds_400_000_parts():
    from fraudspark.llm import tokens

    encode = tokens.Encoder(tokenizer_path())
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    texts = [" ".join(f"{letters(a)}.{letters(b)}" for b in range(1000)) for a in range(400)]
    first = encode.encode_all(texts)
    assert first[-1] == encode.whole(texts[-1:])[0]
    encode._learn = None  # nothing is new
    assert encode.encode_all(texts) == first
