"""Divergence audit: the hash by itself, and the audit against counting with Python numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fraudspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, item string, value string"


def plain(rows, least, most):
    docs = [(text or "", lang or "", source or "") for text, lang, source in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower)), lang, source) for t, lang, source in docs]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for w, lang, source in words:
        seen[lang].update(set(w))
        counts[lang, source].update(w)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept} for s, n in own.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_perfect_hash_is_minimal_and_verified():
    keys = [f"w{i}".encode() for i in range(5000)] + [b"", "é".encode(), b"x" * 1000]
    made = divergence.unpack(divergence.pack(divergence.PerfectHash(keys)))
    slots = made.slots(keys, divergence.hashes_of(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert [made.key(s) for s in slots.tolist()] == keys
    others = [f"v{i}".encode() for i in range(5000)]
    assert (made.slots(others, divergence.hashes_of(others)) == -1).all()
    assert (made.slots(others[: len(keys)], made.hashes[: len(others)]) == -1).all()  # foreign keys with stored hashes


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "hashes_of", lambda keys: np.array([len(k) for k in keys], np.uint64))
    keys = [b"aa", b"bb", b"c", b"dd"]
    made = divergence.PerfectHash(keys)
    assert sorted(made.slots(keys, divergence.hashes_of(keys)).tolist()) == [0, 1, 2, 3]
    assert made.slots([b"zz", b"q"], np.array([2, 1], np.uint64)).tolist() == [-1, -1]


def test_shares_beyond_64_bits():
    counts = np.array([0, 7, 10**12])
    assert divergence.shares(counts, 10**13, 50, 10**9).tolist() == [1 + 10**9 * (c + 2) // (10**13 + 100) for c in counts.tolist()]


@pytest.mark.parametrize(("shard_terms", "block", "round_bytes"), [(12_000, 40, 48 << 20), (6, 2, 900)])
def test_audit_against_plain_counts(spark, monkeypatch, shard_terms, block, round_bytes):
    monkeypatch.setattr(divergence, "ROUND_BYTES", round_bytes)
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + i % 26)}{'xyzé漢'[i % 5]}{'Ab'[i % 2]}" for i in range(45)]
    rows = []
    for _ in range(160):
        source = rng.choice(["hot", "hot", "hot", "a", "b", "", None, "é", "zz"])
        rows.append((" ".join(rng.choices(vocabulary[: rng.randint(3, 45)], k=rng.randint(0, 30))) + rng.choice(["!", "7x", ""]), rng.choice(["en", "de", None]), source))
    rows += [(None, "en", "a"), ("", "xx", "s"), ("rare words here", "xx", "t"), ("word " * 20_000, "en", "long")]
    df = spark.createDataFrame([(i, *r, "item", "value") for i, r in enumerate(rows)], SCHEMA)
    found = divergence.audit(df, least_documents=10, most_terms=3, shard_terms=shard_terms, block=block)
    assert sorted(map(tuple, found.collect())) == plain(rows, 10, 3)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same Same", "en", "a", None, None)] * 4 + [(2, "same", "en", "b", None, None)], SCHEMA)
    assert sorted(map(tuple, divergence.audit(df, least_documents=5).collect())) == plain([("same Same", "en", "a")] * 4 + [("same", "en", "b")], 5, 10)
    assert divergence.audit(df.limit(0)).count() == 0
    assert divergence.audit(df, least_documents=50).collect() == divergence.audit(df, least_documents=60).collect()
