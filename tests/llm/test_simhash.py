"""SimHash: fingerprints, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from fraudspark.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def plain_fingerprint(text, n=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, near):
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if near(codes[i], codes[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("seed", range(4))
def test_trie_forest_has_the_components_of_all_links(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 7))) for _ in range(400)]
    codes = np.unique(np.r_[rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.array([int(centres[i % 4]) ^ f for i, f in enumerate(flips)], np.uint64)])
    forest = simhash.Forest(len(codes))
    for mask in simhash.block_masks(4):
        turned, depth = simhash.turn(codes, mask)
        order = np.argsort(turned)
        root = simhash.trie_links(turned[order], depth, 4)
        forest.link(order, order[root])
    wanted = plain_components(codes.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    assert same_partition(forest.flatten().tolist(), wanted)


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(25)]
    out = [None, "", " \t\n", "One", "one", "ONE two three"]
    for text in base:
        parts = text.split()
        out += [text, text, text.upper(), " ".join([*parts[:-1], "changed"]), " ".join([*parts, "added"])]
    return out + ["word " * 30_000]


def test_near_duplicates_against_all_pairs(spark):
    rows = [(i * 3, t, "clash", "clash") for i, t in enumerate(texts())] + [(0, None, "clash", "clash")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    codes = [plain_fingerprint(t or "") for _, t, *_ in rows]
    component = plain_components(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (doc_id, *_), c in zip(rows, component, strict=True):
        least[c] = min(doc_id, least.get(c, doc_id))
    wanted = sorted((doc_id, f"{code:016x}", least[c]) for (doc_id, *_), code, c in zip(rows, codes, component, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == wanted


def test_query_against_all_pairs(spark, sf_dir):
    from fraudspark.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    codes = [plain_fingerprint(r.text or "") for r in rows]
    component = plain_components(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {c: min(r.doc_id for r, k in zip(rows, component, strict=True) if k == c) for c in set(component)}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, sf_dir).collect()}
    assert found == {r.doc_id: (f"{f:016x}", least[c]) for r, f, c in zip(rows, codes, component, strict=True)}


def test_one_of_each_group_stays(spark):
    rng = random.Random(1)
    text = " ".join(rng.choices([f"v{i}" for i in range(500)], k=200))
    near = text.replace(text.split()[100], "other", 1)
    rows = [(5, text), (4, near), (4, near), (9, "something else"), (9, "another text"), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)
    kept = simhash.keep_one(docs, simhash.similar_documents(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(4, near), (9, "something else"), (9, "another text"), (7, None)], key=lambda r: (r[0], r[1] or ""))
    nothing = docs.limit(0)
    assert simhash.keep_one(nothing, simhash.similar_documents(nothing)).count() == 0


def test_long_fingerprints_find_similar_documents(spark):
    """Every pair at a similarity of 0.85 or more ends in one component, and unrelated texts stay apart."""
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(2000)]
    rows, group = [], []
    for g in range(12):
        words = rng.choices(vocabulary, k=400)
        for _ in range(5):
            copy = list(words)
            for at in rng.sample(range(400), 5):
                copy[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
            group.append(g)
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    found = {r.doc_id: r.component for r in simhash.similar_documents(docs).collect()}
    assert same_partition([found[i] for i in range(len(rows))], group)


def test_documents_below_the_similarity_stay_apart(spark):
    """Set Jaccard of 0.72 to 0.79 is no link, also where fingerprints or counts of repeated shingles suggest it; 0.8 and more is."""
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(100_000)]
    rows, wanted = [], []
    for g in range(40):
        words = rng.sample(vocabulary, 404)  # 400 shingles; a changed last stretch of n words leaves 400 - n of them
        for changed in (0, 48 + g % 18 if g % 2 else 10 + g % 34):
            rows.append((len(rows), " ".join(words[: 404 - changed] + rng.sample(vocabulary, changed))))
            wanted.append(2 * g if g % 2 == 0 else len(rows) - 1)
    phrase = " ".join(rng.sample(vocabulary, 60))
    for end in range(2):  # alike by the many repeats of one phrase only
        rows.append((len(rows), f"{phrase} " * 30 + " ".join(rng.sample(vocabulary, 60))))
        wanted.append(len(rows) - 1)
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    found = {r.doc_id: r.component_id for r in simhash.verified_documents(docs).collect()}
    assert [found[i] for i in range(len(rows))] == wanted


def test_spanning_pairs_are_links():
    forest = simhash.Forest(6)
    a, b = forest.span(np.array([0, 1, 2, 0, 4]), np.array([1, 2, 3, 3, 5]))
    assert len(a) == 4 and set(zip(a.tolist(), b.tolist(), strict=True)) <= {(0, 1), (1, 2), (2, 3), (0, 3), (4, 5)}
    assert forest.flatten().tolist() == [0, 0, 0, 0, 4, 4]


def test_a_large_group_below_the_similarity_gives_no_pairs(spark, monkeypatch):
    """200 texts with three words of their own each are alike at 0.6 to 0.79: few pairs are listed, and each link is found."""
    rng = random.Random(4)
    words = rng.sample([f"t{i}" for i in range(10_000)], 150)
    rows = []
    for i in range(200):
        copy = list(words)
        for k, at in enumerate(rng.sample(range(150), 3)):
            copy[at] = f"own{i}x{k}"
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, f"{rows[i][1]} added{i}") for i in range(0, 40)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in rows]
    component = plain_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert len(set(component)) > 100
    listed, real = [], simhash.verified

    def counted(sets, pairs, similarity):
        listed.append(pairs.count())
        return real(sets, pairs, similarity)

    monkeypatch.setattr(simhash, "verified", counted)
    found = {r.doc_id: r.component for r in simhash.verified_documents(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert same_partition([found[i] for i in range(len(rows))], component)
    assert listed[1] <= len(rows)


def test_slack_keeps_every_similar_pair(spark):
    rng = random.Random(6)
    sets = {}
    for fp in range(120):
        base = range(300 * (fp % 4), 300 * (fp % 4) + rng.randint(60, 120))
        sets[fp] = np.unique(np.array([(7919 * k * 0x9E3779B97F4A7C15) % (1 << 63) for k in [*rng.sample(base, len(base) - rng.randint(0, 12)), *(10_000 + 100 * fp + i for i in range(rng.randint(0, 12)))]], np.uint64))
    frame = spark.createDataFrame([(fp, bytearray(x.tobytes())) for fp, x in sets.items()], "fp long, shingles binary")
    trees = spark.createDataFrame([(fp, fp) for fp in sets], "fp long, tree long")
    marks = {r.fp: r for r in simhash.slacks(frame, trees, 0.8).collect()}
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(marks[a].odd, marks[b].odd, strict=True))
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
    pairs = [(a, b) for a in sets for b in range(a)]
    passed = [p for p in pairs if apart(*p) <= sum(marks[k].slack for k in p) + 1e-6]
    similar = [p for p in pairs if alike(*p)]
    assert len(similar) > 20 and set(similar) <= set(passed) and len(passed) < len(pairs) / 3
