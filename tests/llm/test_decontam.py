"""Decontamination against plain window search."""

import hashlib
import random
import re

import pytest

from fraudspark.llm import decontam

DOCS, ITEMS = "doc_id long, text string, n_chars long, item_id string", "item_id long, text string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, window):
    wanted = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(window, len(p))
            for i in range(max(0, len(p) - n + 1) if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == p[i : i + n]:
                        hit |= set(range(at, at + n))
                        found.add(item)
        ids = ",".join(sorted(map(str, found)))
        wanted.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(wanted, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "E1", "f"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(14)] + [(3, "a b c"), (20, "a b c"), (21, None), (22, "")]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices([*vocabulary, "zz"], k=rng.randint(0, 60))), 1, "clash") for i in range(60)]
    return [*docs, docs[0], (99, None, None, "x"), (None, "a b c a b c", 3, "x"), (98, "", 0, "x"), (97, "a b " * 4000, 1, "x")], items


@pytest.mark.parametrize("seed,shard_words", [(1, 10_000), (2, 15), (3, 1)])
def test_hits_against_window_search(spark, seed, shard_words):
    docs, items = cases(seed)
    docs = docs[:-1] if seed > 1 else docs
    found = decontam.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), window=4, shard_words=shard_words)
    assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == plain(docs, items, 4)


def test_empty_tables(spark):
    docs, items = cases(1)
    none = decontam.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS))
    assert none.count() == 0
    clean = decontam.contamination(spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame([], ITEMS)).collect()
    assert [r.n_hit for r in clean] == [0] * 5 and not any(r.contaminated for r in clean)


def test_spans_are_cut_and_covered_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before it,  {item.upper()}! After it there are many more words than before, so the text remains whole.", 9, "k"), (2, f"X {item}.", 9, "k"), (3, "clean", 9, "k"), (4, None, None, "k")]
    kept = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], ITEMS)).collect()}
    assert sorted(kept) == [1, 3, 4]
    assert kept[1].text == "Before it,  ! After it there are many more words than before, so the text remains whole."
    assert kept[1].n_chars == len(kept[1].text) and kept[1].item_id == "k"
    assert (kept[3].text, kept[3].n_chars, kept[4].text, kept[4].n_chars) == ("clean", 9, None, None)
