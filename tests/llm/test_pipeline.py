"""The pipeline: each stage against what it should do with its own input."""

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from fraudspark.llm import quality
from fraudspark.llm.common import stored, table, tokenizer_path
from fraudspark.llm.tokens import Encoder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_stage_keeps_what_scores(spark, stages):
    _, before, after = stages[0]
    scores = {r.doc_id: r.score for r in quality.quality_scores(before, table(spark, SF, "labels")).collect()}
    assert set(rows(after)) == {i for i, s in scores.items() if s >= 0.7}
    good = [r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()]
    assert len(set(good) & set(rows(after))) >= 0.97 * len(good)


def test_line_stage(stages):
    _, before, after = stages[1]
    sites, first = defaultdict(set), {}
    for r in before.collect():
        for at, line in enumerate(r.text.split("\n")):
            if t := line.strip(" \t\r"):
                sites[t].add(r.source)
                first[t] = min(first.get(t, (r.doc_id, at)), (r.doc_id, at))
    wanted = {}
    for r in before.collect():
        kept = [x for at, x in enumerate(r.text.split("\n")) if len(sites.get(t := x.strip(" \t\r"), ())) < 10 or first[t] == (r.doc_id, at)]
        text = "\n".join(kept)
        if text == r.text or text.strip(" \t\r\n"):
            wanted[r.doc_id] = text
    found = rows(after)
    assert {i: r.text for i, r in found.items()} == wanted
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_near_dedup_stage(stages):
    _, before, after = stages[2]
    old, kept = rows(before), rows(after)
    sets = {}
    for i, r in old.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r.text).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() if len(h) > 1 for a in h for b in h if a < b}
    similar = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    assert all(kept[i] == old[i] for i in kept)
    close = [(a, b) for (a, b), s in similar.items() if s >= 0.82]
    assert close and sum(a in kept and b in kept for a, b in close) <= 0.01 * len(close)
    most = defaultdict(float)
    for (a, b), s in similar.items():
        most[b] = max(most[b], s)
        most[a] = max(most[a], s)
    assert all(most[i] >= 0.5 for i in set(old) - set(kept))  # nothing goes that is not much like another


def test_decontamination_stage(spark, stages):
    _, before, after = stages[3]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = re.findall(word, r.text.lower() if r.text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    def hits(text):
        w = re.findall(word, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return sum(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))

    old, new = rows(before), rows(after)
    dirty = {i for i, r in old.items() if hits(r.text)}
    assert dirty and all(new[i] == r for i, r in old.items() if i not in dirty)
    assert not any(hits(r.text) for i, r in new.items() if i in dirty)


def test_packing_stage(stages):
    _, before, after = stages[4]
    encoder = Encoder(tokenizer_path())
    pieces = after.toPandas()
    lengths = {i: len(x) // 4 + 1 for i, x in zip(rows(before), encoder.whole([r.text for r in rows(before).values()]), strict=True)}
    assert pieces.groupby("doc_id").length.sum().to_dict() == lengths
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert pieces.sequence_id.nunique() <= int(np.ceil(pieces.length.sum() / 2048)) + 2
    ordered = pieces.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum() - ordered.length
    assert (ends == ordered.offset).all()


def test_odd_rows_pass_every_stage(spark):
    given = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a text without an id", "en", None, 20), (3, "word " * 40_000, "en", "s", 200_000)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        out = start
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, out, SF), "odd")
        assert out.count() >= 0
