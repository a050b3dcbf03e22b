"""Stages give back all columns of their input, also where these have the names that the stages use inside."""

import pytest

from fraudspark.llm import decontam, lines, quality, simhash

EXTRA = ["_row", "_lines", "_removed", "_places", "_words", "_spans", "_items", "_quality", "_rest", "score", "place", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some text of number {i}\nshared line here", "en", f"s{i}", 10, *(f"{c}{i}" for c in EXTRA)) for i in range(12)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *EXTRA])


def extras(df):
    return {r.doc_id: tuple(r[c] for c in EXTRA) for r in df.collect()}


def test_all_columns_come_back(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "some text of number 3 shared line here")], "item_id long, text string")
    kept = [
        quality.keep_good(docs, labels, accept=0.4), lines.drop_furniture(docs, "source", 5),
        simhash.keep_one(docs, simhash.verified_documents(docs)), decontam.decontaminate(docs, items, window=4),
    ]
    for out in kept:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert extras(out).items() <= extras(docs).items()
    assert [len(extras(k)) for k in kept[:2]] == [12, 12]
