"""Line dedup against DuckDB on the given tables, and against a plain version on odd rows."""

import random

import duckdb
import pytest

from fraudspark.llm import lines

SCHEMA = "doc_id long, text string, source string, n_chars long, place string"


def plain(rows, least):
    places, first = {}, {}
    for doc_id, text, source, *_ in rows:
        for at, line in enumerate((text or "").split("\n")):
            t = line.strip(" \t\r")
            if t:
                places.setdefault(t, set()).add(source or "")
                first[t] = min(first.get(t, (doc_id, at)), (doc_id, at))
    out = []
    for doc_id, text, source, *rest in rows:
        kept = [x for at, x in enumerate((text or "").split("\n")) if len(places.get(t := x.strip(" \t\r"), ())) < least or first[t] == (doc_id, at)]
        out.append((doc_id, "\n".join(kept) if text is not None else None, source))
    return sorted(out)


@pytest.mark.parametrize("least,lg_k", [(2, 4), (3, 12), (5, 8)])
def test_lines_against_a_plain_version(spark, least, lg_k):
    rng = random.Random(least)
    common = [f"common {i}" for i in range(12)]
    rows = [
        (i, "\n".join(rng.choice([rng.choice(common), f" own {rng.randint(0, 400)} \t", "", "  ", f"{rng.choice(common)}  "]) for _ in range(rng.randint(0, 12))), rng.choice([None, "", *(f"s{k}" for k in range(8))]), 5, "clash")
        for i in range(120)
    ]
    rows += [(200, None, "s1", None, "clash"), (201, "common 1\n" * 3000 + "end", "s2", 3, "clash")]
    out = lines.remove_furniture(spark.createDataFrame(rows, SCHEMA).repartition(3), "source", least, lg_k)
    assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == plain(rows, least)
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "_lines", "_removed"]


def test_repeated_rows_and_blanked_documents(spark):
    rows = [(i, "same line", f"s{i}", 9, "k") for i in range(5)] + [(0, "same line", "s0", 9, "k"), (9, "", "s1", 0, "k"), (8, "same line\nmore", "s8", 14, "k")]
    kept = lines.drop_furniture(spark.createDataFrame(rows, SCHEMA), "source", 3).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept) == [(0, "same line", 9), (0, "same line", 9), (8, "more", 4), (9, "", 0)]
    assert lines.drop_furniture(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_duckdb(spark, sf):
    from fraudspark.llm.queries import ORACLES, QUERIES

    found = QUERIES["op6_lines"](spark, f"/root/testdata/{sf}").toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/{sf}/documents.parquet')")
    wanted = con.sql(ORACLES["op6_lines"]).df()
    assert sorted(map(tuple, found[wanted.columns].values.tolist())) == sorted(map(tuple, wanted.values.tolist()))


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    from fraudspark.llm.queries import QUERIES

    QUERIES["op6_lines"](spark, sf_dir).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


@pytest.mark.parametrize("sites", range(2, 10))
def test_long_passages_on_few_sites_go(spark, sites):
    passage = " ".join(f"word{i}" for i in range(55))
    short = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"own {i}\n{passage}\n{short}", f"s{i}", 0, "k") for i in range(sites)] + [(99, f"own\n{passage}x", "s0", 0, "k")]
    kept = {r.doc_id: r.text for r in lines.drop_furniture(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept.pop(99) == f"own\n{passage}x"
    assert kept.pop(0) == f"own 0\n{passage}\n{short}"
    assert kept == {i: f"own {i}\n{short}" for i in range(1, sites)}
