"""Archives: round trip against hashlib, and the files read by their own format."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

from fraudspark.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, key int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least):
    groups = {}
    for page_id, _, html, *_ in rows:
        if len((html or "").encode()) >= least:
            groups.setdefault(html or "", []).append(page_id)
    out = []
    for html, ids in groups.items():
        ids = sorted(ids)
        out += [(p, len(html.encode()), digest(html), "response" if i == 0 else "revisit", None if i == 0 else ids[0]) for i, p in enumerate(ids)]
    out += [(p, len((h or "").encode()), digest(h), "response", None) for p, _, h, *_ in rows if len((h or "").encode()) < least]
    return sorted(out, key=str)


def pages():
    rng = random.Random(3)
    bodies = ["", None, "é" * 10, "a\r\n\r\nWARC/1.1\r\nb", "\r\n\r\n", "<html>\n" + "x" * 2_000_000, "tail\r\n", "😀"]
    rows = [(i, rng.choice([None, "http://h.example/a b", f"http://h.example/{i}"]), rng.choice(bodies), "clash", 1) for i in rng.sample(range(1000), 60)]
    return [*rows, rows[0], rows[0], (rows[0][0], "http://other", rows[0][2], "clash", 2)]


def test_round_trip_against_a_plain_version(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for least in (0, 5):
        path = str(tmp_path / f"w{least}")
        found = warc.archive(df, least, path)
        assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == plain(rows, least)
        stored = warc.read_archives(spark, path, with_payload=True).filter("record_type = 'response'").collect()
        bodies = {digest(h): (h or "").encode() for _, _, h, *_ in rows}
        assert all(bytes(r.payload) == bodies[r.payload_digest] for r in stored)


def test_files_are_archives(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA), str(path), records_per_file=10)
    ids, refers = [], []
    for file in path.glob("part-*"):
        data = gzip.decompress(file.read_bytes())
        found = list(warc.records(data))
        assert len(found) <= 10
        for headers, start, end in found:
            assert data[start - 4 : start] == b"\r\n\r\n" and end - start == int(headers["Content-Length"])
            ids.append(headers["WARC-Record-ID"])
            refers += [headers["WARC-Refers-To"]] if headers["WARC-Type"] == "revisit" else []
    assert len(ids) == len(pages()) and set(refers) <= set(ids)


def test_empty_table_and_query(spark, sf_dir):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
    from fraudspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op10_warc"](spark, sf_dir).collect()), key=str) == plain(rows, 0)
