"""Secret scan against plain regular expressions over the whole text, and checksums made here."""

import hashlib
import random
import re
import zlib

from fraudspark.llm import secrets

SCHEMA = "doc_id long, text string, spans string"


def base_spans(text):
    text = text or ""
    found = []
    for kind, pattern, group, least in (("assign", secrets.ASSIGN, 2, 12), ("access", secrets.ACCESS, 0, 18), ("hex", secrets.HEX, 0, 16)):
        flags = re.ASCII | re.IGNORECASE if kind == "assign" else 0
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [s for _, _, s in sorted(found)]


def random_texts():
    rng = random.Random(4)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "toKen", "ſecret", "AKIA", "AKIAAKIA", "=", ":", " = ", '"', "'", " ", "\n", "0123456789abcdef", "deadbeef" * 3, "ABCDEFGH12345678", "abc/def+gh.i=j-k", "é", "😀", "x", "İ"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(1500)]


def crc_token(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    return prefix + body + digits.rjust(6, "0")


def xkey(first):
    data = bytes.fromhex("0488ade4") + first * 74
    data += hashlib.sha256(hashlib.sha256(data).digest()).digest()[:4]
    value, out = int.from_bytes(data, "big"), ""
    while value:
        value, d = divmod(value, 58)
        out = secrets.BASE58[d] + out
    return out


def test_base_spans_against_plain_expressions(spark):
    texts = [None, "", *random_texts(), "token=" + "a1" * 50_000 + " " + "f" * 40_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "secret: abcdefghijkl", "clash"), (1, "", "clash")]
    found = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for doc_id, text, _ in rows:
        base, r = base_spans(text), by_id[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (text, base, r.spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in secrets.BASE_KINDS] == base


def test_checksums(spark):
    good = crc_token("ghp_", "Abcdefghij0123456789ABCDEFGHIJ")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    key = xkey(b"\x07")
    rows = [(1, f"é {good}", ""), (2, bad, ""), (3, f"({key})", ""), (4, key[:-1] + ("2" if key[-1] != "2" else "3"), ""), (5, good + "Z", "")]
    found = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1] == "crc:2:42" and found[3] == f"xkey:1:{1 + len(key)}"
    assert "crc" not in found[2] and "xkey" not in found[4] and "crc" not in found[5]


def test_empty_table(spark):
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_plain_expressions(spark, sf_dir):
    from fraudspark.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op4_secrets"](spark, sf_dir).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(base_spans(texts[r.doc_id])).encode()).hexdigest()
