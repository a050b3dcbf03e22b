"""Language of pages: parts against plain versions, the fusion against the same sums in Python."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from fraudspark.llm import langid

SCHEMA = "page_id long, url string, html string, lang string, own int"


def plain_text(html):
    html = re.sub(r"<!--.*?(-->|$)", "<!---->", html, flags=re.S)
    html = re.sub(r"<(script|style)[^>]*>.*?(?=</\1|$)", "<x>", html, flags=re.S | re.I)
    return re.sub(r"<[^>]*(>|$)", " ", html)


@pytest.mark.parametrize("html", [
    "", "plain", "<p>a</p> b", "<script>if (a<b) x('</p>')</script>tail", "<STYLE>p{}</STYLE>x", "a<!-- <b>no</b> -->b", "a<!-- open", "<p>a<!-- x > y --> z <i>q</i>",
    "<script>never closed <p>", "a < b > c", "<br/>x<br>",
])
def test_visible_text(html):
    assert langid.visible_text(html).split() == plain_text(html).split()


def test_long_pages_take_one_pass():
    assert langid.visible_text("<script" * 200_000) == ""
    assert len(langid.visible_text("<p>word" * 200_000).split()) == 200_000


def pages():
    texts = {"en": "the water and the house were there with this", "de": "der Hund und die Katze sind nicht hier für ein", "fr": "le chat et la maison sont dans une rue avec"}
    out = []
    for i in range(60):
        lang = ["en", "de", "fr"][i % 3]
        body = texts[lang] if i % 5 else ""
        declared = f'<html lang="{lang}-X">' if i % 4 else "<html>"
        host = ["a.example.com", "b.example.com", "shop.de.example", "x.fr"][i % 4 if i % 3 else 2]
        out.append((i, f"https://u:p@{host}:80/p?{i}", f"{declared}<body>{body}</body>", "clash", 1))
    return [*out, out[3], (90, None, None, "c", 1), (91, "not an address", "<html lang=de>", "c", 1), (None, "http://x.fr/", texts["fr"], "c", 1), (92, "http://a.example.com", "the " * 50_000, "c", 1)]


def docs(spark):
    rows = [(1, "the water and the house were there with this and that", "en"), (2, "der Hund und die Katze sind nicht hier für ein Haus", "de"), (3, "le chat et la maison sont dans une rue avec vous", "fr"), (4, None, "en"), (5, "unlabelled", None), (6, "", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def fused(given, languages, weights):
    size, rows = len(languages), []
    for page_id, url, html, *_ in given:
        seen = langid.grams(langid.visible_text(html or ""))
        like = weights[seen].mean(axis=0, dtype=float) * min(langid.MOST, langid.DEPENDENCE * len(seen)) if len(seen) else np.zeros(size)
        own = np.exp(like - like.max())
        host = (re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "") or ["", ""])[1].lower()
        parts = host.split(".")
        found = langid.DECLARATION.search(html or "")
        rows.append({"id": page_id, "like": like, "own": own / own.sum(), "host": host, "domain": ".".join(parts[-2:]), "suffix": parts[-1], "declared": found[1].lower() if found else ""})
    sums = {k: defaultdict(lambda: np.zeros(size)) for k in ("host", "domain", "suffix", "declared")}
    for r in rows:
        for k, table in sums.items():
            table[r[k]] += r["own"]
    total, out = sum(r["own"] for r in rows), []
    for r in rows:
        rest = total - r["own"]
        prior = (rest + 1) / (rest.sum() + size)
        for k in ("domain", "host"):
            n = np.maximum(sums[k][r[k]] - r["own"], 0)
            prior = (n + langid.PULL * prior) / (n.sum() + langid.PULL)
        logs = np.log(prior) + r["like"]
        for k, smooth in (("suffix", langid.SUFFIX_SMOOTH), ("declared", langid.DECLARED_SMOOTH)):
            if k == "suffix" or r[k]:
                logs = logs + np.log((np.maximum(sums[k][r[k]] - r["own"], 0) + smooth) / (rest + smooth * len(sums[k])))
        p = np.exp(logs - logs.max())
        out.append((str(r["id"]), r["host"], r["declared"], languages[int(np.argmax(p))], round(float(p.max() / p.sum()), 6)))
    return sorted(out)


def test_fusion_against_plain_sums(spark):
    given = pages()
    languages, weights = langid.text_model(docs(spark))
    assert languages == ["de", "en", "fr"] and np.allclose(np.exp(weights.astype(float)).sum(axis=0), 1, atol=1e-3)
    found = langid.identify(spark.createDataFrame(given, SCHEMA).repartition(3), docs(spark)).collect()
    assert sorted((str(r.page_id), r.host, r.declared, r.lang, round(r.probability, 6)) for r in found) == fused(given, languages, weights)
    assert all(math.isfinite(r.probability) for r in found)


def test_evidence_beyond_the_text(spark):
    found = {r.page_id: r for r in langid.identify(spark.createDataFrame(pages(), SCHEMA), docs(spark)).collect()}
    assert found[55].declared == "de" and found[55].lang == "de"  # no text, a declaration
    assert found[91].lang == "de"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none, docs(spark)).count() == 0
    unlabelled = langid.identify(spark.createDataFrame(pages(), SCHEMA), docs(spark).limit(0)).collect()
    assert len(unlabelled) == len(pages()) and {r.lang for r in unlabelled} == {None}


def test_query_agrees_with_articles(spark):
    from fraudspark.llm.queries import QUERIES

    rows = QUERIES["op9_langid"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) == 250 and (rows.lang == rows.declared).mean() > 0.98 and (rows.text_lang == rows.declared).mean() > 0.97
