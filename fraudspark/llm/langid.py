"""Language of web pages, by fusing independent evidence with Bayes' rule.

Evidence for a language: how likely the page's visible text is (byte trigrams, learnt from labelled documents), the
language that the markup declares, the suffix of the address, and what else is on the host. The host's prior is
smoothed level by level: all pages, then the registered domain, then the host, each level pulled towards the one
above by ``PULL`` pages. These figures come from grouped aggregations over all pages, in which a page counts by the
probabilities of its text; its own share is taken out of the priors before it is judged by them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import per_batch, stored, whole_text

GRAM_BITS = 16  # trigrams are hashed to as many classes: the bound of the text model, per language
SAMPLE_ROWS = 4_000  # labelled documents that the text model is fitted on, chosen by a hash of the id
SMOOTH = 0.5
DEPENDENCE = 0.05  # neighbouring trigrams overlap and repeat: a text counts as this share of its trigrams, at most MOST
MOST = 40.0
PULL = 5.0  # pages that a level of the prior weighs against its own
DECLARED_SMOOTH, SUFFIX_SMOOTH = 1.0, 5.0

DECLARATION = re.compile(r"""<html\b[^<>]*?\s(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,8})""", re.IGNORECASE)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def visible_text(html: str) -> str:
    """Text outside tags, comments, scripts and styles, in one pass."""
    first, *rest = html.split("<")
    out, skip = [first], ""
    for part in rest:
        if skip == "--":
            part = "!--" + part
        low = part[:8].lower()
        if skip and skip != "--":
            if not low.startswith("/" + skip):
                continue
            skip = ""
        if low.startswith("!--"):
            end = part.find("-->", 3)
            skip = "" if end >= 0 else "--"
            if end >= 0:
                out.append(part[end + 3 :])
            continue
        name, closed, text = part.partition(">")
        if low.startswith(("script", "style")) and not name.endswith("/"):
            skip = "script" if low.startswith("script") else "style"
            continue
        out.append(text if closed else "")
    return " ".join(out)


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, white space and digits as one blank."""
    data = np.frombuffer(re.sub(r"[\s\d]+", " ", text.lower()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


def text_model(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probability of each hashed trigram in each; from a bounded sample of labelled documents."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.trim("lang") != ""))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = known.select("doc_id", F.lower(F.trim("lang")).alias("lang"), whole_text().alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                table = tables.setdefault(lang, np.zeros(1 << GRAM_BITS, np.int64))
                table += np.bincount(grams(text), minlength=len(table))
        for lang, table in tables.items():
            gram = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(table[gram])], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    table = np.full((1 << GRAM_BITS, len(languages)), SMOOTH)
    place = {lang: i for i, lang in enumerate(languages)}
    table[counts["gram"].to_numpy(), [place[x] for x in counts["lang"].to_pylist()]] += counts["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def text_evidence(pages: DataFrame, languages: list[str], weights: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, declared, likelihood): log likelihood of the text per language, tempered."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = shared.value
        declared, likelihood = [], []
        for html in batch["html"].to_pylist():
            found = DECLARATION.search(html)
            declared.append(found[1].lower() if found else "")
            seen = grams(visible_text(html))
            mean = table[seen].mean(axis=0, dtype=np.float64) if len(seen) else np.zeros(table.shape[1])
            likelihood.append(mean * min(MOST, DEPENDENCE * len(seen)))
        return pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["host"], pa.array(declared, pa.string()), pa.array(likelihood, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "likelihood"]
        )

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    rows = pages.select("page_id", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    out = rows.mapInArrow(per_batch(read), f"page_id {kind}, host string, declared string, likelihood array<double>")
    parts = F.split("host", r"\.")
    return out.select(
        "page_id", "host", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.element_at(parts, -1).alias("suffix"), "declared", "likelihood",
    )


def softmax(logs: Column) -> Column:
    high = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - high))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, host, declared, suffix, text_lang, lang, probability.

    ``lang`` is the language with the largest posterior (ties: the first by name). Null html or url count as empty:
    without text, declaration or host the prior decides. Repeated rows are judged each. Without labelled documents
    there are no languages, and text_lang, lang and probability are null. Other columns are not used.
    """
    languages, weights = text_model(docs)
    if not languages:
        empty = text_evidence(pages, ["?"], np.zeros((1 << GRAM_BITS, 1), np.float32))
        return empty.select("page_id", "host", "declared", "suffix", *[F.lit(None).cast(k).alias(c) for c, k in (("text_lang", "string"), ("lang", "string"), ("probability", "double"))])
    size = len(languages)
    rows = stored(text_evidence(pages, languages, weights).withColumn("own", softmax(F.col("likelihood"))), "page-evidence")

    def shares(*keys: str) -> DataFrame:
        """Sum of the pages' probabilities per language, per key."""
        sums = rows.groupBy(*keys).agg(*[F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(size)])
        return sums.select(*keys, F.array(*[f"s{i}" for i in range(size)]).alias("_".join(["n", *keys])))

    def joined(df: DataFrame, key: str) -> DataFrame:
        return df.join(shares(key), key)

    total = [float(x or 0) for x in shares().head()[0]]
    number = {k: rows.agg(F.approx_count_distinct(k)).head()[0] or 1 for k in ("declared", "suffix")}
    at = joined(joined(joined(joined(rows, "host"), "domain"), "suffix"), "declared")
    every = F.array(*[F.lit(x) for x in total])
    before = [F.greatest(every[i] - F.col("own")[i], F.lit(0.0)) for i in range(size)]
    prior = [(x + 1.0) / (sum(before) + float(size)) for x in before]
    for level in ("domain", "host"):
        counts = [F.greatest(F.col(f"n_{level}")[i] - F.col("own")[i], F.lit(0.0)) for i in range(size)]
        prior = [(counts[i] + PULL * prior[i]) / (sum(counts) + PULL) for i in range(size)]

    def likelihood(key: str, smooth: float, i: int):
        """Of the page's value, given the language; the page itself does not count."""
        seen = F.greatest(F.col(f"n_{key}")[i] - F.col("own")[i], F.lit(0.0))
        return (seen + smooth) / (before[i] + smooth * number[key])

    logs = F.array(*[
        F.log(prior[i]) + F.col("likelihood")[i] + F.log(likelihood("suffix", SUFFIX_SMOOTH, i))
        + F.when(F.col("declared") != "", F.log(likelihood("declared", DECLARED_SMOOTH, i))).otherwise(0.0)
        for i in range(size)
    ])
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda values: F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    out = at.withColumn("posterior", softmax(logs))
    return out.select(
        "page_id", "host", "declared", "suffix", best(F.col("own")).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability")
    )
