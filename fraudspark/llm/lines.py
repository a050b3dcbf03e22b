"""Line dedup: lines that spread over many sites are site furniture, and all but their first place go.

Lines of many words repeat by copying, not by chance, so they count as furniture on fewer sites than short ones.

Every line is reduced to a hash. One aggregation gives each hash a HyperLogLog sketch of the sites it is on, built
before the shuffle and merged after it, so a line on a third of all pages costs one small row per task. A line whose
estimate is far from the threshold is decided by it; only near the threshold are different sites counted exactly.
DataFrame functions only.
"""

from __future__ import annotations

from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import set_apart, stored, whole_text

LEAST_SITES = 10
LONG_WORDS, LONG_SITES = 50, 2  # a passage of so many words is furniture on fewer sites
LG_K = 12  # registers of a sketch, as a power of two
ERRORS = 5  # standard errors around the threshold within which sites are counted exactly
BLANK = " \t\r"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, site: str) -> DataFrame:
    """(row, place, h, g, site, long) of every line that is not blank; ``row`` is doc_id and a hash of the text, h and g name the line.

    ``long`` tells lines of ``LONG_WORDS`` words or more, counted by single blanks.
    """
    rows = docs.select(_row().alias("row"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(split_lines(whole_text())).alias("place", "line"))
    line = F.btrim(F.col("line"), F.lit(BLANK))
    blanks = F.length(line) - F.length(F.translate(line, " ", ""))
    return rows.filter(line != "").select("row", "place", F.xxhash64(line).alias("h"), F.hash(line).alias("g"), "site", (blanks >= LONG_WORDS - 1).alias("long"))


def _row() -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64(whole_text()).alias("text_key"))


def furniture(lines: DataFrame, least_sites: int = LEAST_SITES, lg_k: int = LG_K, long_sites: int = LONG_SITES) -> DataFrame:
    """(h, g, first): lines on ``least_sites`` sites or more, long ones on ``long_sites``, with the place that comes first by id and line number."""
    margin = ERRORS * 1.04 / sqrt(1 << lg_k)
    by_length = lambda short, long: F.when(F.col("long"), long).otherwise(short)
    low = by_length(*(floor(n * (1 - margin)) for n in (least_sites, long_sites)))
    high = by_length(*(ceil(n * (1 + margin)) for n in (least_sites, long_sites)))
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("row", "place")).alias("first"), F.count("*").alias("n"), F.max("long").alias("long"))
    spread = spread.filter(F.col("n") >= by_length(least_sites, long_sites)).select("h", "g", F.hll_sketch_estimate("sketch").alias("sites"), "first", "long").filter(F.col("sites") >= low)
    spread = stored(spread, "line-spread")
    near = spread.filter(F.col("sites") <= high)
    counted = lines.join(near.select("h", "g"), ["h", "g"], "left_semi").select("h", "g", "site", "long").distinct().groupBy("h", "g").agg(F.count("*").alias("exact"), F.max("long").alias("long"))
    near = near.join(counted.filter(F.col("exact") >= by_length(least_sites, long_sites)), ["h", "g"], "left_semi")
    return spread.filter(F.col("sites") > high).unionByName(near).select("h", "g", "first")


def remove_furniture(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES, lg_k: int = LG_K, long_sites: int = LONG_SITES) -> DataFrame:
    """``docs`` without repeated site furniture, and two more columns: ``_lines`` and ``_removed``, counts of lines.

    Lines are compared without blanks at their ends; blank lines stay. The first place of a line, by doc_id and line
    number, stays, so nothing is lost from the corpus. A document that consists of such lines is left with an empty
    text; rows with the same id and text are treated alike. A null site is a site of its own, a null text stays null.
    """
    lines = stored(hashed_lines(docs, site), "lines")
    marked = lines.join(furniture(lines, least_sites, lg_k, long_sites), ["h", "g"]).filter(F.struct("row", "place") != F.col("first"))
    removed = marked.groupBy("row").agg(F.collect_set("place").alias("_places")).withColumnRenamed("row", "_row")
    joined = docs.withColumn("_row", _row()).join(removed, "_row", "left")
    before = split_lines(F.col("text").cast("string"))
    after = F.array_join(F.filter(before, lambda _, i: ~F.array_contains("_places", i)), "\n")
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(after)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(split_lines(whole_text())), F.lit(0)).cast("long").alias("_lines"),
        F.coalesce(F.size(F.array_compact("_places")), F.lit(0)).cast("long").alias("_removed"),
    )


def line_report(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """Per document: lines, removed lines, and length and MD5 of the text that is left (null: empty)."""
    out = remove_furniture(docs.select("doc_id", "text", site), site, least_sites)
    return out.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"),
        F.length(whole_text()).cast("long").alias("kept_chars"), F.md5(whole_text()).alias("text_md5"),
    )


def drop_furniture(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """``docs`` with its own columns; documents of which only blanks are left go, as every line of theirs stays elsewhere."""
    packed, restore = set_apart(docs, "doc_id", "text", site, "n_chars")
    out = remove_furniture(packed, site, least_sites)
    out = out.filter((F.col("_removed") == 0) | (F.btrim(whole_text(), F.lit(BLANK + "\n")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed") == 0, F.col("n_chars")).otherwise(F.length(whole_text()).cast(docs.schema["n_chars"].dataType)))
    return restore(out)


def oracle_ctes(documents: str = "documents", least_sites: int = LEAST_SITES, long_sites: int = LONG_SITES) -> str:
    """SQL of the same rows: ``cleaned`` (all columns but n_chars, n_lines, n_removed, kept)."""
    trimmed = "trim(line, ' ' || chr(9) || chr(13))"
    return f"""
split AS (SELECT doc_id, lang, source, n_chars, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
lines AS (SELECT doc_id, source, place, ls[place] AS line FROM (SELECT doc_id, source, ls, unnest(generate_series(1, len(ls))) AS place FROM split)),
far AS (SELECT {trimmed} AS t, min((doc_id, place)) AS first FROM lines WHERE {trimmed} <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(source, '')) >= CASE WHEN length({trimmed}) - length(replace({trimmed}, ' ', '')) >= {LONG_WORDS - 1} THEN {long_sites} ELSE {least_sites} END),
gone AS (SELECT doc_id, place FROM lines JOIN far ON {trimmed} = far.t WHERE (doc_id, place) <> far.first),
left_over AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS kept FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id),
cleaned AS (SELECT s.doc_id, s.lang, s.source, s.n_chars, s.text, len(s.ls)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed, coalesce(o.kept, '') AS kept
            FROM split s LEFT JOIN left_over o ON s.doc_id = o.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) n ON s.doc_id = n.doc_id)"""


ORACLE = f"WITH {oracle_ctes()} SELECT doc_id, n_lines, n_removed, length(kept)::BIGINT AS kept_chars, md5(kept) AS text_md5 FROM cleaned"
