"""Name screening against a watch-list.

Candidate pairs come from an inverted index on tokens. Tokens are put in one order, rarest first; two
sets that overlap enough must share a token among the first few of each, so only those are indexed.
This loses no pair, and common tokens rarely reach the index.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudspark.functions.text import normalized, numbered_characters, trigrams
from fraudspark.operators.skew import first_n


def _indexed(texts: DataFrame, tokens: Column, share: float) -> DataFrame:
    """text -> tokens rarest first, and the prefix to index when a pair must share ``share`` of either set."""
    listed = texts.select("text", tokens.alias("tokens")).filter(F.size("tokens") > 0)
    exploded = listed.select("text", F.explode("tokens").alias("token"))
    frequency = exploded.groupBy("token").agg(F.count("*").alias("n"))
    ranked = (
        exploded.join(frequency, "token")
        .groupBy("text")
        .agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        .select("text", F.transform("ranked", lambda r: r["token"]).alias("tokens"))
    )
    size = F.size("tokens")
    keep = size - F.ceil(size * F.lit(share) - F.lit(1e-9)).cast("int") + 1
    return ranked.withColumn("size", size).withColumn("prefix", F.slice("tokens", F.lit(1), keep))


def overlapping_pairs(left: DataFrame, right: DataFrame, tokens, share: float) -> DataFrame:
    """Pairs of texts (``l_text``, ``r_text``) whose token sets may overlap by ``share`` of the larger set.

    Adds the exact overlap and both sizes. ``tokens`` maps a text column to its token array.
    """
    texts = left.select("text").union(right.select("text")).distinct()
    index = _indexed(texts, tokens(F.col("text")), share)
    side = lambda df, p: df.join(index, "text").select(
        *[F.col(c).alias(f"{p}_{c}") for c in ("text", "tokens", "size", "prefix")]
    )
    probe = side(left.select("text").distinct(), "l").withColumn("token", F.explode("l_prefix"))
    build = side(right.select("text").distinct(), "r").withColumn("token", F.explode("r_prefix"))
    sizes = (F.col("r_size") >= F.col("l_size") * share - 1e-9) & (F.col("l_size") >= F.col("r_size") * share - 1e-9)
    # A pair meets once per shared prefix token; it is kept at the first of them.
    first_shared = F.get(F.array_intersect("l_prefix", "r_prefix"), F.lit(0)) == F.col("token")
    return (
        probe.join(build, "token").filter(sizes & first_shared)
        # Through a generator, so that the overlap is worked out once and not in every later expression.
        .withColumn("overlap", F.explode(F.array(F.size(F.array_intersect("l_tokens", "r_tokens")))))
        .select("l_text", "r_text", "l_size", "r_size", "overlap")
    )


def trigram_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    pairs = overlapping_pairs(left, right, trigrams, threshold)
    similarity = F.col("overlap") / (F.col("l_size") + F.col("r_size") - F.col("overlap"))
    return pairs.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).select("l_text", "r_text", "similarity")


def screen_names(names: DataFrame, watch: DataFrame, threshold: float = 0.5, top: int = 5) -> DataFrame:
    """The ``top`` watch-list names per screened name by trigram similarity.

    ``names``: query_id, name. ``watch``: entity_id, name, name_normalized. Ties go to the smaller
    entity id, then the smaller name. Equal names are compared once, and of the entities that share a
    name only the first ``top`` can reach a result.
    """
    left = names.select("query_id", normalized(F.col("name")).alias("text"))
    right = watch.select("entity_id", "name", F.col("name_normalized").alias("text")).distinct()
    pairs = trigram_pairs(left, right, threshold)
    holders = first_n(right, ["text"], [F.col("entity_id"), F.col("name")], top).drop("rn")
    ranked = pairs.join(holders.withColumnRenamed("text", "r_text"), "r_text")
    best = first_n(
        ranked, ["l_text"], [F.desc("similarity"), F.col("entity_id"), F.col("name")], top, "match_rank"
    )
    return left.join(best.withColumnRenamed("l_text", "text"), "text").select(
        "query_id", "entity_id", F.col("name").alias("matched_name"), F.round("similarity", 4).alias("similarity"), "match_rank"
    )


def recent_entities(tx: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Every sender and receiver of the last days, once."""
    recent = tx.filter(F.col("event_time") > as_of - F.expr(f"INTERVAL '{days}' DAY"))
    senders = recent.select(F.col("sender_id").alias("entity"))
    receivers = recent.filter(F.col("receiver_id").isNotNull()).select(F.col("receiver_id").alias("entity"))
    return senders.union(receivers).distinct()


def screen_entities(entities: DataFrame, watch: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Best hit of each entity."""
    names = entities.select(F.col("entity").alias("query_id"), F.col("entity").alias("name"))
    return screen_names(names, watch, threshold, 1).select(
        F.col("query_id").alias("entity_name"), F.col("entity_id").alias("matched_entity_id"), "matched_name", "similarity"
    )


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def screen_ratio(names: DataFrame, watch: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs whose longest-blocks ratio on upper-cased names reaches the threshold.

    The ratio never exceeds the overlap of the letter bags, so pairs are first cut by that overlap,
    without loss, and only the rest is compared.
    """
    left = names.select("query_id", F.upper("name").alias("text"))
    right = watch.select("entity_id", F.upper("name").alias("text")).distinct()
    share = threshold / (2 - threshold)
    pairs = overlapping_pairs(left, right, numbered_characters, share).filter(
        2 * F.col("overlap") >= (F.col("l_size") + F.col("r_size")) * threshold - 1e-9
    )
    # Few bytes but much work per pair: a fixed number of partitions keeps all cores busy.
    spread = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l_text", "r_text")
    # Declared not deterministic, or the optimiser would move it below the cut by overlap.
    ratio = sequence_ratio.asNondeterministic()
    scored = spread.withColumn("ratio", ratio("l_text", "r_text")).filter(F.col("ratio") >= threshold)
    return (
        scored.join(left.withColumnRenamed("text", "l_text"), "l_text")
        .join(right.withColumnRenamed("text", "r_text"), "r_text")
        .select("query_id", "entity_id", F.round("ratio", 4).alias("ratio"))
    )
