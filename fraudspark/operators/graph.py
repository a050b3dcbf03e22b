"""The payment graph: edges, neighbourhood features, k-hop networks, communities, fund flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.operators.components import connected_components
from fraudspark.session import kept_table

# Names of the graph features in contract order, and of the payment features before them.
GRAPH_FEATURES = [
    "graph_1hop_degree", "graph_1hop_unique_counterparties", "graph_1hop_amount_sum", "graph_1hop_amount_mean",
    "graph_1hop_amount_max", "graph_2hop_fanout", "graph_2hop_flagged_fraction", "graph_in_out_ratio", "graph_is_bridge",
    "graph_present",
]
PAYMENT_FEATURES = ["amount", "velocity_count", "hour_of_day", "is_weekend", "entity_risk", "cop_reason"]
MAX_FANOUT = 2500


def edge_aggregate(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("sender_id").isNotNull() & F.col("receiver_id").isNotNull()).groupBy("sender_id", "receiver_id").agg(
        F.sum("amount").alias("total_amount"), F.count("*").alias("tx_count"), F.max("currency").alias("currency")
    )


def _incident(tx: DataFrame) -> DataFrame:
    """Each payment once per party; a payment to oneself is one row with both flags."""
    row = lambda who, other, out, into: F.struct(
        F.col(who).alias("entity"), F.col(other).alias("counterparty"), out.alias("is_out"), into.alias("is_in")
    )
    loop = F.col("sender_id") == F.col("receiver_id")
    yes, no = F.lit(True), F.lit(False)
    sides = F.when(loop, F.array(row("sender_id", "receiver_id", yes, yes))).otherwise(
        F.array(row("sender_id", "receiver_id", yes, no), row("receiver_id", "sender_id", no, yes))
    )
    rest = [c for c in tx.columns if c not in ("sender_id", "receiver_id")]
    return tx.withColumn("__s", F.explode(sides)).select(*rest, "__s.*").filter(F.col("entity").isNotNull())


def _ratio(into: Column, out: Column) -> Column:
    return F.when(out > 0, into / out).otherwise(F.when(into > 0, 1.0).otherwise(0.0))


def _bridge(into: Column, out: Column, ratio: Column) -> Column:
    return F.when((into >= 3) & (out >= 1) & ratio.between(0.3, 5.0), 1.0).otherwise(0.0)


def graph_features(tx: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    """The ten neighbourhood features of every entity, over all its payments of the last hours."""
    recent = tx.filter(F.col("event_time") >= as_of - F.expr(f"INTERVAL '{hours}' HOUR"))
    amount = F.col("amount").cast("double")
    grouped = _incident(recent).groupBy("entity").agg(
        F.count("*").alias("degree"), F.countDistinct("counterparty").alias("uniq"),
        F.coalesce(F.sum(F.when(F.col("is_out"), F.col("amount"))).cast("double"), F.lit(0.0)).alias("amount_sum"),
        F.coalesce(F.max(F.when(F.col("is_out"), amount)), F.lit(0.0)).alias("amount_max"),
        F.count_if("is_out").alias("outs"), F.count_if("is_in").alias("ins"),
        F.count_if(F.coalesce(F.col("risk_score"), F.lit(0)) >= 50).alias("flagged"),
    )
    ins, outs, ratio = F.col("ins"), F.col("outs"), F.col("graph_in_out_ratio")
    return (
        grouped.withColumn("graph_in_out_ratio", _ratio(ins, outs))
        .select(
            "entity", F.col("degree").cast("double").alias("graph_1hop_degree"),
            F.col("uniq").cast("double").alias("graph_1hop_unique_counterparties"), F.col("amount_sum").alias("graph_1hop_amount_sum"),
            F.when(outs > 0, F.col("amount_sum") / outs).otherwise(0.0).alias("graph_1hop_amount_mean"),
            F.col("amount_max").alias("graph_1hop_amount_max"),
            F.least(F.col("uniq") * F.greatest(ins, F.lit(1)), F.lit(MAX_FANOUT)).cast("double").alias("graph_2hop_fanout"),
            (F.col("flagged") / F.col("degree")).alias("graph_2hop_flagged_fraction"), "graph_in_out_ratio",
            _bridge(ins, outs, ratio).alias("graph_is_bridge"), F.lit(1.0).alias("graph_present"),
        )
    )


def rolling_features(tx: DataFrame, as_of: Column, out_seconds: int = 120, in_days: int = 30) -> DataFrame:
    """The same features from the trailing windows: payments sent lately, senders of the last days."""
    amount = F.col("amount").cast("double")
    out = tx.filter(F.col("event_time") > as_of - F.expr(f"INTERVAL '{out_seconds}' SECOND")).select(
        F.col("sender_id").alias("entity"), F.col("external_id").alias("out_id"), F.lit(None).cast("string").alias("in_id"), amount.alias("amount")
    )
    into = tx.filter((F.col("event_time") > as_of - F.expr(f"INTERVAL '{in_days}' DAY")) & F.col("receiver_id").isNotNull()).select(
        F.col("receiver_id").alias("entity"), F.lit(None).cast("string").alias("out_id"), F.col("sender_id").alias("in_id"), F.lit(None).cast("double").alias("amount")
    )
    grouped = out.unionByName(into).groupBy("entity").agg(
        F.count("out_id").alias("outs"), F.count("in_id").alias("ins"), F.countDistinct("out_id").alias("out_ids"),
        F.countDistinct("in_id").alias("in_ids"), F.countDistinct(F.coalesce("out_id", "in_id")).alias("uniq"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount_sum"), F.coalesce(F.max("amount"), F.lit(0.0)).alias("amount_max"),
    )
    ins, outs, ratio = F.col("ins"), F.col("outs"), F.col("graph_in_out_ratio")
    return grouped.withColumn("graph_in_out_ratio", _ratio(ins, outs)).select(
        "entity", (outs + ins).cast("double").alias("graph_1hop_degree"), F.col("uniq").cast("double").alias("graph_1hop_unique_counterparties"),
        F.col("amount_sum").alias("graph_1hop_amount_sum"),
        F.when(outs > 0, F.col("amount_sum") / outs).otherwise(0.0).alias("graph_1hop_amount_mean"),
        F.col("amount_max").alias("graph_1hop_amount_max"),
        F.least(F.col("out_ids") * F.col("in_ids"), F.lit(MAX_FANOUT)).cast("double").alias("graph_2hop_fanout"),
        F.lit(0.0).alias("graph_2hop_flagged_fraction"), "graph_in_out_ratio", _bridge(ins, outs, ratio).alias("graph_is_bridge"),
        F.lit(1.0).alias("graph_present"),
    )


def merge_features(payments: DataFrame, graph: DataFrame, entity: str = "sender_id") -> DataFrame:
    """Payment features and graph features in contract order; an entity without graph has zeros."""
    joined = payments.join(graph.withColumnRenamed("entity", entity), entity, "left")
    kept = [c for c in payments.columns if c not in PAYMENT_FEATURES]
    return joined.select(
        *kept, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in [*PAYMENT_FEATURES, *GRAPH_FEATURES]]
    )


def _neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without loops and duplicates."""
    pair = F.array(
        F.struct(F.col("sender_id").alias("node"), F.col("receiver_id").alias("neighbour")),
        F.struct(F.col("receiver_id").alias("node"), F.col("sender_id").alias("neighbour")),
    )
    return edges.filter(F.col("sender_id") != F.col("receiver_id")).select(F.explode(pair).alias("p")).select("p.*").distinct()


ROOTS_PER_MASK = 63


def _near_together(roots: DataFrame, neighbours: DataFrame) -> DataFrame:
    """The different roots, in the order of the least node that they are next to or are.

    Roots that share much of their networks often stand side by side in that order, and then share the rows of a mask:
    the more so, the nearer the names of a network are. The result does not depend on it.
    """
    around = neighbours.groupBy(F.col("node").alias("root")).agg(F.min("neighbour").alias("least"))
    met = roots.select("root").distinct().join(around, "root", "left")
    return met.select("root", F.coalesce(F.least("least", "root"), "root").alias("least")).orderBy("least", "root").select("root")


def node_figures(edges: DataFrame) -> DataFrame:
    """Per node of the edge aggregate: payments sent and received, and their total; one to oneself is two payments and one amount."""
    own = F.col("sender_id") == F.col("receiver_id")
    side = lambda who, amount: edges.select(F.col(who).alias("node"), F.col("tx_count").alias("n"), amount.alias("amount"))
    amount = F.col("total_amount")
    both = side("sender_id", amount).unionByName(side("receiver_id", F.when(own, amount - amount).otherwise(amount)))
    return both.groupBy("node").agg(F.sum("n").alias("transaction_count"), F.sum("amount").alias("total_amount"))


def khop_network(edges: DataFrame, roots: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each root, for many roots at once.

    ``edges`` is the edge aggregate, ``roots`` has one column ``root``. Nodes carry their distance and figures; the
    edges of every node up to ``depth`` hops are included, so nodes one hop further appear as well.

    The search goes out from ``ROOTS_PER_MASK`` roots together: a row is a node with the set of roots that have come
    there, as bits, and what meets in a node is put together before the shuffle. Roots near each other are taken together,
    so that a row serves many of them. Only the result has a row per root.
    """
    edges = kept_table(edges, "khop-edges")
    neighbours = kept_table(_neighbours(edges), "khop-neighbours")
    numbered = kept_table(_near_together(roots, neighbours).withColumn("__id", F.monotonically_increasing_id()), "khop-roots")
    numbered = numbered.select(
        "root", F.expr(f"__id div {ROOTS_PER_MASK}").alias("block"), F.expr(f"shiftleft(1L, CAST(__id % {ROOTS_PER_MASK} AS INT))").alias("bit")
    )
    frontier = numbered.groupBy("block", F.col("root").alias("node")).agg(F.bit_or("bit").alias("mask")).withColumn("distance", F.lit(0))
    reached, last = frontier, frontier
    for step in range(1, depth + 2):
        before = frontier
        met = frontier.join(neighbours, "node").groupBy("block", F.col("neighbour").alias("node")).agg(F.bit_or("mask").alias("mask"))
        seen = last.groupBy("block", "node").agg(F.bit_or("mask").alias("seen"))  # a neighbour is at most one step nearer
        new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        fresh = met.join(seen, ["block", "node"], "left").withColumn("mask", new).filter("mask <> 0")
        frontier = kept_table(fresh.select("block", "node", "mask", F.lit(step).alias("distance")), "khop-reached")
        last = frontier.unionByName(before)
        reached = reached.unionByName(frontier)

    def by_root(rows: DataFrame) -> DataFrame:
        return rows.join(numbered, "block").filter(F.col("mask").bitwiseAND(F.col("bit")) != 0).drop("block", "mask", "bit")

    inner = reached.filter(F.col("distance") <= depth).groupBy("block", "node").agg(F.bit_or("mask").alias("mask"))
    columns = ["sender_id", "receiver_id", "total_amount", "tx_count", "currency"]
    touching = (
        inner.join(edges, F.col("node") == F.col("sender_id")).select("block", "mask", *columns)
        .unionByName(inner.join(edges, F.col("node") == F.col("receiver_id")).select("block", "mask", *columns))
        .groupBy("block", *columns).agg(F.bit_or("mask").alias("mask"))
    )
    nodes = reached.join(node_figures(edges), "node", "left")
    return by_root(nodes).select("root", "node", "distance", "transaction_count", "total_amount"), by_root(touching).select("root", *columns)


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the component is named by its smallest node. Rounds grow with the logarithm of the nodes."""
    return connected_components(edges, "sender_id", "receiver_id")


def communities(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, payments inside and their total per component of more than one node; members are ``labels``."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    inside = (
        tx.join(labels.withColumnRenamed("node", "sender_id"), "sender_id")
        .groupBy("component").agg(F.count("*").alias("tx_count"), F.sum("amount").alias("total_amount"))
    )
    return sizes.join(inside, "component", "left")


def fund_flow(tx: DataFrame) -> DataFrame:
    """Money in, out and net per entity, with the number of payments each way."""
    amount = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("amount"))), F.lit(0))
    flows = _incident(tx).groupBy("entity").agg(
        amount("is_in").alias("total_in"), amount("is_out").alias("total_out"), F.count_if("is_in").alias("count_in"), F.count_if("is_out").alias("count_out")
    )
    return flows.withColumn("net_flow", F.col("total_in") - F.col("total_out"))
