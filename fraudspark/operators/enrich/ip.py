"""IP signals and network-list matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.net import ipv4_number, is_ipv4, is_ipv6, is_loopback, is_private
from fraudspark.operators.enrich.common import scored

# Text prefixes of cloud and proxy ranges.
DATACENTRE_PREFIXES = [
    "34.", "35.", "52.", "54.", "104.16.", "104.17.", "13.64.", "13.65.", "20.33.", "35.186.", "35.187.", "159.203.",
    "167.99.", "5.188.", "45.155.",
]


def clean_list(lines: DataFrame, kind: str | None = None) -> DataFrame:
    """Entries of a text list: trimmed, lower case, without blanks and comments, once each."""
    picked = lines.filter(F.col("kind") == kind) if kind else lines
    value = F.lower(F.trim("line"))
    columns = ["value"] if kind else ["kind", "value"]
    return picked.withColumn("value", value).filter((F.col("value") != "") & ~F.col("value").startswith("#")).select(*columns).distinct()


def longest_network(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """For each distinct IPv4 address and list: the length of the longest network that holds it.

    ``addresses``: ip_address. ``networks``: kind, value in CIDR form. One equi join on (prefix length,
    network number); there are at most 33 lengths, and only those that occur are tried.
    """
    bits = F.split("value", "/")
    parsed = networks.withColumn("bits", F.get(bits, F.lit(1)).try_cast("int")).withColumn(
        "number", ipv4_number(F.get(bits, F.lit(0)))
    ).filter(F.col("bits").between(0, 32) & F.col("number").isNotNull())
    shift = lambda number: F.floor(number / F.pow(F.lit(2.0), 32 - F.col("bits"))).cast("long")
    keyed = parsed.select("kind", "bits", shift(F.col("number")).alias("network")).distinct()
    lengths = keyed.agg(F.collect_set("bits")).scalar()
    probes = (
        addresses.select("ip_address").distinct().withColumn("number", ipv4_number(F.col("ip_address")))
        .filter(F.col("number").isNotNull())
        .withColumn("bits", F.explode(lengths)).withColumn("network", shift(F.col("number")))
    )
    return probes.join(keyed, ["bits", "network"]).groupBy("ip_address", "kind").agg(F.max("bits").alias("prefix_length"))


def network_flags(addresses: DataFrame, lists: DataFrame) -> DataFrame:
    """is_vpn, is_datacentre_network and is_tor_exit per distinct address, from the cleaned lists."""
    nets = longest_network(addresses, lists.filter(F.col("kind").isin("vpn", "datacentre")))
    tor = lists.filter(F.col("kind") == "tor").select(F.col("value").alias("ip_address")).distinct().withColumn("kind", F.lit("tor"))
    distinct = addresses.select("ip_address").distinct()
    hits = nets.select("ip_address", "kind").unionByName(distinct.join(tor, "ip_address"))
    found = hits.groupBy("ip_address").agg(
        F.bool_or(F.col("kind") == "vpn").alias("is_vpn"), F.bool_or(F.col("kind") == "datacentre").alias("is_datacentre_network"),
        F.bool_or(F.col("kind") == "tor").alias("is_tor_exit"),
    )
    none = F.lit(False)
    return distinct.join(found, "ip_address", "left").select(
        "ip_address", *[F.coalesce(c, none).alias(c) for c in ("is_vpn", "is_datacentre_network", "is_tor_exit")]
    )


def ip_signals(contacts: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds validity, kind, list flags, ``ip_factors`` and ``ip_score``."""
    ip = F.col("ip_address")
    joined = contacts.join(network_flags(contacts.filter(ip.isNotNull()), lists), "ip_address", "left")
    v4, v6 = is_ipv4(ip), is_ipv6(ip)
    base = (
        joined.withColumn("ip_version", F.when(v4, 4).when(v6, 6).otherwise(0))
        .withColumn("ip_private", is_private(ip)).withColumn("ip_loopback", is_loopback(ip))
        .withColumn("cloud_prefix", ip.rlike("^(" + "|".join(p.replace(".", r"\.") for p in DATACENTRE_PREFIXES) + ")"))
    )
    return scored(
        base,
        [
            ("private_or_loopback_ip", F.col("ip_private") | F.col("ip_loopback"), 15),
            ("datacenter_ip_detected", F.col("cloud_prefix"), 25),
            ("ipv6_address", F.col("ip_version") == 6, 5),
            ("vpn_cidr_match", F.col("is_vpn") & ~F.col("cloud_prefix"), 25),
            ("datacenter_cidr_match", F.col("is_datacentre_network") & ~F.col("cloud_prefix"), 25),
            ("tor_exit_node", F.col("is_tor_exit"), 40),
        ],
        "ip",
        ("invalid_ip_address", F.col("ip_version") == 0, 30),
    )
