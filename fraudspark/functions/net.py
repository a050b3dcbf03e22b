"""IP address expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(\.{OCTET}){{3}}"

# IPv4 blocks that are not public, and the two public addresses inside one of them.
PRIVATE_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
]
PUBLIC_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(f"^{IPV4}$"), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    """Eight groups of up to four hex digits, or fewer with one ``::``; the end may be a dotted IPv4."""
    text = F.regexp_replace(F.lower(ip), f"{IPV4}$", "0:0")
    groups = F.split(text, ":")
    filled = F.filter(groups, lambda g: g != "")
    short = F.size(F.split(text, "::")) - 1
    ends_right = (~text.rlike("^:[^:]") & ~text.rlike("[^:]:$"))
    fits = F.when(short == 0, (F.size(groups) == 8) & (F.size(filled) == 8)).otherwise((short == 1) & (F.size(filled) <= 7))
    ok = text.rlike("^[0-9a-f:]+$") & ~F.contains(text, F.lit(":::")) & F.forall(groups, lambda g: F.length(g) <= 4) & ends_right & fits
    return F.coalesce(ok, F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a long; null where it is not IPv4."""
    parts = F.split(ip, r"\.")
    number = reduce(lambda acc, i: acc * 256 + F.get(parts, F.lit(i)).try_cast("long"), range(1, 4), F.get(parts, F.lit(0)).try_cast("long"))
    return F.when(is_ipv4(ip), number)


def _block(number: Column, cidr: str) -> Column:
    base, bits = cidr.split("/")
    first = reduce(lambda acc, part: acc * 256 + int(part), base.split("."), 0)
    return number.between(first, first + 2 ** (32 - int(bits)) - 1)


def is_private(ip: Column) -> Column:
    number = ipv4_number(ip)
    inside = reduce(Column.__or__, [_block(number, b) for b in PRIVATE_BLOCKS])
    excepted = reduce(Column.__or__, [_block(number, b) for b in PUBLIC_EXCEPTIONS])
    text = F.lower(ip)
    first = F.conv(F.split(text, ":")[0], 16, 10).try_cast("long")
    second = F.coalesce(F.conv(F.get(F.split(text, ":"), F.lit(1)), 16, 10).try_cast("long"), F.lit(0))
    v6 = (
        is_loopback(ip) | text.isin("::", "0:0:0:0:0:0:0:0") | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF)
        | ((first == 0x2001) & ((second == 0xDB8) | (second < 0x200))) | text.startswith("::ffff:") | text.startswith("100:0:0:0:")
    )
    return F.coalesce(F.when(is_ipv4(ip), inside & ~excepted).when(is_ipv6(ip), v6), F.lit(False))


def is_loopback(ip: Column) -> Column:
    return F.coalesce(_block(ipv4_number(ip), "127.0.0.0/8"), F.lit(False)) | F.lower(ip).isin("::1", "0:0:0:0:0:0:0:1")
