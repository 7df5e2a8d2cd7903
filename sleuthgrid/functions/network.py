"""Addresses as numbers."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"


def ip_number(address: Column) -> Column:
    """An IPv4 address as a long; null for anything else."""
    number = lambda p: ((p[0].cast("long") * 256 + p[1].cast("long")) * 256 + p[2].cast("long")) * 256 + p[3].cast("long")
    return F.when(address.rlike(IPV4), let(F.split(address, r"\."), number))


def cidr_range(cidr: Column) -> Column:
    """struct(start, end) of an IPv4 network."""
    bits = F.substring_index(cidr, "/", -1).cast("int")
    size = F.shiftleft(F.lit(1).cast("long"), 32 - bits)
    start = (ip_number(F.substring_index(cidr, "/", 1)) / size).cast("long") * size
    return F.struct(start.alias("start"), (start + size - 1).alias("end"))


def is_private(address: Column) -> Column:
    n = ip_number(address)
    within = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8), ("169.254.0.0", 16)]
    out = F.lit(False)
    for first, bits in within:
        start = sum(int(p) << (24 - 8 * i) for i, p in enumerate(first.split(".")))
        out = out | n.between(start, start + (1 << (32 - bits)) - 1)
    return out


# Networks that no end user is given, those of one edge provider, and internal ones.
UNROUTABLE = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 ::1/128 ::/128 fc00::/7 fe80::/10 2001:db8::/32 ff00::/8".split()
EDGE = "173.245.48.0/20 103.21.244.0/22 103.22.200.0/22 103.31.4.0/22 141.101.64.0/18 108.162.192.0/18 190.93.240.0/20 188.114.96.0/20 197.234.240.0/22 198.41.128.0/17 162.158.0.0/15 104.16.0.0/13 104.24.0.0/14 172.64.0.0/13 131.0.72.0/22 2400:cb00::/32 2606:4700::/32 2803:f800::/32 2405:b500::/32 2405:8100::/32 2a06:98c0::/29 2c0f:f248::/32".split()
INTERNAL = "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 224.0.0.0/4 0.0.0.0/32 fc00::/7 fe80::/10 ff00::/8 ::1/128 ::/128".split()


def ip6_hex(address: Column) -> Column:
    """An IPv6 address as 32 hex digits, in whose order addresses sort; null for anything else. Zones after % are dropped."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    shape = lambda t: t.rlike("^[0-9a-f:]*$") & t.contains(":") & ~t.rlike(":::|::.*::|^:[^:]|[^:]:$|[0-9a-f]{5}")
    parts = lambda t: F.struct(groups(F.substring_index(t, "::", 1)).alias("head"), groups(F.when(t.contains("::"), F.substring_index(t, "::", -1)).otherwise("")).alias("tail"), t.contains("::").alias("short"))

    def joined(p: Column) -> Column:
        missing = 8 - F.size(p["head"]) - F.size(p["tail"])
        filled = F.concat(p["head"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), p["tail"])
        return F.when(F.when(p["short"], missing >= 1).otherwise(missing == 0), F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))

    return let(F.lower(F.substring_index(F.trim(address), "%", 1)), lambda t: F.when(shape(t), let(parts(t), joined)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is written and worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def address_key(address: Column) -> Column:
    """4 and 8 hex digits, or 6 and 32: in the order of the addresses of each version; null if it isn't an address."""
    four = F.concat(F.lit("4"), F.lpad(F.hex(ip_number(F.trim(address))), 8, "0"))
    return F.lower(F.coalesce(four, F.concat(F.lit("6"), ip6_hex(address))))


def is_address(address: Column) -> Column:
    """Whether address_key knows it; the key itself isn't made. False for null."""
    return F.coalesce(F.trim(address).rlike(IPV4), F.lit(False)) | ip6_hex(address).isNotNull()


def within(address: Column, networks: list[str]) -> Column:
    """Whether an IPv4 or IPv6 address lies in one of the networks; null if it isn't an address."""
    keys = lambda n: [f"{n.version}{int(x):0{n.max_prefixlen // 4}x}" for x in (n.network_address, n.broadcast_address)]
    ranges = F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in (keys(ipaddress.ip_network(n)) for n in networks)))
    return let(address_key(address), lambda k: F.when(k.isNotNull(), F.exists(ranges, lambda r: k.between(r["lo"], r["hi"]))))


def is_eligible(address: Column) -> Column:
    """Whether an address is worth a lookup: an address, routable, and not of the edge provider."""
    return F.coalesce(~within(address, UNROUTABLE + EDGE), F.lit(False))


def is_public(address: Column) -> Column:
    return F.coalesce(~within(address, UNROUTABLE), F.lit(False))


def is_routable(address: Column) -> Column:
    """Whether it isn't internal plumbing; networks for documentation count as routable here."""
    return F.coalesce(~within(address, INTERNAL), F.lit(False))
