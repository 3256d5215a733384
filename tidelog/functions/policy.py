"""Names, patterns and addresses as column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_name_ok(name, client: bool = True) -> Column:
    """1 to 249 characters, letters, digits, dot, underscore or hyphen, no two dots together; clients get no `__` names."""
    n = _col(name)
    ok = (F.length(n) >= 1) & (F.length(n) <= 249) & n.rlike(r"\A[\p{L}\p{N}._-]+\z") & ~F.contains(n, F.lit(".."))
    return F.coalesce(ok & ~F.startswith(n, F.lit("__")) if client else ok, F.lit(False))


def glob_match(pattern, text) -> Column:
    """`*` stands for any run of characters, everything else for itself."""
    escaped = F.regexp_replace(_col(pattern), r"([^*\p{L}\p{N}])", r"\\$1")
    return F.regexp_like(_col(text), F.concat(F.lit(r"(?s)\A"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit(r"\z")))


def ipv4(address) -> Column:
    """The address as a number; null if it isn't one."""
    parts = F.split(_col(address), r"\.")
    number = [F.element_at(parts, k + 1).cast("long") for k in range(4)]
    total = number[0] * 16777216 + number[1] * 65536 + number[2] * 256 + number[3]
    return F.when(_col(address).rlike(r"\A(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}\z"), total)


def cidr_contains(network: str, address) -> Column:
    """Whether the IPv4 or IPv6 address lies in the network; of different kinds it never does."""
    import ipaddress

    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        shift = 32 - net.prefixlen
        return F.coalesce(F.shiftrightunsigned(ipv4(address), shift) == (int(net.network_address) >> shift), F.lit(False))

    @F.pandas_udf("boolean")
    def inside(values):
        def one(v):
            try:
                return ipaddress.ip_address(v) in net
            except ValueError:
                return False

        return values.map(one).astype(bool)

    return inside(F.coalesce(_col(address), F.lit("")))
