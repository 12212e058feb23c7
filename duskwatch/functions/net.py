"""IPv4 predicates on dotted quads without Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges that count as private, by first address and number of host bits.
PRIVATE_RANGES = (
    ("0.0.0.0", 24),
    ("10.0.0.0", 24),
    ("127.0.0.0", 24),
    ("169.254.0.0", 16),
    ("172.16.0.0", 20),
    ("192.0.0.0", 8),
    ("192.0.2.0", 8),
    ("192.168.0.0", 16),
    ("198.18.0.0", 17),
    ("198.51.100.0", 8),
    ("203.0.113.0", 8),
    ("240.0.0.0", 28),
)

_QUAD = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def ip_number(ip: Column) -> Column:
    """Address as a number, null if it isn't a dotted quad. A port behind a colon is ignored."""
    host = F.split_part(ip, F.lit(":"), F.lit(1))
    parts = F.split(host, r"\.")
    value = reduce(lambda acc, i: acc * 256 + F.try_element_at(parts, F.lit(i)).try_cast("long"), (2, 3, 4), F.try_element_at(parts, F.lit(1)).try_cast("long"))
    return F.when(host.rlike(_QUAD), value)


def _as_number(ip: str) -> int:
    return reduce(lambda acc, part: acc * 256 + int(part), ip.split("."), 0)


def _in_range(number: Column, first: str, bits: int) -> Column:
    low = _as_number(first)
    return number.between(low, low + (1 << bits) - 1)


def is_private(ip: Column) -> Column:
    """True for private, loopback, link-local and reserved addresses and for anything that isn't an address."""
    inside = lambda n: reduce(lambda acc, r: acc | _in_range(n, *r), PRIVATE_RANGES, F.lit(False))
    return F.coalesce(_once(ip_number(ip), inside), F.lit(True))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time per row."""
    return F.get(F.transform(F.array(value), use), 0)


def ip_class(ip: Column) -> Column:
    """LOOPBACK, PRIVATE/LAN, PUBLIC/INTERNET or UNKNOWN."""
    named = lambda n: (
        F.when(n.isNull(), F.lit("UNKNOWN"))
        .when(_in_range(n, "127.0.0.0", 24), F.lit("LOOPBACK"))
        .when(reduce(lambda acc, r: acc | _in_range(n, *r), PRIVATE_RANGES, F.lit(False)), F.lit("PRIVATE/LAN"))
        .otherwise(F.lit("PUBLIC/INTERNET"))
    )
    return _once(ip_number(ip), named)


def valid_port(port: Column) -> Column:
    number = port.try_cast("int")
    return F.coalesce(number.between(0, 65535), F.lit(False))
