"""Addresses of pages and machines as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_part(url: Column, part: str) -> Column:
    """A part of an address (PROTOCOL, HOST, PATH, QUERY, REF, AUTHORITY, FILE, USERINFO); null if it can't be parsed or lacks it."""
    return F.try_parse_url(url, F.lit(part.upper()))


def is_url(url: Column) -> Column:
    """Whether an address is absolute: it has a scheme and can be parsed. Null for null."""
    return F.when(url.isNotNull(), F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull())


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")


def is_ip(ip: Column) -> Column:
    return is_ipv4(ip) | (ip.rlike(r"^[0-9A-Fa-f:.]+$") & ip.rlike(r":.*:"))


def ip_sort_key(ip: Column) -> Column:
    """Text that sorts addresses as numbers do, those of version 4 before those of version 6; null for others."""
    parts = F.split(ip, r"\.")
    four = F.concat(F.lit("4"), *[F.lpad(F.conv(F.element_at(parts, i), 10, 16), 2, "0") for i in range(1, 5)])
    left = F.split_part(ip, F.lit("::"), F.lit(1))
    right = F.when(F.instr(ip, "::") > 0, F.split_part(ip, F.lit("::"), F.lit(2))).otherwise(F.lit(""))
    a = F.filter(F.split(left, ":"), lambda x: x != "")
    b = F.filter(F.split(right, ":"), lambda x: x != "")
    middle = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(a) - F.size(b)))
    six = F.concat(F.lit("6"), F.array_join(F.transform(F.concat(a, middle, b), lambda x: F.lpad(F.lower(x), 4, "0")), ""))
    return F.when(is_ipv4(ip), four).when(is_ip(ip), six)
