"""Deterministic choice: orders and splits from digests of keys, never from random state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_rank_key(*parts: Column | str) -> Column:
    """md5 of the parts joined by '|'; its hex order is the pseudo-random order."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def hash_number(key: Column, digits: int = 8) -> Column:
    """The first hex digits of a hex digest as a long."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def hash_share(key: Column) -> Column:
    """A digest as a number in [0, 1) with a resolution of 1/1000: the thousandths of a SHA-1's last 12 hex digits."""
    return (F.conv(F.right(key, F.lit(12)), 16, 10).cast("decimal(20,0)") % 1000).cast("int")
