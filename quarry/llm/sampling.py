"""Bounded samples by hash: no shuffle, the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_below(h: str, key: Column, share: dict | float) -> Column:
    """Whether a row's 64-bit hash falls in the key's share of all hashes.  A sample of expected size n from N rows takes the share n / N."""
    place = F.pmod(F.col(h), F.lit(1 << 40)) / F.lit(float(1 << 40))
    if isinstance(share, float):
        return place < F.lit(share)
    shares = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, float(v))))
    return place < F.coalesce(shares[key], F.lit(0.0))
