"""Dealing rows out by ranges of an integer key, in key order, with bounds read from the key column alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending key values; each begins a range."""
    if parts < 2:
        return []
    marks = [i / parts for i in range(1, parts)]
    found = df.select(key).agg(F.percentile_approx(key, marks, 20 * parts if parts < 5000 else 100000).alias("q"), F.min(key).alias("low")).first()
    return sorted({q for q in found.q or [] if q > found.low})


def range_index(key: str, bounds: list[int]) -> Column:
    """The number of bounds that are not above the key, 0 for a null key.

    Only the key goes through the function; the bounds travel with it (8 bytes a range, broadcast by Spark if they are many), not in the plan.
    """
    if not bounds:
        return F.lit(0)
    marks = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def index(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(marks, keys.fill_null(-(1 << 63)).to_numpy(), side="right").astype(np.int32))

    return index(F.col(key))


def begins_range(key: str, bounds: list[int]) -> Column:
    """Whether the key is one of the bounds."""
    if not bounds:
        return F.lit(False)
    marks = np.array(bounds, np.int64)

    @F.arrow_udf("boolean")
    def begins(keys: pa.Array) -> pa.Array:
        return pa.array(np.isin(keys.fill_null(-(1 << 63)).to_numpy(), marks))

    return begins(F.col(key))


def range_parts(df: DataFrame) -> int:
    """As many ranges as the input has splits, the session's shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
