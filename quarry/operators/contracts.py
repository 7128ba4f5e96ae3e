"""Invariants across artifacts: content digests, equal objects as one, references that lead nowhere, and what else a contract rules out.

A violation is a row (rule, subject, detail).  Each rule is a filter, an anti-join or a grouped count, so a check is a few joins however
many objects there are; a reference that very many objects share is made distinct before it is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*columns: str) -> Column:
    """SHA-256 of the columns as canonical JSON: names in order, no blanks, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def coalesced(objects: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Equal objects as one: ``digest``, the columns, ``first`` (the least key) and ``occurrences``."""
    return objects.withColumn("digest", digest(*columns)).groupBy("digest").agg(*(F.min_by(c, key).alias(c) for c in columns), F.min(key).alias("first"), F.count(F.lit(1)).alias("occurrences"))


def _rows(found: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return found.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def dangling(objects: DataFrame, key: str, reference: str, targets: DataFrame, target: str, rule: str) -> DataFrame:
    """Objects whose reference names nothing, null or not: the references are made distinct, then looked up, then their objects found."""
    lost = objects.select(reference).where(F.col(reference).isNotNull()).distinct().join(targets.select(F.col(target).alias(reference)).distinct(), reference, "left_anti")
    missing = objects.where(F.col(reference).isNull()).select(key, F.lit("none").alias("to"))
    return _rows(missing.unionByName(objects.join(lost, reference, "left_semi").select(key, F.col(reference).cast("string").alias("to"))), rule, F.col(key), F.col("to"))


def repeated(objects: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that several objects have."""
    return _rows(objects.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rule, F.col(key), F.col("n"))


def outside(objects: DataFrame, key: str, value: str, low: float, high: float, rule: str) -> DataFrame:
    """Objects whose value is null or not between two bounds."""
    return _rows(objects.where(~F.coalesce(F.col(value).between(low, high), F.lit(False))), rule, F.col(key), F.coalesce(F.col(value).cast("string"), F.lit("none")))


def unknown(objects: DataFrame, key: str, value: str, allowed: Sequence[str], rule: str) -> DataFrame:
    return _rows(objects.where(~F.coalesce(F.col(value).isin(*allowed), F.lit(False))), rule, F.col(key), F.coalesce(F.col(value), F.lit("none")))


def violations(found: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def summary(found: DataFrame) -> DataFrame:
    """(rule, violations, subjects): how often each rule is broken, and by how many."""
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"), F.countDistinct("subject").alias("subjects"))
