"""Result and method signatures by pattern, and what state they leave a work in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import METHOD_PATTERNS, RESULT_PATTERNS


def _kinds(patterns: dict[str, str], text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items())))


def signatures(docs: DataFrame, results: dict[str, str] = RESULT_PATTERNS, methods: dict[str, str] = METHOD_PATTERNS, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the kinds of result and method signatures that occur, in the patterns' order."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*(c for c in docs.columns if c != text), _kinds(results, body).alias("results"), _kinds(methods, body).alias("methods"))


def status(works: DataFrame, review: Column) -> DataFrame:
    """Reviews are partial; a work without a result or a method signature needs review; others are ready."""
    state = F.when(review, "partial").when((F.size("results") == 0) | (F.size("methods") == 0), "needs_review").otherwise("ready")
    return works.withColumn("status", state).withColumn("anomaly", F.when(F.col("status") == "needs_review", "missing_required_signatures"))
