"""Dirty lanes, job events, evidence references and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shared import written


def dirty(events: DataFrame) -> DataFrame:
    """(lane, object_id, updated_at, reason): the latest mark of every object in every lane."""
    return events.groupBy(F.col("event_type").alias("lane"), F.col("user_id").alias("object_id")).agg(F.max("ts").alias("updated_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("reason"))


def lane_counts(marks: DataFrame, lanes: list[str]) -> DataFrame:
    """Marked objects of every lane; a lane without any counts 0."""
    known = marks.sparkSession.createDataFrame([(x,) for x in lanes], "lane string")
    return F.broadcast(known).join(marks.groupBy("lane").agg(F.count("object_id").alias("n")), "lane", "left").select("lane", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tail(events: DataFrame, job: int, after: int) -> DataFrame:
    return events.where((F.col("user_id") == job) & (F.col("event_id") > after))


def prune(events: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` events of every job: the rule of the log, not a sample."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def place_in_group(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with ``place``: the dense rank of ``order`` within ``group``, however many rows a group has.

    Rows are dealt by ranges of (group, order), so equal ones meet; each task ranks its part, and what the parts before it
    hold of the group, one row a part, is added.
    """
    dealt = rows.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")  # the parts must stay as they are
    own = Window.partitionBy("_part", group).orderBy(order)
    ranked = dealt.withColumn("_own", F.dense_rank().over(own))
    parts = ranked.groupBy(group, "_part").agg(F.max("_own").alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(before.select(group, "_part", "_before"), [group, "_part"]).withColumn("place", F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def evidence(rows: DataFrame) -> DataFrame:
    """(lane, key, occurrences, ref) from (lane, key, pos): references per lane in order of first registration."""
    first = rows.groupBy("lane", "key").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("occurrences"))
    return place_in_group(first, "lane", "pos").select("lane", "key", "occurrences", F.concat(F.upper(F.substring("lane", 1, 1)), F.col("place").cast("string")).alias("ref"))


#: Values from which quantiles are read at once.
BRACKET = 1_000_000


def exact_quantiles(rows: DataFrame, group: str, value: str, marks: list[float]) -> DataFrame:
    """(group, n, q_0, q_1, ...): exact quantiles with linear interpolation, in memory that does not grow with a group.

    Approximate quantiles bracket each exact one; the values within are counted, and only those between the brackets' ends
    are gathered.  A bracket is a 2000th of a group wide.
    """
    n = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    if (n.agg(F.max("n")).first()[0] or 0) <= BRACKET:
        q = F.percentile(value, F.array(*map(F.lit, marks)))
        return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(q[i].alias(f"q_{i}") for i in range(len(marks))))
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    for i, m in enumerate(marks):
        ends = rows.groupBy(group).agg(F.percentile_approx(value, F.array(F.lit(max(0.0, m - 2.5e-4)), F.lit(min(1.0, m + 2.5e-4))), F.lit(20_000)).alias("e"))
        near = rows.join(F.broadcast(ends.select(group, F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))), group)
        counted = near.where(F.col(value).isNotNull()).groupBy(group).agg(
            F.count(F.lit(1)).alias("all"), F.count_if(F.col(value) < F.col("lo")).alias("below"),
            F.array_sort(F.collect_list(F.when(F.col(value).between(F.col("lo"), F.col("hi")), F.col(value)))).alias("held"),
        )
        at = F.lit(m) * (F.col("all") - 1) - F.col("below")
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        exact = F.get("held", low) + (F.get("held", high) - F.get("held", low)) * (at - low)
        out = out.join(counted.select(group, exact.alias(f"q_{i}")), group, "left")
    return out


def violations(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """``rows`` with ``bad``: the rules of the contract that a row breaks."""
    rules = [
        F.when(~F.col("status").isin(statuses), F.lit("bad_status")),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence_range")),
        F.when(F.col("key").isNull(), F.lit("missing_key")),
    ]
    return rows.withColumn("bad", F.array_compact(F.array(*rules)))
