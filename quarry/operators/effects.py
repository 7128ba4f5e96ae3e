"""How good ranked lists are, by scenario, and how sure a difference between two scenarios is.

Measures are per query; scenarios are compared on the same queries.  The interval of a difference comes from a Poisson bootstrap whose
weights are a hash of query and round: the same input gives the same interval, on any number of machines, and a round needs no sample
to be drawn: each query carries its weights, and sums over them are grouped sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 200
#: What a uniform number below the k-th bound is as a Poisson count of mean one: k.
BOUNDS = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8))


def measures(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(scenario, query, recall, ndcg, rr) at k of lists (scenario, query, item, rank) against judgements (query, item).

    A query with judgements counts in every scenario, with zeros where a scenario found nothing of it."""
    judged = relevant.select("query", "item").distinct()
    wanted = judged.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(judged, ["query", "item"])
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    found = hits.groupBy("scenario", "query").agg(F.countDistinct("item").alias("hits"), F.sum(gain).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    names = [r.scenario for r in ranked.select("scenario").distinct().collect()]  # a handful
    every = wanted.withColumn("scenario", F.explode(F.array(*map(F.lit, names)))) if names else wanted.withColumn("scenario", F.lit("")).limit(0)
    rows = every.join(found, ["scenario", "query"], "left").fillna({"hits": 0, "dcg": 0.0})
    return rows.select("scenario", "query", (F.col("hits") / F.col("n")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def _weight(query: Column, round_: Column) -> Column:
    uniform = F.conv(F.substring(F.md5(F.concat_ws("-", query.cast("string"), round_.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out = F.lit(len(BOUNDS))
    for k in range(len(BOUNDS) - 1, -1, -1):
        out = F.when(uniform < BOUNDS[k], k).otherwise(out)
    return out


def compared(measured: DataFrame, base: str, measure: str, rounds: int = ROUNDS) -> DataFrame:
    """(scenario, queries, mean, difference, low, high): each scenario against ``base`` on a measure, with the middle 95 in a hundred rounds."""
    own = measured.select("query", F.col("scenario"), F.col(measure).alias("x"))
    other = measured.where(F.col("scenario") == base).select("query", F.col(measure).alias("y"))
    pairs = own.join(other, "query").withColumn("d", F.col("x") - F.col("y"))
    mean = pairs.groupBy("scenario").agg(F.count(F.lit(1)).alias("queries"), F.avg("x").alias("mean"), F.avg("d").alias("difference"))
    drawn = pairs.select("scenario", "query", "d", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", _weight(F.col("query"), F.col("round")))
    each = drawn.groupBy("scenario", "round").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m")).where("m IS NOT NULL")
    place = each.withColumn("r", F.row_number().over(Window.partitionBy("scenario").orderBy("m", "round"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("scenario")))  # ``rounds`` rows a scenario
    ends = place.groupBy("scenario").agg(F.min(F.when(F.col("r") > 0.025 * F.col("n"), F.col("m"))).alias("low"), F.max(F.when(F.col("r") <= 0.975 * F.col("n"), F.col("m"))).alias("high"))
    return mean.join(ends, "scenario")


def labels_of(rows: DataFrame, n: int) -> DataFrame:
    """(owner, labels): each owner's ``n`` surest labels (owner, label, confidence), once each by their folded form, ties by label."""
    best = rows.where(F.trim("label") != "").groupBy("owner", F.lower(F.trim("label")).alias("k")).agg(F.max(F.struct("confidence", (-F.length("label")).alias("l"), "label")).alias("b"))
    order = Window.partitionBy("owner").orderBy(F.col("b.confidence").desc(), "k")
    kept = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return kept.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "b.label"))), lambda x: x["label"]).alias("labels"))
