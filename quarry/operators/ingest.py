"""Ingest: upserts, identities, ordered text, path prefixes, bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order: an upsert.  The maximum is combined before the shuffle."""
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order: an insert that ignores what is there."""
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def rewrite_children(old: DataFrame, new: DataFrame, touched: DataFrame, parent: str) -> DataFrame:
    """The old children of all but the touched parents, and the new ones."""
    return old.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(new)


def canonical_identity(inspire: Column, arxiv: Column, doi: Column, title: Column, year: Column) -> Column:
    """struct(source, canonical_id): the first identifier there is, else a hash of title and year."""
    local = F.concat(F.lit("local:"), F.sha2(F.concat_ws("|", title, year.cast("string")), 256))
    one = lambda source, value: F.when(value.isNotNull() & (value != ""), F.struct(F.lit(source).alias("source"), value.alias("canonical_id")))
    return F.coalesce(one("inspire", inspire), one("arxiv", arxiv), one("doi", F.lower(doi)), F.struct(F.lit("local").alias("source"), local.alias("canonical_id")))


def ordered_text(rows: DataFrame, owner: str, position: str, value: str) -> DataFrame:
    """(owner, text): distinct non-empty values in first-seen order between bars."""
    first = rows.where(F.trim(value) != "").groupBy(owner, F.trim(value).alias("v")).agg(F.min(position).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x.v), "|")
    return first.groupBy(owner).agg(F.concat(F.lit("|"), joined, F.lit("|")).alias("text"))


def path_prefixes(paths: DataFrame) -> DataFrame:
    """(path, label, level, parent, below) of every prefix of arrays of segments."""
    at = paths.select("segments", F.posexplode("segments").alias("i", "label"))
    path = F.array_join(F.slice("segments", F.lit(1), F.col("i") + 1), " / ")
    parent = F.when(F.col("i") > 0, F.array_join(F.slice("segments", F.lit(1), F.greatest(F.col("i"), F.lit(1))), " / "))
    return at.select(path.alias("path"), "label", (F.col("i") + 1).cast("long").alias("level"), parent.alias("parent")).groupBy("path", "label", "level", "parent").agg(F.count(F.lit(1)).alias("below"))


def synthetic_works(spark: SparkSession, n: int) -> DataFrame:
    """Made-up records for scale tests, in three families."""
    i = F.col("id")
    month, number = F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lpad(i.cast("string"), 5, "0")
    name = F.when(i % 3 == 0, "CMS").when(i % 3 == 1, "ATLAS").otherwise("LHCb")
    return spark.range(n).select(
        i.alias("work"), (i + 9_000_000).alias("control_number"), (i % 9 + 2016).alias("year"), F.concat(F.lit("26"), month, F.lit("."), number).alias("arxiv"), name.alias("collaboration"),
        F.concat(F.lit("Search number "), i.cast("string"), F.lit(" by "), name).alias("title"),
    )
