"""Ranked hits collapsed greedily: each joins the first family that has a hit like it, or begins one.

Hits go by rank.  A hit's family is thus the earliest family among those of the earlier hits that are like it, and following that
back, the least hit that descending links lead to.  All hits pass on the least they have heard of to later ones, round by round,
until nothing changes: as many rounds as the longest descending chain that matters, each a join and a minimum.  (Components would
also join two families through a later hit; this does not.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shared import written

#: Title words that two titles share at least, their share of all words in a hundred, and how far years may be apart.
SHARED, PERCENT, YEARS = 6, 92, 1


def like(hits: DataFrame) -> DataFrame:
    """(early, late): pairs of hits (place, arxiv, doi, year, title_normal, title_words, reports, collaboration_keys, stage, signal) that stand for one work.

    Equal arXiv numbers, or else equal DOIs, decide; different ones speak against it.  Otherwise titles are equal or share most of
    their words, years are close or unknown, and a report number is shared, or a collaboration by versions of different stages.
    Candidates share an identifier, a title, or one of the rarest words of similar titles, so that no others meet."""
    words = hits.where(F.size("title_words") >= SHARED).select("place", F.explode("title_words").alias("w"), F.size("title_words").alias("n"))
    rare = words.join(words.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w").withColumn("pos", F.row_number().over(Window.partitionBy("place").orderBy("df", "w")))
    rare = rare.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    keys = [hits.select("place", F.concat(F.lit(f"{c} "), F.lower(c)).alias("k")) for c in ("arxiv", "doi", "title_normal")] + [rare.select("place", F.concat(F.lit("word "), "w").alias("k"))]
    met = keys[0].unionByName(keys[1]).unionByName(keys[2]).unionByName(keys[3]).where("k IS NOT NULL AND k <> 'title_normal '").distinct()
    pairs = met.select(F.col("place").alias("early"), "k").join(met.select(F.col("place").alias("late"), "k"), "k").where("early < late").select("early", "late").distinct()
    side = lambda c: hits.select(*(F.col(x).alias(f"{c}_{x}") for x in ("place", "arxiv", "doi", "year", "title_normal", "title_words", "reports", "collaboration_keys", "stage", "signal")))
    rows = pairs.join(side("a"), F.col("early") == F.col("a_place")).join(side("b"), F.col("late") == F.col("b_place"))
    return rows.where(_alike()).select("early", "late")


def _alike() -> Column:
    a, b = (lambda x: F.col(f"a_{x}")), (lambda x: F.col(f"b_{x}"))
    both = lambda c: a(c).isNotNull() & b(c).isNotNull()
    equal = lambda c: F.lower(a(c)) == F.lower(b(c))
    shared, union = F.size(F.array_intersect(a("title_words"), b("title_words"))), F.size(F.array_union(a("title_words"), b("title_words")))
    titled = (a("title_normal") != "") & (b("title_normal") != "") & ((a("title_normal") == b("title_normal")) | (shared >= SHARED) & (100 * shared >= PERCENT * union))
    close = F.coalesce(F.abs(a("year") - b("year")) <= YEARS, F.lit(True))
    higher = F.when(a("stage") > b("stage"), a("signal")).otherwise(b("signal"))
    lower = F.when(a("stage") > b("stage"), b("signal") & (b("stage") >= 4)).otherwise(a("signal") & (a("stage") >= 4))
    staged = (a("stage") != b("stage")) & (F.greatest(a("stage"), b("stage")) >= 3) & higher & ~lower
    versions = titled & close & (F.arrays_overlap(a("reports"), b("reports")) | F.arrays_overlap(a("collaboration_keys"), b("collaboration_keys")) & staged)
    return F.when(both("arxiv"), equal("arxiv")).when(both("doi"), equal("doi")).otherwise(versions)


def families(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(place, family): the place of the hit that began each hit's family."""
    links = written(pairs.select("early", "late").distinct(), "links")
    heard = links.select(F.col("late").alias("place"), F.col("early").alias("family")).groupBy("place").agg(F.min("family").alias("family"))
    while True:
        heard = written(heard, "families")
        further = links.join(heard.withColumnRenamed("place", "early"), "early").groupBy(F.col("late").alias("place")).agg(F.min("family").alias("far"))
        moved = heard.join(further, "place").where("far < family")
        if moved.isEmpty():
            break
        heard = heard.join(further, "place", "left").select("place", F.least("family", F.coalesce("far", "family")).alias("family"))
    return hits.select("place").join(heard, "place", "left").select("place", F.coalesce("family", "place").alias("family"))


def collapsed(hits: DataFrame, richness: Column, pairs: DataFrame | None = None) -> DataFrame:
    """One row a family: ``place`` of its first hit, ``best`` (the place of the richest; ties to the earlier), ``members`` (the other places)."""
    found = families(hits, like(hits) if pairs is None else pairs)
    rows = hits.select("place", richness.alias("rich")).join(found, "place")
    one = rows.groupBy("family").agg(F.max_by("place", F.struct("rich", -F.col("place"))).alias("best"), F.array_sort(F.collect_list("place")).alias("all"))
    return one.select(F.col("family").alias("place"), "best", F.array_except("all", F.array("best")).alias("members"))


def richness() -> Column:
    """Eight keys: type, a file, a place of publication, arXiv, DOI, documents, citations, length of the title."""
    has = lambda c: F.when(c, 1).otherwise(0)
    return F.struct("preference", has(F.col("pdf_url").isNotNull()), has(F.col("published")), has(F.col("arxiv").isNotNull()), has(F.col("doi").isNotNull()), F.coalesce("documents", F.lit(0)), F.coalesce("citation_count", F.lit(0)), F.length(F.coalesce("title", F.lit(""))))
