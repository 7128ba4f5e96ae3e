"""Summaries of communities and of facets: labels, texts, representative works, their search, and the works that they lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators import community as C
from quarry.operators.search import agreement

#: What a community is named by: its most frequent value of the first of these kinds, beside its most frequent collaboration.
NAMING = ("topic", "result", "method", "physics")
SHOWN_VALUES, SHOWN_WORKS, SHOWN_CHILDREN = 3, 4, 3
WORDS_OF_KIND = {"collaboration": "collaborations", "topic": "topics", "result": "result kinds", "method": "method families", "physics": "physics concepts"}
LEAST_WORKS = 2


def community_name(named: Column, collaboration: Column, title: Column) -> Column:
    """The label of a community from its first naming value, its collaboration and its first work's title, whichever there are."""
    both = F.when(named.isNotNull() & collaboration.isNotNull(), F.format_string("%s / %s community", collaboration, named))
    return F.coalesce(both, F.when(named.isNotNull(), F.concat(named, F.lit(" community"))), F.concat(collaboration, F.lit(" literature community")), F.concat(F.lit("Community around "), title), F.lit("Literature community"))


def communities(members: DataFrame, strong: DataFrame, works: DataFrame, labels: DataFrame) -> DataFrame:
    """``community works edges representatives label text`` of communities of two works or more.

    ``works``: (work, citations, year, title); ``labels``: (work, kind, value)."""
    inner = C.within(strong, members)
    best = C.representatives(members, inner, works)
    titles = best.select("community", F.posexplode("representatives").alias("at", "work")).join(works.select("work", "title", "year"), "work")
    shown = F.format_string("%s (%s)", "title", F.coalesce(F.col("year").cast("string"), F.lit("None")))
    titled = titles.groupBy("community").agg(F.min_by("title", "at").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("t")))), lambda x: x["t"]), "; ").alias("titles"))
    top = C.top_labels(members, labels)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("works")).alias("n"), "value")))
    listed = top.withColumn("kind", F.concat(F.lit("top_"), "kind")).groupBy("community").pivot("kind", [f"top_{k}" for k in WORDS_OF_KIND]).agg(ranked)
    rows = members.groupBy("community").agg(F.count(F.lit(1)).alias("works")).join(C.edge_stats(inner), "community").join(best, "community").join(titled, "community").join(listed, "community", "left")
    first = {k: F.get(F.col(f"top_{k}"), 0)["value"] for k in WORDS_OF_KIND}
    label = community_name(F.coalesce(*(first[k] for k in NAMING)), first["collaboration"], F.col("title"))
    values = [F.concat(F.lit(f"{name}: "), F.array_join(F.transform(F.slice(f"top_{k}", 1, SHOWN_VALUES), lambda x: F.concat_ws("=", x["value"], (-x["n"]).cast("string"))), ", ")) for k, name in WORDS_OF_KIND.items()]
    signals = F.array_sort(F.array(*(F.struct((-F.col(s)).alias("n"), F.lit(s).alias("name")) for s in C.SIGNALS)))
    mix = F.array_join(F.transform(F.filter(signals, lambda x: x["n"] < 0), lambda x: F.concat_ws("=", x["name"], (-x["n"]).cast("string"))), ", ")
    text = F.concat_ws(" | ", F.format_string("works=%d", "works"), F.format_string("edges=%d", "edges"), F.concat(F.lit("signals: "), mix), F.concat(F.lit("representative works: "), F.col("titles")), *values)
    return rows.select("community", "works", "edges", "representatives", label.alias("label"), text.alias("text"))


def with_overviews(own: DataFrame, above: DataFrame) -> DataFrame:
    """Both levels as rows to search: ``id level parent label text works edges children representatives``.

    ``own``: (community, works, edges, representatives, label, text); ``above``: (community, overview).  An overview has its
    communities' sums, the label of the largest, their texts, and its members' representatives in turn."""
    rows = own.join(above, "community", "left")
    name = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")))
    low = rows.select(name("fine", "community").alias("id"), F.lit("fine").alias("level"), name("overview", "overview").alias("parent"), "label", "text", "works", "edges", F.lit(0).cast("long").alias("children"), "representatives")
    children = F.array_sort(F.collect_list(F.struct((-F.col("works")).alias("n"), "community", "label", "text", "representatives")))
    high = rows.where("overview is not null").groupBy("overview").agg(children.alias("c"), F.sum("works").alias("works"), F.sum("edges").alias("edges"), F.count(F.lit(1)).alias("children"))
    first = F.array_distinct(F.flatten(F.transform("c", lambda x: F.slice(x["representatives"], 1, 2))))
    text = F.concat_ws(" | ", F.concat(F.lit("child communities: "), F.array_join(F.transform(F.slice("c", 1, SHOWN_CHILDREN), lambda x: x["label"]), "; ")), F.array_join(F.transform("c", lambda x: x["text"]), " | "))
    return low.unionByName(high.select(name("overview", "overview").alias("id"), F.lit("overview").alias("level"), F.lit(None).cast("string").alias("parent"), F.get("c", 0)["label"].alias("label"), text.alias("text"), "works", "edges", "children", F.slice(first, 1, SHOWN_WORKS).alias("representatives")))


def search_communities(rows: DataFrame, groups: Sequence[Sequence[str]], limit: int) -> DataFrame:
    """``rows`` of ``with_overviews`` ranked by ``community.search``: its columns, the label, the text and the representatives."""
    worded = rows.withColumn("words", tokens(F.concat_ws(" ", "label", "text"))).withColumn("label_words", tokens(F.col("label")))
    found = C.search(worded, groups, limit)
    return F.broadcast(found).join(rows.select("id", "parent", "label", "text", "representatives"), "id").orderBy("rank")  # ``limit`` rows


# ---- facets


def facets(signals: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """``id facet label works signals representatives``: values of a kind that at least two works have; ``signals``: (work, facet, label).

    Representatives: the most cited, then latest works, then by title and id; without ``works`` (work, citations, year, title) the least ids."""
    counted = signals.groupBy("facet", "label").agg(F.countDistinct("work").alias("works"), F.count(F.lit(1)).alias("signals")).where(F.col("works") >= LEAST_WORKS)
    one = signals.select("facet", "label", "work").distinct()
    order = [F.col("work")]
    if works is not None:
        one = one.join(works, "work")
        order = [F.coalesce("citations", F.lit(0)).desc(), F.coalesce("year", F.lit(0)).desc(), F.lower("title"), F.col("work")]
    best = one.withColumn("r", F.row_number().over(Window.partitionBy("facet", "label").orderBy(*order))).where(F.col("r") <= SHOWN_WORKS)
    shown = best.groupBy("facet", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "work"))), lambda x: x["work"]).alias("representatives"))
    return counted.join(shown, ["facet", "label"], "left").select(F.concat_ws(":", "facet", "label").alias("id"), "facet", "label", "works", "signals", "representatives")


def search_facets(rows: DataFrame, groups: Sequence[Sequence[str]], limit: int, text: Column | None = None) -> DataFrame:
    """Facets that agree with the query in their text or label, best first: score, hits, coverage, hits of the label, works, signals, label; then id.

    ``text``: what is searched beside the label; the facet's name by itself if there is nothing else."""
    words = tokens(F.concat_ws(" ", "label", "facet", *([text] if text is not None else [])))
    hits, coverage = agreement(F.col("words"), groups)
    label_hits, label_coverage = agreement(F.col("label_words"), groups)
    scored = rows.withColumn("words", words).withColumn("label_words", tokens(F.col("label"))).withColumns({"hits": hits, "coverage": coverage, "label_hits": label_hits, "label_coverage": label_coverage}).drop("words", "label_words")
    score = 1.5 * F.col("hits") + F.col("coverage") + 0.8 * F.col("label_hits") + 0.4 * F.col("label_coverage") + 0.02 * F.least("works", F.lit(25)) + 0.01 * F.least("signals", F.lit(25))
    scored = scored.withColumn("score", score)
    if groups:
        scored = scored.where("hits > 0 or label_hits > 0")
    order = [F.round("score", 9).desc(), F.col("hits").desc(), F.round("coverage", 9).desc(), F.col("label_hits").desc(), F.col("works").desc(), F.col("signals").desc(), F.lower("label"), F.col("id")]
    return scored.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def works_of(found: DataFrame, limit: int) -> DataFrame:
    """``work rank``: the representatives of ranked summaries as they are first met, ``limit`` at most.  ``found`` is a list of bounded length."""
    each = found.select("rank", F.posexplode("representatives").alias("at", "work"))
    first = each.groupBy("work").agg(F.min(F.struct("rank", "at")).alias("met")).orderBy("met").limit(limit)
    return first.select("work", F.row_number().over(Window.orderBy("met")).cast("long").alias("rank"))
