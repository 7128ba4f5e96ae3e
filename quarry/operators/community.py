"""Communities of works: weighted edges from eight signals, fine components, overviews of them, and their search.

No step pairs all communities: overviews are connected through the sets of shared labels that suffice by themselves (their
members meet at the least one of them) and through cross edges that are there.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import connected_components
from quarry.operators.search import agreement

# Fixed values that the data model prescribes.
FINE, OVERVIEW = 0.38, 0.26
#: Signal of shared keys: (weight, largest group that counts).
GROUPS = {"topic": (0.18, 24), "result": (0.12, 16), "method": (0.10, 16), "collaboration": (0.08, 8), "physics": (0.16, 20)}
SIGNALS = ("similarity", "bibliographic", "co_citation", *GROUPS)
#: What a kind of label that two communities share adds to their link.
SHARED = {"topic": 0.16, "physics": 0.14, "result": 0.12, "method": 0.10, "collaboration": 0.08}
CROSS_SHARE, CROSS_CAP = 0.22, 0.24
REPRESENTATIVES, LABELS = 4, 3


def cited_weight(score: Column, shared: Column) -> Column:
    """What coupling or co-citation adds to an edge."""
    return F.least(F.lit(0.6), F.greatest(1.6 * score, F.least(F.lit(0.35), 0.06 * shared)))


def group_pairs(members: DataFrame, cap: int) -> DataFrame:
    """(src, dst): pairs of works (work, key) of the same key, for keys of 2 to ``cap`` works (the rule that defines the signal)."""
    m = members.where("key is not null").distinct()
    sized = m.join(m.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(f"size between 2 and {cap}"), "key")
    a, b = sized.alias("a"), sized.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.work") < F.col("b.work"))).select(F.col("a.work").alias("src"), F.col("b.work").alias("dst"))


def signal_rows(similar: DataFrame, coupled: DataFrame, cocited: DataFrame, keys: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, signal, w), src < dst: ``similar`` has src, dst, score; ``coupled`` and ``cocited`` have shared too; ``keys`` gives (work, key) by signal."""
    out = similar.select("src", "dst", F.lit("similarity").alias("signal"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("w"))
    for name, edges in (("bibliographic", coupled), ("co_citation", cocited)):
        out = out.unionByName(edges.select("src", "dst", F.lit(name).alias("signal"), cited_weight(F.col("score"), F.col("shared")).alias("w")))
    for name, members in keys.items():
        weight, cap = GROUPS[name]
        out = out.unionByName(group_pairs(members, cap).select("src", "dst", F.lit(name).alias("signal"), F.lit(weight).alias("w")))
    return out.where("w > 0 and src <> dst")


def weighted(signals: DataFrame) -> DataFrame:
    """(src, dst, weight, and how often each signal occurs)."""
    return signals.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("weight"), *(F.count_if(F.col("signal") == s).alias(s) for s in SIGNALS))


def strong(edges: DataFrame, least: float = FINE) -> DataFrame:
    return edges.where(F.round("weight", 9) >= least)


def components(edges: DataFrame) -> DataFrame:
    """(work, community): the least work that strong edges lead to."""
    return connected_components(edges).select(F.col("node").alias("work"), F.col("component").alias("community"))


def within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in one community."""
    a, b = members.select(F.col("work").alias("src"), "community"), members.select(F.col("work").alias("dst"), F.col("community").alias("other"))
    return edges.join(a, "src").join(b, "dst").where("community = other").drop("other")


def edge_stats(inner: DataFrame) -> DataFrame:
    """(community, edges, and the sum of each signal's occurrences)."""
    return inner.groupBy("community").agg(F.count(F.lit(1)).alias("edges"), *(F.sum(s).alias(s) for s in SIGNALS))


def representatives(members: DataFrame, inner: DataFrame, works: DataFrame, n: int = REPRESENTATIVES) -> DataFrame:
    """(community, representatives): the works of most weight within it; then citations, year, title, id.  ``works``: (work, citations, year, title)."""
    ends = inner.select("community", F.col("src").alias("work"), "weight").unionByName(inner.select("community", F.col("dst").alias("work"), "weight"))
    central = ends.groupBy("community", "work").agg(F.sum("weight").alias("centrality"))
    rows = members.join(works, "work").join(central, ["community", "work"], "left").fillna({"centrality": 0.0})
    order = Window.partitionBy("community").orderBy(F.round("centrality", 9).desc(), F.coalesce("citations", F.lit(0)).desc(), F.coalesce("year", F.lit(0)).desc(), F.lower("title"), "work")
    best = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return best.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "work"))), lambda x: x["work"]).alias("representatives"))


def top_labels(members: DataFrame, labels: DataFrame, n: int = LABELS) -> DataFrame:
    """(community, kind, value, works): each kind's most frequent values, ties by value.  ``labels``: (work, kind, value)."""
    counted = members.join(labels.distinct(), "work").groupBy("community", "kind", "value").agg(F.count(F.lit(1)).alias("works"))
    order = Window.partitionBy("community", "kind").orderBy(F.col("works").desc(), "value")
    return counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def sufficient(shared: dict[str, float] = SHARED, least: float = OVERVIEW) -> list[tuple[str, ...]]:
    """The smallest sets of kinds whose weights link two communities by themselves."""
    out: list[tuple[str, ...]] = []
    for n in range(1, len(shared) + 1):
        out += [c for c in combinations(shared, n) if sum(shared[k] for k in c) >= least - 1e-9 and not any(set(s) <= set(c) for s in out)]
    return out


def cross_weights(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, raw): the summed weight of strong edges between two communities."""
    left, right = members.select(F.col("work").alias("src"), F.col("community").alias("x")), members.select(F.col("work").alias("dst"), F.col("community").alias("y"))
    return edges.join(left, "src").join(right, "dst").where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("raw"))


def cross_links(cross: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): pairs with cross edges whose link, with the kinds of labels that they share, is strong enough.  ``sizes``: (community, works)."""
    size = lambda c: sizes.select(F.col("community").alias(c), F.col("works").alias(f"{c}_works"))
    pairs = cross.join(size("a"), "a").join(size("b"), "b")
    own = F.least(F.lit(CROSS_CAP), CROSS_SHARE * F.col("raw") / F.greatest(F.lit(1.0), F.sqrt(F.col("a_works") * F.col("b_works"))))
    side = lambda c: labels.select(F.col("community").alias(c), "kind", "value")
    kinds = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "kind", "value"]).select("a", "b", "kind").distinct()
    weight = F.create_map(*(F.lit(x) for kv in SHARED.items() for x in kv))[F.col("kind")]
    shared = kinds.groupBy("a", "b").agg(F.sum(weight).alias("shared"))
    return pairs.join(shared, ["a", "b"], "left").where(F.round(own + F.coalesce("shared", F.lit(0.0)), 9) >= OVERVIEW).select("a", "b")


def label_links(labels: DataFrame) -> DataFrame:
    """(a, b): each community beside the least one that shares a sufficient set of labels with it; as good as all pairs for components."""
    out = None
    for kinds in sufficient():
        rows = None
        for k in kinds:
            part = labels.where(F.col("kind") == k).select("community", F.col("value").alias(k))
            rows = part if rows is None else rows.join(part, "community")
        rows = rows.groupBy(*kinds).agg(F.min("community").alias("a")).join(rows, list(kinds)).where("a <> community").select("a", F.col("community").alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def overviews(members: DataFrame, cross: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, overview): the least community that links lead to, for communities that are linked with another."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("works"))
    links = label_links(labels).unionByName(cross_links(cross, sizes, labels))
    return connected_components(links, "a", "b").select(F.col("node").alias("community"), F.col("component").alias("overview"))


# ---- search


def summary_score(level: Column, hits: Column, coverage: Column, label_hits: Column, label_coverage: Column, works: Column, edges: Column, children: Column) -> Column:
    score = 1.6 * hits + coverage + 0.8 * label_hits + 0.4 * label_coverage + 0.02 * F.least(works, F.lit(30)) + 0.015 * F.least(edges, F.lit(30))
    return score + F.when(level == "overview", 0.03 * F.least(children, F.lit(6))).otherwise(0.0)


def search(summaries: DataFrame, groups: Sequence[Sequence[str]], limit: int, shown: int = 2, bonus: float = 0.35) -> DataFrame:
    """Ranked summaries: the best overviews, then the fine ones of their routes or with hits, the former with a bonus.

    ``summaries``: id, level, parent, label, words, label_words, works, edges, children; those without any hit are left out.
    """
    hits, coverage = agreement(F.col("words"), groups)
    label_hits, label_coverage = agreement(F.col("label_words"), groups)
    rows = summaries.select("id", "level", "parent", "label", "works", "edges", "children", hits.alias("hits"), coverage.alias("coverage"), label_hits.alias("label_hits"), label_coverage.alias("label_coverage")).where("hits > 0 or label_hits > 0")
    rows = rows.withColumn("score", summary_score(*(F.col(c) for c in ("level", "hits", "coverage", "label_hits", "label_coverage", "works", "edges", "children"))))
    by = [F.round("score", 9).desc(), F.col("hits").desc(), F.round("coverage", 9).desc(), F.col("label_hits").desc(), F.col("works").desc(), F.col("edges").desc(), F.lower("label"), F.col("id")]
    top = rows.where("level = 'overview'").orderBy(*by).limit(min(shown, limit))
    top = top.withColumn("place", F.row_number().over(Window.orderBy(*by))).withColumn("route", F.lit(0)).withColumn("route_score", F.col("score"))
    routed = F.broadcast(top.select(F.col("id").alias("parent"), F.lit(1).alias("on_route")))  # ``shown`` rows
    fine = rows.where("level = 'fine'").join(routed, "parent", "left").withColumn("on_route", F.coalesce("on_route", F.lit(0)))
    fine = fine.withColumn("route_score", F.round("score", 6) + bonus * F.col("on_route"))
    order = [F.round("route_score", 9).desc(), F.col("on_route").desc(), F.col("hits").desc(), F.round("coverage", 9).desc(), F.col("works").desc(), F.lower("label"), F.col("id")]
    fine = fine.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("route", F.lit(1))
    cols = ["id", "level", "hits", "label_hits", "score", "route_score", "route", "place"]
    both = top.select(*cols).unionByName(fine.select(*cols)).orderBy("route", "place").limit(limit)
    return both.select("id", "level", "hits", "label_hits", F.round("route_score", 6).alias("score"), F.row_number().over(Window.orderBy("route", "place")).cast("long").alias("rank"))
