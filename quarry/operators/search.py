"""Fielded word indexes, match queries of phrases ranked by BM25, vector ranking with agreement, hybrid search.

A query's phrases are few and known, so a search is two passes over their postings (``operators.inverted``): one for the phrases'
document frequencies (one row), one that ranks every query of the cascade at once; only each task's best rows are shuffled.
Everything after that works on at most a few hundred rows.  Ties always end at a key.  A table of word lists serves as well, by
a scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.functions.query import MatchQuery
from quarry.operators.inverted import Index

K1, B = 1.2, 0.75
RRF = 60
#: Weights of the ranked lists (words, vectors); both 1 where the word search finds nothing.
WORKS_WEIGHTS, CHUNKS_WEIGHTS = (1.25, 0.75), (1.15, 0.85)
#: Chunk roles in order of preference, and what a role adds to a score (lower scores are better).
ROLES = ("abstract_chunk", "section_parent", "section_child", "asset_window", "formula_window")
PENALTIES = {"asset_window": 0.02, "formula_window": 0.05}


def index(rows: DataFrame, key: str, fields: Sequence[str], keep: Sequence[str] = (), analyze: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, kept columns, fields): the words of each field, in the order of the fields."""
    return rows.select(key, *keep, F.array(*(analyze(F.col(f)) for f in fields)).alias("fields"))


def is_current(built: DataFrame, rows: DataFrame) -> bool:
    """Whether an index has as many rows as its source: then it need not be built again."""
    return built.count() == rows.count()


def _count(phrase: str) -> str:
    words = phrase.split()
    first = "t -> t = '{}'".format(words[0])
    if len(words) == 1:
        return f"aggregate(fields, 0, (s, a) -> s + size(filter(a, {first})))"
    here = " AND ".join(f"get(a, i + {k}) = '{w}'" for k, w in enumerate(words))
    return f"aggregate(fields, 0, (s, a) -> s + size(filter(transform(a, (t, i) -> {here}), x -> x)))"


def phrases_of(queries: Sequence[MatchQuery]) -> list[str]:
    return list(dict.fromkeys(p for q in queries for g in q.groups for p in g))


def counted(built: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """``built`` with dl, its words, and tf, the phrases' occurrences in all fields together."""
    rows = built.withColumn("dl", F.aggregate("fields", F.lit(0), lambda s, a: s + F.size(a)))
    return rows.withColumn("tf", F.expr(f"array({', '.join(_count(p) for p in phrases)})")).drop("fields")


def weighed(built: Index | DataFrame, phrases: Sequence[str]) -> tuple[DataFrame, list[float], Column]:
    """Rows with ``dl`` and ``tf``, the phrases' weights, and what a document's length adds to a frequency.

    An inverted index reads the postings of the phrases' words; a table of word lists is scanned."""
    of_phrase = [F.count_if(F.col("tf")[i] > 0).alias(f"df_{i}") for i in range(len(phrases))]
    if isinstance(built, Index):
        rows, n, avgdl = built.counted(phrases), built.n, built.avgdl
        if any(" " in p for p in phrases):
            s = rows.agg(*of_phrase).first()
        else:
            found = built.frequencies(phrases)
            s = {f"df_{i}": found[p] for i, p in enumerate(phrases)}
    else:
        rows = counted(built, phrases)
        s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *of_phrase).first()
        n, avgdl = s.n, s.avgdl
    idf = [max(1e-6, math.log((n - s[f"df_{i}"] + 0.5) / (s[f"df_{i}"] + 0.5))) if n else 0.0 for i in range(len(phrases))]
    return rows, idf, K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0))


def _matches(q: MatchQuery, at: dict[str, int]) -> Column:
    any_of = lambda g: F.expr(" OR ".join(f"tf[{at[p]}] > 0" for p in g))
    out = any_of(q.groups[0])
    for g in q.groups[1:]:
        out = (out & any_of(g)) if q.every else (out | any_of(g))
    return out


def search(built: Index | DataFrame, queries: Sequence[MatchQuery], limit: int, order: Sequence[Column], where: Column | None = None, penalty: Column | None = None, within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The cascade: rows of the first query by rank, then what the next one adds, up to ``limit``.

    Columns: those of ``built`` but the words, score (negative; lower is better), stage, rank.  ``order`` breaks ties of
    rounded scores (of score + ``penalty`` and then score, where there is one).  Statistics cover all rows, ``where`` and
    ``within`` (a filter as a function) only what may be returned.
    """
    if not queries:
        empty = built.counted([]).drop("dl", "tf") if isinstance(built, Index) else built.drop("fields")
        return empty.select("*", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("stage"), F.lit(0).cast("long").alias("rank")).limit(0)
    phrases = phrases_of(queries)
    at = {p: i for i, p in enumerate(phrases)}
    rows, idf, norm = weighed(built, phrases)

    def score(q: MatchQuery) -> Column:
        total = F.lit(0.0)
        for g in q.groups:
            for p in g:
                f = F.col("tf")[at[p]]
                total = total - F.lit(idf[at[p]]) * f * (K1 + 1) / (f + norm)
        return total

    if where is not None:
        rows = rows.where(where)
    if within is not None:
        rows = within(rows)
    stages = F.filter(F.array(*(F.struct(F.lit(i).cast("long").alias("stage"), score(q).alias("score"), _matches(q, at).alias("hit")) for i, q in enumerate(queries))), lambda x: x.hit)
    kept = [c for c in rows.columns if c not in ("dl", "tf")]
    found = rows.withColumn("x", F.explode(stages)).select(*kept, F.col("x.stage").alias("stage"), F.col("x.score").alias("score"))
    by = [F.round(F.col("score") + penalty, 9)] if penalty is not None else []
    by += [F.round("score", 9), *order]
    fetch = max(3 * limit, 20)
    best = found.withColumn("pos", F.row_number().over(Window.partitionBy("stage").orderBy(*by))).where(F.col("pos") <= fetch)
    first = best.withColumn("seen", F.row_number().over(Window.partitionBy(kept[0]).orderBy("stage", "pos"))).where("seen = 1").orderBy("stage", "pos").limit(limit)
    return first.select(*kept, "score", "stage", F.row_number().over(Window.orderBy("stage", "pos")).cast("long").alias("rank"))


def search_works(built: Index | DataFrame, queries: Sequence[MatchQuery], limit: int, key: str = "work_id", year: str = "year", where: Column | None = None, within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Equal scores: the later year first (none last), then the later id."""
    return search(built, queries, limit, [F.col(year).desc_nulls_last(), F.col(key).desc()], where, within=within)


def search_chunks(built: Index | DataFrame, queries: Sequence[MatchQuery], limit: int, key: str = "chunk_id", role: str = "chunk_role", where: Column | None = None, within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Windows of formulas and assets rank a little lower; equal scores: by role, then by id."""
    penalty, place = F.lit(0.0), F.lit(len(ROLES))
    for k, v in PENALTIES.items():
        penalty = F.when(F.col(role) == k, v).otherwise(penalty)
    for i, k in enumerate(ROLES):
        place = F.when(F.col(role) == k, i).otherwise(place)
    return search(built, queries, limit, [place, F.col(key)], where, penalty, within)


def search_by_id(built: Index | DataFrame, queries: Sequence[MatchQuery], limit: int, key: str, where: Column | None = None) -> DataFrame:
    """Formulas and assets: equal scores by id."""
    return search(built, queries, limit, [F.col(key)], where)


# ---- agreement and vectors


def agreement(words: Column, groups: Sequence[Sequence[str]]) -> tuple[Column, Column]:
    """(hits, coverage): groups of which an alias has all its words among ``words``; coverage is their share."""
    hits = F.lit(0)
    for g in groups:
        found = F.lit(False)
        for alias in g:
            every = F.lit(True)
            for w in alias.split():
                every = every & F.array_contains(words, w)
            found = found | every
        hits = hits + found.cast("int")
    return hits.cast("long"), hits / F.lit(float(len(groups) or 1))


def agrees(groups: Sequence[Sequence[str]]) -> Column:
    return (F.col("hits") >= max(1, min(2, len(groups)))) | (F.col("coverage") >= 0.75) if groups else F.lit(True)


def _whole(value: Column) -> Column:
    """The greatest value of a ranked list, a few hundred rows at most."""
    return F.max(value).over(Window.partitionBy())


def vector_ranked(scores: DataFrame, texts: DataFrame, groups: Sequence[Sequence[str]], limit: int, key: str = "id", analyze: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, score, hits, coverage, rank) of the best vectors.

    Scores of zero and less go if there are others.  Of those left, the ones that agree with the query; else those that
    hit any group; else all.  Rank: hits, coverage, score, then the order by score.  ``texts``: (key, words), or (key, text)
    with ``analyze``, which then cuts only the best rows' texts into words.
    """
    order = [F.round("score", 9).desc(), F.col(key)]
    top = scores.orderBy(*order).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    top = top.withColumn("positive", _whole((F.col("score") > 0).cast("int"))).where("score > 0 or positive = 0")
    hits, coverage = agreement(F.col("words"), groups)
    rows = texts.join(F.broadcast(top), key)
    rows = rows if analyze is None else rows.withColumn("words", analyze(F.col("text")))
    rows = rows.select(key, "score", "pos", hits.alias("hits"), coverage.alias("coverage"))
    rows = rows.withColumn("tier", F.when(agrees(groups), 2).when(F.col("hits") > 0, 1).otherwise(0)).withColumn("top", _whole(F.col("tier")))
    rows = rows.where(F.col("tier") == F.col("top")) if groups else rows
    by = [F.col("hits").desc(), F.round("coverage", 9).desc(), F.round("score", 9).desc(), F.col("pos")]
    return rows.select(key, "score", "hits", "coverage", F.row_number().over(Window.orderBy(*by)).cast("long").alias("rank"))


def fuse(words: DataFrame, vectors: DataFrame, groups: Sequence[Sequence[str]], weights: tuple[float, float], key: str = "id") -> DataFrame:
    """(key, hybrid, bm25_rank, vector_rank, hits, coverage): reciprocal ranks of both lists (key, rank, hits, coverage), weighted.

    Vectors that do not agree with the query take part only if no vector does and the words found nothing.
    """
    found = words.agg(F.count(F.lit(1)).alias("n")).scalar()
    v = vectors.withColumn("agrees", agrees(groups)).withColumn("some", _whole(F.col("agrees").cast("int"))).where(F.col("agrees") | ((F.col("some") == 0) & (found == 0)))
    v = v.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("long"))
    w1, w2 = (F.when(found > 0, w).otherwise(1.0) for w in weights)
    a = words.select(key, F.col("rank").alias("bm25_rank"), F.lit(None).cast("long").alias("vector_rank"), "hits", "coverage")
    b = v.select(key, F.lit(None).cast("long").alias("bm25_rank"), F.col("rank").alias("vector_rank"), "hits", "coverage")
    both = a.unionByName(b).groupBy(key).agg(*(F.max(c).alias(c) for c in ("bm25_rank", "vector_rank", "hits", "coverage")))
    hybrid = F.coalesce(w1 / (RRF + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(w2 / (RRF + F.col("vector_rank")), F.lit(0.0))
    return both.withColumn("hybrid", hybrid)


# ---- graph support


#: A table of edges from both ends, or what makes those of a list of sources.
Edges = DataFrame | Callable[[list], DataFrame]


def seed_neighbours(seeds: DataFrame, edges: Edges, similar: Edges, k: int, key: str = "id") -> DataFrame:
    """(seed columns, dst, shared, edge_score, kind, place): each seed's k neighbours.

    First those of coupling and co-citation ``edges`` (src, dst, shared, score; both directions; one that is found by both
    kinds counts twice), most shared first; then, where they are fewer than k, by similarity, without those seen.
    """
    ids = [r[0] for r in seeds.select(key).collect()]  # as many as the caller's limit of seeds
    seeds, at_seed = F.broadcast(seeds), F.col("src").isin(ids)
    edges, similar = (x(ids) if callable(x) else x.where(at_seed) for x in (edges, similar))
    by = [F.col("shared").desc(), F.round("edge_score", 9).desc_nulls_last(), F.col("dst")]
    cited = edges.select("src", "dst", "shared", F.col("score").alias("edge_score")).join(seeds, F.col("src") == F.col(key)).drop("src")
    cited = cited.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("place") <= k)
    alike = similar.select("src", "dst", F.lit(0).cast("long").alias("shared"), F.col("score").alias("edge_score")).join(seeds, F.col("src") == F.col(key)).drop("src")
    alike = alike.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("place") <= 2 * k)
    new = alike.join(cited.select(key, "dst").distinct(), [key, "dst"], "left_anti")
    rows = cited.withColumn("tier", F.lit(0)).unionByName(new.withColumn("tier", F.lit(1)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("tier", "place"))).where(F.col("place") <= k)
    return rows.withColumn("kind", F.when(F.col("tier") == 1, "similarity").otherwise("citation")).drop("tier")


def inject(fused: DataFrame, edges: Edges, similar: Edges, groups: Sequence[Sequence[str]], k: int, seed_limit: int, key: str = "id") -> DataFrame:
    """``fused`` with what the neighbours of its best rows gain: graph_score, graph_votes, graph_shared; new rows have no hits."""
    order = [F.round("hybrid", 9).desc(), F.col(key)]
    seeds = fused.orderBy(*order).limit(max(1, seed_limit)).withColumn("seed_rank", F.row_number().over(Window.orderBy(*order)))
    support = F.when(F.col("bm25_rank").isNotNull(), 1.0).otherwise(F.greatest(F.lit(0.25), F.col("coverage")))
    seeds = seeds.where(F.col("bm25_rank").isNotNull() | agrees(groups)).select(key, "seed_rank", support.alias("support"))
    near = seed_neighbours(seeds, edges, similar, max(1, k), key)
    strength = F.when(F.col("kind") == "similarity", F.greatest(F.lit(0.2), F.col("edge_score"))).otherwise(1.0)
    boost = F.col("support") * strength * 0.5 / (RRF + F.col("seed_rank") + F.col("place"))
    gained = near.groupBy(F.col("dst").alias(key)).agg(F.sum(boost).alias("graph_score"), F.count(F.lit(1)).alias("graph_votes"), F.max("shared").alias("graph_shared"))
    rows = fused.join(gained, key, "full")
    zero = {"hybrid": 0.0, "hits": 0, "coverage": 0.0, "graph_score": 0.0, "graph_votes": 0, "graph_shared": 0}
    return rows.fillna(zero).withColumn("hybrid", F.col("hybrid") + F.col("graph_score"))


def rank_works(fused: DataFrame, limit: int, key: str = "id") -> DataFrame:
    order = [F.col("hits").desc(), F.round("coverage", 9).desc(), F.round("hybrid", 9).desc(), F.round("graph_score", 9).desc(), F.col(key)]
    return fused.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def rank_chunks(fused: DataFrame, limit: int, key: str = "id") -> DataFrame:
    order = [F.round("hybrid", 9).desc(), F.col("hits").desc(), F.round("coverage", 9).desc(), F.col(key)]
    return fused.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def one_per_family(ranked: DataFrame, families: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """One row of each family: its primary if that was found, else its best; at the place of the best, with the other members' ids as ``versions``.

    ``families``: (key, family, primary); a work without family stands for itself.
    """
    rows = ranked.join(families, key, "left")
    group = F.struct(F.col("family").isNull().alias("alone"), F.coalesce("family", key).alias("name"))
    rows = rows.withColumn("group", group).withColumn("is_primary", F.coalesce(F.col("primary") == F.col(key), F.lit(False)))
    own = Window.partitionBy("group")
    rows = rows.withColumn("place", F.min("rank").over(own)).withColumn("members", F.collect_list(key).over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = rows.withColumn("n", F.row_number().over(own.orderBy(F.col("is_primary").desc(), "rank"))).where("n = 1").orderBy("place").limit(limit)
    return first.withColumn("versions", F.array_except("members", F.array(key))).withColumn("rank", F.row_number().over(Window.orderBy("place")).cast("long")).drop("group", "is_primary", "place", "members", "n")
