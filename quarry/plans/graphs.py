"""Graph, family, community and facet queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import title, tokens
from quarry.operators import graph, lexical, objects
from quarry.operators.families import title_classes, title_pairs
from quarry.plans.registry import Registry
from quarry.plans.stored import stored
from quarry.plans.retrieval import WORDS, _bm25, _RANK, _TOKENS, coupled, text_index
from quarry.sources.tables import table

R = Registry()


def _pairs(node: str, via: str) -> str:
    return f"""e AS (SELECT DISTINCT {node} AS n, {via} AS v FROM lineitem), g AS (SELECT n, count(*) AS deg FROM e GROUP BY 1),
    p AS (SELECT a.n AS src, b.n AS dst, count(*) AS shared FROM e a JOIN e b ON a.v = b.v AND a.n < b.n GROUP BY 1, 2 HAVING count(*) >= 2),
    s AS (SELECT src, dst, shared, shared / sqrt(x.deg * y.deg) AS score FROM p JOIN g x ON x.n = src JOIN g y ON y.n = dst)"""


@R.add("biblio_coupling", f"WITH {_pairs('l_orderkey', 'l_partkey')} SELECT src, dst, shared, round(score, 6) AS score FROM s")
def biblio_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shared_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey").withColumn("score", F.round("score", 6))


@R.add("co_citation", f"WITH {_pairs('l_partkey', 'l_orderkey')} SELECT src, dst, shared, round(score, 6) AS score FROM s")
def co_citation(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shared_pairs(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey").withColumn("score", F.round("score", 6))


@R.add(
    "graph_neighbors",
    f"""WITH {_pairs('l_partkey', 'l_orderkey')}, m AS (SELECT src, dst, shared, score FROM s UNION ALL SELECT dst, src, shared, score FROM s)
    SELECT src, dst, shared, round(score, 6) AS score, row_number() OVER (PARTITION BY src ORDER BY shared DESC, round(score, 9) DESC NULLS LAST, dst) AS rank FROM m QUALIFY rank <= 5""",
)
def graph_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(coupled(spark, sf), 5).withColumn("score", F.round("score", 6))


@R.add(
    "updated_edges",
    """WITH e AS (SELECT DISTINCT l_partkey AS n, l_orderkey AS v FROM lineitem WHERE l_quantity > 2), d AS (SELECT n, count(*) AS d FROM e GROUP BY 1),
    p AS (SELECT a.n AS src, b.n AS dst, count(*) AS shared FROM e a JOIN e b ON a.v = b.v AND a.n < b.n GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT src, dst, shared, round(shared / sqrt(x.d * y.d), 6) AS score FROM p JOIN d x ON x.n = src JOIN d y ON y.n = dst""",
)
def updated_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after rows came and went: those of the older table, with the touched parts' edges made anew.

    The older table lacks what was shipped last and still has the rows of the smallest quantities, which have gone since."""
    items = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", "l_shipdate")
    late = F.col("l_shipdate") >= F.add_months(F.lit(items.agg(F.max("l_shipdate")).first()[0]), -1)
    old = items.where(~late)
    before = stored(spark, sf, "older-edges", ["lineitem"], lambda: graph.shared_pairs(old, "l_partkey", "l_orderkey"))
    now = items.where("l_quantity > 2")
    changed = now.where(late).unionByName(old.where("l_quantity <= 2"))
    return graph.updated_pairs(before, now, changed, "l_partkey", "l_orderkey").withColumn("score", F.round("score", 6))


@R.add(
    "citation_backfill",
    """SELECT l_orderkey, count(*) AS citations, count(p_partkey) AS resolved FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON p_partkey = l_partkey GROUP BY 1""",
)
def citation_backfill(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    known = table(spark, sf, "part").where("p_size <= 25").select("p_partkey")
    return refs.join(known, refs.l_partkey == known.p_partkey, "left").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("citations"), F.count("p_partkey").alias("resolved"))


# ---- version families: works whose titles are nearly the same


def stored_families(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "families", ["documents"], lambda: families(table(spark, sf, "documents")))


def families(docs: DataFrame) -> DataFrame:
    """(doc_id, family): the least document id that equal or nearly equal titles lead to."""
    classes = graph.written(title_classes(docs), "titles")
    members = graph.connected_components(title_pairs(classes))
    return classes.join(members.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("family"))


_TITLES = """tw AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80)), '[\\p{L}\\p{N}_]+'))) AS words FROM documents),
  tc AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY words) AS rep, words FROM tw), rp AS (SELECT rep, words FROM tc WHERE doc_id = rep AND len(words) >= 6),
  tp AS (SELECT a.rep AS src, b.rep AS dst, len(list_intersect(a.words, b.words)) AS shared, len(list_distinct(list_concat(a.words, b.words))) AS u FROM rp a JOIN rp b ON a.rep < b.rep
    WHERE len(list_intersect(a.words, b.words)) >= 6 AND 100 * len(list_intersect(a.words, b.words)) >= 92 * len(list_distinct(list_concat(a.words, b.words))))"""
_FAMILIES = (
    _TITLES
    + """, mir AS (SELECT src, dst FROM tp UNION SELECT dst, src FROM tp), reach(a, b) AS (SELECT rep, rep FROM rp UNION SELECT reach.a, mir.dst FROM reach JOIN mir ON mir.src = reach.b),
  fam AS (SELECT doc_id, coalesce(f, rep) AS family FROM tc LEFT JOIN (SELECT a, min(b) AS f FROM reach GROUP BY 1) ON a = rep)"""
)


@R.add("near_dup_pairs", f"WITH {_TITLES} SELECT src, dst, shared::BIGINT AS shared, round(shared / u, 6) AS score FROM tp")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return title_pairs(graph.written(title_classes(table(spark, sf, "documents")), "titles")).withColumn("score", F.round("score", 6))


@R.add("family_components", f"WITH RECURSIVE {_FAMILIES} SELECT doc_id, family FROM fam")
def family_components(spark: SparkSession, sf: str) -> DataFrame:
    return stored_families(spark, sf)


@R.add(
    "family_primary",
    f"""WITH RECURSIVE {_FAMILIES}, x AS (SELECT family, doc_id, coalesce(quality, 0) AS q, n_chars FROM fam JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id))
    SELECT family, arg_max(doc_id, (q, n_chars, -doc_id)) AS primary_id, count(*) AS members, max(n_chars) AS longest FROM x GROUP BY 1""",
)
def family_primary(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = stored_families(spark, sf).join(docs, "doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    best = F.max_by("doc_id", F.struct(F.coalesce("quality", F.lit(0)), "n_chars", -F.col("doc_id")))
    return rows.groupBy("family").agg(best.alias("primary_id"), F.count(F.lit(1)).alias("members"), F.max("n_chars").alias("longest"))


@R.add(
    "family_dedup_rank",
    f"""WITH RECURSIVE {_TOKENS}, s AS ({_bm25(WORDS)}), r AS (SELECT doc_id, {_RANK} AS pos FROM s QUALIFY pos <= 60), {_FAMILIES},
    k AS (SELECT family, min(pos) AS pos, arg_min(doc_id, pos) AS doc_id, count(*) AS versions FROM r JOIN fam USING (doc_id) GROUP BY 1)
    SELECT doc_id, family, versions, row_number() OVER (ORDER BY pos) AS rank FROM k""",
)
def family_dedup_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    best = lexical.ranked(lexical.bm25_scores(text_index(spark, sf), WORDS), 60)
    rows = stored_families(spark, sf).join(F.broadcast(best), "doc_id")  # 60 rows
    kept = rows.groupBy("family").agg(F.min("rank").alias("pos"), F.min_by("doc_id", "rank").alias("doc_id"), F.count(F.lit(1)).alias("versions"))
    return kept.select("doc_id", "family", "versions", F.row_number().over(Window.orderBy("pos")).cast("long").alias("rank"))


_TYPES = "CASE lang WHEN 'en' THEN 'article' WHEN 'fr' THEN 'review' WHEN 'de' THEN 'note' ELSE 'conference paper' END"


@R.add(
    "online_merge",
    f"""WITH RECURSIVE {_TOKENS}, a AS ({_bm25(WORDS[:1])}), b AS ({_bm25(WORDS[1:])}), r AS (SELECT doc_id, 0 AS l, {_RANK} AS r FROM a QUALIFY r <= 30 UNION ALL SELECT doc_id, 1, {_RANK} AS r FROM b QUALIFY r <= 30), {_FAMILIES},
    t AS (SELECT doc_id, n_chars, {_TYPES} AS type FROM documents),
    f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r) + CASE type WHEN 'article' THEN 0.003 WHEN 'review' THEN 0.0015 WHEN 'note' THEN -0.0015 ELSE -0.001 END) AS score, count(*) AS lists, min((l, r)) AS first FROM r JOIN t USING (doc_id) GROUP BY 1),
    p AS (SELECT f.*, family, n_chars, type, row_number() OVER (ORDER BY round(score, 9) DESC, first, doc_id) AS place FROM f JOIN fam USING (doc_id) JOIN t USING (doc_id)),
    g AS (SELECT arg_max({{'k': doc_id, 's': score, 'l': lists}}, (CASE type WHEN 'article' THEN 5 WHEN 'review' THEN 4 WHEN 'note' THEN 3 ELSE 2 END, n_chars, -place)) AS b, min(place) AS place, count(*) AS members FROM p GROUP BY family)
    SELECT b.k AS key, round(b.s, 6) AS score, b.l AS lists, members, row_number() OVER (ORDER BY place) AS rank FROM g""",
)
def online_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Several ranked lists as one: reciprocal ranks with a bonus for the type, versions of one work as one hit, the richest standing for it."""
    docs = table(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", "article").when(F.col("lang") == "fr", "review").when(F.col("lang") == "de", "note").otherwise("conference paper")
    typed = docs.select("doc_id", "n_chars", kind.alias("type"))
    lists = [lexical.ranked(lexical.bm25_scores(text_index(spark, sf), w), 30).select("doc_id", F.lit(i).alias("list"), "rank") for i, w in enumerate((WORDS[:1], WORDS[1:]))]
    hits = typed.join(F.broadcast(lists[0].unionByName(lists[1])), "doc_id")  # 60 rows
    fused = objects.fused_lists(hits.select(F.col("doc_id").alias("key"), "list", "rank", "type"))
    preference = F.when(F.col("type") == "article", 5).when(F.col("type") == "review", 4).when(F.col("type") == "note", 3).otherwise(2)
    groups = stored_families(spark, sf).join(typed, "doc_id").select(F.col("doc_id").alias("key"), F.col("family").alias("group"), F.struct(preference, "n_chars").alias("richness"))
    return objects.one_per_group(fused, groups, 60)


# ---- communities of parts


def group_pairs(rows: DataFrame, key: list[str], member: str, cap: int) -> DataFrame:
    """(src, dst): pairs of members of the same group, for groups of 2 to ``cap`` members (the rule that defines this signal)."""
    m = rows.select(*key, F.col(member).alias("m")).distinct()
    sized = m.join(m.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(f"size between 2 and {cap}"), key)
    a, b = sized.alias("a"), sized.alias("b")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same & (F.col("a.m") < F.col("b.m"))).select(F.col("a.m").alias("src"), F.col("b.m").alias("dst"))


def _group(key: str, member: str, cap: int, weight: float) -> str:
    return f"""SELECT a.{member} AS src, b.{member} AS dst, {weight}::DOUBLE AS w FROM part a JOIN part b ON ({', '.join('a.' + k for k in key.split(','))}) = ({', '.join('b.' + k for k in key.split(','))}) AND a.{member} < b.{member}
      WHERE (SELECT count(*) FROM part c WHERE ({', '.join('c.' + k for k in key.split(','))}) = ({', '.join('a.' + k for k in key.split(','))})) BETWEEN 2 AND {cap}"""


@R.add("group_overlap_edges", "SELECT src, dst FROM (" + _group("p_brand,p_type,p_size", "p_partkey", 24, 0.18) + ")")
def group_overlap_edges(spark: SparkSession, sf: str) -> DataFrame:
    return group_pairs(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"], "p_partkey", 24)


def top_values(rows: DataFrame, group: str, value: str, n: int = 3) -> DataFrame:
    """(group, labels): the n most frequent values as 'value=count', ties by value."""
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(group).orderBy(F.col("c").desc(), value)
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    label = F.concat(F.replace(F.col(value), F.lit("_"), F.lit(" ")), F.lit("="), F.col("c").cast("string"))
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", label.alias("l")))), lambda x: x.l), " | ").alias("labels"))


# ---- facets


def facets(spark: SparkSession, sf: str) -> DataFrame:
    """(facet, label, owner): five facets of the star tables."""
    customer, part = table(spark, sf, "customer"), table(spark, sf, "part")
    col = lambda df, kind, label, owner: df.select(F.lit(kind).alias("facet"), F.col(label).cast("string").alias("label"), F.col(owner).cast("long").alias("owner"))
    frames = [
        col(customer, "collaboration", "c_mktsegment", "c_custkey"),
        col(customer, "topic", "c_nationkey", "c_custkey"),
        col(part, "result_kind", "p_type", "p_partkey"),
        col(part, "method_family", "p_brand", "p_partkey"),
        col(part, "physics_concept", "p_name", "p_partkey"),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_FACETS = """fc AS (SELECT 'collaboration' AS facet, c_mktsegment AS label, c_custkey AS owner FROM customer UNION ALL SELECT 'topic', c_nationkey::VARCHAR, c_custkey FROM customer UNION ALL SELECT 'result_kind', p_type, p_partkey FROM part
  UNION ALL SELECT 'method_family', p_brand, p_partkey FROM part UNION ALL SELECT 'physics_concept', p_name, p_partkey FROM part)"""


@R.add("facet_summaries", f"WITH {_FACETS} SELECT facet, label, count(DISTINCT owner) AS works, count(*) AS signals FROM fc GROUP BY 1, 2 HAVING count(DISTINCT owner) >= 2")
def facet_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return facets(spark, sf).groupBy("facet", "label").agg(F.countDistinct("owner").alias("works"), F.count(F.lit(1)).alias("signals")).where("works >= 2")


@R.add(
    "facet_topn",
    f"""WITH {_FACETS}, c AS (SELECT facet, label, count(*) AS n FROM fc GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, label) AS r FROM c QUALIFY r <= 3)
    SELECT facet, string_agg(replace(label, '_', ' ') || '=' || n, ' | ' ORDER BY r) AS labels FROM t GROUP BY 1""",
)
def facet_topn(spark: SparkSession, sf: str) -> DataFrame:
    return top_values(facets(spark, sf), "facet", "label")


@R.add(
    "summary_search",
    f"""WITH {_FACETS}, s AS (SELECT facet, label, count(DISTINCT owner) AS works, count(*) AS signals FROM fc GROUP BY 1, 2), h AS (SELECT *, contains(lower(label), 'brand')::INT + contains(lower(label), '1')::INT + contains(lower(label), 'ring')::INT AS hits FROM s)
    SELECT facet, label, hits::BIGINT AS hits, round(1.5 * hits + hits / 3.0::DOUBLE + 0.02 * least(works, 25) + 0.01 * least(signals, 25), 6)::DOUBLE AS score FROM h WHERE hits > 0""",
)
def summary_search(spark: SparkSession, sf: str) -> DataFrame:
    s = facets(spark, sf).groupBy("facet", "label").agg(F.countDistinct("owner").alias("works"), F.count(F.lit(1)).alias("signals"))
    hits = sum((F.lower("label").contains(w).cast("int") for w in ("brand", "1", "ring")), F.lit(0))
    score = 1.5 * F.col("hits") + F.col("hits") / 3.0 + 0.02 * F.least("works", F.lit(25)) + 0.01 * F.least("signals", F.lit(25))
    return s.withColumn("hits", hits.cast("long")).where("hits > 0").select("facet", "label", "hits", F.round(score, 6).alias("score"))


@R.add(
    "transfer_candidates",
    """WITH x AS (SELECT DISTINCT l_suppkey AS supp, lower(p_name) || '/' || lower(p_brand) || '/' || p_size AS k FROM lineitem JOIN part ON p_partkey = l_partkey), r AS (SELECT l_suppkey AS supp, max((l_returnflag = 'R')::INT) AS has FROM lineitem GROUP BY 1),
    p AS (SELECT a.supp AS src, b.supp AS dst, count(*) AS support FROM x a JOIN x b ON a.k = b.k AND a.supp <> b.supp GROUP BY 1, 2)
    SELECT src, dst, support, round(least(0.99, 0.35 + 0.2 * support + 0.15 * has), 6)::DOUBLE AS score FROM p JOIN r ON r.supp = src WHERE support >= 2""",
)
def transfer_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of suppliers whose parts share a computed key."""
    items = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    key = F.concat(F.lower("p_name"), F.lit("/"), F.lower("p_brand"), F.lit("/"), F.col("p_size").cast("string"))
    x = items.join(part, items.l_partkey == part.p_partkey).select(F.col("l_suppkey").alias("supp"), key.alias("k"))
    # Here the giver's own returns count as the result that supports it, so pairs are turned round.
    has = items.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("work")).distinct()
    found = objects.transfer(x.select(F.col("supp").alias("work"), F.col("k").alias("key")), has, least=2)
    return found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "support", F.round("score", 6).alias("score"))
