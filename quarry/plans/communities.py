"""Communities of parts: eight signals, fine communities, their summaries, overviews and search.

Bindings: works are parts; similarity is the nearest-neighbour edges of the embeddings; coupling joins parts of returned orders,
co-citation parts of all orders; the keys of the other signals are put together from a part's attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators import community as C
from quarry.operators import graph, vectors
from quarry.plans.pieces import KNN as _KNN
from quarry.plans.pieces import hits_sql as _hits_sql
from quarry.plans.registry import Registry
from quarry.plans.stored import stored
from quarry.sources.tables import table

R = Registry()
KEYS = {
    "topic": ("p_brand", "p_type", "p_size"),
    "result": ("p_name", "p_size"),
    "method": ("p_name", "p_brand"),
    "collaboration": ("p_type", "p_size", "p_name"),
    "physics": ("p_brand", "p_size"),
}
#: What communities are described by.
LABELS = {"topic": "p_brand", "result": "p_type", "method": "p_name", "physics": "p_size", "collaboration": "p_mod"}
#: The tables that communities are made of.
MADE_OF = ("part", "lineitem", "embeddings")
QUERY_GROUPS = (("brand 1", "brand 12", "brand 7"), ("ring", "bolt"), ("economy", "promo"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    part, items = table(spark, sf, "part"), table(spark, sf, "lineitem")
    keyed = {k: part.select(F.col("p_partkey").alias("work"), F.concat_ws("/", *(F.col(c).cast("string") for c in cols)).alias("key")) for k, cols in KEYS.items()}
    coupled = graph.shared_pairs(items.where("l_returnflag = 'R'"), "l_partkey", "l_orderkey")
    cocited = graph.shared_pairs(items, "l_partkey", "l_orderkey")
    return C.weighted(C.signal_rows(vectors.knn_edges(table(spark, sf, "embeddings")), coupled, cocited, keyed))


def _shared_sql(name: str, where: str) -> str:
    return f"""{name}_e AS (SELECT DISTINCT l_partkey AS n, l_orderkey AS v FROM lineitem WHERE {where}), {name}_g AS (SELECT n, count(*) AS d FROM {name}_e GROUP BY 1),
  {name}_p AS (SELECT a.n AS src, b.n AS dst, count(*) AS shared FROM {name}_e a JOIN {name}_e b ON a.v = b.v AND a.n < b.n GROUP BY 1, 2 HAVING count(*) >= 2),
  {name} AS (SELECT src, dst, least(0.6, greatest(1.6 * shared / sqrt(x.d * y.d), least(0.35, 0.06 * shared)))::DOUBLE AS w FROM {name}_p JOIN {name}_g x ON x.n = src JOIN {name}_g y ON y.n = dst)"""


def _group_sql(name: str) -> str:
    weight, cap = C.GROUPS[name]
    key = " || '/' || ".join(KEYS[name])
    return f"""{name}_k AS (SELECT p_partkey AS w, {key} AS k, count(*) OVER (PARTITION BY {key}) AS c FROM part),
  {name}_s AS (SELECT a.w AS src, b.w AS dst, {weight}::DOUBLE AS w FROM {name}_k a JOIN {name}_k b ON a.k = b.k AND a.w < b.w WHERE a.c BETWEEN 2 AND {cap})"""


_COUNTS = ", ".join(f"count(*) FILTER (WHERE signal = '{s}') AS {s}" for s in C.SIGNALS)
_EDGES = f"""{_KNN}, {_shared_sql('bib', "l_returnflag = 'R'")}, {_shared_sql('coc', 'true')}, {', '.join(_group_sql(k) for k in C.GROUPS)},
  sg AS (SELECT a AS src, b AS dst, 'similarity' AS signal, least(1, greatest(0, score))::DOUBLE AS w FROM kn UNION ALL SELECT src, dst, 'bibliographic', w FROM bib UNION ALL SELECT src, dst, 'co_citation', w FROM coc
    {' '.join(f"UNION ALL SELECT src, dst, '{k}', w FROM {k}_s" for k in C.GROUPS)}),
  we AS (SELECT src, dst, sum(w) AS weight, {_COUNTS} FROM sg GROUP BY 1, 2), st AS (SELECT * FROM we WHERE round(weight, 9) >= {C.FINE})"""
_FINE = f"""{_EDGES}, mir AS (SELECT src, dst FROM st UNION SELECT dst, src FROM st),
  reach(a, b) AS (SELECT src, src FROM mir UNION SELECT reach.a, mir.dst FROM reach JOIN mir ON mir.src = reach.b), comm AS (SELECT a AS work, min(b) AS community FROM reach GROUP BY 1)"""


@R.add("weighted_edges", f"WITH {_EDGES} SELECT src, dst, round(weight, 6) AS weight, {', '.join(C.SIGNALS)} FROM we")
def weighted_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).withColumn("weight", F.round("weight", 6))


def fine(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(members, strong edges), both stored."""
    strong = stored(spark, sf, "strong-edges", MADE_OF, lambda: C.strong(edges(spark, sf)))
    return stored(spark, sf, "communities", MADE_OF, lambda: C.components(strong)), strong


@R.add("communities", f"WITH RECURSIVE {_FINE} SELECT work, community FROM comm")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return fine(spark, sf)[0]


def labels(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("p_mod", F.col("p_partkey") % 5)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in LABELS.items()))
    return part.select(F.col("p_partkey").alias("work"), F.explode(kinds).alias("l")).select("work", "l.*").where("value is not null")


_LABELS = "lb AS (" + " UNION ALL ".join(f"SELECT p_partkey AS work, '{k}' AS kind, ({'p_partkey % 5' if c == 'p_mod' else c})::VARCHAR AS value FROM part" for k, c in LABELS.items()) + ")"
_TOP = f"""{_LABELS}, lc AS (SELECT community, kind, value, count(*) AS works FROM comm JOIN lb USING (work) GROUP BY 1, 2, 3),
  tl AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY community, kind ORDER BY works DESC, value) <= {C.LABELS})"""
_SUMMARY = f"""{_TOP}, inn AS (SELECT st.*, a.community FROM st JOIN comm a ON a.work = src JOIN comm b ON b.work = dst AND a.community = b.community),
  es AS (SELECT community, count(*) AS edges, {', '.join(f'sum({s})::BIGINT AS {s}' for s in C.SIGNALS)} FROM inn GROUP BY 1),
  ce AS (SELECT work, sum(weight) AS centrality FROM (SELECT src AS work, weight FROM inn UNION ALL SELECT dst, weight FROM inn) GROUP BY 1),
  rp AS (SELECT community, work, row_number() OVER (PARTITION BY community ORDER BY round(coalesce(centrality, 0), 9) DESC, p_size DESC, lower(p_name), work) AS r FROM comm JOIN part ON p_partkey = work LEFT JOIN ce USING (work) QUALIFY r <= {C.REPRESENTATIVES}),
  rl AS (SELECT community, string_agg(work::VARCHAR, ',' ORDER BY r) AS representatives FROM rp GROUP BY 1),
  fl AS (SELECT community, string_agg(value, ' ' ORDER BY kind, works DESC, value) AS words, min(value) FILTER (WHERE kind = 'topic' AND works = m) AS label FROM (SELECT *, max(works) OVER (PARTITION BY community, kind) AS m FROM tl) GROUP BY 1),
  su AS (SELECT c.community, c.works, edges, {', '.join(C.SIGNALS)}, representatives, words, label FROM (SELECT community, count(*) AS works FROM comm GROUP BY 1) c JOIN es USING (community) JOIN rl USING (community) JOIN fl USING (community))"""


def summaries(spark: SparkSession, sf: str, members: DataFrame, strong: DataFrame) -> DataFrame:
    """(community, works, edges, signals, representatives, words, label)."""
    inner = C.within(strong, members)
    part = table(spark, sf, "part")
    works = part.select(F.col("p_partkey").alias("work"), F.lit(0).alias("citations"), F.col("p_size").alias("year"), F.col("p_name").alias("title"))
    top = C.top_labels(members, labels(spark, sf))
    listed = F.array_sort(F.collect_list(F.struct("kind", (-F.col("works")).alias("w"), "value")))
    words = top.groupBy("community").agg(
        F.array_join(F.transform(listed, lambda x: x["value"]), " ").alias("words"),
        F.min(F.when(F.col("kind") == "topic", F.struct((-F.col("works")).alias("w"), "value")))["value"].alias("label"),
    )
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("works"))
    found = size.join(C.edge_stats(inner), "community").join(C.representatives(members, inner, works), "community").join(words, "community")
    return found.withColumn("representatives", F.array_join(F.transform("representatives", lambda x: x.cast("string")), ","))


@R.add("community_summary", f"WITH RECURSIVE {_FINE}, {_SUMMARY} SELECT * FROM su")
def community_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(spark, sf, *fine(spark, sf))


_SHARE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SHARED.items()) + " END"
_OVERVIEW = f"""cs AS (SELECT community, count(*) AS works FROM comm GROUP BY 1),
  ks AS (SELECT a, b, sum({_SHARE}) AS shared FROM (SELECT DISTINCT x.community AS a, y.community AS b, x.kind FROM tl x JOIN tl y ON x.kind = y.kind AND x.value = y.value AND x.community < y.community) GROUP BY 1, 2),
  xw AS (SELECT least(p.community, q.community) AS a, greatest(p.community, q.community) AS b, sum(weight) AS raw FROM we JOIN comm p ON p.work = src JOIN comm q ON q.work = dst WHERE p.community <> q.community AND round(weight, 9) >= {C.FINE} GROUP BY 1, 2),
  xs AS (SELECT a, b, least({C.CROSS_CAP}, {C.CROSS_SHARE} * raw / greatest(1.0, sqrt(p.works * q.works))) AS own FROM xw JOIN cs p ON p.community = a JOIN cs q ON q.community = b),
  ol AS (SELECT coalesce(ks.a, xs.a) AS a, coalesce(ks.b, xs.b) AS b FROM ks FULL JOIN xs ON ks.a = xs.a AND ks.b = xs.b WHERE round(coalesce(shared, 0)::DOUBLE + coalesce(own, 0), 9) >= {C.OVERVIEW}),
  om AS (SELECT a, b FROM ol UNION SELECT b, a FROM ol), orr(a, b) AS (SELECT a, a FROM om UNION SELECT orr.a, om.b FROM orr JOIN om ON om.a = orr.b), ov AS (SELECT a AS community, min(b) AS overview FROM orr GROUP BY 1)"""


@R.add("overview_communities", f"WITH RECURSIVE {_FINE}, {_TOP}, {_OVERVIEW} SELECT community, overview FROM ov")
def overview_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities by the overview that shared labels and cross edges lead to."""
    members, strong = fine(spark, sf)
    return C.overviews(members, C.cross_weights(strong, members), C.top_labels(members, labels(spark, sf)))


_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_SEARCH = f"""allsu AS (SELECT 'fine:' || su.community AS id, 'fine' AS level, 'overview:' || overview AS parent, label, words || ' ' || label AS text, works, edges, 0 AS children FROM su LEFT JOIN ov ON ov.community = su.community
    UNION ALL SELECT 'overview:' || overview, 'overview', NULL, min(label), string_agg(words, ' ' ORDER BY su.community), sum(works)::BIGINT, sum(edges)::BIGINT, count(*) FROM su JOIN ov ON ov.community = su.community GROUP BY overview),
  hs AS (SELECT *, {_hits_sql(QUERY_GROUPS, _TOK.format('text'))}::BIGINT AS hits, {_hits_sql(QUERY_GROUPS, _TOK.format('label'))}::BIGINT AS label_hits FROM allsu),
  sc AS (SELECT *, 1.6 * hits + hits / 3.0::DOUBLE + 0.8 * label_hits + 0.4 * (label_hits / 3.0::DOUBLE) + 0.02 * least(works, 30) + 0.015 * least(edges, 30) + CASE WHEN level = 'overview' THEN 0.03 * least(children, 6) ELSE 0 END AS score FROM hs WHERE hits > 0 OR label_hits > 0),
  topo AS (SELECT *, score AS route_score, 0 AS route, row_number() OVER (ORDER BY round(score, 9) DESC, hits DESC, label_hits DESC, works DESC, edges DESC, lower(label), id) AS place FROM sc WHERE level = 'overview' QUALIFY place <= 2),
  finer AS (SELECT sc.*, (sc.parent IN (SELECT id FROM topo))::INT AS on_route, round(sc.score, 6) + 0.35 * coalesce((sc.parent IN (SELECT id FROM topo))::INT, 0) AS route_score FROM sc WHERE level = 'fine'),
  ord AS (SELECT id, level, hits, label_hits, route_score, 0 AS route, place FROM topo UNION ALL SELECT id, level, hits, label_hits, route_score, 1, row_number() OVER (ORDER BY round(route_score, 9) DESC, coalesce(on_route, 0) DESC, hits DESC, works DESC, lower(label), id) FROM finer)"""


SEARCH_SQL = f"WITH RECURSIVE {_FINE}, {_SUMMARY}, {_OVERVIEW}, {_SEARCH} SELECT id, level, hits, label_hits, round(route_score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY route, place) AS rank FROM ord QUALIFY rank <= 8"


@R.add("community_search", SEARCH_SQL)
def community_search(spark: SparkSession, sf: str) -> DataFrame:
    return C.search(searched(spark, sf), QUERY_GROUPS, 8)


def searched(spark: SparkSession, sf: str) -> DataFrame:
    """Both levels of summaries with their words, as they are stored."""
    return stored(spark, sf, "community-summaries", MADE_OF, lambda: described(spark, sf))


def described(spark: SparkSession, sf: str) -> DataFrame:
    members, strong = fine(spark, sf)
    own = summaries(spark, sf, members, strong).select("community", "works", "edges", "words", "label")
    above = C.overviews(members, C.cross_weights(strong, members), C.top_labels(members, labels(spark, sf)))
    rows = own.join(above, "community", "left")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    low = rows.select(name("fine", "community").alias("id"), F.lit("fine").alias("level"), name("overview", "overview").alias("parent"), "label", F.concat_ws(" ", "words", "label").alias("text"), "works", "edges", F.lit(0).cast("long").alias("children"))
    high = rows.where("overview is not null").groupBy("overview").agg(F.min("label").alias("label"), F.array_join(F.collect_list("words"), " ").alias("text"), F.sum("works").alias("works"), F.sum("edges").alias("edges"), F.count(F.lit(1)).alias("children"))
    high = high.select(name("overview", "overview").alias("id"), F.lit("overview").alias("level"), F.lit(None).cast("string").alias("parent"), "label", "text", "works", "edges", "children")
    return low.unionByName(high).withColumn("words", tokens(F.col("text"))).withColumn("label_words", tokens(F.col("label")))
