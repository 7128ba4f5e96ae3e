"""Fielded search over works, chunks, formulas and assets; vector ranking, hybrid search and retrieval as a whole.

Bindings: works are documents (title: the first line, abstract: the text, topic: the language, collection: the source), chunks
are turns of conversations, formulas are parts, assets are pages; citations between works are order-part pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import query as Q
from quarry.functions.query import MatchQuery
from quarry.functions.text import title, tokens
from quarry.operators import inverted, search, summaries, vectors
from quarry.operators.versions import derived
from quarry.plans import communities
from quarry.plans.graphs import _FAMILIES, stored_families
from quarry.plans.pieces import KNN as _KNN
from quarry.plans.pieces import hits_sql as _hits_sql
from quarry.plans.registry import Registry
from quarry.plans.retrieval import coupled_to, similar_to
from quarry.plans.stored import KIND, stored
from quarry.sources.tables import table

R = Registry()

#: A test profile whose words occur in the tables: concepts with triggers, aliases (phrases too) and terms to embed.
CONCEPTS: Q.Concepts = {
    "ouble": (("edoution", "ouble"), ("edoution", "ouble"), ("edoution",)),
    "the_of": (("stst",), ("stst", "of the", "and the"), ("stst", "ndin")),
}
WORK_QUERY = "overview of edoution stst ndin onharent"
CHUNK_QUERY = "edoution the de la que"
PART_GROUPS = (("red widget", "small ring"), ("blue",), ("standard", "economy"))
PAGE_GROUPS = (("de la", "of the"), ("ndin", "euxre"), ("fr",))
PROFILE = Q.analyze(WORK_QUERY, CONCEPTS)
CHUNK_PROFILE = Q.analyze(CHUNK_QUERY, {"de": (("de",), ("de la", "de le"), ("de",))})
LIMIT = 20

_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def _cascade(groups: tuple[tuple[str, ...], ...]) -> list[MatchQuery]:
    return [MatchQuery(True, groups[:4]), MatchQuery(False, groups[:3])]


def _lists(fields: list[str]) -> str:
    return "[" + ", ".join(_TOK.format(f) for f in fields) + "]"


def _tf_sql(phrase: str) -> str:
    w = phrase.split()
    if len(w) == 1:
        return f"list_sum(list_transform(fields, lambda a: len(list_filter(a, lambda x: x = '{w[0]}'))))"
    here = " AND ".join(f"a[i + {k}] = '{x}'" for k, x in enumerate(w))
    return f"list_sum(list_transform(fields, lambda a: len(list_filter(range(1, len(a) + 1), lambda i: {here}))))"


def _search_sql(name: str, built: str, key: str, keep: list[str], queries: list[MatchQuery], limit: int, order: str, where: str = "true", penalty: str = "0.0") -> str:
    """CTEs that end in ``name`` (key, keep, score, stage, rank); ``built`` selects key, keep and fields."""
    p = search.phrases_of(queries)
    at = {x: i for i, x in enumerate(p)}
    cols = ", ".join([key, *keep])
    fetch = max(3 * limit, 20)
    part = lambda x: f"greatest(1e-6, ln((n - df{at[x]} + 0.5) / (df{at[x]} + 0.5))) * tf{at[x]} * 2.2 / (tf{at[x]} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    stages = []
    for i, q in enumerate(queries):
        hit = (" AND " if q.every else " OR ").join("(" + " OR ".join(f"tf{at[x]} > 0" for x in g) + ")" for g in q.groups)
        total = " + ".join(part(x) for g in q.groups for x in g)
        stages.append(f"SELECT {cols}, {i}::BIGINT AS stage, -({total}) AS score FROM {name}_tf, {name}_df WHERE ({where}) AND ({hit})")
    return f"""{name}_in AS ({built}),
  {name}_tf AS (SELECT {cols}, list_sum(list_transform(fields, lambda a: len(a))) AS dl, {', '.join(f'{_tf_sql(x)} AS tf{i}' for i, x in enumerate(p))} FROM {name}_in),
  {name}_df AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in range(len(p)))} FROM {name}_tf),
  {name}_st AS ({' UNION ALL '.join(stages)}),
  {name}_ps AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY {'' if penalty == '0.0' else f'round(score + {penalty}, 9), '}round(score, 9), {order}) AS pos FROM {name}_st QUALIFY pos <= {fetch}),
  {name} AS (SELECT {cols}, score, stage, row_number() OVER (ORDER BY stage, pos) AS rank FROM (SELECT * FROM {name}_ps QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY stage, pos) = 1) QUALIFY rank <= {limit})"""


# ---- works

_TITLE = "substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80)"
_WORKS = f"SELECT doc_id AS id, n_chars AS year, source, {_lists([_TITLE, 'text', 'lang'])} AS fields FROM documents"


def works_index(spark: SparkSession, sf: str) -> inverted.Index:
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("year"), "source", title(F.col("text")).alias("title"), "text", "lang")
    return inverted.of_table(spark, "works", [f"{sf}/documents.parquet"], rows, "id", ["title", "text", "lang"], ["year"])


QUERIES = Q.match_queries(PROFILE)


@R.add("search_works", f"WITH {_search_sql('r', _WORKS, 'id', ['year', 'source'], QUERIES, LIMIT, 'year DESC NULLS LAST, id DESC')} SELECT id, round(score, 6) AS score, stage, rank FROM r")
def search_works(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search_works(works_index(spark, sf), QUERIES, LIMIT, "id")
    return found.select("id", F.round("score", 6).alias("score"), "stage", "rank")


@R.add(
    "search_works_in_collection",
    f"WITH {_search_sql('r', _WORKS, 'id', ['year', 'source'], QUERIES, LIMIT, 'year DESC NULLS LAST, id DESC', where='source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 3)')} SELECT id, source, round(score, 6) AS score, stage, rank FROM r",
)
def search_works_in_collection(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    names = [r.source for r in docs.select("source").where("source is not null").distinct().orderBy("source").limit(3).collect()]
    inside = docs.where(F.col("source").isin(names)).select(F.col("doc_id").alias("id"), "source")
    found = search.search_works(works_index(spark, sf), QUERIES, LIMIT, "id", within=lambda rows: rows.join(inside.select("id"), "id", "left_semi"))
    return found.join(inside, "id").select("id", "source", F.round("score", 6).alias("score"), "stage", "rank")


# ---- chunks

_ROLE = "CASE role WHEN 'system' THEN 'abstract_chunk' WHEN 'user' THEN 'section_child' ELSE 'asset_window' END"
_CHUNKS = f"SELECT conv_id * 1000 + turn AS id, conv_id AS work_id, {_ROLE} AS chunk_role, {_lists(['role', 'text'])} AS fields FROM conversations"
_PENALTY = "CASE chunk_role WHEN 'asset_window' THEN 0.02 WHEN 'formula_window' THEN 0.05 ELSE 0 END"
_ROLE_ORDER = "CASE chunk_role WHEN 'abstract_chunk' THEN 0 WHEN 'section_parent' THEN 1 WHEN 'section_child' THEN 2 WHEN 'asset_window' THEN 3 WHEN 'formula_window' THEN 4 ELSE 5 END, id"
CHUNK_QUERIES = Q.match_queries(CHUNK_PROFILE)


def chunk_rows(turns: DataFrame) -> DataFrame:
    role = F.when(F.col("role") == "system", "abstract_chunk").when(F.col("role") == "user", "section_child").otherwise("asset_window")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("work_id"), role.alias("chunk_role"), "role", "text")


def chunks_index(spark: SparkSession, sf: str) -> inverted.Index:
    return inverted.of_table(spark, "chunks", [f"{sf}/conversations.parquet"], chunk_rows(table(spark, sf, "conversations")), "id", ["role", "text"], ["work_id", "chunk_role"])


@R.add("search_chunks", f"WITH {_search_sql('r', _CHUNKS, 'id', ['work_id', 'chunk_role'], CHUNK_QUERIES, LIMIT, _ROLE_ORDER, penalty=_PENALTY)} SELECT id, work_id, chunk_role, round(score, 6) AS score, stage, rank FROM r")
def search_chunks(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search_chunks(chunks_index(spark, sf), CHUNK_QUERIES, LIMIT, "id")
    return found.select("id", "work_id", "chunk_role", F.round("score", 6).alias("score"), "stage", "rank")


# ---- formulas and assets

_PARTS = f"SELECT p_partkey AS id, {_lists(['p_brand', 'p_type', 'p_name'])} AS fields FROM part"
_PAGES = f"SELECT page_id AS id, {_lists(['url', chr(34) + 'caption' + chr(34)])} AS fields FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS caption FROM pages)"


@R.add("search_formulas", f"WITH {_search_sql('r', _PARTS, 'id', [], _cascade(PART_GROUPS), LIMIT, 'id')} SELECT id, round(score, 6) AS score, stage, rank FROM r")
def search_formulas(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_name")
    found = search.search_by_id(inverted.of_table(spark, "formulas", [f"{sf}/part.parquet"], rows, "id", ["p_brand", "p_type", "p_name"]), _cascade(PART_GROUPS), LIMIT, "id")
    return found.select("id", F.round("score", 6).alias("score"), "stage", "rank")


@R.add("search_assets", f"WITH {_search_sql('r', _PAGES, 'id', [], _cascade(PAGE_GROUPS), LIMIT, 'id')} SELECT id, round(score, 6) AS score, stage, rank FROM r")
def search_assets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("caption"))
    found = search.search_by_id(inverted.of_table(spark, "assets", [f"{sf}/pages.parquet"], rows, "id", ["url", "caption"]), _cascade(PAGE_GROUPS), LIMIT, "id")
    return found.select("id", F.round("score", 6).alias("score"), "stage", "rank")


# ---- vectors


def _need(groups) -> str:
    return f"(hits >= {max(1, min(2, len(groups)))} OR coverage >= 0.75)"


def _vector_sql(name: str, rows: str, embedded: str, groups, limit: int) -> str:
    """CTEs that end in ``name`` (id, score, hits, coverage, rank); ``rows`` selects id, t (words that are embedded) and w (words that may agree)."""
    feats = """SELECT id, unnest(list_concat(t, list_filter(list_transform(range(1, len(t) + 1), lambda i: t[i] || '__' || t[i + 1]), lambda x: x IS NOT NULL))) AS f FROM {}"""
    hashed = "SELECT id, ('0x' || substr(md5(f), 1, 15))::BIGINT % 768 AS bucket, sum(CASE WHEN contains(f, '__') THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN ('0x' || substr(md5(f), 16, 1))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS value FROM {} GROUP BY 1, 2"
    words = ", ".join(f"'{w}'" for w in embedded.split())
    return f"""{name}_rows AS ({rows}), {name}_f AS ({feats.format(f'{name}_rows')}), {name}_h AS ({hashed.format(f'{name}_f')}),
  {name}_idf AS (SELECT bucket, ln((1.0 + (SELECT count(*) FROM {name}_rows)) / (1.0 + count(*))) + 1 AS idf FROM {name}_h GROUP BY 1),
  {name}_qr AS (SELECT 0 AS id, [{words}] AS t), {name}_qf AS ({feats.format(f'{name}_qr')}), {name}_qh AS ({hashed.format(f'{name}_qf')}),
  {name}_q AS (SELECT bucket, value * coalesce(idf, ln(1.0 + (SELECT count(*) FROM {name}_rows)) + 1) AS w FROM {name}_qh LEFT JOIN {name}_idf USING (bucket)),
  {name}_s AS (SELECT id, sum(value * idf * coalesce(w, 0)) / sqrt(sum(value * idf * value * idf)) / (SELECT sqrt(sum(w * w)) FROM {name}_q) AS score FROM {name}_h JOIN {name}_idf USING (bucket) LEFT JOIN {name}_q USING (bucket) GROUP BY 1),
  {name}_t AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS pos FROM {name}_s QUALIFY pos <= {limit}),
  {name}_p AS (SELECT * FROM {name}_t WHERE score > 0 OR NOT (SELECT bool_or(score > 0) FROM {name}_t)),
  {name}_a AS (SELECT id, score, pos, {_hits_sql(groups)}::BIGINT AS hits, {_hits_sql(groups)} / {len(groups)}.0::DOUBLE AS coverage FROM {name}_p JOIN {name}_rows USING (id)),
  {name}_g AS (SELECT *, CASE WHEN {_need(groups)} THEN 2 WHEN hits > 0 THEN 1 ELSE 0 END AS tier FROM {name}_a),
  {name} AS (SELECT id, score, hits, coverage, row_number() OVER (ORDER BY hits DESC, round(coverage, 9) DESC, round(score, 9) DESC, pos) AS rank FROM {name}_g WHERE tier = (SELECT max(tier) FROM {name}_g))"""


EMBEDDED = Q.embedded_form(PROFILE, CONCEPTS)
CHUNK_EMBEDDED = " ".join(CHUNK_PROFILE.content)
_WORK_WORDS = f"SELECT doc_id AS id, list_concat({_TOK.format(_TITLE)}, list_concat({_TOK.format(_TITLE)}, list_concat({_TOK.format('text')}, {_TOK.format('lang')}))) AS t, {_TOK.format('text')} AS w FROM documents"
_CHUNK_WORDS = f"SELECT conv_id * 1000 + turn AS id, list_concat({_TOK.format('role')}, {_TOK.format('text')}) AS t, list_concat({_TOK.format('role')}, {_TOK.format('text')}) AS w FROM conversations"
CANDIDATES = max(3 * LIMIT, 50)


def works_vector(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    """A work is embedded as its title twice, its abstract and its topics."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.concat_ws(" ", title(F.col("text")), title(F.col("text")), F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))).alias("body"))
    scores = vector_index(spark, sf, "works", "documents", rows).cosine(EMBEDDED.split())
    return search.vector_ranked(scores, rows.select("id", "text"), PROFILE.groups, limit, analyze=tokens)


def chunk_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(table(spark, sf, "conversations")).select("id", F.concat_ws(" ", "role", "text").alias("text"))


def chunks_vector(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    rows = chunk_bodies(spark, sf)
    scores = vector_index(spark, sf, "chunks", "conversations", rows.withColumnRenamed("text", "body")).cosine(CHUNK_EMBEDDED.split())
    return search.vector_ranked(scores, rows, CHUNK_PROFILE.groups, limit, analyze=tokens)


def vector_index(spark: SparkSession, sf: str, name: str, source: str, rows: DataFrame) -> vectors.Index:
    """The stored vectors of a table's rows (id, body)."""
    found = derived(spark, f"vectors-{name}", [f"{sf}/{source}.parquet"], lambda path, _: vectors.write_index(rows, path, "id", "body", kind="md5", words=tokens), KIND)
    return vectors.Index(spark, found["path"])


@R.add("search_works_vector", f"WITH {_vector_sql('v', _WORK_WORDS, EMBEDDED, PROFILE.groups, LIMIT)} SELECT id, round(score, 6) AS score, hits, round(coverage, 6) AS coverage, rank FROM v")
def search_works_vector(spark: SparkSession, sf: str) -> DataFrame:
    return works_vector(spark, sf, LIMIT).select("id", F.round("score", 6).alias("score"), "hits", F.round("coverage", 6).alias("coverage"), "rank")


@R.add("search_chunks_vector", f"WITH {_vector_sql('v', _CHUNK_WORDS, CHUNK_EMBEDDED, CHUNK_PROFILE.groups, LIMIT)} SELECT id, round(score, 6) AS score, hits, round(coverage, 6) AS coverage, rank FROM v")
def search_chunks_vector(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_vector(spark, sf, LIMIT).select("id", F.round("score", 6).alias("score"), "hits", F.round("coverage", 6).alias("coverage"), "rank")


# ---- hybrid


def _fuse_sql(name: str, words: str, vecs: str, word_rows: str, groups, weights: tuple[float, float]) -> str:
    n = f"(SELECT count(*) FROM {words})"
    return f"""{name}_b AS (SELECT r.id, r.rank, {_hits_sql(groups)}::BIGINT AS hits, {_hits_sql(groups)} / {len(groups)}.0::DOUBLE AS coverage FROM {words} r JOIN ({word_rows}) USING (id)),
  {name}_v AS (SELECT id, hits, coverage, row_number() OVER (ORDER BY rank) AS rank FROM {vecs} WHERE {_need(groups)} OR ({n} = 0 AND NOT (SELECT bool_or({_need(groups)}) FROM {vecs}))),
  {name} AS (SELECT coalesce(b.id, v.id) AS id, b.rank AS bm25_rank, v.rank AS vector_rank, greatest(coalesce(b.hits, 0), coalesce(v.hits, 0)) AS hits, greatest(coalesce(b.coverage, 0), coalesce(v.coverage, 0)) AS coverage,
    coalesce(CASE WHEN {n} > 0 THEN {weights[0]} ELSE 1.0 END / (60 + b.rank), 0)::DOUBLE + coalesce(CASE WHEN {n} > 0 THEN {weights[1]} ELSE 1.0 END / (60 + v.rank), 0)::DOUBLE AS hybrid FROM {name}_b b FULL JOIN {name}_v v ON b.id = v.id)"""


_EDGES = """e AS (SELECT DISTINCT l_partkey AS n, l_orderkey AS v FROM lineitem), deg AS (SELECT n, count(*) AS d FROM e GROUP BY 1),
  pr AS (SELECT a.n AS src, b.n AS dst, count(*) AS shared FROM e a JOIN e b ON a.v = b.v AND a.n < b.n GROUP BY 1, 2 HAVING count(*) >= 2),
  es AS (SELECT src, dst, shared, shared / sqrt(x.d * y.d) AS score FROM pr JOIN deg x ON x.n = src JOIN deg y ON y.n = dst),
  edges AS (SELECT src, dst, shared, score FROM es UNION ALL SELECT dst, src, shared, score FROM es)"""
EXPAND, SEEDS = 5, 5
_INJECT = f"""seed AS (SELECT id, row_number() OVER (ORDER BY round(hybrid, 9) DESC, id) AS seed_rank, bm25_rank, hits, coverage FROM fu QUALIFY seed_rank <= {SEEDS}),
  ok AS (SELECT id, seed_rank, CASE WHEN bm25_rank IS NOT NULL THEN 1.0::DOUBLE ELSE greatest(0.25, coverage) END AS support FROM seed WHERE bm25_rank IS NOT NULL OR {_need(PROFILE.groups)}),
  n1 AS (SELECT id, seed_rank, support, dst, shared, score, row_number() OVER (PARTITION BY id ORDER BY shared DESC, round(score, 9) DESC, dst) AS place FROM edges JOIN ok ON src = id QUALIFY place <= {EXPAND}),
  n2 AS (SELECT id, seed_rank, support, dst, 0 AS shared, score, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, dst) AS place FROM sim JOIN ok ON src = id QUALIFY place <= {2 * EXPAND}),
  nn AS (SELECT *, 0 AS tier FROM n1 UNION ALL SELECT *, 1 FROM n2 WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n1.id = n2.id AND n1.dst = n2.dst)),
  nb AS (SELECT id, seed_rank, support, dst, shared, score, tier, row_number() OVER (PARTITION BY id ORDER BY tier, place) AS place FROM nn QUALIFY place <= {EXPAND}),
  gs AS (SELECT dst AS id, sum(support * CASE WHEN tier = 1 THEN greatest(0.2, score) ELSE 1 END * 0.5 / (60 + seed_rank + place)) AS graph_score, count(*) AS graph_votes, max(shared) AS graph_shared FROM nb GROUP BY 1),
  al AS (SELECT coalesce(f.id, g.id) AS id, bm25_rank, vector_rank, coalesce(hits, 0) AS hits, coalesce(coverage, 0) AS coverage, coalesce(hybrid, 0) + coalesce(graph_score, 0) AS hybrid, coalesce(graph_score, 0) AS graph_score, coalesce(graph_votes, 0) AS graph_votes
    FROM fu f FULL JOIN gs g ON f.id = g.id),
  rk AS (SELECT *, row_number() OVER (ORDER BY hits DESC, round(coverage, 9) DESC, round(hybrid, 9) DESC, round(graph_score, 9) DESC, id) AS pos FROM al QUALIFY pos <= {LIMIT}),
  fp AS (SELECT family, arg_max(doc_id, (n_chars, -doc_id)) AS prim FROM fam JOIN documents USING (doc_id) GROUP BY 1),
  ff AS (SELECT rk.*, coalesce('f' || fam.family, 'w' || id) AS grp, coalesce(prim = id, false) AS is_prim FROM rk LEFT JOIN fam ON fam.doc_id = id LEFT JOIN fp USING (family)),
  gr AS (SELECT *, min(pos) OVER (PARTITION BY grp) AS place, count(*) OVER (PARTITION BY grp) - 1 AS versions FROM ff QUALIFY row_number() OVER (PARTITION BY grp ORDER BY is_prim DESC, pos) = 1)"""
_HYBRID_WORKS = f"""WITH RECURSIVE {_FAMILIES}, {_search_sql('b', _WORKS, 'id', ['year', 'source'], QUERIES, CANDIDATES, 'year DESC NULLS LAST, id DESC')}, {_vector_sql('v', _WORK_WORDS, EMBEDDED, PROFILE.groups, CANDIDATES)},
  {_fuse_sql('fu', 'b', 'v', f"SELECT doc_id AS id, {_TOK.format('text')} AS w FROM documents", PROFILE.groups, search.WORKS_WEIGHTS)}, {_EDGES}, {_KNN}, {_INJECT}"""


def few(rows: DataFrame) -> DataFrame:
    """Ranked candidates, a few hundred rows at most, as a table of their own: what comes after doesn't search again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def agreeing(found: DataFrame, texts: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """(id, rank, hits, coverage) of found rows; only their texts (id, text) are cut into words."""
    hits, coverage = search.agreement(F.col("words"), groups)
    rows = texts.join(F.broadcast(found.select("id", "rank")), "id").withColumn("words", tokens(F.col("text")))  # CANDIDATES rows
    return rows.select("id", "rank", hits.alias("hits"), coverage.alias("coverage"))


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked works with their graph support, one of each family; index and families are read as they are stored, and only
    the edges of the seeds are made (of similar ones the first ten, 2 * EXPAND, are asked for)."""
    docs = table(spark, sf, "documents")
    groups = PROFILE.groups
    found = few(search.search_works(works_index(spark, sf), QUERIES, CANDIDATES, "id").select("id", "rank"))
    bm25 = agreeing(found, docs.select(F.col("doc_id").alias("id"), "text"), groups)
    fused = few(search.fuse(bm25, works_vector(spark, sf, CANDIDATES), groups, search.WORKS_WEIGHTS))
    ranked = search.rank_works(search.inject(fused, partial(coupled_to, spark, sf), partial(similar_to, spark, sf), groups, EXPAND, SEEDS), LIMIT)
    fams = stored_families(spark, sf).join(docs.select("doc_id", "n_chars"), "doc_id")
    primary = fams.groupBy("family").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("primary"))
    return search.one_per_family(ranked, fams.join(primary, "family").select(F.col("doc_id").alias("id"), "family", "primary"), LIMIT)


@R.add("hybrid_works", f"{_HYBRID_WORKS} SELECT id, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(vector_rank, 0) AS vector_rank, hits, round(hybrid, 6) AS hybrid, round(graph_score, 6) AS graph_score, graph_votes, versions, row_number() OVER (ORDER BY place) AS rank FROM gr")
def hybrid_works(spark: SparkSession, sf: str) -> DataFrame:
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return hybrid(spark, sf).select("id", whole("bm25_rank"), whole("vector_rank"), "hits", F.round("hybrid", 6).alias("hybrid"), F.round("graph_score", 6).alias("graph_score"), "graph_votes", F.size("versions").cast("long").alias("versions"), "rank")


def hybrid_chunk_rows(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    groups, n = CHUNK_PROFILE.groups, max(3 * limit, 50)
    found = few(search.search_chunks(chunks_index(spark, sf), CHUNK_QUERIES, n, "id").select("id", "rank"))
    bm25 = agreeing(found, chunk_bodies(spark, sf), groups)
    return search.rank_chunks(search.fuse(bm25, chunks_vector(spark, sf, n), groups, search.CHUNKS_WEIGHTS), limit)


_HYBRID_CHUNKS = f"""{_search_sql('cb', _CHUNKS, 'id', ['work_id', 'chunk_role'], CHUNK_QUERIES, CANDIDATES, _ROLE_ORDER, penalty=_PENALTY)}, {_vector_sql('cv', _CHUNK_WORDS, CHUNK_EMBEDDED, CHUNK_PROFILE.groups, CANDIDATES)},
  {_fuse_sql('cf', 'cb', 'cv', f"SELECT id, w FROM ({_CHUNK_WORDS})", CHUNK_PROFILE.groups, search.CHUNKS_WEIGHTS)},
  ck AS (SELECT *, row_number() OVER (ORDER BY round(hybrid, 9) DESC, hits DESC, round(coverage, 9) DESC, id) AS rank FROM cf QUALIFY rank <= {LIMIT})"""


@R.add("hybrid_chunks", f"WITH {_HYBRID_CHUNKS} SELECT id, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(vector_rank, 0) AS vector_rank, hits, round(hybrid, 6) AS hybrid, rank FROM ck")
def hybrid_chunks(spark: SparkSession, sf: str) -> DataFrame:
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return hybrid_chunk_rows(spark, sf, LIMIT).select("id", whole("bm25_rank"), whole("vector_rank"), "hits", F.round("hybrid", 6).alias("hybrid"), "rank")


# ---- retrieval as a whole

SHOWN, SUMMARIES = 10, 3
#: Communities and facets of the binding speak of parts; these lanes are asked with the parts' groups.
_PART_FACETS = """fs AS (SELECT DISTINCT 'type' AS facet, p_type AS label, p_partkey AS work FROM part UNION ALL SELECT DISTINCT 'name', p_name, p_partkey FROM part UNION ALL SELECT DISTINCT 'brand', p_brand, p_partkey FROM part),
  fw AS (SELECT facet, label, count(DISTINCT work) AS works, count(*) AS signals FROM fs GROUP BY 1, 2 HAVING count(DISTINCT work) >= 2)"""


def _facet_sql(name: str, groups: Sequence[Sequence[str]], limit: int) -> str:
    label, both = _TOK.format("label"), _TOK.format("label || ' ' || facet")
    n = len(groups)
    return f"""{_PART_FACETS}, fh AS (SELECT *, {_hits_sql(groups, both)}::BIGINT AS hits, {_hits_sql(groups, label)}::BIGINT AS label_hits FROM fw),
  fc AS (SELECT *, 1.5 * hits + hits / {n}.0::DOUBLE + 0.8 * label_hits + 0.4 * (label_hits / {n}.0::DOUBLE) + 0.02 * least(works, 25) + 0.01 * least(signals, 25) AS score FROM fh WHERE hits > 0 OR label_hits > 0),
  {name} AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, hits DESC, label_hits DESC, works DESC, signals DESC, lower(label), facet || ':' || label) AS rank FROM fc QUALIFY rank <= {limit})"""


def part_facets(spark: SparkSession, sf: str) -> DataFrame:
    """The stored facets of parts, with the largest parts of each."""

    def made() -> DataFrame:
        part = table(spark, sf, "part")
        signals = F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), F.col(c).alias("label")) for k, c in (("type", "p_type"), ("name", "p_name"), ("brand", "p_brand")))))
        works = part.select(F.col("p_partkey").alias("work"), F.lit(0).alias("citations"), F.col("p_size").alias("year"), F.col("p_name").alias("title"))
        return summaries.facets(part.select(F.col("p_partkey").alias("work"), signals.alias("s")).select("work", "s.*"), works)

    return stored(spark, sf, "part-facets", ["part"], made)


@R.add("facet_search", f"WITH {_facet_sql('f', PART_GROUPS, 8)} SELECT facet, label, hits, label_hits, works, signals, round(score, 6)::DOUBLE AS score, rank FROM f")
def facet_search(spark: SparkSession, sf: str) -> DataFrame:
    """The facets that agree with a query, in the order of seven keys."""
    return summaries.search_facets(part_facets(spark, sf), PART_GROUPS, 8).select("facet", "label", "hits", "label_hits", "works", "signals", F.round("score", 6).alias("score"), "rank")


@R.add(
    "summary_works",
    f"""WITH {_facet_sql('f', PART_GROUPS, 8)}, rw AS (SELECT f.rank, p_partkey AS work, row_number() OVER (PARTITION BY f.rank ORDER BY p_size DESC, lower(p_name), p_partkey) AS r FROM f JOIN fs USING (facet, label) JOIN part ON p_partkey = fs.work QUALIFY r <= 4),
    m AS (SELECT work, min((rank, r)) AS met FROM rw GROUP BY 1) SELECT work, row_number() OVER (ORDER BY met) AS rank FROM m QUALIFY rank <= 12""",
)
def summary_works(spark: SparkSession, sf: str) -> DataFrame:
    """The works that stand for the found facets, as they are first met."""
    return summaries.works_of(summaries.search_facets(part_facets(spark, sf), PART_GROUPS, 8), 12)


@R.add(
    "retrieve",
    f"""{_HYBRID_WORKS}, {_HYBRID_CHUNKS}, top AS (SELECT id, row_number() OVER (ORDER BY place) AS rank, hybrid FROM gr QUALIFY rank <= {SHOWN}),
  sc AS (SELECT ck.id, ck.hybrid, row_number() OVER (ORDER BY (top.id IS NOT NULL) DESC, ck.rank) AS place FROM ck LEFT JOIN top ON top.id = ck.id // 1000 QUALIFY place <= {SHOWN})
  SELECT 'work' AS lane, 'W' || rank AS ref, id::VARCHAR AS item, rank, round(hybrid, 6) AS score FROM top UNION ALL SELECT 'chunk', 'C' || place, id::VARCHAR, place, round(hybrid, 6) FROM sc
  UNION ALL SELECT 'community', 'G' || rank, id, rank, score FROM ({communities.SEARCH_SQL}) WHERE rank <= {SUMMARIES}
  UNION ALL SELECT 'facet', 'O' || rank, facet || ':' || label, rank, round(score, 6)::DOUBLE FROM (WITH {_facet_sql('f', communities.QUERY_GROUPS, SUMMARIES)} SELECT * FROM f)""",
)
def retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The lanes that the route asks for: works with graph support, chunks that support them first, and, for relation and result
    queries, summaries of communities and of facets."""
    target, _ = Q.route(WORK_QUERY, CONCEPTS)
    works = hybrid(spark, sf).where(F.col("rank") <= SHOWN)
    chunks = hybrid_chunk_rows(spark, sf, LIMIT)
    # Chunks of the works that were found come first, then the others.
    order = [F.col("found").desc(), F.col("at")]
    near = chunks.select("id", "hybrid", F.col("rank").alias("at"), F.floor(F.col("id") / 1000).alias("work")).join(F.broadcast(works.select(F.col("id").alias("work"), F.lit(1).alias("found"))), "work", "left")
    near = near.withColumn("found", F.coalesce("found", F.lit(0)))
    near = near.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("rank") <= SHOWN)
    lane = lambda df, name, mark, item, score: df.select(F.lit(name).alias("lane"), F.concat(F.lit(mark), F.col("rank").cast("string")).alias("ref"), F.col(item).cast("string").alias("item"), "rank", F.round(score, 6).cast("double").alias("score"))
    out = lane(works, "work", "W", "id", "hybrid").unionByName(lane(near, "chunk", "C", "id", "hybrid"))
    if Q.wants_summaries(WORK_QUERY, target):
        found = communities.community_search(spark, sf).where(F.col("rank") <= SUMMARIES)
        facets = summaries.search_facets(part_facets(spark, sf), communities.QUERY_GROUPS, SUMMARIES)
        out = out.unionByName(lane(found, "community", "G", "id", "score")).unionByName(lane(facets, "facet", "O", "id", "score"))
    return out
