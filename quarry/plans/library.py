"""Records, works and families; scopes and selections; what comes in from outside.

Bindings: orders are bibliographic records that share identifiers, titles and report numbers with orders near them; collections
are suppliers, sources or languages; parsed documents are conversations; runs are users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import blocks, collapse, graph, records, scopes
from quarry.operators.jobs import place_in_group
from quarry.operators.shared import spread, written
from quarry.operators.families import title_classes, title_pairs
from quarry.plans.registry import Registry
from quarry.plans.stored import stored
from quarry.sources import landing
from quarry.sources.tables import table

R = Registry()

# ---- records

_RECORDS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderpriority AS p FROM orders),
  rec AS (SELECT k, c, s, p, y AS year, CASE WHEN s = 'F' AND k % 4 < 2 THEN (k // 2)::VARCHAR END AS inspire, CASE WHEN k % 7 = 0 THEN c || '.' || y END AS arxiv, CASE WHEN k % 11 = 0 THEN '10.1/' || c || '.' || m END AS doi,
    'Goods of group ' || (k // 6) || ' asked for in a hurry by some customer of year ' || (k // 6 % 7) AS title, s || '-' || (k // 3) AS report, p AS collaboration FROM o),
  idn AS (SELECT *, CASE WHEN inspire IS NOT NULL THEN 'inspire' WHEN arxiv IS NOT NULL THEN 'arxiv' WHEN doi IS NOT NULL THEN 'doi' ELSE 'local' END AS src,
    coalesce(inspire, arxiv, doi, 'local:' || sha256(title || '|' || year)) AS cid FROM rec)"""


def order_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as hits of a source, parsed and described, and the work that each belongs to."""
    return stored(spark, sf, "order-records", ["orders"], lambda: records.merged(stored_hits(spark, sf)), ["work"])


def order_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The identifiers of those works."""
    return stored(spark, sf, "order-ids", ["orders"], lambda: records.merged_ids(order_hits(spark, sf)))


def stored_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The hits, parsed once for works and families."""
    return stored(spark, sf, "order-hits", ["orders"], lambda: order_hits(spark, sf))


def order_hits(spark: SparkSession, sf: str) -> DataFrame:
    k, c, s = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    group = F.floor(k / 6)
    title = F.concat(F.lit("Goods of group "), group.cast("string"), F.lit(" asked for in a hurry by some customer of year "), (group % 7).cast("string"))
    one = lambda v, f: F.array(F.struct(v.alias(f)))
    body = F.struct(
        F.when((s == "F") & (k % 4 < 2), F.floor(k / 2)).alias("control_number"), one(title, "title").alias("titles"), one(year, "year").alias("publication_info"),
        F.when(k % 7 == 0, one(F.concat(c, F.lit("."), year.cast("string")), "value")).alias("arxiv_eprints"), F.when(k % 11 == 0, one(F.concat(F.lit("10.1/"), c, F.lit("."), month.cast("string")), "value")).alias("dois"),
        one(F.concat(s, F.lit("-NOTE-"), F.floor(k / 3).cast("string")), "value").alias("report_numbers"), one(F.col("o_orderpriority"), "value").alias("collaborations"),
        F.when(s == "F", F.array(F.lit("Article"))).when(s == "P", F.array(F.lit("note"))).alias("document_type"), one(F.col("o_orderpriority"), "value").alias("keywords"), one(F.concat(F.lit("status "), s), "term").alias("inspire_categories"),
        F.array(F.struct(F.floor(k / 2 + 1).cast("bigint").alias("control_number")), F.struct(F.lit(None).cast("bigint").alias("control_number"))).alias("references"), (k % 9).cast("int").alias("citation_count"),
    )
    links = F.struct(F.concat(F.lit("https://orders/"), k.cast("string")).alias("self"))
    return records.described(records.parse_hits(spread(table(spark, sf, "orders")).select(F.to_json(F.struct(body.alias("metadata"), links.alias("links"))).alias("value"))))


_WORKS = f"""{_RECORDS}, nd AS (SELECT DISTINCT src || ':' || cid AS r, t || ':' || v AS i FROM idn, (VALUES ('inspire'), ('arxiv'), ('doi')) x(t), LATERAL (SELECT CASE t WHEN 'inspire' THEN inspire WHEN 'arxiv' THEN arxiv ELSE doi END AS v) WHERE v IS NOT NULL),
  lk AS (SELECT DISTINCT a.r AS a, b.r AS b FROM nd a JOIN nd b USING (i)), rch(a, b) AS (SELECT a, a FROM lk UNION SELECT rch.a, lk.b FROM rch JOIN lk ON lk.a = rch.b),
  wk AS (SELECT a AS r, min(b) AS work FROM rch GROUP BY 1), w AS (SELECT idn.*, coalesce(wk.work, src || ':' || cid) AS work FROM idn LEFT JOIN wk ON wk.r = src || ':' || cid)"""


@R.add("record_works", f"WITH RECURSIVE {_WORKS} SELECT work, arg_max(title, (k % 9, year, title, src, cid)) AS title, arg_max(year, (k % 9, year, title, src, cid)) AS year, max(k % 9) AS citation_count FROM w GROUP BY 1")
def record_works(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as works: records that share any identifier are one."""
    return records.works(order_records(spark, sf)).select("work", "title", F.col("year").cast("long").alias("year"), F.col("citation_count").cast("long").alias("citation_count"))


@R.add("record_ids", f"WITH RECURSIVE {_WORKS} SELECT DISTINCT work, split_part(i, ':', 1) AS id_type, split_part(i, ':', 2) AS id_value, i = work AS is_primary FROM w JOIN nd ON nd.r = src || ':' || cid")
def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    return order_ids(spark, sf)


@R.add(
    "record_topics",
    f"WITH RECURSIVE {_WORKS} SELECT work, source, topic_key, min(topic) AS topic FROM (SELECT work, 'keyword' AS source, lower(p) AS topic_key, p AS topic FROM w UNION ALL SELECT work, 'category', 'status ' || lower(s), 'status ' || s FROM w) GROUP BY ALL",
)
def record_topics(spark: SparkSession, sf: str) -> DataFrame:
    return records.work_topics(order_records(spark, sf))


@R.add(
    "record_citations",
    f"""WITH RECURSIVE {_WORKS}, c AS (SELECT DISTINCT work, 'inspire' AS dst_source, floor(k / 2 + 1)::BIGINT::VARCHAR AS dst_external_id FROM w), n AS (SELECT inspire, min(work) AS dst FROM w WHERE inspire IS NOT NULL GROUP BY 1)
    SELECT work, dst_source, dst_external_id, dst, CASE WHEN dst IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM c LEFT JOIN n ON inspire = dst_external_id""",
)
def record_citations(spark: SparkSession, sf: str) -> DataFrame:
    """References to works, those that are there resolved."""
    found = order_records(spark, sf)
    return records.resolve_citations(records.citations(found), records.work_ids(found)).select("work", "dst_source", "dst_external_id", "dst", "status")


@R.add(
    "record_lookup",
    f"""WITH RECURSIVE {_WORKS}, q AS (SELECT c_custkey AS request, c_custkey::VARCHAR AS inspire, c_custkey || '.1995' AS arxiv, '10.1/' || c_custkey || '.3' AS doi FROM customer),
    i AS (SELECT split_part(nd.i, ':', 1) AS t, split_part(nd.i, ':', 2) AS v, min(work) AS work FROM w JOIN nd ON nd.r = src || ':' || cid GROUP BY ALL)
    SELECT request, coalesce(a.work, b.work, d.work) AS work FROM q LEFT JOIN i a ON a.t = 'inspire' AND a.v = q.inspire LEFT JOIN i b ON b.t = 'arxiv' AND b.v = q.arxiv LEFT JOIN i d ON d.t = 'doi' AND d.v = q.doi
    WHERE coalesce(a.work, b.work, d.work) IS NOT NULL""",
)
def record_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Works by the first of several identifiers that is known."""
    c = F.col("c_custkey").cast("string")
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("request"), c.alias("inspire"), F.concat(c, F.lit(".1995")).alias("arxiv"), F.concat(F.lit("10.1/"), c, F.lit(".3")).alias("doi"))
    return records.look_up(wanted, order_ids(spark, sf))


# ---- families of records: here each order is a work by itself

_TITLE = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
_PAIRS = f"""{_RECORDS}, fw AS (SELECT k AS id, year, {_TITLE} AS t, CASE s WHEN 'F' THEN 5 WHEN 'P' THEN 4 ELSE 2 END AS stage, arxiv, doi, lower(report) AS report, lower(collaboration) AS collab FROM rec),
  fp AS (SELECT a.id AS src, b.id AS dst, a.t = b.t AND a.report = b.report AND abs(a.year - b.year) <= 2 AS r1, a.t = b.t AND a.collab = b.collab AND a.stage <> b.stage AND greatest(a.stage, b.stage) >= 3 AND NOT least(a.stage, b.stage) >= 4 AS r2,
    a.report = b.report AND a.collab = b.collab AND abs(a.year - b.year) <= 2 AS r3 FROM fw a JOIN fw b ON a.id < b.id AND (a.t = b.t OR a.report = b.report)
    WHERE NOT coalesce(a.arxiv <> b.arxiv, false) AND NOT coalesce(a.doi <> b.doi, false)),
  pairs AS (SELECT src, dst, CASE WHEN r1 THEN 'report_number+title' WHEN r2 THEN 'title+stage_variant' ELSE 'report_number+collaboration' END AS matched_by, CASE WHEN r1 THEN 0.99 WHEN r2 THEN 0.93 ELSE 0.82 END::DOUBLE AS confidence FROM fp WHERE r1 OR r2 OR r3)"""
_FAMILY = f"""{_PAIRS}, pm AS (SELECT src AS a, dst AS b FROM pairs UNION SELECT dst, src FROM pairs), fr(a, b) AS (SELECT a, a FROM pm UNION SELECT fr.a, pm.b FROM fr JOIN pm ON pm.a = fr.b), fc AS (SELECT a AS k, min(b) AS family FROM fr GROUP BY 1),
  ff AS (SELECT rec.*, coalesce(family, k) AS family, (CASE s WHEN 'F' THEN 6 WHEN 'P' THEN 4 ELSE CASE WHEN arxiv IS NULL THEN 1 ELSE 2 END END, (arxiv IS NOT NULL)::INT, 1, (arxiv IS NOT NULL)::INT, (doi IS NOT NULL)::INT, k % 9, year, length(title), -k) AS richness FROM rec LEFT JOIN fc USING (k))"""


def order_works(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a work with what families are found by."""
    return stored_hits(spark, sf).withColumn("work_id", F.element_at(F.split("source_url", "/"), -1).cast("long"))


def order_pairs(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame([], "a string, b string")
    return stored(spark, sf, "order-pairs", ["orders"], lambda: records.family_pairs(order_works(spark, sf), none))


@R.add("record_family_pairs", f"WITH {_PAIRS} SELECT src, dst, matched_by, confidence FROM pairs")
def record_family_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of one work by three rules, unless identifiers speak against it."""
    return order_pairs(spark, sf).select("src", "dst", "matched_by", "confidence")


@R.add("record_families", f"WITH RECURSIVE {_FAMILY} SELECT family, arg_max(k, richness) AS primary, arg_max(title, richness) AS label, CASE WHEN count(*) > 1 THEN 'version_family' ELSE 'standalone' END AS relation, count(*) AS members FROM ff GROUP BY 1")
def record_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families with the member that stands for each, by eight keys."""
    members = records.family_rows(order_works(spark, sf), order_pairs(spark, sf))
    return records.family_summary(members).select("family", "primary", "label", "relation", "members")


_SEEDS = "sd AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 30)"


@R.add(
    "family_expansion",
    f"""WITH RECURSIVE {_FAMILY}, {_SEEDS}, pr AS (SELECT family, arg_max(k, richness) AS primary FROM ff GROUP BY 1), ex AS (SELECT sd.rank, m.k AS id, m.k <> pr.primary AS later FROM sd JOIN ff own ON own.k = sd.id JOIN ff m ON m.family = own.family JOIN pr ON pr.family = own.family)
    SELECT id AS work_id, row_number() OVER (ORDER BY min((rank, later, id))) AS rank FROM ex GROUP BY id""",
)
def family_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """The best works with the other versions of each behind it, its primary first."""
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    seeds = table(spark, sf, "orders").orderBy(*order).limit(30).select(F.col("o_orderkey").alias("work_id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))
    members = records.family_rows(order_works(spark, sf), order_pairs(spark, sf))
    return records.expanded(seeds, members.join(records.family_summary(members).select("family", "primary"), "family"))


_SAID = "goods that some customer asked for in a hurry and on credit".split()


@R.add(
    "near_titles",
    f"""WITH t AS (SELECT k, list_sort(list_transform({[*_SAID, 'once']!r}, lambda w: w || (k // 6)) || CASE WHEN k % 3 = 0 THEN ['again' || (k // 6)] ELSE [] END) AS w FROM (SELECT o_orderkey AS k FROM orders)),
    c AS (SELECT w, min(k) AS rep FROM t GROUP BY 1), p AS (SELECT a.rep AS src, b.rep AS dst, len(list_intersect(a.w, b.w)) AS shared, len(list_distinct(list_concat(a.w, b.w))) AS u FROM c a JOIN c b ON a.rep < b.rep AND a.rep // 6 = b.rep // 6)
    SELECT src, dst, shared::BIGINT AS shared, round(shared / u, 6) AS score FROM p WHERE 100 * shared >= 92 * u""",
)
def near_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that are as good as equal: here those of one group's orders, some of them a word longer."""
    k = F.col("o_orderkey")
    group = F.floor(k / 6).cast("string")
    text = F.concat_ws(" ", *(F.concat(F.lit(w), group) for w in [*_SAID, "once"]), F.when(k % 3 == 0, F.concat(F.lit("again"), group)))
    rows = table(spark, sf, "orders").select(k.alias("doc_id"), text.alias("text"))
    return title_pairs(written(title_classes(rows, whole=True), "titles")).withColumn("score", F.round("score", 6))


# ---- hits collapsed by rank


def ranked_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as hits of one list, dearest first."""
    price = table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), "o_totalprice")
    rows = order_works(spark, sf).join(price, "work_id")
    placed = place_in_group(rows.select("work_id", F.lit(0).alias("g"), F.struct((-F.col("o_totalprice")).alias("p"), F.col("work_id").alias("w")).alias("by")), "g", "by").select("work_id", F.col("place").cast("long").alias("place"))
    kinds = F.when(F.array_contains(F.col("document_type"), "Article"), 5).when(F.array_contains(F.col("document_type"), "note"), 3).otherwise(1)
    return rows.join(placed, "work_id").withColumns({"title_words": records.title_words(F.col("title_normal")), "preference": kinds, "documents": F.coalesce(F.size("documents"), F.lit(0))})


@R.add(
    "collapsed_hits",
    f"""WITH RECURSIVE {_RECORDS}, h AS (SELECT rec.*, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, {_TITLE} AS t, CASE s WHEN 'F' THEN 5 WHEN 'P' THEN 4 ELSE 2 END AS stage FROM rec JOIN orders ON o_orderkey = k),
    x AS (SELECT a.place AS early, b.place AS late FROM h a JOIN h b ON a.place < b.place AND (a.t = b.t OR a.arxiv = b.arxiv OR a.doi = b.doi)
      WHERE CASE WHEN a.arxiv IS NOT NULL AND b.arxiv IS NOT NULL THEN a.arxiv = b.arxiv WHEN a.doi IS NOT NULL AND b.doi IS NOT NULL THEN a.doi = b.doi
        ELSE a.t = b.t AND abs(a.year - b.year) <= 1 AND (a.report = b.report OR a.collaboration = b.collaboration AND a.stage <> b.stage AND greatest(a.stage, b.stage) >= 3 AND NOT least(a.stage, b.stage) >= 4) END),
    d(late, early) AS (SELECT late, early FROM x UNION SELECT d.late, x.early FROM d JOIN x ON x.late = d.early), f AS (SELECT h.*, coalesce(m, place) AS family FROM h LEFT JOIN (SELECT late, min(early) AS m FROM d GROUP BY 1) ON late = place)
    SELECT family AS place, arg_max(place, (CASE s WHEN 'F' THEN 5 WHEN 'P' THEN 3 ELSE 1 END, (arxiv IS NOT NULL)::INT, (doi IS NOT NULL)::INT, k % 9, length(title), -place)) AS best, count(*) AS hits FROM f GROUP BY 1""",
)
def collapsed_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked hits with versions of one work as one, at the place of the first, the richest standing for it."""
    found = collapse.collapsed(written(ranked_orders(spark, sf), "hits"), collapse.richness())
    return found.select("place", "best", (F.size("members") + 1).cast("long").alias("hits"))


# ---- scopes and selections

_ONE_PER_SOURCE = "SELECT doc_id AS work_id, source AS collection FROM documents WHERE source IS NOT NULL"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(collection, work_id): documents by their source."""
    return table(spark, sf, "documents").where("source IS NOT NULL").select(F.col("source").alias("collection"), F.col("doc_id").alias("work_id"))


@R.add("collection_in_list", "SELECT lang, list_contains(string_split(string_agg(DISTINCT source, '|'), '|'), 'src1') AS has_src1 FROM documents GROUP BY 1")
def collection_in_list(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the names between bars of each language hold a collection."""
    listed = table(spark, sf, "documents").groupBy("lang").agg(F.concat(F.lit("|"), F.array_join(F.collect_set("source"), "|"), F.lit("|")).alias("names"))
    return listed.select("lang", scopes.has_collection(F.col("names"), "collection:src1").alias("has_src1"))


@R.add("retrievable_turns", "SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND coalesce(text, '') <> ''")
def retrievable_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where(scopes.retrievable(F.col("role") != "system", F.col("text"))).select("conv_id", "turn")


@R.add("hydrated_ranks", "WITH r AS (SELECT item_id AS doc_id, row_number() OVER (ORDER BY length(text) DESC, item_id) AS rank FROM benchmark QUALIFY rank <= 25) SELECT doc_id, rank, lang, n_chars FROM r JOIN documents USING (doc_id)")
def hydrated_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked ids with the rows that they name; ids without a row fall out."""
    order = [F.length("text").desc(), F.col("item_id")]
    ranked = table(spark, sf, "benchmark").orderBy(*order).limit(25).select(F.col("item_id").alias("doc_id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))
    return scopes.hydrated(ranked, table(spark, sf, "documents"), "doc_id").select("doc_id", "rank", "lang", "n_chars")


@R.add("works_without_edges", "SELECT p_partkey AS work_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def works_without_edges(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("src"))
    return scopes.without_edges(table(spark, sf, "part").select(F.col("p_partkey").alias("work_id")), items)


@R.add("works_without_kind", "SELECT doc_id AS work_id FROM documents WHERE source IS DISTINCT FROM 'src2' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
def works_without_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that neither come from a source nor are marked as of its kind."""
    works = table(spark, sf, "documents").select(F.col("doc_id").alias("work_id"), F.col("source").alias("canonical_source"))
    ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("work_id"), F.lit("src2").alias("id_type"))
    return scopes.without_kind(works, ids, "src2").select("work_id")


@R.add(
    "selected_works",
    f"WITH m AS ({_ONE_PER_SOURCE}) SELECT 'ids' AS how, doc_id AS work_id FROM documents WHERE doc_id IN (3, 5, 8) UNION ALL SELECT 'collection', work_id FROM m WHERE collection = 'src3' UNION ALL SELECT 'all', doc_id FROM documents",
)
def selected_works(spark: SparkSession, sf: str) -> DataFrame:
    """What an operation covers: ids before a collection before everything."""
    works, members = table(spark, sf, "documents").select(F.col("doc_id").alias("work_id")), sources(spark, sf)
    how = (("ids", [8, 3, 5, 5], "src3"), ("collection", None, " collection:src3"), ("all", None, "*"))
    parts = [scopes.selected(works, members, ids, name).select(F.lit(k).alias("how"), "work_id") for k, ids, name in how]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add(
    "reparse_candidates",
    """WITH d AS (SELECT doc_id AS work_id, CASE WHEN toxic = 1 THEN 'other' ELSE 'parser' END AS parser_name, CASE WHEN quality = 1 THEN 'materialized' ELSE 'failed' END AS parse_status FROM labels)
    SELECT doc_id AS work_id FROM documents LEFT JOIN d ON d.work_id = doc_id WHERE doc_id IN (SELECT page_id FROM pages) AND (parser_name IS NULL OR parser_name = 'parser') AND coalesce(parse_status, '') <> 'materialized' ORDER BY doc_id LIMIT 100""",
)
def reparse_candidates(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "documents").select(F.col("doc_id").alias("work_id"))
    read = table(spark, sf, "labels").select(F.col("doc_id").alias("work_id"), F.when(F.col("toxic") == 1, "other").otherwise("parser").alias("parser_name"), F.when(F.col("quality") == 1, "materialized").otherwise("failed").alias("parse_status"))
    return scopes.reparse_candidates(works, read, table(spark, sf, "pages").select(F.col("page_id").alias("work_id")), "parser", False, 100).select("work_id")


@R.add("first_collections", "SELECT p_partkey AS work_id, (SELECT min(s_name) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey) AS collection FROM part")
def first_collections(spark: SparkSession, sf: str) -> DataFrame:
    """The least collection that each work is in."""
    members = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("work_id"), F.col("s_name").alias("collection"))
    return scopes.first_collection(table(spark, sf, "part").select(F.col("p_partkey").alias("work_id")), members)


@R.add("first_texts", "SELECT c_custkey AS section_id, (SELECT arg_min(md5(text), turn) FROM conversations WHERE conv_id = c_custkey AND role = 'user' AND text <> '') AS first_text FROM customer")
def first_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each section's first retrievable chunk."""
    chunks = table(spark, sf, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("chunk_id"), F.when(F.col("text") != "", F.md5("text")).alias("text"), (F.col("role") == "user").alias("searched"))
    return scopes.first_texts(table(spark, sf, "customer").select(F.col("c_custkey").alias("section_id")), chunks)


@R.add(
    "local_status",
    """SELECT item_id AS work_id, item_id IN (SELECT doc_id FROM documents) AS known, item_id IN (SELECT page_id FROM pages) AS has_pdf, item_id IN (SELECT user_id FROM events) AS has_document,
    (SELECT arg_max(event_type, event_id) FROM events WHERE user_id = item_id) AS parse_status FROM benchmark""",
)
def local_status(spark: SparkSession, sf: str) -> DataFrame:
    """What is there of each hit: the work, its file, its parsed document and that one's status."""
    hits = table(spark, sf, "benchmark").select(F.col("item_id").alias("work_id"))
    read = table(spark, sf, "events").select(F.col("user_id").alias("work_id"), F.col("event_id").alias("document_id"), F.col("event_type").alias("parse_status"))
    return scopes.annotated(hits, table(spark, sf, "documents").select(F.col("doc_id").alias("work_id")), read, table(spark, sf, "pages").select(F.col("page_id").alias("work_id"))).select("work_id", "known", "has_pdf", "has_document", "parse_status")


_SHARED = """{n}e AS (SELECT DISTINCT l_partkey AS n, l_orderkey AS v FROM lineitem WHERE {w}), {n} AS (SELECT a.n AS src, b.n AS dst, count(*) AS shared FROM {n}e a JOIN {n}e b ON a.v = b.v AND a.n < b.n GROUP BY 1, 2 HAVING count(*) >= 2)"""
_INSIDE = "SELECT p_partkey AS work_id FROM part WHERE p_size <= 20"


@R.add(
    "rebuilt_edges",
    f"""WITH {_SHARED.format(n='o', w="l_returnflag <> 'R'")}, {_SHARED.format(n='w', w='true')}, m AS ({_INSIDE}) SELECT src, dst, shared FROM o WHERE src NOT IN (FROM m) OR dst NOT IN (FROM m) UNION ALL SELECT src, dst, shared FROM w WHERE src IN (FROM m) AND dst IN (FROM m)""",
)
def rebuilt_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after a rebuild within a collection: its own anew, those with an end outside as they were."""
    items = table(spark, sf, "lineitem")
    inside = table(spark, sf, "part").where("p_size <= 20").select(F.col("p_partkey").alias("work_id"))
    old = stored(spark, sf, "unreturned-edges", ["lineitem"], lambda: graph.shared_pairs(items.where("l_returnflag <> 'R'"), "l_partkey", "l_orderkey")).select("src", "dst", "shared")
    new = stored(spark, sf, "all-edges", ["lineitem"], lambda: graph.shared_pairs(items, "l_partkey", "l_orderkey")).select("src", "dst", "shared")
    side = lambda c: inside.select(F.col("work_id").alias(c))
    return scopes.rebuilt_edges(old, new.join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi").select("src", "dst", "shared"), inside)


@R.add("stale_rows", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders EXCEPT SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that were there and were not seen again."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    return scopes.stale(o.select("o_custkey", "o_orderpriority").distinct(), o.where("o_orderstatus <> 'F'"), ["o_custkey", "o_orderpriority"])


@R.add("run_log", "SELECT user_id AS run, min(event_id) AS started, max(event_id) AS ended, arg_max(event_type, event_id) AS status, count(*) AS steps FROM events GROUP BY 1")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return scopes.run_log(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), F.col("event_type").alias("status")))


@R.add(
    "storage_stems",
    """WITH i AS (SELECT o_custkey AS c, CASE o_orderstatus WHEN 'F' THEN 'inspire' WHEN 'O' THEN 'arxiv' ELSE 'doi' END AS t, o_orderpriority AS v, o_orderkey % 10 = 0 AS p FROM orders),
    b AS (SELECT c, v FROM i QUALIFY row_number() OVER (PARTITION BY c ORDER BY NOT p, CASE t WHEN 'arxiv' THEN 0 WHEN 'inspire' THEN 1 ELSE 2 END, t, v) = 1)
    SELECT c_custkey AS work_id, coalesce(v, CASE WHEN c_nationkey = 3 THEN 'n3' END, 'work-' || c_custkey) AS stem FROM customer LEFT JOIN b ON c = c_custkey""",
)
def storage_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Names of folders: the best identifier, else the canonical id, else the work's own."""
    works = table(spark, sf, "customer").select(F.col("c_custkey").alias("work_id"), F.when(F.col("c_nationkey") == 3, "n3").otherwise(" ").alias("canonical_id"))
    kind = F.when(F.col("o_orderstatus") == "F", "inspire").when(F.col("o_orderstatus") == "O", "arxiv").otherwise("doi")
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("work_id"), kind.alias("id_type"), F.col("o_orderpriority").alias("id_value"), (F.col("o_orderkey") % 10 == 0).alias("is_primary"))
    return scopes.storage_stems(works, ids)


# ---- what comes in from outside


@R.add(
    "old_rows_as_works",
    """SELECT 'inspire' AS canonical_source, c_custkey::VARCHAR AS canonical_id, c_name AS title, 1990 + c_nationkey AS year, c_custkey::VARCHAR AS inspire, CASE WHEN c_nationkey <> 1 THEN 'c.' || c_custkey END AS arxiv, '10.2/' || lower(c_mktsegment) AS doi
    FROM customer WHERE trim(c_name) <> ''""",
)
def old_rows_as_works(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an older table as hits, read like any others."""
    c = table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").cast("string").alias("inspire_id"), F.when(F.col("c_nationkey") == 1, " ").otherwise(F.concat(F.lit("c."), F.col("c_custkey").cast("string"))).alias("arxiv_id"), F.concat(F.lit("10.2/"), "c_mktsegment").alias("doi"), F.col("c_name").alias("title"), F.lit("").alias("abstract"), (1990 + F.col("c_nationkey")).alias("year"))
    return records.described(records.parse_hits(landing.old_rows(old))).select("canonical_source", "canonical_id", "title", "year", "inspire", "arxiv", "doi")


@R.add(
    "manifest_works",
    """WITH f AS (SELECT 'parsed/' || CASE c_nationkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN '24' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '.' || lpad((c_custkey % 10000)::VARCHAR, 5, '0') ELSE 'notes ' || c_custkey END AS folder FROM customer),
    i AS (SELECT c_custkey AS work_id, 'inspire' AS t, c_custkey::VARCHAR AS v FROM customer UNION ALL SELECT c_custkey, 'arxiv', '24' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '.' || lpad((c_custkey % 10000)::VARCHAR, 5, '0') FROM customer),
    n AS (SELECT folder, split_part(folder, '/', 2) AS v, CASE WHEN regexp_full_match(split_part(folder, '/', 2), '[0-9]+') THEN 'inspire' WHEN regexp_full_match(split_part(folder, '/', 2), '[0-9]{4}[.][0-9]{4,5}(v[0-9]+)?') THEN 'arxiv' END AS t FROM f)
    SELECT folder, min(work_id) AS work_id FROM n JOIN i USING (t, v) GROUP BY folder""",
)
def manifest_works(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed folders and the works that their names stand for."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    number = F.concat(F.lit("24"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("."), F.lpad((key % 10000).cast("string"), 5, "0"))
    folders = c.select(F.concat(F.lit("parsed/"), F.when(F.col("c_nationkey") % 3 == 0, key.cast("string")).when(F.col("c_nationkey") % 3 == 1, number).otherwise(F.concat(F.lit("notes "), key.cast("string")))).alias("folder"))
    ids = c.select(key.alias("work_id"), F.lit("inspire").alias("id_type"), key.cast("string").alias("id_value")).unionByName(c.select(key.alias("work_id"), F.lit("arxiv").alias("id_type"), number.alias("id_value")))
    return landing.manifests(folders.distinct(), ids)


@R.add(
    "content_blocks",
    """SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, CASE role WHEN 'system' THEN 'text' WHEN 'user' THEN 'equation' ELSE 'assistant' END AS kind, turn // 3 AS page, md5(trim(text)) AS text
    FROM conversations WHERE trim(coalesce(text, '')) <> ''""",
)
def content_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Content lists, some wrapped in an object, as blocks with the kinds that their types stand for."""
    kind = F.when(F.col("role") == "system", "Heading").when(F.col("role") == "user", "inline_formula").otherwise("Assistant")
    item = F.struct("turn", kind.alias("type"), F.col("text").alias("text"), F.when(F.col("conv_id") % 2 == 0, F.floor(F.col("turn") / 3)).cast("int").alias("page_idx"), F.when(F.col("conv_id") % 2 == 1, F.floor(F.col("turn") / 3)).cast("int").alias("page_no"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("turn")))
    lists = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(listed.alias("list"))
    wrapped = lists.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"data": '), "list", F.lit("}"))).otherwise(F.col("list")).alias("content"))
    return blocks.decode(wrapped).select("doc_id", "position", "kind", F.col("page").cast("long").alias("page"), F.md5(F.trim("text")).alias("text"))


@R.add("shortened_texts", "SELECT doc_id, md5(CASE WHEN length(text) > 360 THEN substr(text, 1, 359) || '…' ELSE text END) AS text FROM documents")
def shortened_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.truncate(F.col("text"), 360)).alias("text"))


@R.add(
    "hit_summaries",
    f"""WITH {_RECORDS} SELECT k, title, year, concat_ws(';', 'arxiv=' || arxiv, 'doi=' || doi, 'inspire=' || inspire) AS identifiers, coalesce('https://arxiv.org/pdf/' || arxiv || '.pdf', '') AS pdf_candidates, 'https://orders/' || k AS source_url FROM rec""",
)
def hit_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """What is shown of each hit."""
    found = records.hit_summary(order_hits(spark, sf))
    ids = F.array_join(F.array_sort(F.transform(F.map_entries("identifiers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select(F.element_at(F.split("source_url", "/"), -1).cast("long").alias("k"), "title", F.col("year").cast("long").alias("year"), ids.alias("identifiers"), F.array_join("pdf_candidates", ";").alias("pdf_candidates"), "source_url")


@R.add(
    "purged_works",
    """WITH g AS (SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand%' AND (p_name LIKE 'red %' OR p_name LIKE '% ring'))
    SELECT 'work' AS what, p_partkey AS id FROM part WHERE p_partkey NOT IN (FROM g) UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_partkey NOT IN (FROM g)""",
)
def purged_works(spark: SparkSession, sf: str) -> DataFrame:
    """What is left when deprecated works go with all that belongs to them."""
    works = table(spark, sf, "part").select(F.col("p_partkey").alias("work_id"), F.when(F.col("p_brand").like("Brand%"), "pdg").alias("canonical_source"), F.col("p_name").alias("canonical_id"))
    items = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    left, children, _ = scopes.purged(works, "pdg", ["red %", "% ring"], {"lines": (items, "l_partkey")})
    return left.select(F.lit("work").alias("what"), F.col("work_id").alias("id")).unionByName(children["lines"].select(F.lit("line").alias("what"), "id"))


@R.add(
    "coerced_values",
    r"""WITH v AS (SELECT event_id, ' ' || coalesce(regexp_extract(props, '"k": *([0-9]+)', 1), '') || CASE event_id % 4 WHEN 1 THEN '.5' WHEN 2 THEN ' x' WHEN 3 THEN ' ' ELSE '' END AS x FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(trim(x), '[+-]?[0-9]+') THEN trim(x)::BIGINT END AS n, TRY_CAST(trim(x) AS DOUBLE) AS f, nullif(trim(x), '') AS t FROM v""",
)
def coerced_values(spark: SparkSession, sf: str) -> DataFrame:
    """Loose values as whole numbers, numbers and texts, null for what is none."""
    tail = F.when(F.col("event_id") % 4 == 1, ".5").when(F.col("event_id") % 4 == 2, " x").when(F.col("event_id") % 4 == 3, " ").otherwise("")
    x = F.concat(F.lit(" "), F.coalesce(F.regexp_extract("props", '"k": *([0-9]+)', 1), F.lit("")), tail)
    return table(spark, sf, "events").select("event_id", T.int_or_null(x).alias("n"), T.float_or_null(x).alias("f"), T.text_or_null(x).alias("t"))
