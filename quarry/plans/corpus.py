"""Corpus queries: normal forms, sentences, chunks, sections, extraction, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import normalize
from quarry.functions import text as T
from quarry.operators import documents, extract, fulltext, ingest, objects, taxonomy
from quarry.operators.shared import spread
from quarry.plans.registry import Registry
from quarry.sources.tables import table

R = Registry()
#: Terms that occur in the test corpus, beside the default patterns of results and methods.
TEST_PROFILE = {"measurement": r"(?i)\b(edoution|measure(?:ment|d|s)?)\b", "upper_limit": r"(?i)\b(upper limit|stst)\b", "exclusion": r"(?i)\b(exclude(?:d|s)?|threl)\b"}
TEST_METHODS = {"statistical_fit": r"(?i)\b(onharent|likelihood fit)\b", "multivariate": r"(?i)\b(inin|neural network)\b"}

_ENT = "coalesce(text, '')"
for _k, _v in T.ENTITIES.items():
    _q = _v.replace("'", "''")
    _ENT = f"replace({_ENT}, '{_k}', '{_q}')"
_ENT = f"regexp_replace({_ENT}, '</?[A-Za-z][^>]*?>', ' ', 'g')"
_NORMAL = f"trim(regexp_replace(regexp_replace({_ENT}, '[$^_{{}}()\\[\\],;:|/–-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_DISPLAY = f"regexp_replace(regexp_replace(trim(regexp_replace({_ENT}, '\\s+', ' ', 'g')), ' ([.,;:!?)\\]])', '\\1', 'g'), '([(\\[]) ', '\\1', 'g')"


def _digest(c: str) -> str:
    return f"md5({c}) AS digest, length({c})::BIGINT AS n"


@R.add("normalize_search", f"SELECT doc_id, {_digest(_NORMAL)} FROM documents")
def normalize_search(spark: SparkSession, sf: str) -> DataFrame:
    n = T.normalize_search(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


@R.add("normalize_display", f"SELECT doc_id, {_digest(_DISPLAY)} FROM documents")
def normalize_display(spark: SparkSession, sf: str) -> DataFrame:
    n = T.normalize_display(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


_SENT = "list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+([\"(]*[A-Z0-9ΔΣΩ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> '')"


@R.add("sentence_split", f"SELECT doc_id, len({_SENT})::BIGINT AS sentences, list_max(list_transform({_SENT}, lambda s: length(s)))::BIGINT AS longest FROM documents")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("sentences"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


@R.add(
    "inline_citation_strip",
    r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\[[0-9,\s;–-]+\]', '', 'g'))::BIGINT AS n, len(regexp_extract_all(coalesce(text, ''), '\[[0-9,\s;–-]+\]'))::BIGINT AS removed FROM documents",
)
def inline_citation_strip(spark: SparkSession, sf: str) -> DataFrame:
    body, removed = T.strip_inline_citations(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(body).cast("long").alias("n"), removed.alias("removed"))


@R.add(
    "identifier_extract",
    r"""SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, 'https?://[^\s<>"]+'), regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), regexp_extract_all(text, '\b10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+')))) AS identifier FROM documents WHERE text IS NOT NULL""",
)
def identifier_extract(spark: SparkSession, sf: str) -> DataFrame:
    patterns = (r"https?://[^\s<>\"]+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+")
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in patterns))
    return table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("identifier"))


@R.add(
    "bibliography_entries",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), e AS (SELECT doc_id, lower(trim(regexp_replace(line, '^\s*(\[[0-9]+\]|[0-9]+\.|[A-Z])\s+', ''))) AS entry FROM l WHERE regexp_matches(line, '^\s*(\[[0-9]+\]|[0-9]+\.|[A-Z])\s+'))
    SELECT doc_id, md5(entry) AS entry, count(*) AS occurrences FROM e WHERE length(entry) >= 12 GROUP BY 1, 2""",
)
def bibliography_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered or lettered lines as entries, folded and deduplicated within the document."""
    head = r"^\s*(\[[0-9]+\]|[0-9]+\.|[A-Z])\s+"
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where(F.col("line").rlike(head))
    entry = F.lower(F.trim(F.regexp_replace("line", head, "")))
    return lines.select("doc_id", entry.alias("e")).where("length(e) >= 12").groupBy("doc_id", F.md5("e").alias("entry")).agg(F.count(F.lit(1)).alias("occurrences"))


def _edges(p: str) -> str:
    """The pattern with Unicode word edges spelled out, for an engine whose edges are ASCII."""
    return p.replace(r"\b(", r"(^|[^\p{L}\p{N}_])(", 1).replace(r")\b", r")($|[^\p{L}\p{N}_])", 1)


def _sql_list(patterns: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{_edges(p)}') THEN '{k}' END" for k, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


_STRUCTURE = f"x AS (SELECT doc_id, source, {_sql_list(TEST_PROFILE)} AS results, {_sql_list(TEST_METHODS)} AS methods FROM documents)"


def structures(spark: SparkSession, sf: str) -> DataFrame:
    return extract.signatures(table(spark, sf, "documents"), TEST_PROFILE, TEST_METHODS)


@R.add("signature_extract", f"WITH {_STRUCTURE} SELECT doc_id, array_to_string(results, '|') AS results, array_to_string(methods, '|') AS methods FROM x WHERE len(results) + len(methods) > 0")
def signature_extract(spark: SparkSession, sf: str) -> DataFrame:
    return structures(spark, sf).where("size(results) + size(methods) > 0").select("doc_id", F.array_join("results", "|").alias("results"), F.array_join("methods", "|").alias("methods"))


_STATUS = "CASE WHEN source = 'src0' THEN 'partial' WHEN len(results) = 0 OR len(methods) = 0 THEN 'needs_review' ELSE 'ready' END"


@R.add("structure_status", f"WITH {_STRUCTURE} SELECT doc_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'needs_review' THEN 'missing_required_signatures' END AS anomaly FROM x")
def structure_status(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews (here: one source) are partial; works without a result or method signature need review."""
    return extract.status(structures(spark, sf), F.col("source") == "src0").select("doc_id", "status", "anomaly")


# A snapshot of earlier capsules: labelled documents; those of poor quality were left in review.
_VALUES = lambda p: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{_edges(x)}') THEN '{k}' END" for k, x in p.items()) + "], lambda x: x IS NOT NULL)"
_OBJECTS = f"""o AS (SELECT doc_id, {_VALUES(TEST_PROFILE)} AS vals, CASE WHEN quality = 0 THEN 'needs_review' WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'ready' END AS recorded,
    coalesce(trim(text, ' '), '') <> '' AS has_text FROM documents LEFT JOIN labels USING (doc_id))"""


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("quality") == 0, "needs_review").when(F.col("toxic") == 1, "odd").otherwise("ready")
    return table(spark, sf, "labels").select("doc_id", status.alias("status"), F.lit(None).cast(f"array<{objects.VALUE}>").alias("values"))


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", T.title(F.col("text")).alias("title"), "text")
    found = objects.capsules(docs, F.lit(False), TEST_PROFILE, TEST_METHODS, "doc_id")
    return objects.objects(found, "results", snapshot(spark, sf), "doc_id")


@R.add(
    "result_objects",
    f"""WITH {_OBJECTS} SELECT doc_id, vals[1] AS kind, CASE WHEN recorded IN ('needs_review', 'failed') THEN recorded WHEN len(vals) > 0 THEN 'ready' WHEN has_text THEN 'partial' ELSE 'failed' END AS status,
      CASE WHEN len(vals) > 0 THEN 0.65::DOUBLE END AS confidence, CASE WHEN has_text THEN 'chunks' ELSE 'metadata_only' END AS source, len(vals)::BIGINT AS n_values FROM o""",
)
def result_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Result objects of all documents: their first kind, their state, how sure, and from where."""
    return result_rows(spark, sf).select("doc_id", "kind", "status", "confidence", "source", F.size("values").cast("long").alias("n_values"))


@R.add("result_values", f"WITH {_OBJECTS}, u AS (SELECT doc_id, unnest(vals) AS kind, unnest(range(1, len(vals) + 1)) AS place FROM o) SELECT doc_id, place, kind, 0.65::DOUBLE AS confidence FROM u")
def result_values(spark: SparkSession, sf: str) -> DataFrame:
    return objects.object_values(result_rows(spark, sf), "doc_id").select("doc_id", "place", "kind", "confidence")


@R.add(
    "typed_signatures",
    f"""WITH {_OBJECTS}, u AS (SELECT doc_id, unnest(vals) AS kind, unnest(range(1, len(vals) + 1)) AS place FROM o)
    SELECT 'result_signature:' || doc_id || ':' || place AS object_id, doc_id AS work_id, kind, CASE WHEN doc_id % 7 = 0 THEN 'status' WHEN doc_id % 11 = 0 THEN 'confidence' ELSE '' END AS broken FROM u""",
)
def typed_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Result values as typed objects, some of them made to break the contract, with the rules that they break."""
    values = objects.object_values(result_rows(spark, sf), "doc_id")
    values = values.withColumn("confidence", F.when((F.col("doc_id") % 11 == 0) & (F.col("doc_id") % 7 != 0), 1.5).otherwise(F.col("confidence")))
    typed = objects.signature_objects(values, F.when(F.col("doc_id") % 7 == 0, "odd").otherwise("ready"), work="doc_id")
    return typed.select("object_id", "work_id", "kind", F.array_join(objects.violations(typed), ",").alias("broken"))


_AUDIT = {
    "latex_frac_literal": r"(?i)\bfrac\b",
    "style_command_literal": r"(?i)\b(?:mathnormal|boldsymbol|textcircled|operatorname)\b",
    "array_artifact": r"(?i)\b(?:begin|end)\s+array\b",
    "arrow_split": r"[A-Za-zΑ-Ωα-ω0-9]\s+-\s+>\s*[A-Za-zΑ-Ωα-ω0-9(]",
    "double_punct": r"(,\s*,|,,|(^|[^.])\.\s*\.($|[^.]))",
    "orphan_citation_phrase": r"(?i)\bdetailed\s+in(?:\s+(?:Refs?\.?|references?))?\s*([.,;:]|$)",
}
_AUDIT_SQL = ", ".join(f"regexp_matches(coalesce(text, ''), '{p}')::INT AS {k}" for k, p in _AUDIT.items())
_SUMS = ", ".join(f"sum({k})::BIGINT AS {k}" for k in _AUDIT)
_HITS = "(" + " + ".join(_AUDIT) + ")"


@R.add(
    "conversation_audit",
    f"""WITH t AS (SELECT conv_id, CASE role WHEN 'assistant' THEN 'block' ELSE 'chunk' END AS level, {_AUDIT_SQL} FROM conversations),
    s AS (SELECT conv_id, {_SUMS}, coalesce(sum({_HITS}) FILTER (WHERE level = 'chunk'), 0)::BIGINT AS chunk_noise, coalesce(sum({_HITS}) FILTER (WHERE level = 'block'), 0)::BIGINT AS block_noise FROM t GROUP BY 1)
    SELECT *, chunk_noise <= 0 AND block_noise <= 1 AS ready, CASE WHEN chunk_noise > 0 THEN 'repair_chunks' WHEN block_noise > 1 THEN 'repair_blocks' ELSE 'none' END AS recommendation FROM s""",
)
def conversation_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Readiness of every conversation: its turns as chunks and blocks."""
    turns = table(spark, sf, "conversations").select("conv_id", F.when(F.col("role") == "assistant", "block").otherwise("chunk").alias("level"), "text")
    return objects.audit(turns, "conv_id").drop("equations", "structured")


@R.add("document_items")
def document_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a parsed paper: sections, blocks and chunks, in one pass."""
    docs = table(spark, sf, "documents").select("doc_id", T.title(F.col("text")).alias("title"), documents.text_as_content(F.col("text")).alias("content"))
    return documents.materialize(docs).select("doc_id", "item", "id", "section", "role", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@R.add("searched_forms")
def searched_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The searched and the shown form of every document, as the data model prescribes them."""
    both = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", normalize.search_form(F.col("text")).alias("s"), normalize.display_form(F.col("text")).alias("d"))
    return both.select("doc_id", F.md5("s").alias("searched"), F.length("s").cast("long").alias("n_searched"), F.md5("d").alias("shown"), F.length("d").cast("long").alias("n_shown"))


_PHYSICAL = "|".join([*(h for hints in taxonomy.HINTS.values() for h in hints), taxonomy.PHYSICAL])
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(label), '{'|'.join(hints)}') THEN '{k}'" for k, hints in taxonomy.HINTS.items()) + " ELSE 'section' END"


@R.add(
    "concept_taxonomy",
    rf"""WITH p AS (SELECT p_partkey AS source, [p_brand || ' meson', CASE WHEN p_size % 2 = 0 THEN 'Decays' ELSE 'Introduction' END, p_type] AS w FROM part),
    s AS (SELECT source, unnest(range(1, 4)) AS level, w FROM p),
    t AS (SELECT source, level, w[level] AS own, w[level - 1] AS parent, array_to_string(list_transform(w[1:level], lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')), '/') AS key FROM s),
    a AS (
      SELECT *, CASE WHEN parent IS NOT NULL AND lower(own) IN {taxonomy.CONTEXTUAL} THEN parent || ' ' || lower(own) ELSE own END AS label FROM t
      WHERE lower(own) NOT IN {taxonomy.GENERIC} AND (coalesce(regexp_matches(lower(parent), '{_PHYSICAL}'), false) OR regexp_matches(lower(own), '{_PHYSICAL}') AND lower(own) NOT IN {taxonomy.CONTEXTUAL})),
    k AS (SELECT key, arg_max(label, (length(label), label)) AS label, arg_max({_KIND}, CASE {_KIND} WHEN 'particle' THEN 5 WHEN 'process' THEN 4 WHEN 'decay' THEN 4 WHEN 'section' THEN 1 ELSE 3 END) AS kind, min(level)::BIGINT AS level, count(DISTINCT source) AS mentions FROM a GROUP BY key)
    SELECT k.key, k.label, k.kind, k.level, (SELECT arg_max(b.key, length(b.key)) FROM k b WHERE starts_with(k.key, b.key || '/')) AS parent, k.mentions FROM k""",
)
def concept_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts that the paths of parts name, beside headings of the kind that the data model knows."""
    part = table(spark, sf, "part")
    path = F.concat_ws(" / ", F.lit("Parts"), F.concat("p_brand", F.lit(" meson")), F.when(F.col("p_size") % 2 == 0, "1.2 Decays").otherwise("Introduction"), "p_type")
    return taxonomy.taxonomy(taxonomy.steps(part.select(F.col("p_partkey").alias("source"), path.alias("path")), ("Parts",)))


@R.add(
    "evidence_snippet",
    r"""WITH m AS (SELECT doc_id, text, instr(lower(text), 'edoution') AS p0 FROM documents) SELECT doc_id, trim(regexp_replace(substr(text, greatest(p0 - 80, 1), p0 - greatest(p0 - 80, 1) + 120), '\s+', ' ', 'g')) AS snippet FROM m WHERE p0 > 0""",
)
def evidence_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), "(?i)edoution").alias("snippet")).where("snippet is not null")


@R.add(
    "prev_next_context",
    """SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      first_value(CASE WHEN role <> 'assistant' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM conversations""",
)
def prev_next_context(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return fulltext.neighbour_text(c, "conv_id", "turn", F.when(F.col("role") != "assistant", F.md5("text"))).select("conv_id", "turn", "before", "after")


@R.add("first_k_concat", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS blob FROM (SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3) GROUP BY 1")
def first_k_concat(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.first_k(table(spark, sf, "conversations").where("role <> 'system'"), "conv_id", "turn", "text", 3)


@R.add(
    "chunk_pack",
    rf"""WITH RECURSIVE u AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS s FROM (SELECT doc_id, {_SENT} AS s FROM documents)),
    t AS (SELECT doc_id, i, trim(s) AS s, len(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'))::BIGINT AS n, lag(len(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'))) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM u),
    r(doc_id, i, chunk, first, held) AS (SELECT doc_id, i, 0::BIGINT, 1, n FROM t WHERE i = 1
      UNION ALL SELECT t.doc_id, t.i, CASE WHEN held + n > 120 THEN chunk + 1 ELSE chunk END, CASE WHEN held + n <= 120 THEN first WHEN p + n <= 120 THEN t.i - 1 ELSE t.i END, CASE WHEN held + n <= 120 THEN held + n WHEN p + n <= 120 THEN p + n ELSE n END
      FROM r JOIN t ON t.doc_id = r.doc_id AND t.i = r.i + 1),
    c AS (SELECT doc_id, chunk, min(first) AS a, max(i) AS b FROM r GROUP BY ALL)
    SELECT c.doc_id, chunk, string_agg(s, ' ' ORDER BY t.i) AS text, sum(n)::BIGINT AS n_tokens FROM c JOIN t ON t.doc_id = c.doc_id AND t.i BETWEEN a AND b GROUP BY ALL""",
)
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every document packed into chunks of a token budget, with overlap."""
    return fulltext.pack_chunks(table(spark, sf, "documents"), budget=120, overlap=1)


@R.add(
    "chunk_roles",
    """WITH l AS (SELECT doc_id, length(coalesce(text, '')) AS n, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
    SELECT doc_id, 'abstract_chunk' AS role, length(ls[1])::BIGINT AS n FROM l WHERE trim(ls[1]) <> '' UNION ALL SELECT doc_id, 'section_parent', n::BIGINT FROM l WHERE n <= 2400 AND n > 0
    UNION ALL SELECT doc_id, 'section_child', length(x)::BIGINT FROM (SELECT doc_id, unnest(ls[2:]) AS x FROM l) WHERE trim(x) <> ''""",
)
def chunk_roles(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.chunk_roles(table(spark, sf, "documents"), 2400)


@R.add("html_sections")
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every page by its headings."""
    return fulltext.html_sections(table(spark, sf, "pages")).select("page_id", "section", "level", "title", "path", "n_chars")


@R.add(
    "concept_paths",
    """WITH p AS (SELECT DISTINCT p_type, p_type || ' / ' || p_brand AS b, p_type || ' / ' || p_brand || ' / ' || p_name AS c, p_brand, p_name FROM part)
    SELECT p_type AS path, p_type AS label, 1::BIGINT AS level, NULL AS parent, count(*) AS below FROM p GROUP BY 1 UNION ALL SELECT b, p_brand, 2, p_type, count(*) FROM p GROUP BY b, p_brand, p_type
    UNION ALL SELECT c, p_name, 3, b, count(*) FROM p GROUP BY c, p_name, b""",
)
def concept_paths(spark: SparkSession, sf: str) -> DataFrame:
    leaves = table(spark, sf, "part").select("p_type", "p_brand", "p_name").distinct()
    return ingest.path_prefixes(leaves.select(F.array("p_type", "p_brand", "p_name").alias("segments")))


@R.add(
    "canonical_identity",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'inspire' WHEN o_orderkey % 4 = 1 THEN 'arxiv' WHEN o_orderkey % 4 = 2 THEN 'doi' ELSE 'local' END AS source,
      CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey::VARCHAR WHEN o_orderkey % 4 = 1 THEN 'arXiv:' || o_orderkey WHEN o_orderkey % 4 = 2 THEN lower('10.1000/' || c_name) ELSE 'local:' || sha256(c_name || '|' || year(o_orderdate)) END AS canonical_id
      FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def canonical_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.pmod("o_orderkey", F.lit(4))
    identity = ingest.canonical_identity(
        F.when(k == 0, F.col("o_orderkey").cast("string")), F.when(k == 1, F.concat(F.lit("arXiv:"), F.col("o_orderkey").cast("string"))), F.when(k == 2, F.concat(F.lit("10.1000/"), F.col("c_name"))), F.col("c_name"), F.year("o_orderdate")
    )
    return rows.select("o_orderkey", identity.alias("i")).select("o_orderkey", "i.source", "i.canonical_id")


@R.add("upsert_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.keep_latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@R.add("insert_or_ignore_first", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def insert_or_ignore_first(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.keep_first(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@R.add(
    "ordered_text_agg",
    """WITH f AS (SELECT l_orderkey, s_name, min(l_linenumber) AS pos FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT l_orderkey, '|' || string_agg(s_name, '|' ORDER BY pos, s_name) || '|' AS names FROM f GROUP BY 1""",
)
def ordered_text_agg(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return ingest.ordered_text(rows, "l_orderkey", "l_linenumber", "s_name").withColumnRenamed("text", "names")


@R.add(
    "child_rewrite",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_returnflag <> 'R'""",
)
def child_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """The children of touched parents are replaced by new ones."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    touched = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = items.where("l_returnflag <> 'R'").join(touched, "l_orderkey", "left_semi").withColumn("l_quantity", F.col("l_quantity") * 2)
    return ingest.rewrite_children(items, new, touched, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@R.add("synthetic_works", "SELECT i AS work, 9000000 + i AS control_number, 2016 + i % 9 AS year, '26' || lpad((i % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad(i::VARCHAR, 5, '0') AS arxiv, CASE i % 3 WHEN 0 THEN 'CMS' WHEN 1 THEN 'ATLAS' ELSE 'LHCb' END AS collaboration FROM range(10000) t(i)")
def synthetic_works(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.synthetic_works(spark, 10_000).select("work", "control_number", "year", "arxiv", "collaboration")
