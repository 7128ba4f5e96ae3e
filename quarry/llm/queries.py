"""The queries of the training-data operators, over the whole ``documents``, ``pages`` and ``conversations`` tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from quarry.llm import circulant_minhash, context_mixing, conversation_repair, html_layout, knn_quality, langid, packing, pii, quality_rules, scaled_sketch, spelling, token_file, unigram
from quarry.llm.common import crc_mod, documents, materialize

#: The public vocabularies of the queries; operators take a path.
WORD_BPE, BYTE_BPE, PIECE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
#: The id that ends a document in the token file.
END_ID = 2


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through the rANS token file: written, read back, digested."""
    path = token_file.new_path(spark)
    token_file.write(documents(spark, sf_dir), path, WORD_BPE, "words", END_ID)
    return token_file.read(spark, path, digest=True)


def op2_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its labelled neighbours, learned outside the held-out fifth."""
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod("doc_id", 5) == 0
    model = knn_quality.fit(docs, labels, ~held_out)
    return knn_quality.score(docs, model, keep_text=False).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned outside the held-out tenth."""
    return context_mixing.score_documents(documents(spark, sf_dir), crc_mod("doc_id", 10) == 0)


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85 and more."""
    return circulant_minhash.near_duplicates(documents(spark, sf_dir), 3, 85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out quarter."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 ids, digested."""
    pieces = packing.pack_documents(documents(spark, sf_dir), BYTE_BPE, "spaced", 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, as it is laid out."""
    return html_layout.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules on every document."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    measured = materialize(quality_rules.with_statistics(docs, keep_text=False), "op8-statistics")
    found = quality_rules.judge(measured, quality_rules.thresholds(measured))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
tok AS (SELECT rid, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d)),
win AS (SELECT *, list(w) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g, lag(w) OVER (PARTITION BY rid ORDER BY pos) AS prev FROM tok),
rep AS (SELECT *, len(g) = 8 AND count(*) OVER (PARTITION BY rid, g) > 1 AS again FROM win),
cov AS (SELECT *, bool_or(again) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM rep),
per_doc AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE hit) AS n_repeat_words, count(*) FILTER (WHERE w = prev) AS n_adjacent FROM cov GROUP BY rid),
line AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, coalesce(n_adjacent, 0) AS n_adjacent,
    length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters, length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper
  FROM d LEFT JOIN per_doc USING (rid) JOIN line USING (rid)),
v AS (
  SELECT *, unnest(['symbol_rate', 'upper_rate', 'adjacent_rate', 'dup_line_rate', 'word_length', 'letter_rate']) AS stat, unnest([10, 5, 5, 50, 3, 10]) AS grain,
    unnest([true, true, true, true, true, false]) AS has_max, unnest([false, false, false, false, true, true]) AS has_min,
    unnest([CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END, CASE WHEN n_letters > 0 THEN 1000 * n_upper // n_letters ELSE 0 END,
      CASE WHEN n_words > 0 THEN 1000 * n_adjacent // n_words ELSE 0 END, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END,
      CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END, CASE WHEN word_chars > 0 THEN 1000 * n_letters // word_chars ELSE 0 END])::BIGINT AS v FROM m),
c AS (SELECT lang, source, stat, grain, (v >> greatest(length(bin(v)) - 7, 0)::BIGINT) << greatest(length(bin(v)) - 7, 0)::BIGINT AS value, count(*) AS n FROM v GROUP BY ALL),
lev AS (
  SELECT 0 AS level, lang, source, stat, grain, value, n FROM c
  UNION ALL SELECT 1, lang, NULL, stat, grain, value, sum(n) FROM c GROUP BY lang, stat, grain, value
  UNION ALL SELECT 2, NULL, NULL, stat, grain, value, sum(n) FROM c GROUP BY stat, grain, value),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, stat ORDER BY value) AS seen, sum(n) OVER (PARTITION BY level, lang, source, stat) AS docs FROM lev),
q AS (
  SELECT level, lang, source, stat, max(grain) AS grain, max(docs) AS docs,
    min(value) FILTER (WHERE 10 * seen >= docs) AS low, min(value) FILTER (WHERE 10 * seen >= 5 * docs) AS middle, min(value) FILTER (WHERE 10 * seen >= 9 * docs) AS high
  FROM run GROUP BY level, lang, source, stat),
f AS (SELECT *, high + 6 * greatest(high - middle, grain) AS most, low - 6 * greatest(middle - low, grain) AS least FROM q),
ok AS (
  SELECT v.doc_id, bool_and((NOT has_max OR v.v <= CASE WHEN o.docs >= 200 THEN o.most WHEN l.docs >= 200 THEN l.most ELSE w.most END)
    AND (NOT has_min OR v.v >= CASE WHEN o.docs >= 200 THEN o.least WHEN l.docs >= 200 THEN l.least ELSE w.least END)) AS inside
  FROM v JOIN f o ON o.level = 0 AND o.stat = v.stat AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source
  JOIN f l ON l.level = 1 AND l.stat = v.stat AND l.lang IS NOT DISTINCT FROM v.lang JOIN f w ON w.level = 2 AND w.stat = v.stat GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND inside AS kept
FROM m JOIN ok USING (doc_id)
"""

def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return scaled_sketch.with_neighbours(documents(spark, sf_dir))


def op10_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to its text."""
    return unigram.round_trip(documents(spark, sf_dir), PIECE_BPE)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired, digested."""
    turns = conversation_repair.turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.digests(conversation_repair.repair(conversation_repair.damaged(turns)))


OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
src AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
byte AS (SELECT rid, unnest(range(1, length(name) + 1)) AS i, name FROM src),
k AS (SELECT rid, xor(list_reduce(list(ascii(name[i])::BIGINT ORDER BY i), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS kind FROM byte, crc GROUP BY rid, t),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src JOIN k USING (rid) WHERE kind <> 0),
num AS (
  SELECT *, row_number() OVER o AS i, lag(role[1:1]) OVER o || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM dam WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
flag AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM num),
step AS (SELECT conv_id, i, role[1:1] AS r, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM flag),
p AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS e, NULL::STRUCT(c BIGINT, a VARCHAR) AS s, {'c': 5::BIGINT, 'a': 'I'} AS u, {'c': 10::BIGINT, 'a': 'II'} AS a FROM src
  UNION ALL
  SELECT conv_id, i, e, s, u, list_min([a, {'c': u.c + 5, 'a': u.a || 'I'}]) FROM (
    SELECT conv_id, i, e, s, list_min([u, {'c': e.c + 5, 'a': e.a || 'I'}, CASE WHEN s IS NOT NULL THEN {'c': s.c + 5, 'a': s.a || 'I'} END, {'c': a.c + 5, 'a': a.a || 'I'}]) AS u, a FROM (
      SELECT p.conv_id, step.i, {'c': e.c + 2, 'a': e.a || 'D'} AS e,
        list_min([CASE WHEN s IS NOT NULL THEN {'c': s.c + 2, 'a': s.a || 'D'} END, CASE WHEN NOT gone AND r = 's' THEN {'c': e.c + extra, 'a': e.a || 'K'} END]) AS s,
        list_min([{'c': u.c + 2, 'a': u.a || 'D'}, CASE WHEN NOT gone THEN {'c': list_min([e, s, a]).c + extra + (r <> 'u')::INT, 'a': list_min([e, s, a]).a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END} END]) AS u,
        list_min([{'c': a.c + 2, 'a': a.a || 'D'}, CASE WHEN NOT gone THEN {'c': u.c + extra + (r <> 'a')::INT, 'a': u.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END} END]) AS a
      FROM p JOIN step ON step.conv_id IS NOT DISTINCT FROM p.conv_id AND step.i = p.i + 1))),
best AS (SELECT conv_id, list_min([arg_max(e, i), arg_max(a, i)]) AS b FROM p GROUP BY conv_id),
ed AS (SELECT conv_id, unnest(range(1, length(b.a) + 1)) AS j, b.a AS audit FROM best),
pos AS (SELECT conv_id, j, audit[j] AS edit, length(replace(audit[1:j], 'I', '')) AS i, length(replace(audit[1:j], 'D', '')) AS o FROM ed),
line AS (
  SELECT pos.conv_id, pos.j, edit, role, text, o - max(CASE WHEN edit = 'K' AND role[1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY pos.conv_id) AS o
  FROM pos LEFT JOIN flag ON flag.conv_id IS NOT DISTINCT FROM pos.conv_id AND flag.i = pos.i),
text AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN o % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t FROM line WHERE edit <> 'D' GROUP BY conv_id),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM flag GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM best LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM best.conv_id
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the words near them, their forms and roots."""
    return spelling.group_variants(documents(spark, sf_dir))


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
r AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS name, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(name, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (
  SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest
  UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest),
f AS (
  SELECT x, count(*) AS n_near, arg_min(y, {'n': -n, 'y': y}) AS y, max(n) AS m FROM (SELECT x, y, v.n FROM e JOIN v ON v.word = e.y) GROUP BY x),
g AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN y END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN f ON x = word),
z(word, root, form) AS (SELECT word, word, form FROM g UNION ALL SELECT z.word, g.word, g.form FROM z JOIN g ON g.word = z.form)
SELECT g.word, g.form, z.root, n, n_near, form_n FROM g JOIN z ON z.word = g.word AND z.form IS NULL
"""


def op13_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: by strict patterns, and by contexts learned from what they find."""
    return pii.digests(pii.find(documents(spark, sf_dir)))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(i, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.i, l.j FROM r JOIN l ON l.i = r.c),
m AS (SELECT i AS doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_file": op1_token_file,
    "op2_knn_quality": op2_knn_quality,
    "op3_context_mixing": op3_context_mixing,
    "op4_circulant_minhash": op4_circulant_minhash,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_html_layout": op7_html_layout,
    "op8_quality_rules": op8_quality_rules,
    "op9_scaled_sketch": op9_scaled_sketch,
    "op10_unigram": op10_unigram,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_contextual_pii": op13_contextual_pii,
}

#: DuckDB's SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op4_circulant_minhash": OP4_SQL, "op8_quality_rules": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op12_spelling_variants": OP12_SQL}
