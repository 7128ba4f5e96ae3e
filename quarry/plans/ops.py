"""Maintenance, jobs, audits, serving shells and benchmark queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import contracts, effects, jobs, lexical, states
from quarry.plans.registry import Registry
from quarry.plans.retrieval import _RANK, _TOKENS, WORDS, _bm25, text_index
from quarry.sources.tables import table
from quarry.streaming import jobs as job_stream

R = Registry()
LANES = ["click", "error", "purchase", "refund", "signup", "sync", "view"]
_LANES = "(SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'sync', 'view']) AS lane)"
_DIRTY = "dirty AS (SELECT event_type AS lane, user_id AS object_id, max(ts) AS updated_at, arg_max(event_id, (ts, event_id)) AS reason FROM events GROUP BY 1, 2)"


@R.add("dirty_lane_counts", f"WITH {_DIRTY} SELECT lane, count(object_id) AS n FROM {_LANES} LEFT JOIN dirty USING (lane) GROUP BY 1")
def dirty_lane_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.lane_counts(jobs.dirty(table(spark, sf, "events")), LANES)


@R.add("dirty_select", f"WITH {_DIRTY} SELECT lane, object_id, reason FROM dirty WHERE lane = 'error' AND updated_at >= TIMESTAMP '2024-01-25 00:00:00'")
def dirty_select(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.dirty(table(spark, sf, "events")).where("lane = 'error' and updated_at >= timestamp'2024-01-25 00:00:00'").select("lane", "object_id", "reason")


@R.add(
    "dirty_clear",
    f"WITH {_DIRTY} SELECT lane, object_id FROM dirty WHERE NOT (lane = 'view' AND object_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 10))",
)
def dirty_clear(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    done = events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("object_id")).count().where("count >= 10").select("object_id", F.lit("view").alias("lane"))
    return jobs.dirty(events).select("lane", "object_id").join(done, ["lane", "object_id"], "left_anti")


@R.add("job_latest_status", "SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY 1")
def job_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_event"))


@R.add("event_tail", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 AND user_id = 8")
def event_tail(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.tail(table(spark, sf, "events"), 8, 500).select("event_id", "user_id", "event_type")


@R.add("event_prune", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def event_prune(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.prune(table(spark, sf, "events"), 20).select("event_id", "user_id")


@R.add("latency_summary", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = jobs.exact_quantiles(table(spark, sf, "events"), "event_type", "value", [0.5, 0.95])
    return found.select("event_type", "n", F.round("q_0", 6).alias("p50"), F.round("q_1", 6).alias("p95"))


@R.add("scope_filter", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    scope = nation.join(region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer").join(scope, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@R.add("collection_counts", "SELECT n_name, count(c_custkey) AS works FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM customer")
def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Members of every collection, empty ones too, and of the whole."""
    members = table(spark, sf, "customer")
    own = table(spark, sf, "nation").join(members, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("works"))
    return own.unionByName(members.agg(F.count(F.lit(1)).alias("works")).select(F.lit("all").alias("n_name"), "works"))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@R.add("workspace_snapshot", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def workspace_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    frames = [table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@R.add("role_counts", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS convs, count(*) FILTER (WHERE length(text) > 200) AS long_turns FROM conversations GROUP BY 1")
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("convs"), F.count_if(F.length("text") > 200).alias("long_turns"))


_NOISE = {"double_punct": "(,[ ]*,)|,,", "frac_literal": r"\bfrac\b", "markup": "</?[a-z]+>", "symbol_run": r"[#*$%&]{3,}"}
_COUNTS = ", ".join(f"(regexp_matches(coalesce(text, ''), '{p}'))::INT AS {k}" for k, p in _NOISE.items())


@R.add(
    "document_audit",
    f"""WITH x AS (SELECT source, {_COUNTS} FROM documents), s AS (SELECT source, count(*) AS documents, {', '.join(f'sum({k})::BIGINT AS {k}' for k in _NOISE)} FROM x GROUP BY 1)
    SELECT *, (double_punct + frac_literal + markup + symbol_run) <= 1 AS ready, CASE WHEN symbol_run > documents // 20 THEN 'reparse' WHEN markup > 0 THEN 'strip_markup' ELSE 'none' END AS recommendation FROM s""",
)
def document_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Noise patterns by source, whether it is ready, and what to do first."""
    body = F.coalesce("text", F.lit(""))
    s = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), *(F.count_if(body.rlike(p)).alias(k) for k, p in _NOISE.items()))
    what = F.when(F.col("symbol_run") > F.expr("documents div 20"), "reparse").when(F.col("markup") > 0, "strip_markup").otherwise("none")
    return s.withColumn("ready", F.expr(" + ".join(_NOISE)) <= 1).withColumn("recommendation", what)


@R.add(
    "evidence_registry",
    """WITH f AS (SELECT role AS lane, conv_id AS key, min(turn * 1000000 + conv_id) AS pos, count(*) AS occurrences FROM conversations GROUP BY 1, 2)
    SELECT lane, key, occurrences, upper(substr(lane, 1, 1)) || dense_rank() OVER (PARTITION BY lane ORDER BY pos) AS ref FROM f""",
)
def evidence_registry(spark: SparkSession, sf: str) -> DataFrame:
    """References per lane in order of first registration; repeats are counted."""
    c = table(spark, sf, "conversations").select(F.col("role").alias("lane"), F.col("conv_id").alias("key"), (F.col("turn") * 1_000_000 + F.col("conv_id")).alias("pos"))
    return jobs.evidence(c)


_SHELL = f"""s AS ({_bm25(WORDS)}), b AS (SELECT doc_id, round(score, 6) AS score, {_RANK} AS rank FROM s QUALIFY rank <= 10)"""


@R.add("idea_rank", f"WITH {_TOKENS}, {_SHELL} SELECT doc_id, round(least(1.0, 0.45 + 0.5 * score / (1 + score)), 3)::DOUBLE AS idea_score, rank FROM b")
def idea_rank(spark: SparkSession, sf: str) -> DataFrame:
    best = lexical.bm25_topk(text_index(spark, sf), WORDS, 10)
    return best.select("doc_id", F.round(F.least(F.lit(1.0), 0.45 + 0.5 * F.col("score") / (1 + F.col("score"))), 3).alias("idea_score"), "rank")


@R.add(
    "retrieval_shell",
    f"""WITH {_TOKENS}, {_SHELL} SELECT 'evidence_bundle' AS object_type, 'work:' || doc_id AS object_id, 'ready' AS status, 'ranked' AS derivation, rank, 'E' || rank AS ref FROM b""",
)
def retrieval_shell(spark: SparkSession, sf: str) -> DataFrame:
    best = lexical.bm25_topk(text_index(spark, sf), WORDS, 10)
    return best.select(
        F.lit("evidence_bundle").alias("object_type"), F.concat(F.lit("work:"), F.col("doc_id").cast("string")).alias("object_id"), F.lit("ready").alias("status"), F.lit("ranked").alias("derivation"), "rank", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("ref")
    )


@R.add(
    "contract_validate",
    """WITH v AS (SELECT event_id, list_filter([CASE WHEN event_type NOT IN ('view', 'click', 'signup') THEN 'bad_status' END, CASE WHEN value / 50 > 1 THEN 'confidence_range' END, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing_key' END], lambda x: x IS NOT NULL) AS bad FROM events)
    SELECT array_to_string(bad, ',') AS violations, count(*) AS n FROM v WHERE len(bad) > 0 GROUP BY 1""",
)
def contract_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of the typed contract, as listed: status, confidence between 0 and 1, a key in the payload."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("status"), (F.col("value") / 50).alias("confidence"), F.get_json_object("props", "$.k").alias("key"))
    bad = jobs.violations(rows, ["view", "click", "signup"])
    return bad.where("size(bad) > 0").groupBy(F.array_join("bad", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@R.add("event_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows over the event table; ``quarry.streaming`` runs the same aggregation on a stream with a watermark."""
    from quarry.streaming.windows import windowed

    return windowed(table(spark, sf, "events"), "1 day")


@R.add("safe_keys", r"SELECT doc_id, lower(regexp_replace(regexp_replace(substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS key FROM documents")
def safe_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.safe_key(T.title(F.col("text"))).alias("key"))


# ---- logs of transitions: users' events as jobs

_EVENTS = {"signup": "submit", "view": "progress", "click": "progress", "purchase": "success", "error": "failure"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _EVENTS.items()) + " END"
_JOB_SQL = f"""e AS (SELECT user_id AS job, event_id, ts, {_CASE} AS event FROM events),
  n AS (SELECT *, row_number() OVER o AS seq, count(*) FILTER (WHERE event = 'submit') OVER o AS part FROM e WINDOW o AS (PARTITION BY job ORDER BY ts, event_id)),
  f AS (SELECT *, first_value(CASE event WHEN 'success' THEN 'succeeded' WHEN 'failure' THEN 'failed' END IGNORE NULLS) OVER p AS done, bool_or(event = 'progress') OVER p AS moved
    FROM n WINDOW p AS (PARTITION BY job, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  l AS (SELECT job, seq, event_id, ts, event, CASE WHEN done IS NOT NULL THEN done WHEN moved THEN 'running' ELSE 'queued' END AS status FROM f)"""


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in _EVENTS.items() for x in kv))
    return table(spark, sf, "events").select(F.col("user_id").alias("job"), "event_id", "ts", names[F.col("event_type")].alias("event"))


@R.add("job_log", f"WITH {_JOB_SQL} SELECT job, seq, event_id, event, status, status IN ('succeeded', 'failed') AS ended FROM l")
def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every job's events with their numbers and the status after each: what the stream of jobs writes."""
    return job_stream.followed(job_events(spark, sf)).drop("ts")


@R.add(
    "job_snapshot",
    f"""WITH {_JOB_SQL}, s AS (SELECT job, arg_max(status, seq) AS status, count(*) AS events, max(seq) AS last_seq, max(ts) FILTER (WHERE event = 'submit') AS submitted_at, arg_max(ts, seq) AS updated_at, arg_max(ts, seq) FILTER (WHERE event IN ('success', 'failure')) AS f FROM l GROUP BY 1)
    SELECT job, status, events, last_seq, submitted_at, updated_at, CASE WHEN status IN ('succeeded', 'failed') THEN f END AS finished_at FROM s""",
)
def job_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return job_stream.snapshot(job_stream.followed(job_events(spark, sf)))


#: Users' events as states of a parsed document: most orders of them are not allowed.
_PARSE = {"signup": "registered", "view": "submitted", "click": "submitted", "purchase": "materialized", "error": "failed"}
_PARSE_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _PARSE.items()) + " END"
_LEGAL = ", ".join(f"('{s}', '{e}', '{t}')" for (s, e), t in states.PARSE.items())


@R.add(
    "parse_states",
    f"""WITH RECURSIVE m(s, e, t) AS (VALUES {_LEGAL}), x AS (SELECT user_id AS doc, event_id, {_PARSE_CASE} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
    r(doc, place, before, after, event, event_id, allowed) AS (
      SELECT x.doc, x.place, '', coalesce(m.t, ''), x.event, x.event_id, m.t IS NOT NULL FROM x LEFT JOIN m ON m.s = '' AND m.e = x.event WHERE x.place = 1
      UNION ALL SELECT x.doc, x.place, r.after, coalesce(m.t, r.after), x.event, x.event_id, m.t IS NOT NULL FROM r JOIN x ON x.doc = r.doc AND x.place = r.place + 1 LEFT JOIN m ON m.s = r.after AND m.e = x.event)
    SELECT doc, place, event_id, event, before, after, allowed FROM r""",
)
def parse_states(spark: SparkSession, sf: str) -> DataFrame:
    """Every transition of every document: allowed or refused, and the states around it."""
    names = F.create_map(*(F.lit(x) for kv in _PARSE.items() for x in kv))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("doc"), "event_id", "ts", names[F.col("event_type")].alias("event"))
    return states.history(rows, states.PARSE, "doc", "event", ["ts", "event_id"]).drop("ts")


# ---- contracts and effects


@R.add(
    "contract_violations",
    """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey + 10 * l_linenumber AS evidence, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey END AS work, l_quantity / 48 AS confidence, l_linestatus || l_returnflag AS status FROM lineitem)
    SELECT 'lost_evidence' AS rule, id::VARCHAR AS subject, evidence::VARCHAR AS detail FROM s WHERE evidence NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'untraced', id::VARCHAR, coalesce(work::VARCHAR, 'none') FROM s WHERE work IS NULL OR work NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    UNION ALL SELECT 'confidence', id::VARCHAR, NULL FROM s WHERE confidence > 1 UNION ALL SELECT 'status', id::VARCHAR, status FROM s WHERE status NOT IN ('FA', 'FR', 'ON')
    UNION ALL SELECT 'repeated', id::VARCHAR, count(*)::VARCHAR FROM s GROUP BY id HAVING count(*) > 1""",
)
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What a contract rules out: objects without evidence or work, values out of bounds, unknown states, repeated keys."""
    items = table(spark, sf, "lineitem")
    s = items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") + 10 * F.col("l_linenumber")).alias("evidence"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("work"),
        (F.col("l_quantity") / 48).alias("confidence"), F.concat("l_linestatus", "l_returnflag").alias("status"),
    )
    rules = [
        contracts.dangling(s, "id", "evidence", table(spark, sf, "part"), "p_partkey", "lost_evidence"), contracts.dangling(s, "id", "work", table(spark, sf, "supplier").where("s_acctbal > 0"), "s_suppkey", "untraced"),
        contracts.outside(s, "id", "confidence", 0.0, 1.0, "confidence").withColumn("detail", F.lit(None).cast("string")), contracts.unknown(s, "id", "status", ("FA", "FR", "ON"), "status"), contracts.repeated(s, "id", "repeated"),
    ]
    return contracts.violations(rules)


@R.add(
    "coalesced_objects",
    """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part, l_returnflag AS flag, l_linenumber AS line FROM lineitem)
    SELECT sha256(to_json({'flag': flag, 'line': line, 'part': part})) AS digest, part, flag, line, min(id) AS first, count(*) AS occurrences FROM x GROUP BY ALL""",
)
def coalesced_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Equal objects as one, named by the digest of what they say."""
    x = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"))
    return contracts.coalesced(x, "id", ["part", "flag", "line"])


_K = 3
_LISTS = f"""l AS (SELECT 'price' AS scenario, o_custkey AS query, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
    UNION ALL SELECT 'date', o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) FROM orders UNION ALL SELECT 'key', o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders),
  j AS (SELECT o_custkey AS query, o_orderkey AS item FROM orders WHERE o_orderpriority LIKE '1%'), n AS (SELECT query, count(*) AS n FROM j GROUP BY 1),
  h AS (SELECT scenario, query, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM l JOIN j USING (query, item) WHERE rank <= {_K} GROUP BY ALL),
  m AS (SELECT scenario, query, coalesce(hits, 0) / n AS recall, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, {_K}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(1 / first, 0) AS rr
    FROM n CROSS JOIN (VALUES ('price'), ('date'), ('key')) s(scenario) LEFT JOIN h USING (scenario, query))"""


def order_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders in three orders, measured by how early the urgent ones come."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderdate", "o_orderpriority")
    by = {"price": [F.col("o_totalprice").desc(), F.col("item")], "date": [F.col("o_orderdate").desc(), F.col("item")], "key": [F.col("item")]}
    lists = [o.select(F.lit(k).alias("scenario"), "query", "item", F.row_number().over(Window.partitionBy("query").orderBy(*v)).alias("rank")) for k, v in by.items()]
    return effects.measures(lists[0].unionByName(lists[1]).unionByName(lists[2]), o.where("o_orderpriority LIKE '1%'"), _K)


@R.add("effect_measures", f"WITH {_LISTS} SELECT scenario, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr FROM m GROUP BY 1")
def effect_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Recall, discounted gain and reciprocal rank of each scenario."""
    means = [F.round(F.avg(c), 6).alias(n) for c, n in (("recall", "recall"), ("ndcg", "ndcg"), ("rr", "mrr"))]
    return order_lists(spark, sf).groupBy("scenario").agg(F.count(F.lit(1)).alias("queries"), *means)


_COUNT = "CASE " + " ".join(f"WHEN u < {b!r} THEN {k}" for k, b in enumerate(effects.BOUNDS)) + f" ELSE {len(effects.BOUNDS)} END"


@R.add(
    "effect_intervals",
    f"""WITH {_LISTS}, d AS (SELECT a.scenario, a.query, a.ndcg AS x, a.ndcg - b.ndcg AS d FROM m a JOIN m b ON b.query = a.query AND b.scenario = 'key'),
    w AS (SELECT scenario, round, d, {_COUNT} AS w FROM (SELECT *, ('0x' || substr(md5(query || '-' || round), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM d CROSS JOIN range(1, {effects.ROUNDS + 1}) r(round))),
    e AS (SELECT scenario, round, sum(w * d) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0), p AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY m, round) AS r, count(*) OVER (PARTITION BY scenario) AS n FROM e),
    i AS (SELECT scenario, min(m) FILTER (WHERE r > 0.025 * n) AS low, max(m) FILTER (WHERE r <= 0.975 * n) AS high FROM p GROUP BY 1)
    SELECT scenario, count(*) AS queries, round(avg(x), 6) AS mean, round(avg(d), 6) AS difference, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM d JOIN i USING (scenario) GROUP BY 1""",
)
def effect_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Each scenario against one, with an interval over resampled queries."""
    found = effects.compared(order_lists(spark, sf), "key", "ndcg")
    return found.select("scenario", "queries", *(F.round(c, 6).alias(c) for c in ("mean", "difference", "low", "high")))


@R.add(
    "owner_labels",
    """WITH r AS (SELECT l_suppkey AS owner, p_name AS label, l_discount AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey), b AS (SELECT owner, lower(label) AS k, max(confidence) AS c, min(label) AS label FROM r GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY c DESC, k) AS n FROM b QUALIFY n <= 6) SELECT owner, string_agg(label, ';' ORDER BY n) AS labels FROM t GROUP BY 1""",
)
def owner_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The six surest labels of each owner."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("owner"), F.col("p_name").alias("label"), F.col("l_discount").alias("confidence"))
    return effects.labels_of(rows, 6).select("owner", F.array_join("labels", ";").alias("labels"))
