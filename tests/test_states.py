"""Logs of transitions against plain loops, merges that may be repeated, and the stream of jobs against the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, states
from quarry.operators.shared import new_path
from quarry.streaming import jobs as stream

EVENTS = ["registered", "submitted", "materialized", "failed", "nonsense"]


def made_up(n, keys, seed):
    pick = random.Random(seed)
    return [(pick.randrange(keys) if pick.random() < 0.6 else 0, i, pick.choice(EVENTS)) for i in range(n)]


def walked(rows, machine):
    now, out = {}, {}
    for k, seq, e in sorted(rows, key=lambda r: (r[0], r[1])):
        before = now.get(k, "")
        now[k] = machine.get((before, e), before)
        out[k, seq] = (before, now[k], (before, e) in machine)
    return now, out


@pytest.mark.parametrize("block", [1024, 7, 2])
def test_history_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(states, "BLOCK", block)
    rows = made_up(300, 9, block)
    log = states.history(spark.createDataFrame(rows, "doc long, seq long, event string"), states.PARSE, "doc", "event", ["seq"])
    now, want = walked(rows, states.PARSE)
    assert {(r.doc, r.seq): (r.before, r.after, r.allowed) for r in log.collect()} == want
    assert {r.doc: r.state for r in states.current(log, "doc").collect()} == now


def test_merges_may_be_repeated(spark):
    schema = "doc long, seq long, event string"
    rows = made_up(120, 6, 4)
    known = spark.createDataFrame([], "doc long, state string, last struct<seq: bigint>")
    refused = []
    for a in (0, 40, 40, 80, 0):
        known, bad = states.merged(known, spark.createDataFrame(rows[a : a + 40], schema), states.PARSE, "doc", "event", ["seq"])
        known = spark.createDataFrame(known.collect(), known.schema)
        refused += [(r.doc, r.seq) for r in bad.collect()]
    now, want = walked(rows, states.PARSE)
    assert {r.doc: r.state for r in known.collect()} == now
    assert sorted(refused) == sorted(k for k, (_, _, ok) in want.items() if not ok)


def test_empty_log(spark):
    assert states.history(spark.createDataFrame([], "doc long, seq long, event string"), states.RUN, "doc", "event", ["seq"]).count() == 0


def test_a_stream_of_jobs_that_is_restarted(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kinds = F.create_map(*(F.lit(x) for kv in {"signup": "submit", "view": "progress", "click": "progress", "purchase": "success", "error": "failure"}.items() for x in kv))
    rows = events.select(F.col("user_id").alias("job"), "event_id", "ts", kinds[F.col("event_type")].alias("event"))
    ordered = rows.orderBy("ts", "event_id").collect()
    source, log, checkpoint = (new_path(spark, x) for x in ("arrived", "log", "checkpoint"))
    for a in range(0, len(ordered), 400):
        spark.createDataFrame(ordered[a : a + 400], rows.schema).coalesce(1).write.mode("append").parquet(source)
        query = stream.follow(spark, spark.readStream.schema(rows.schema).parquet(source), log, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
    columns = ["job", "seq", "event_id", "ts", "event", "status", "ended"]
    got = sorted(map(tuple, stream.read(spark, log).select(*columns).collect()))
    assert got == sorted(map(tuple, stream.followed(rows).select(*columns).collect())) and len(got) == len(ordered)
    whole = stream.read(spark, log)
    job = ordered[0].job
    assert [r.seq for r in stream.tail(whole, job, 2).collect()] == list(range(3, whole.where(F.col("job") == job).count() + 1))
    assert stream.pruned(whole, 3).groupBy("job").count().where("count > 3").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_updated_pairs_are_as_rebuilt(spark, seed):
    pick = random.Random(seed)
    pairs = {(pick.randrange(25), 0 if pick.random() < 0.2 else pick.randrange(30)) for _ in range(220)}
    gone = set(pick.sample(sorted(pairs), 15))
    come = {(pick.randrange(30), pick.randrange(32)) for _ in range(15)} - pairs
    frame = lambda rows: spark.createDataFrame(sorted(rows), "w long, ref long")
    now = (pairs - gone) | come
    found = graph.updated_pairs(graph.shared_pairs(frame(pairs), "w", "ref"), frame(now), frame(gone | come), "w", "ref")
    rows = lambda df: sorted((r.src, r.dst, r.shared, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(graph.shared_pairs(frame(now), "w", "ref"))
