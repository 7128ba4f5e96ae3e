"""The paged source: links, limits, failed fetches, shards without pages, and a stream that goes on where it stopped."""

import json
import os
import time
from pathlib import Path

import pytest

from quarry.operators.shared import new_path
from quarry.sources import paged


def landed(folder, shard, n, size, links=True):
    """Pages of n records in a folder, as a source would answer."""
    pages = max(1, -(-n // size))
    for p in range(1, pages + 1):
        records = [{"id": f"{shard}-{i}"} for i in range((p - 1) * size, min(n, p * size))]
        body = {"hits": {"total": n, "hits": records}, "links": {"next": f"{folder}/{shard}/{p + 1}"} if links and p < pages else {}}
        path = Path(folder, shard, str(p))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(body))


def flaky(address):
    """Fails the first time that a page is asked for."""
    mark = Path(f"{address}.tried")
    if not mark.exists():
        mark.touch()
        raise OSError("no answer")
    return Path(address).read_text()


def plan(folder, shards, **more):
    return paged.Plan(tuple((s, f"{folder}/{s}") for s in shards), fetch=flaky, address=lambda url, page, size: f"{url}/{page}", pause=0.01, **more)


def ids(df):
    return sorted(json.loads(r.value)["id"] for r in df.collect())


def test_shards_are_read_by_their_links(spark, tmp_path):
    landed(tmp_path, "a", 7, 3)
    landed(tmp_path, "b", 0, 3)
    landed(tmp_path, "c", 4, 3)
    df = paged.pages(spark, plan(tmp_path, "abc", size=3), "linked")
    assert ids(df) == sorted([f"a-{i}" for i in range(7)] + [f"c-{i}" for i in range(4)])
    assert df.rdd.getNumPartitions() == 3
    assert {(r.shard, r.page, r.position) for r in df.where("shard = 'a'").collect()} == {("a", 1 + i // 3, i % 3) for i in range(7)}


def test_limit_of_a_shard(spark, tmp_path):
    landed(tmp_path, "a", 9, 3)
    assert ids(paged.pages(spark, plan(tmp_path, "a", size=3, limit=5), "limited")) == [f"a-{i}" for i in range(5)]
    assert not os.path.exists(tmp_path / "a" / "3.tried")  # the third page was not asked for


def test_what_cannot_be_fetched(spark, tmp_path):
    with pytest.raises(Exception, match="no answer|No such file"):
        paged.pages(spark, plan(tmp_path, "z", tries=2), "missing").collect()
    Path(tmp_path, "y").mkdir()
    Path(tmp_path, "y", "1").write_text("[1, 2]")
    assert ids(paged.pages(spark, plan(tmp_path, "y"), "odd")) == []


def test_address_and_size():
    assert paged.numbered("https://x/api?q=a", 2, 25) == "https://x/api?q=a&size=25&page=2"
    assert paged.numbered("https://x/api", 1, 5) == "https://x/api?size=5&page=1"


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    landed(tmp_path, "a", 11, 2)
    landed(tmp_path, "b", 3, 2)
    out, checkpoint = new_path(spark, "paged"), new_path(spark, "checkpoint")

    def run(name):
        rows = paged.page_stream(spark, plan(tmp_path, "ab", size=2, pages_a_batch=2), name)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        for _ in range(200):
            time.sleep(0.1)
            if query.lastProgress and query.lastProgress["numInputRows"] == 0 or query.exception():
                break
        query.stop()
        assert query.exception() is None

    run("streamed")
    assert ids(spark.read.parquet(out)) == sorted([f"a-{i}" for i in range(11)] + [f"b-{i}" for i in range(3)])
    landed(tmp_path, "b", 8, 2)  # the source has grown at its end (page 2 was not full and is not read again)
    run("streamed")
    got = ids(spark.read.parquet(out))
    assert len(got) == len(set(got)) and set(got) >= {"b-4", "b-5", "b-6", "b-7"}
