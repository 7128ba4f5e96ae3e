"""The inverted index: it finds what a scan finds, reads only what it must, and grows by segments."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions.query import MatchQuery
from quarry.operators import inverted, search
from quarry.operators.shared import new_path
from quarry.operators.versions import Store

WORDS = "ash birch cedar elm fir hazel oak pine rowan yew".split()
QUERIES = [MatchQuery(True, (("ash", "oak pine"), ("elm",))), MatchQuery(False, (("fir hazel", "yew"), ("birch oak elm",), ("nowhere",)))]


def made_up(n, seed):
    pick = random.Random(seed)
    text = lambda k: " ".join(pick.choice(WORDS[: 3 + pick.randrange(8)]) for _ in range(pick.randrange(k)))
    return [(i, pick.choice([None, text(6), ""]), text(30), 1990 + i % 7) for i in range(n)]


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame([*made_up(400, 1), (1000, "oak", "pine", 2000), (1001, None, None, None)], "work_id long, title string, abstract string, year int")


def built(rows):
    store = Store(rows.sparkSession, new_path(rows.sparkSession, "index"))
    inverted.write(store, "words", rows, "work_id", ["title", "abstract"], ["year"])
    return store, inverted.read(store, "words")


@pytest.fixture(scope="module")
def index(works):
    return built(works)[1]


def found(source):
    return [(r.work_id, round(r.score, 9), r.stage, r.rank) for r in search.search_works(source, QUERIES, 40).collect()]


def test_as_a_scan_finds(works, index):
    scanned = search.index(works, "work_id", ["title", "abstract"], ["year"])
    assert found(index) == found(scanned)
    assert len(found(index)) == 40


def test_counts_of_phrases(works, index):
    phrases = ["oak pine", "ash", "birch birch birch", "pine oak ash elm"]
    got = {r.work_id: r.tf for r in index.counted(phrases).collect() if any(r.tf)}
    want = {}
    for w in works.collect():
        tf = [sum(f[i : i + len(p)] == p for f in ((w.title or "").split(), (w.abstract or "").split()) for i in range(len(f))) for p in (x.split() for x in phrases)]
        if any(tf):
            want[w.work_id] = tf
    assert got == want
    assert 1000 not in {k for k, tf in got.items() if tf[0]}  # one field ends in oak, the next begins with pine


def test_only_the_words_folders_are_read(index, capsys):
    index.blocks(["oak", "elm"]).explain("formatted")
    plan = capsys.readouterr().out
    folders = re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(([\d,]+)\)", plan)
    assert set(map(int, folders[1].split(","))) == {inverted.bucket("oak"), inverted.bucket("elm")}
    assert re.search(r"PushedFilters: \[.*In\(word, \[elm,oak\]\)", plan)


def test_a_search_never_reads_the_texts(works, index):
    read = search.search_works(index, QUERIES, 5).inputFiles()
    assert read and all("bucket=" in f for f in read)


def test_segments_are_as_one_index(spark, works):
    first, later = works.where("work_id % 3 > 0"), works.where("work_id % 3 = 0")
    store, before = built(first)
    inverted.append(store, "words", later, ["title", "abstract"])
    after = inverted.read(store, "words")
    whole = built(works)[1]
    assert found(after) == found(whole) and (after.n, after.avgdl) == (whole.n, whole.avgdl)
    assert found(before) == found(built(first)[1])  # who has read a version keeps it
    with pytest.raises(ValueError):
        inverted.append(store, "words", later.limit(1), ["title", "abstract"])


def test_blocks_of_few_words(works, monkeypatch):
    monkeypatch.setattr(inverted, "WORDS", 50)
    index = built(works)[1]
    assert index.rows.where("word = 'oak'").count() > 20
    assert found(index) == found(search.index(works, "work_id", ["title", "abstract"], ["year"]))


def test_no_words_and_no_rows(spark, works):
    for rows in (works.where("work_id = 1001"), works.where("work_id < 0")):
        index = built(rows)[1]
        assert index.avgdl == 0.0 and found(index) == []
    assert search.search_works(index, [], 5).columns == ["work_id", "year", "score", "stage", "rank"]


def test_a_word_of_every_document_is_dealt(spark):
    """Postings of one word go to more than one file, in order."""
    rows = spark.range(5000).repartition(40).select(F.col("id").alias("work_id"), F.lit("oak").alias("title"), F.lit(None).cast("string").alias("abstract"), F.lit(1).alias("year"))
    index = built(rows)[1]
    assert len(index.blocks(["oak"]).inputFiles()) > 1
    assert index.postings(["oak"]).count() == index.frequencies(["oak", "elm"])["oak"] == 5000


def test_numbers_of_blocks_are_packed_and_read_again():
    import numpy as np

    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 1 << int(b), 40, dtype=np.uint64) for b in rng.integers(1, 63, 30)] + [np.array([0, 127, 128, (1 << 64) - 1], np.uint64)])
    starts = np.array([0, 5, 700, len(values) - 4])
    data, ends = inverted.packed(values, starts)
    got = [inverted.unpacked(data[a:b].tobytes()).tolist() for a, b in zip(ends, ends[1:])]
    assert got == [values[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(values)])]


def test_kept_columns_and_keys_of_all_kinds(spark):
    rows = [(-5, "oak pine", None, "x", -7), (1 << 60, "pine", None, None, None), (3, "oak oak", "elm", "y", 9), (None, "oak", None, "z", 1)]
    frame = spark.createDataFrame(rows, "work_id long, title string, abstract string, kind string, year int")
    store = Store(spark, new_path(spark, "index"))
    inverted.write(store, "words", frame, "work_id", ["title", "abstract"], ["kind", "year"])
    index = inverted.read(store, "words")
    got = sorted((r.word, r.work_id, r.kind, r.year, r.dl, r.tf, r.places) for r in index.postings(["oak", "pine", "elm"]).collect())
    assert got == [("elm", 3, "y", 9, 3, 1, [3]), ("oak", -5, "x", -7, 2, 1, [0]), ("oak", 3, "y", 9, 3, 2, [0, 1]), ("pine", -5, "x", -7, 2, 1, [1]), ("pine", 1 << 60, None, None, 1, 1, [0])]
    assert index.n == 3
    with pytest.raises(TypeError):
        inverted.blocks(frame, "title", ["abstract"])
