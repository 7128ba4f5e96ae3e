"""The index of cells: exact against all vectors, recall of the nearest cells, pruned folders, scopes, odd vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cells
from quarry.operators.shared import new_path


def clustered(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered(900, 16, 3)
    x[700:] = x[5]  # a third of what is near one query is one vector
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.fixture(scope="module")
def index(spark, vectors):
    path = new_path(spark, "cells")
    assert cells.write(vectors[1], path)["vectors"] == 900
    return cells.Index(spark, path)


def brute(x, queries, k, allowed=None):
    score = np.round(x @ x.T, 9)
    out = {}
    for q in queries:
        ids = [i for i in range(len(x)) if i != q and (allowed is None or i in allowed)]
        out[q] = sorted(ids, key=lambda i: (-score[q, i], i))[:k]
    return out


def got(rows):
    out = {}
    for r in rows.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("block", [4096, 17])
def test_exact_search_is_exact(vectors, index, monkeypatch, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    x, frame = vectors
    assert got(index.search(frame.where("vec_id % 50 = 0"), 10, probes=2)) == brute(x, range(0, 900, 50), 10)


def test_scope_before_the_search(vectors, index):
    x, frame = vectors
    allowed = frame.where("vec_id % 7 = 3").select("vec_id")
    assert got(index.search(frame.where("vec_id % 50 = 0"), 5, allowed=allowed, probes=2)) == brute(x, range(0, 900, 50), 5, set(range(3, 900, 7)))


def test_recall_of_the_nearest_cells(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = new_path(spark, "cells")
    cells.write(frame, path)
    index, queries = cells.Index(spark, path), frame.where("vec_id % 50 = 0")
    near, exact = (got(index.search(queries, 10, exact=e)) for e in (False, True))
    recall = sum(len(set(near[q]) & set(ids)) for q, ids in exact.items()) / sum(map(len, exact.values()))
    assert recall >= 0.9, recall
    assert index.probes < len(index.centres)


def test_only_the_nearest_folders_are_read(vectors, index, capsys):
    rows = index.pruned(vectors[0][0].tolist(), 3)
    rows.explain("formatted")
    assert len(re.search(r"PartitionFilters: \[.*cell#\d+ IN \(([\d,]+)\)", capsys.readouterr().out)[1].split(",")) == 3
    assert rows.where("id = 0").count() == 1


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (None, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = new_path(spark, "cells")
    cells.write(frame, path)
    assert got(cells.Index(spark, path).search(frame.where("vec_id IS NOT NULL"), 3)) == {1: [4], 2: [1, 4], 4: [1]}
    path = new_path(spark, "cells")
    assert cells.write(frame.where("vec_id > 9"), path) == {"vectors": 0, "cells": 0}
    assert cells.Index(spark, path).search(frame.where(F.col("vec_id") == 1), 3).count() == 0
