"""Spelling variants against neighbourhoods made by deleting, and the wavelet tree against plain loops."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import spelling
from quarry.llm.queries import ORACLES, QUERIES
from quarry.llm.wavelet import Wavelet
from tests.oracle import connect, rows_of_spark, rows_of_sql


def test_wavelet_tree_reports_what_lies_in_a_range():
    rng = np.random.default_rng(1)
    for n in (1, 2, 37, 300):
        values = rng.permutation(n)
        tree = Wavelet(values)
        q = rng.integers(0, n + 1, (4, 60))
        got = defaultdict(set)
        for i, v in zip(*(x.tolist() for x in tree.report(*q))):
            assert v not in got[i]
            got[i].add(v)
        for i, (a, b, low, high) in enumerate(q.T):
            assert got[i] == {v for v in values[a:b].tolist() if low <= v < high}


def is_near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    i = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def brute(counts):
    near = {w: [y for y in counts if is_near(w, y)] for w in counts}
    form = {}
    for w, ys in near.items():
        best = min(ys, key=lambda y: (-counts[y], y), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("group", [1 << 16, 8, 1])
def test_variants_of_random_words(spark, group):
    """Few letters make many near words, runs and ties; small groups make keys that are halved to the last place."""
    pick = random.Random(group)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(5, 9))) for _ in range(250)}
    words |= {"commonbeginning" + "".join(pick.choice("xyz") for _ in range(3)) for _ in range(20)}
    counts = {w: pick.choice([3, 5, 6, 12, 30, 100]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame, group).collect()}
    assert got == brute(counts)


def test_words_outside_the_first_plane(spark):
    counts = {"hello": 9, "hell🙂": 3, "hel": 4, "Āāāāā": 5, "āāāāā": 12}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame).collect()}
    assert got == brute(counts)


def test_vocabulary_of_odd_documents(spark, odd_docs):
    import re
    import zlib

    lower = {i: i + 32 for i in range(65, 91)}
    counts = Counter()
    for r in odd_docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", (r.text or "").translate(lower)):
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    got = {r.word: r.n for r in spelling.vocabulary(odd_docs).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 3}


def test_empty_and_null_documents(spark):
    for rows in ([], [(None, None), (1, ""), (2, None)]):
        assert spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    names, want = rows_of_sql(connect(folder), ORACLES["op12_spelling_variants"])
    found = QUERIES["op12_spelling_variants"](spark, folder)
    assert sorted(found.columns) == names and rows_of_spark(found) == want
