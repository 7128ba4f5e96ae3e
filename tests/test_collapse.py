"""Greedy collapse against the rule hit by hit."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import collapse

SCHEMA = "place long, arxiv string, doi string, year int, title_normal string, title_words array<string>, reports array<string>, collaboration_keys array<string>, stage int, signal boolean"


def one_by_one(places, pairs):
    families, out = [], {}
    for h in sorted(places):
        own = next((f for f in families if any((x, h) in pairs for x in f)), None)
        if own is None:
            families.append(own := [])
        own.append(h)
        out[h] = own[0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_families_by_rank(spark, seed):
    pick = random.Random(seed)
    places = list(range(1, 60))
    pairs = {(a, b) for a in places for b in places if a < b and pick.random() < 0.03} | {(a, a + 1) for a in range(40, 55)}
    hits = spark.createDataFrame([(p,) for p in places], "place long")
    found = collapse.families(hits, spark.createDataFrame(sorted(pairs), "early long, late long"))
    assert {r.place: r.family for r in found.collect()} == one_by_one(places, pairs)


def test_a_later_hit_joins_no_two_families(spark):
    """Components would make one family of 1, 2 and 3."""
    hits = spark.createDataFrame([(1, 5), (2, 9), (3, 7)], "place long, rich long")
    pairs = spark.createDataFrame([(1, 3), (2, 3)], "early long, late long")
    got = {(r.place, r.best, tuple(r.members)) for r in collapse.collapsed(hits, F.col("rich"), pairs).collect()}
    assert got == {(1, 3, (1,)), (2, 2, ())}


def alike(a, b):
    if a[1] and b[1]:
        return a[1].lower() == b[1].lower()
    if a[2] and b[2]:
        return a[2].lower() == b[2].lower()
    if a[3] is not None and b[3] is not None and abs(a[3] - b[3]) > 1:
        return False
    wa, wb = set(a[5]), set(b[5])
    if not a[4] or not b[4] or a[4] != b[4] and not (len(wa & wb) >= 6 and 100 * len(wa & wb) >= 92 * len(wa | wb)):
        return False
    if set(a[6]) & set(b[6]):
        return True
    high, low = (a, b) if a[8] > b[8] else (b, a)
    return bool(set(a[7]) & set(b[7])) and a[8] != b[8] and high[8] >= 3 and high[9] and not (low[9] and low[8] >= 4)


def test_which_hits_are_alike(spark):
    pick = random.Random(2)
    base = [f"w{i}" for i in range(13)]
    rows = []
    for p in range(1, 121):
        words = sorted(set(base[: pick.choice([12, 13])]) | ({pick.choice(["x", "y"])} if pick.random() < 0.3 else set()))
        words = words if pick.random() < 0.8 else ["a", "b"]
        maybe = lambda v, q=0.3: v if pick.random() < q else None
        rows.append((p, maybe(pick.choice(["A1", "a1", "a2"])), maybe(pick.choice(["d1", "D1", "d2"])), maybe(pick.choice([2000, 2001, 2003]), 0.8), " ".join(words) if pick.random() < 0.9 else "", words, [pick.choice(["r1", "r2", "r3"])] if pick.random() < 0.5 else [], [pick.choice(["cms", "atlas"])] if pick.random() < 0.7 else [], pick.choice([1, 2, 3, 4, 5]), pick.random() < 0.7))
    got = {(r.early, r.late) for r in collapse.like(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if alike(a, b)}
    assert collapse.like(spark.createDataFrame([], SCHEMA)).count() == 0
