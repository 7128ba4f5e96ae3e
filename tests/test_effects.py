"""Measures of ranked lists, their intervals, owners' labels and contracts, against plain loops."""

import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from quarry.operators import contracts, effects


def test_measures_of_lists(spark):
    ranked = [("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 1, 12, 3), ("b", 1, 12, 1), ("b", 1, 10, 2), ("a", 2, 20, 1)]
    judged = [(1, 10), (1, 12), (2, 99), (1, 10)]
    found = effects.measures(spark.createDataFrame(ranked, "scenario string, query long, item long, rank long"), spark.createDataFrame(judged, "query long, item long"), 2)
    got = {(r.scenario, r.query): (r.recall, round(r.ndcg, 9), r.rr) for r in found.collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got == {("a", 1): (0.5, round(1 / ideal, 9), 1.0), ("b", 1): (1.0, 1.0, 1.0), ("a", 2): (0.0, 0.0, 0.0), ("b", 2): (0.0, 0.0, 0.0)}
    assert effects.measures(spark.createDataFrame([], "scenario string, query long, item long, rank long"), spark.createDataFrame(judged, "query long, item long"), 2).count() == 0


def test_intervals_hold_the_difference_and_repeat(spark):
    pick = random.Random(1)
    rows = [(s, q, pick.random() + (0.3 if s == "new" else 0.0)) for q in range(150) for s in ("old", "new")]
    measured = spark.createDataFrame(rows, "scenario string, query long, ndcg double")
    one, two = ({r.scenario: tuple(r) for r in effects.compared(m, "old", "ndcg").collect()} for m in (measured, measured.repartition(7)))
    assert one.keys() == two.keys() and all(abs(a - b) < 1e-9 for k in one for a, b in zip(one[k][1:], two[k][1:]))
    _, n, _, difference, low, high = one["new"]
    assert n == 150 and low < difference < high and low > 0.1 and high - low < 0.3
    assert one["old"][3:] == (0.0, 0.0, 0.0)


def test_labels_of_owners(spark):
    rows = [(1, "Higgs", 0.5), (1, "higgs ", 0.9), (1, "top", 0.9), (1, " ", 1.0), (1, None, 1.0), (1, "muon", 0.1), (2, "x", 0.2)]
    got = {r.owner: r.labels for r in effects.labels_of(spark.createDataFrame(rows, "owner long, label string, confidence double"), 2).collect()}
    assert got == {1: ["higgs ", "top"], 2: ["x"]}


def test_digests_and_equal_objects(spark):
    rows = [(3, "k", 7), (1, "k", 7), (2, None, 7)]
    found = {r.first: (r.digest, r.occurrences) for r in contracts.coalesced(spark.createDataFrame(rows, "id long, kind string, n long"), "id", ["n", "kind"]).collect()}
    sha = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert found == {1: (sha({"kind": "k", "n": 7}), 2), 2: (sha({"n": 7}), 1)}


def test_rules_of_a_contract(spark):
    rows = [(1, 5, 0.5, "ready"), (2, 6, 1.5, "ready"), (2, None, None, "odd"), (4, 5, 1.0, None)]
    s = spark.createDataFrame(rows, "id long, work long, confidence double, status string")
    works = spark.createDataFrame([(5,)], "work_id long")
    found = contracts.violations([contracts.dangling(s, "id", "work", works, "work_id", "lost"), contracts.repeated(s, "id", "twice"), contracts.outside(s, "id", "confidence", 0.0, 1.0, "bounds"), contracts.unknown(s, "id", "status", ("ready",), "status")])
    assert sorted(map(tuple, found.collect())) == [("bounds", "2", "1.5"), ("bounds", "2", "none"), ("lost", "2", "6"), ("lost", "2", "none"), ("status", "2", "odd"), ("status", "4", "none"), ("twice", "2", "2")]
    assert {r.rule: (r.violations, r.subjects) for r in contracts.summary(found).collect()}["lost"] == (2, 1)
    assert contracts.dangling(s.where(F.col("id") < 0), "id", "work", works, "work_id", "lost").count() == 0
