"""Concepts, aliases and their mentions."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import grounding
from quarry.operators import taxonomy as K

PATHS = [
    (1, "Root / 1 B meson / Decays"), (2, "Root / B meson / 1.1 decays / Notes"), (3, "Root / Summary"), (4, None), (5, ""), (6, "PDG book / IV. Review of Kaon (K0) / Property"),
    (7, "pdg"), (8, "Root / History / Decays"), (8, "Root / History / Decays"), (9, "Root / pages / Tau physics / widths / Notes / deep"),
]


@pytest.fixture(scope="module")
def taken(spark):
    return K.steps(spark.createDataFrame(PATHS, "source long, path string"), ("Root",))


def test_headings_below_the_roots(taken):
    got = {}
    for r in taken.orderBy("source", "level").collect():
        got.setdefault(r.source, []).append((r.level, r.own, r.key))
    assert got[2] == [(1, "B meson", "b_meson"), (2, "decays", "b_meson/decays"), (3, "Notes", "b_meson/decays/notes")]
    assert [x[1] for x in got[6]] == ["Kaon (K0)", "Property"]
    assert got[7] == [(1, "pdg", "pdg")]
    assert got.keys() == {1, 2, 3, 6, 7, 8, 9}


def test_what_counts_and_how_it_is_called(taken):
    got = {r.key: (r.label, r.kind, r.parent, r.mentions) for r in K.taxonomy(taken).collect()}
    assert got["b_meson"] == ("B meson", "particle", None, 2)
    assert got["b_meson/decays"] == ("B meson decays", "decay", "b_meson", 2)
    assert got["kaon_k0/property"] == ("Kaon (K0) properties", "particle", "kaon_k0", 1)
    assert got["pages/tau_physics/widths"][:2] == ("Tau physics widths", "decay")
    assert got["pages/tau_physics/widths/notes"][2] == "pages/tau_physics/widths"
    assert not {"summary", "history", "history/decays", "pages", "pages/tau_physics/widths/notes/deep"} & got.keys()


def test_kinds(spark):
    texts = ["B meson decays", "vector boson scattering", "CKM", "W mass", "top quark", "History"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.k for r in rows.select(K.kind(K.folded(F.col("t"))).alias("k")).collect()] == ["decay", "process", "parameter", "observable", "particle", "section"]


def test_aliases(taken):
    got = {(r.key, r.alias): (r.alias_kind, r.confidence) for r in K.alias_rows(taken).collect()}
    assert got["b_meson/decays", "B meson decays"] == ("label", 1.0)
    assert got["b_meson/decays", "Decays of B meson"] == ("alias", pytest.approx(0.87)) or got["b_meson/decays", "decays of B meson"] == ("alias", pytest.approx(0.87))
    assert ("kaon_k0", "Kaon") in got and ("kaon_k0", "K0") not in got  # a single word needs four letters


def test_subjects(spark):
    rows = spark.createDataFrame([("See the ckm matrix, some b mesons, one W boson with a Higgs boson and tau leptons",), (None,), ("nothing",)], "t string")
    assert [r.s for r in rows.select(K.subjects(F.col("t")).alias("s")).collect()] == [["CKM Matrix", "B mesons", "W boson", "Higgs boson"], [], []]


@pytest.mark.parametrize("bound", [10, 0])
def test_mentions_either_way(spark, monkeypatch, bound):
    monkeypatch.setattr(grounding, "ALIASES", bound)
    texts = spark.createDataFrame([(1, "a b c d e f".split()), (2, "x a b".split()), (3, []), (4, None)], "doc_id long, words array<string>")
    aliases = spark.createDataFrame([(1, ["a", "b"]), (2, "b c d e".split()), (3, []), (4, "b c d x".split()), (5, ["a", "b"]), (6, ["x"])], "item_id long, words array<string>")
    got = sorted((r.doc_id, r.item_id, r.words) for r in grounding.mentions(texts, aliases, "doc_id", "item_id").collect())
    assert got == [(1, 1, 2), (1, 2, 4), (1, 5, 2), (2, 1, 2), (2, 5, 2), (2, 6, 1)]
