"""Defined cases of the training-data operators: repeated and missing ids, hubs, groups' own thresholds, brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import circulant_minhash, components, knn_quality, quality_rules
from tests.llm.test_text_models import components_by_brute_force

X = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
Y = "red orange yellow green blue indigo violet black white grey brown pink cyan magenta olive navy teal maroon lime silver"
NEAR = X + " more"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_rows_that_repeat_an_id_have_their_own_components(spark):
    docs = table(spark, [(5, X), (5, Y), (3, NEAR), (9, Y + " z")])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in circulant_minhash.near_duplicates(docs, 3, 85).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)]


def test_near_duplicates_without_ids(spark):
    docs = table(spark, [(None, X), (7, NEAR), (None, Y), (None, Y), (None, None)])
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in circulant_minhash.near_duplicates(docs, 3, 85).collect()))
    assert got == [(0, 0, True), (0, 0, True), (0, 0, True), (0, 7, False), (7, 7, True)]


def test_one_row_of_each_group_stays(spark):
    rows = [(5, X), (5, Y), (3, NEAR), (None, X), (None, Y), (4, "a b"), (4, "a b"), (6, None), (6, None), (None, "c d"), (None, "c d")]
    left = circulant_minhash.one_of_each(table(spark, rows), 3, 85)
    got = sorted(((r.doc_id or 0), r.text or "") for r in left.collect())
    # A text without words stays as often as it occurs; any other group has one row left.
    assert got == sorted([(3, NEAR), (5, Y), (4, "a b"), (0, "c d"), (6, ""), (6, "")])
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize(("small", "hub"), [(10**6, 10**6), (0, 10**6), (0, 2)])
def test_components_of_any_shape(spark, small, hub):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500, i) for i in range(501, 530)] + [(i, i + 1) for i in range(600, 640)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    want = {(x, root(x)) for x in list(parent) if root(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in components.connected_components(df, "a", "b", small, hub).collect()} == want
    texts = df.select(F.lpad(F.col("a").cast("string"), 4, "0").cast("binary").alias("a"), F.lpad(F.col("b").cast("string"), 4, "0").cast("binary").alias("b"))
    assert {(int(r.node), int(r.component)) for r in components.connected_components(texts, "a", "b", small, hub).collect()} == want


def test_buckets_with_strays(spark, monkeypatch):
    """Buckets so coarse that unrelated texts share them: what the least class leaves open is compared all the same."""
    monkeypatch.setattr(circulant_minhash, "bands_for", lambda *_: 12)
    monkeypatch.setattr(circulant_minhash, "BLOCK", 150)
    rng = np.random.default_rng(2)
    texts, common = {}, [f"c{i}" for i in range(40)]
    for g in range(12):
        own = [f"w{g}x{i}" for i in range(14)]
        for k in range(4):
            words = common + own + [f"u{g}{k}{j}" for j in range(int(rng.integers(0, 4)))]
            texts[100 * (12 - g) + k] = " ".join(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in circulant_minhash.near_duplicates(table(spark, list(texts.items())), 3, 85, 1).collect()}
    assert got == components_by_brute_force(texts, 3, 85)
    assert len({c for _, c in got.values()}) >= 12


def test_thresholds_are_the_group_s_own(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        shouting = i % 2
        words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 7)))) for _ in range(60)]
        if shouting:
            words = [w.upper() if rng.random() < 0.2 + 0.3 * rng.random() else w for w in words]
        rows.append((i, " ".join(words), "en", "loud" if shouting else "calm"))
    odd = " ".join(w.upper() if k % 3 == 0 else w for k, w in enumerate(rows[0][1].split()))
    rows += [(1000, odd, "en", "calm"), (1001, odd, "en", "loud")]
    measured = quality_rules.with_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    limits = {r.source: r for r in quality_rules.thresholds(measured).collect()}
    rate = quality_rules.FENCES["upper_rate"]
    for source, r in limits.items():
        values = sorted(rate[2] * x.n_upper // x.n_letters for x in measured.where(F.col("source") == source).collect())
        at = lambda q: values[math.ceil(q * len(values)) - 1]
        middle, high = at(0.5), at(0.9)
        assert abs(r.max_upper_rate - (high + quality_rules.REACH * max(high - middle, rate[3]))) <= 0.1 * r.max_upper_rate
    assert limits["loud"].max_upper_rate > 5 * limits["calm"].max_upper_rate
    kept = {r.doc_id: r.kept for r in quality_rules.judge(measured, quality_rules.thresholds(measured)).where("doc_id >= 1000").collect()}
    assert kept == {1000: False, 1001: True}
    assert sum(r.kept for r in quality_rules.judge(measured, quality_rules.thresholds(measured)).collect()) >= 590


def test_quality_rules_with_clashing_columns_and_without_rows(odd_docs):
    df = odd_docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(3))
    measured = quality_rules.with_statistics(df)
    got = quality_rules.judge(measured, quality_rules.thresholds(measured))
    assert got.columns.count("kept") == 1
    assert got.where("score is not null").count() == odd_docs.where("score is not null").count()
    none = quality_rules.with_statistics(odd_docs.where("doc_id < 0"))
    assert quality_rules.judge(none, quality_rules.thresholds(none)).count() == 0


def test_terms_of_a_text_by_brute_force():
    texts = ["", "a", "b a b a a", "Ein Satz, ein Satz. Noch ein Satz", "x " * 40]
    for t, row in zip(texts, knn_quality.recurrences(texts), strict=True):
        want, last = [0] * knn_quality.GAPS, {}
        for i, w in enumerate(t.split()):
            want[(i - last[w]).bit_length() if w in last else 0] += 1
            last[w] = i
        assert row.tolist() == want
        assert knn_quality.trigrams(t).sum() == max(1, len(t))
    v = knn_quality.vectors(texts, np.ones(knn_quality.FEATURES))
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5)
    share = (v[2:, 1 << knn_quality.BITS :] ** 2).sum(1)
    assert np.allclose(share, 0.2, atol=1e-4)


def test_quality_without_rows_and_with_ties(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (5, 0)], "doc_id long, quality int")  # documents 1 and 8 are the same text
    model = knn_quality.fit(odd_docs, labels, F.lit(True))
    assert knn_quality.score(odd_docs.where("doc_id < 0"), model).count() == 0
    got = {r.doc_id: r.score for r in knn_quality.score(odd_docs, model).collect()}
    assert got[1] == got[8]


def test_pipeline_stages_on_odd_documents(spark, odd_docs):
    docs = table(spark, [(r.doc_id, r.text) for r in odd_docs.collect()] + [(None, X), (None, X), (None, None), (11, X + " " + Y)])
    none = docs.where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        out = stage(spark, docs, "")
        if stage is not corpus_pipeline.pack:
            assert out.columns == docs.columns
            assert out.exceptAll(docs.withColumn("lang", F.lit(None).cast("string"))).count() <= out.count()
        out.count()
