"""Language ID, quality, rules, fingerprints, near duplicates, language model, HTML: brute force, held-out accuracy, odd inputs."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import circulant_minhash, context_mixing, html_layout, knn_quality, langid, mixing, quality_rules, scaled_sketch, shingles
from quarry.llm.components import connected_components
from quarry.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_accuracy_on_held_out_rows(spark, docs):
    got = QUERIES["op5_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(odd_docs):
    model = langid.fit(odd_docs, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd_docs, model).collect()}
    assert {(2, "und"), (3, "und"), (5, "und")} <= got
    nothing = langid.fit(odd_docs, F.lit(False))
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    assert langid.predict(odd_docs.where("doc_id < 0"), model).count() == 0


def test_elastic_net_leaves_most_weights_at_zero(docs):
    model = langid.fit(docs, F.lit(True), per_lang=100)
    assert (model.weights == 0).mean() > 0.5


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"  # sf0.001 marks some ten bad documents only
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op2_knn_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_cosines_are_exact():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc de"), 60)) for _ in range(80)]
    idf = np.ones(knn_quality.FEATURES)
    x = knn_quality.vectors(texts, idf)
    basis = knn_quality.latent_basis(x, 16)
    points = x @ basis
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    y = rng.integers(0, 2, 80).astype(float)
    model = knn_quality.Model(idf, basis, points, y)
    for i, s in enumerate(model.scores(texts[:10])):
        cosine = points @ points[i]
        near = np.argsort(-cosine)[: knn_quality.K]
        w = np.maximum(1e-6, cosine[near]) ** knn_quality.POWER
        assert abs(s - (w * y[near]).sum() / w.sum()) < 1e-3


def test_quality_of_odd_texts(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    model = knn_quality.fit(odd_docs, labels, F.lit(True))
    got = knn_quality.score(odd_docs, model).collect()
    assert len(got) == 9
    assert all(0 <= r.score <= 1 for r in got)
    none = knn_quality.fit(odd_docs, labels, F.lit(False))
    assert {r.score for r in knn_quality.score(odd_docs, none).collect()} == {0.5}


def repeated_words(words):
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_statistics_by_brute_force():
    texts = ["", "a b c d e f g h a b c d e f g h i", "x x x x x x x x x x", "One line\nOne line\n\n#Two $3", "one two " * 30, "ÉÀ b" * 9]
    got = quality_rules.measure(texts)
    for t, row in zip(texts, got, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip()]
        want = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated_words(w)]
        assert row[:5].tolist() == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    _, want = rows_of_sql(connect(SF), ORACLES[name])
    assert rows_of_spark(QUERIES[name](spark, SF)) == want


def test_quality_rules_on_odd_texts(odd_docs):
    measured = quality_rules.with_statistics(odd_docs)
    got = quality_rules.judge(measured, quality_rules.thresholds(measured)).collect()
    assert len(got) == 9
    assert {r.doc_id for r in got if r.base_failed} >= {2, 3, 5, 6}
    assert {r.doc_id for r in got if r.kept} >= {1, 8}


def test_fingerprints(spark, odd_docs):
    docs = odd_docs.dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in scaled_sketch.with_neighbours(docs).collect()}
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    ids = sorted(got)
    import hashlib

    for k, i in enumerate(ids):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        h = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
    assert got[1].fingerprint == got[8].fingerprint != ""
    assert got[2].fingerprint == "" and got[2].near_next == 1.0
    assert 0 <= min(r.near_edited for r in got.values()) <= max(r.near_edited for r in got.values()) <= 1
    assert scaled_sketch.with_neighbours(docs.where("doc_id < 0")).count() == 0
    one = scaled_sketch.with_neighbours(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketches_estimate_containment_and_merge():
    rng = np.random.default_rng(1)
    whole = "".join(rng.choice(list("abcdefgh ij"), 60_000))
    part = whole[:6_000]
    a, b = scaled_sketch.sketch([whole, part])
    assert scaled_sketch.likeness(a, b) > 0.95
    left, right = scaled_sketch.sketch([whole[:30_000], whole[30_000:]])
    merged = scaled_sketch.merge(left, right)
    assert len(np.setxor1d(merged[1], a[1])) < 10
    assert scaled_sketch.unpack(scaled_sketch.pack(a))[0] == a[0]
    assert (scaled_sketch.unpack(scaled_sketch.pack(a))[1] == a[1]).all()


def test_no_estimate_is_not_zero():
    rng = np.random.default_rng(4)
    whole = "".join(rng.choice(list("abcdefgh ij"), 60_000))
    long, *short = scaled_sketch.sketch([whole, *(whole[a : a + 25] for a in range(0, 6000, 100))])
    got = [scaled_sketch.likeness(long, s) for s in short]
    assert None in got and {x for x in got if x is not None} <= {1.0}
    assert scaled_sketch.likeness(*scaled_sketch.sketch(["x" * 20, "y" * 20])) == 0.0


def components_by_brute_force(texts, width, percent):
    def sets(t):
        w = [x.lower() for x in (t or "").encode().split()]
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    s = {i: sets(t) for i, t in texts.items()}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if s[i] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(docs, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in circulant_minhash.near_duplicates(docs, width, percent).collect()}
    assert got == components_by_brute_force({r.doc_id: r.text for r in docs.collect()}, width, percent)


def test_hub_and_spokes_over_many_blocks(spark, monkeypatch):
    """Spokes that only the hub joins, in a cluster of many blocks."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    texts = {900: " ".join(base)}
    for k in range(60):
        w = list(base)
        for p in rng.choice(300, 8, replace=False):
            w[p] = f"x{k}_{p}"
        texts[k] = " ".join(w)
    monkeypatch.setattr(circulant_minhash, "BLOCK", 7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in circulant_minhash.near_duplicates(df, 3, 85).collect()}
    assert got == components_by_brute_force(texts, 3, 85)


def test_near_duplicates_of_odd_texts(odd_docs):
    got = {r.doc_id: (r.component_id, r.kept) for r in circulant_minhash.near_duplicates(odd_docs, 3, 85).collect()}
    assert got[8] == (1, False) and got[1] == (1, True)
    assert all(got[i] == (i, True) for i in (2, 3, 4, 5, 6, 7))
    assert circulant_minhash.near_duplicates(odd_docs.where("doc_id < 0"), 3, 85).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64))))
    s = shingles.signatures([a, b], 512)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.08


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 6)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges, "a", "b").collect()} == {(2, 1), (3, 1), (7, 6), (8, 6)}


def test_language_model(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op3_context_mixing"](spark, SF).collect()}
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert r.score < 0


def test_language_model_beats_word_counts_on_held_out_texts(spark):
    some = QUERIES["op3_context_mixing"](spark, "/root/testdata/sf0.01").where("held_out").collect()  # on sf0.001 a third of the words are new
    assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_language_model_of_odd_texts(odd_docs):
    got = context_mixing.score_documents(odd_docs, F.lit(False)).collect()
    assert len(got) == 9 and all(r.n_tokens >= 1 for r in got)
    untrained = context_mixing.score_documents(odd_docs, F.lit(True)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in untrained)
    assert context_mixing.score_documents(odd_docs.where("doc_id < 0"), F.lit(False)).count() == 0


def test_scores_do_not_depend_on_order(spark, docs):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    a = {r.doc_id: round(r.score, 4) for r in context_mixing.score_documents(docs.repartition(1), held).collect()}
    b = {r.doc_id: round(r.score, 4) for r in context_mixing.score_documents(docs.orderBy(F.desc("doc_id")).repartition(1), held).collect()}
    assert a == b



def test_blocks_meet_their_answers_in_shares(docs, monkeypatch):
    held = F.col("doc_id") % 10 == 0
    met, real = [], context_mixing._met

    def spied(table, answers, totals):
        if totals is not None:
            met.append({r.block for r in table.select("block").collect()})
        return real(table, answers, totals)

    monkeypatch.setattr(context_mixing, "_met", spied)
    some = docs.repartition(16, "doc_id")
    shares = {r.doc_id: r.score for r in context_mixing.score_documents(some, held).collect()}
    assert len(met) == 2
    assert not met[0] & met[1]
    assert sum(map(len, met)) == 16
    monkeypatch.setattr(context_mixing, "WAVES", 1)
    assert shares == {r.doc_id: r.score for r in context_mixing.score_documents(some, held).collect()}
    assert len(shares) == docs.count()


def test_distinct_counted_and_numbered_by_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 5000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)[rng.integers(0, max(1, n // 3 + 1), n)] if n else np.empty(0, np.uint64)
        x[: n // 2] &= np.uint64(7)
        x[: n // 4] |= np.uint64(1 << 63)
        values, place = np.unique(x, return_inverse=True)
        assert (mixing.distinct(x) == values).all()
        assert (mixing.counted(values, x[: n // 2]) == np.bincount(place[: n // 2], minlength=len(values))).all()
        got = mixing.numbered(x)
        assert (got[0] == values).all()
        assert (got[1] == place).all()


def test_language_model_counts_every_context_apart():
    """Log odds of every decision from counts of the symbols on either side, by brute force, with more contexts than words."""
    rng = np.random.default_rng(3)
    words = [b"", *(f"w{i}".encode() for i in range(400))]
    hashes = context_mixing.word_hashes(words)
    tokens = rng.integers(1, len(words), 20_000)
    code = mixing.Code(hashes[:300], rng.integers(1, 50, 300), 100, np.ones(257, np.int64))
    text = mixing.Symbols(tokens, np.arange(len(tokens)), words, hashes, code)
    assert text.n.sum() == len(tokens) + sum(len(words[t]) + 1 for t in tokens if t >= 300)
    pairs, n = np.unique(np.concatenate((text.one, text.both)), return_counts=True)
    previous = {(x, y, z) for x, y, z in zip(tokens[:-2], tokens[1:-1], np.minimum(tokens[2:], 300), strict=True)}
    assert len(pairs) > len(previous)  # none shares a place with another
    alone, split, odds = mixing.context_odds(pairs, n, code)
    shared = mixing.inherited(pairs, split, code)
    first = np.cumsum(split, dtype=np.int64) - split
    odds, place = mixing.whole_paths(pairs, alone, split, odds[mixing.ranges(first + shared, split - shared)], code)
    assert shared.sum() > split.sum() // 4  # much is sent once only
    path = lambda s: range(code.start[s], code.start[s] + code.length[s])
    sides = Counter()
    split = [(int(p) >> mixing.SYMBOL, int(p) & (1 << mixing.SYMBOL) - 1) for p in pairs]
    for (c, s), k in zip(split, n, strict=True):
        for i in path(s):
            sides[c, code.nodes[i], code.bits[i]] += int(k)
    for (c, s), at in list(zip(split, place, strict=True))[::97]:
        for d, i in enumerate(path(s)):
            want = (math.log(sides[c, code.nodes[i], 1] + 0.4) - math.log(sides[c, code.nodes[i], 0] + 0.4)) * mixing.SCALE
            assert abs(odds[at + d] * (2 * code.bits[i] - 1) - np.clip(want, -127, 127)) < 0.51


def test_language_model_finds_odds_of_two_counts_in_one_pass():
    """Both counts' odds are those of each by itself, large counts too, and memory stays within what the answers and one pass hold."""
    rng = np.random.default_rng(5)
    code = mixing.Code(np.sort(rng.integers(0, 1 << 62, 3000).astype(np.uint64)), rng.integers(1, 10_000, 3000), 100, np.ones(257, np.int64))
    pairs = mixing.distinct(mixing.fmix64(rng.integers(0, 500, 200_000).astype(np.uint64)) & code.cut | rng.integers(0, len(code.length), 200_000).astype(np.uint64))
    counts = [np.minimum(rng.zipf(1.3, len(pairs)), 10**7).astype(np.int64), rng.integers(0, 3, len(pairs))]
    tracemalloc.start()
    found = context_mixing._Answers(pairs, code, *counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    decisions = int(found.split.sum(dtype=np.int64))
    assert peak < 9 * decisions + 40 * len(pairs)  # two passes with places of eight bytes took more
    for n, (alone, odds) in zip(counts, found.odds, strict=True):
        own = mixing.context_odds(pairs, n, code)
        assert (own[0] == alone).all()
        assert (own[1] == found.split).all()
        assert (own[2] == odds).all()
        ends = np.log(n + 0.4) - np.log(0.4)
        assert (alone == np.clip(np.rint(ends * mixing.SCALE), -127, 127)).all()


def test_language_model_grows_with_its_training_texts(docs):
    """Every distinct pair of a context and a symbol is answered; the tree takes more words of more tokens."""
    assert mixing.WORDS == mixing.tree_words(1000) < mixing.tree_words(1 << 26) < mixing.tree_words(1 << 30)
    size = []
    for part in (docs.where("doc_id % 4 = 0"), docs):
        table = context_mixing.blocks(part, F.lit(False))
        code, n, _ = context_mixing.make_code(context_mixing.word_totals(table, 1), context_mixing.byte_counts(table))
        answers = context_mixing.pair_odds(table, docs.sparkSession.sparkContext.broadcast(code), 3, True)
        size.append(answers.agg(F.sum("size")).first()[0])
    assert size[1] > 3 * size[0]


def test_language_model_learns_from_calibration_documents(spark, monkeypatch):
    """With every training document a calibration document, repeated contexts still count."""
    monkeypatch.setattr(context_mixing, "CALIBRATE", 1)
    text = " ".join(f"w{i * 7 % 50} w{i * 11 % 50}" for i in range(400))
    table = context_mixing.blocks(spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string"), F.lit(False))
    code, _, _ = context_mixing.make_code(context_mixing.word_totals(table, 1), context_mixing.byte_counts(table))
    r = context_mixing.pair_odds(table, spark.sparkContext.broadcast(code), 1, False).first()
    read = context_mixing._Answers.read
    assert any(x.any() for x in read(r["odds"], r["size"])[::2])
    assert not any(x.any() for x in read(r["first_odds"], r["first_size"])[::2])


PAGE = """<html><head><title>no</title><style>.h{display:none}</style></head><body><h1>A &amp; b</h1><p>One<p>Two<br>three<div class=h>no</div><ul><li>x<li>y<ol start=3><li>z</ol></ul>
<table><tr><th>Name<th>Qty<tr><td>pear<td>10</table><pre>
 a
   b</pre><div hidden>no</div><script>var x="<p>no</p>"</script><span style="visibility:hidden">no<b style="visibility:visible">yes</b></span></body></html>"""


def test_html_layout():
    want = "A & b\n\nOne\n\nTwo\nthree\n\n- x\n- y\n  3. z\n\nName | Qty\npear | 10\n\n a\n   b\n\nyes"
    assert html_layout.render(PAGE) == want


@pytest.mark.parametrize(("html", "want"), [(None, ""), ("", ""), ("plain < text", "plain < text"), ("<td>a", "a"), ("<!-- open", ""), ("<p>a<p>b", "a\n\nb"), ("<div>" * 3000 + "x", "x"), ("a&nbsp;b", "a b")])
def test_html_edges(html, want):
    assert html_layout.render(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<style>@media print { .nav, #side { display:none } } .x{display:none}</style><p class=nav>a<p id=side>b<p class=x>c", "a\n\nb"),
        ("<style>@media (max-width: 600px) { p { display:none } }</style><p>a", "a"),
        ("<style>p{display:none} @media (min-width: 600px) { p { display:block } }</style><p>a", "a"),
        ("<style>@media screen { p { display:none } }</style><p>a", ""),
        ("<style media=print>p{display:none}</style><p>a", "a"),
        ("<style>@import 'x'; .x{display:none} @keyframes k { from {visibility:hidden} }</style><p class=x>a<p>b", "b"),
        ("<style>.x{display:none} .x{display:block}</style><p class=x>a", "a"),
        ("<style>#i{display:none} .x{display:block}</style><p class=x id=i>a", ""),
        ("<style>.x{display:none !important} .x{display:block}</style><p class=x style='display:block'>a", ""),
        ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"),
        ("<style>.x{color:red; @media print {display:none}} .y{content:'}'; display:none</style><p class=x>a<p class=y>b", "a"),
        ("<style>.x{visibility:hidden} .y{visibility:visible}</style><div class=x>a<b class=y>b</b><b style='visibility:visible'>c</b></div>", "bc"),
        ("<p>so <math><mfrac><mi>a</mi><mi>b</mi></mfrac><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "so a b =1"),
        ("<p>x<svg><title/><desc>no</desc><defs><text>no</text></defs><g>no<path d='M0'/><text>one</text><text>t<tspan>wo</tspan></text></g></svg>y", "x\none\ntwo\ny"),
    ],
)
def test_style_rules_formulas_and_drawings(html, want):
    assert html_layout.render(html) == want


def test_every_visible_word_is_kept(spark):
    pages = duckdb.connect().execute(f"select html from read_parquet('{SF}/pages.parquet')").fetchall()
    for (html,) in pages:
        bare = re.sub(r"<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", html, flags=re.S)
        words = Counter(re.findall(r"\w+", __import__("html").unescape(re.sub(r"<[^>]*>", " ", bare))))
        got = Counter(re.findall(r"\w+", html_layout.render(html)))
        assert words - got == Counter(got - words) or not (words - got)


def test_html_operator(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    got = {r.page_id: r.n_lines for r in html_layout.extract(df).collect()}
    assert got[2] == 0 and got[1] > 5


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.toPandas(), docs.schema)
    groups = components_by_brute_force({r.doc_id: r.text for r in kept.collect()}, 5, 80)
    assert all(i == c for i, (_, c) in groups.items())
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.select("doc_id").collect()}
