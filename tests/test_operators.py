"""Operators on small made-up tables: order, ties, nulls, empty input."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import fulltext, graph, ingest, inverted, jobs, lexical, vectors
from quarry.operators.shared import new_path
from quarry.operators.versions import Store


def rows(df):
    return sorted(map(tuple, df.collect()))


def index_of(docs):
    store = Store(docs.sparkSession, new_path(docs.sparkSession, "index"))
    inverted.write(store, "words", docs, "doc_id", ["text"])
    return inverted.read(store, "words")


def test_components_of_paths_stars_and_loops(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (10, 11), (20, 20)], "src long, dst long")
    assert rows(graph.connected_components(edges)) == [(3, 3), (4, 3), (5, 3), (9, 3), (10, 10), (11, 10), (20, 20)]


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_coupling_and_co_citation(spark):
    e = spark.createDataFrame([(101, 201), (101, 202), (102, 201), (102, 202)], "w long, ref long")
    assert rows(graph.shared_pairs(e, "w", "ref")) == [(101, 102, 2, 1.0)]
    assert rows(graph.shared_pairs(e, "ref", "w")) == [(201, 202, 2, 1.0)]


def test_bm25_prefers_rare_words_and_short_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta beta gamma gamma gamma"), (3, "beta"), (4, None), (5, "")], "doc_id long, text string")
    got = [r.doc_id for r in lexical.bm25_topk(index_of(docs), ["alpha"], 5).collect()]
    assert got == [1, 2]


def test_phrase_needs_adjacency(spark):
    docs = spark.createDataFrame([(1, "of the of the"), (2, "of a the"), (3, None)], "doc_id long, text string")
    assert rows(lexical.phrase_match(index_of(docs), ["of", "the"])) == [(1, 2)]


def test_knn_in_blocks_is_exact(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 13)
    got = {(r.src, r.dst) for r in vectors.knn_edges(df, 3, 0.1).collect()}
    cosine = x @ x.T
    np.fill_diagonal(cosine, -1)
    want = set()
    for i in range(60):
        for j in np.argsort(-cosine[i])[:3]:
            if cosine[i, j] >= 0.1:
                want.add((min(i, int(j)), max(i, int(j))))
    assert got == want


def test_knn_of_many_copies_in_few_blocks_and_strips(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate((rng.standard_normal((30, 8)), np.repeat(rng.standard_normal((2, 8)), 60, axis=0)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for name, value in (("BLOCK", 2), ("BLOCKS", 3), ("STRIP", 7)):
        monkeypatch.setattr(vectors, name, value)
    for k, least in ((1, 0.1), (3, 0.35)):
        cosine = np.round(x @ x.T, 9)
        want = {(min(i, j), max(i, j)) for i in range(150) for j in sorted((j for j in range(150) if j != i and cosine[i, j] >= least), key=lambda j: (-cosine[i, j], j))[:k]}
        assert {(r.src, r.dst) for r in vectors.knn_edges(df, k, least).collect()} == want


def test_knn_sends_a_vector_to_few_blocks_and_keeps_ties(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate((rng.standard_normal((200, 16)), np.repeat(rng.standard_normal((3, 16)), 40, axis=0)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(len(x)) * 7, x, strict=True)]
    df = spark.createDataFrame([*rows, (3, None)], "vec_id long, embedding array<float>")
    for name, value in (("BLOCK", 8), ("BLOCKS", 5), ("STRIP", 16), ("TILE", 32), ("SOURCES", 50)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    exact = {r.vec_id: np.array(r.embedding) for r in df.where("embedding is not null").collect()}
    ids = sorted(exact)
    m = np.array([exact[i] for i in ids])
    cosine = np.round(m @ m.T, 9)
    for k, least in ((4, 0.3), (60, 0.1)):
        want = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in sorted((b for b in range(len(ids)) if b != a and cosine[a, b] >= least), key=lambda b: (-cosine[a, b], b))[:k]}
        edges = vectors.knn_edges(df, k, least)
        assert {(r.src, r.dst) for r in edges.collect()} == want
    # 320 vectors of 16 numbers in blocks of at most 1,024 numbers are more blocks than BLOCKS, with the same edges.
    monkeypatch.setattr(vectors, "NUMBERS", 1024, raising=False)
    assert {(r.src, r.dst) for r in vectors.knn_edges(df, k, least).collect()} == want


@pytest.mark.parametrize("kind", vectors.HASHES)
def test_folded_rows_are_sums_of_slots_of_all_features(kind):
    import numpy as np
    import pyarrow as pa

    rows = [["a", "b", "a", "b"], [], None, ["é__x", "a", "日本", "a"], ["b"]]
    want = np.zeros((len(rows), 7))
    for i, r in enumerate(rows):
        for f in [*(r or []), *(f"{x}__{y}" for x, y in zip(r or [], (r or [])[1:], strict=False))]:
            at, sign = vectors.slot(f, 7, kind)
            want[i, at] += sign * (0.5 if "__" in f else 1.0)
    values, present = vectors.fold(pa.array(rows, pa.list_(pa.string())), 7, kind)
    assert (values == want).all() and not present[[1, 2]].any() and present[values != 0].all()
    names = ["a", "b", "é__x", "日本__a"] * 50
    at, sign = vectors.slots_of([x.encode() for x in names], 768, kind)
    assert list(zip(at.tolist(), sign.tolist(), strict=True)) == [vectors.slot(x, 768, kind) for x in names]


def test_chunks_keep_every_sentence_and_the_budget(spark):
    text = " ".join(f"Word{i} is here now." for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = fulltext.pack_chunks(docs, budget=20, overlap=1).orderBy("chunk").collect()
    assert {r.doc_id for r in out} == {1}
    assert all(f"Word{i} " in " ".join(r.text for r in out) for i in range(30))
    assert all(r.n_tokens <= 20 for r in out)


def test_neighbour_text_skips_nulls(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c"), (1, 3, None)], "o long, p long, t string")
    got = {r.p: (r.before, r.after) for r in fulltext.neighbour_text(df, "o", "p", F.col("t")).collect()}
    assert got == {0: (None, "c"), 1: ("a", "c"), 2: ("a", None), 3: ("c", None)}


@pytest.mark.parametrize(("raw", "want"), [("A &amp; <b>B</b>", "A & B"), ("x_{1} , (y)", "x 1 y"), (None, "")])
def test_normalize_search(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.normalize_search(F.col("t"))).first()[0] == want


def test_upserts(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, seq long, v string")
    assert rows(ingest.keep_latest(df, ["key"], ["seq"]).select("key", "v")) == [("k", "b"), ("m", "c")]
    assert rows(ingest.keep_first(df, ["key"], ["seq"]).select("key", "v")) == [("k", "a"), ("m", "c")]


def test_evidence_references(spark):
    df = spark.createDataFrame([("works", "a", 2), ("works", "b", 1), ("works", "a", 5)], "lane string, key string, pos long")
    assert rows(jobs.evidence(df)) == [("works", "a", 2, "W2"), ("works", "b", 1, "W1")]


def test_stream_equals_batch(spark, tmp_path):
    from quarry.streaming.windows import event_stream, latest_status

    events = spark.createDataFrame([(i, i % 3, "view" if i % 2 else "click", float(i)) for i in range(20)], "event_id long, user_id long, event_type string, value double")
    events = events.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 60))
    events.write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), events.schema)
    latest_status(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    versions = sorted((tmp_path / "out").glob("v=*"), key=lambda p: int(p.name[2:]))
    got = {r.job: r.s.event_id for r in spark.read.parquet(str(versions[-1])).collect()}
    assert got == {0: 18, 1: 19, 2: 17}


def test_query_profile_and_routes():
    from quarry.functions import query as Q

    p = Q.analyze("latest results on the CMS trimuon search")
    assert p.content == ("cms", "collaboration", "trimuon", "search")
    assert p.groups[0] == ("cms", "cms collaboration")
    assert p.concepts == ("cms", "muon")
    assert [q.every for q in Q.match_queries(p)] == [True, False, True, False]
    assert Q.route("overview of trimuon") == ("works", 5)
    assert Q.route("trimuon mass") == ("chunks", 0)
    assert Q.match_queries(Q.analyze("")) == []
    assert Q.embedded_form(Q.analyze("")) == ""
    assert Q.strategy(0, 0, True) == "insufficient_evidence"
    assert Q.strategy(1, 3, True) == "community_map_reduce"
    assert Q.wants_summaries("overview", "works")
    assert not Q.wants_summaries("overview", "chunks")


def test_query_language_of_abbreviations_and_intent():
    from quarry.functions import query as Q

    p = Q.analyze("综述一下 H -> aa 相关工作")
    rewritten = Q.embedded_form(p)
    assert "higgs" in rewritten
    assert "pseudoscalar" in rewritten
    assert "综述" not in rewritten
    first = Q.match_queries(p)[0]
    assert first.every
    assert {"higgs", "pseudoscalar"} <= {x for g in first.groups for x in g}
    assert p.relations == ("综述", "相关工作")
    p = Q.analyze("总结CMS VBS SSWW的最新结果")
    for want in ("cms collaboration", "vector boson scattering", "same-sign"):
        assert want in Q.embedded_form(p)
    p = Q.analyze("CMS current SSWW best results")
    phrases = {x for q in Q.match_queries(p) for g in q.groups for x in g}
    assert {"cms", "same sign ww"} <= phrases
    assert not {"current", "best", "results"} & phrases
    assert Q.route("CMS current SSWW best results") == ("works", 3)
    assert Q.route("总结CMS VBS SSWW的最新结果")[0] == "works"
    assert Q.analyze("network 123456 中").content == ()  # "work" within a word, a long number, a single ideograph


def test_default_signatures_and_status(spark):
    from quarry.operators import extract

    docs = spark.createDataFrame([(1, "We measured the branching fraction by a profile likelihood.", False), (2, "Nothing.", False), (3, None, True)], "doc_id long, text string, review boolean")
    got = {r.doc_id: (r.results, r.methods, r.status, r.anomaly) for r in extract.status(extract.signatures(docs), F.col("review")).collect()}
    assert got[1] == (["measurement"], ["statistical_fit"], "ready", None)
    assert got[2] == ([], [], "needs_review", "missing_required_signatures")
    assert got[3] == ([], [], "partial", None)


def test_hashed_vectors_by_brute_force(spark):
    import hashlib

    import numpy as np

    texts = {1: "search alpha beta alpha", 2: "", 3: None, 4: "a__b a b alpha", 5: "gamma " * 50}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)

    def folded(words, dim, kind):
        out, seen = np.zeros(dim), set()
        for f in words + [f"{a}__{b}" for a, b in zip(words, words[1:], strict=False)]:
            if kind == "md5":
                d = hashlib.md5(f.encode()).hexdigest()
                k, sign = int(d[:15], 16) % dim, 1 if int(d[15], 16) % 2 else -1
            else:
                d = hashlib.blake2b(f.encode(), digest_size=16).digest()
                k, sign = int.from_bytes(d[:8], "little") % dim, 1 if d[8] & 1 else -1
            out[k] += sign * (0.5 if "__" in f else 1)
            seen.add(k)
        return out, seen

    for kind, dim in (("md5", 16), ("blake2b", 64)):
        plain = {i: folded((t or "").split(), dim, kind) for i, t in texts.items()}
        idf = np.log(6 / (1 + np.array([sum(k in s for _, s in plain.values()) for k in range(dim)]))) + 1
        assert np.allclose(vectors.slot_idf(docs, dim=dim, kind=kind), idf)
        for r in vectors.hash_vectors(docs, idf, dim=dim, kind=kind).collect():
            want = plain[r.doc_id][0] * idf
            want /= np.linalg.norm(want) or 1
            got = np.zeros(dim)
            got[r.slots] = r.weights
            assert np.allclose(got, want)


def test_embedded_words_and_stored_index(spark, tmp_path):
    assert vectors.embedding_words("Search for τ→μ: <b>results</b> in $\\eta$ Alpha") == ["for", "tau", "to", "mu", "in", "eta", "alpha"]
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "gamma delta"), (4, None)], "doc_id long, text string")
    path = str(tmp_path / "index")
    vectors.write_index(docs, path)
    index = vectors.Index(spark, path)
    got = {r.doc_id: r.score for r in index.cosine(["beta", "gamma"]).collect()}
    assert max(got, key=got.get) == 2
    assert got[2] == pytest.approx(1.0)
    assert got[4] == 0
    assert {r.doc_id for r in index.cosine(["beta"], docs.where("doc_id < 3").select("doc_id")).collect()} == {1, 2}
    assert set(r.score for r in index.cosine([]).collect()) == {0.0}
    assert vectors.slot("abc") == (251, 1.0 if int(__import__("hashlib").md5(b"abc").hexdigest()[15], 16) & 1 else -1.0)


NORMAL_FORMS = [
    (r"$1 3 \mathrm { T e V }$ and $9 7. 7 \mathrm { f b } ^ { - 1 }$ and $1 0 ^ { - 8 }$ with $\tau \to 3 \mu$", ["13 TeV", "97.7 fb^-1", "10^-8", "τ -> 3 μ"], []),
    (
        r"The selection requires $| \eta | < 2 . 4$ and $p _ { \mathrm { T } } > 3 . 5 \mathrm { G e V }$. The transverse mass is $\begin{array} { r } { m _ { \mathrm { T } } = \sqrt { 2 p _ { \mathrm { T } } } } \end{array}$.",
        ["| η | < 2.4", "pT > 3.5 GeV", "mT = sqrt"],
        ["begin array", "end array"],
    ),
    ("The strategy, detailed in Ref., is summarized here. Any muon must have pT > 3.5 GeV . .", ["The strategy is summarized here."], ["detailed in", ".."]),
    ("The exact procedure is detailed in.\x00 The isolation is rI = frac pT (B) pT (B) + sum trkpT.", ["/"], ["\x00", "detailed in.", "frac"]),
    ("aa frac xx yy bb frac", ["aa (xx) / (yy) bb frac"], []),
    ("frac frac aa bb cc", ["((aa) / (bb)) / (cc)"], []),
]


@pytest.mark.parametrize(("text", "wanted", "unwanted"), NORMAL_FORMS)
def test_displayed_form(text, wanted, unwanted):
    from quarry.functions.normalize import display_text

    got = display_text(text)
    for x in wanted:
        assert x in got, got
    for x in unwanted:
        assert x not in got, got


def test_searched_form(spark):
    from quarry.functions import normalize

    got = normalize.search_text("Rare decay <math><mi>η</mi><mo>→</mo><msup><mi>μ</mi><mo>+</mo></msup></math> at $\\sqrt{s}$ = 1 3 TeV and 101 fb$^{-1}$.")
    for x in ("eta", "mu", "sqrt", "13", "101"):
        assert x in got.split()
    assert normalize.search_text("粒子 a&amp;b\u2060c\x01") == "粒 子 a&bc"
    df = spark.createDataFrame([("x_{2} – y",), (None,)], "t string").select(normalize.search_form(F.col("t")).alias("s"), normalize.display_form(F.col("t")).alias("d"))
    assert [tuple(r) for r in df.collect()] == [("x 2 y", "x 2 – y"), ("", "")]


def test_content_lists_become_blocks_and_windows(spark):
    from quarry.operators import blocks

    items = [
        {"type": "title", "text": "Head", "text_level": 1, "page_idx": 0},
        {"type": "paragraph", "text": "Before.", "page_no": 1},
        {"type": "formula", "latex": "x=1"},
        {"type": "discarded", "text": "gone"},
        {"type": "figure", "image_path": "a.png", "image_caption": ["Plot", "one"]},
        {"type": "text", "text": " "},
        {"type": "text", "text": "After."},
    ]
    rows_ = [(1, json.dumps(items)), (2, json.dumps({"data": items[:1]})), (3, "junk"), (4, None)]
    df = blocks.decode(spark.createDataFrame(rows_, "doc_id long, content string"))
    got = [(r.position, r.kind, r.page, r.text) for r in df.where("doc_id = 1").orderBy("position").collect()]
    assert got == [(0, "text", 0, "Head"), (1, "text", 1, "Before."), (2, "equation", None, "x=1"), (4, "image", None, "Plot one"), (6, "text", None, "After.")]
    assert {r.doc_id for r in df.collect()} == {1, 2}
    around = {r.position: (r.role, r.text) for r in blocks.windows(df).collect()}
    assert around == {2: ("formula_window", "Before.\nAfter."), 4: ("asset_window", "Before.\nPlot one\nAfter.")}


def test_pairs_of_a_hub_and_of_blocks(spark, monkeypatch):
    import itertools

    rows_ = [(n, 0) for n in range(40)] + [(n, n % 7 + 1) for n in range(40)] + [(n, n % 5 + 100) for n in range(0, 40, 2)] + [(3, 100), (3, 100)]
    df = spark.createDataFrame(rows_, "n long, v long")
    via = {}
    for n, v in set(rows_):
        via.setdefault(n, set()).add(v)
    want = {(a, b): len(via[a] & via[b]) for a, b in itertools.combinations(sorted(via), 2) if len(via[a] & via[b]) >= 2}
    for block in (2048, 3):  # directly, and by candidates where a neighbour has many nodes
        monkeypatch.setattr(graph, "BLOCK", block)
        got = {(r.src, r.dst): (r.shared, r.score) for r in graph.shared_pairs(df, "n", "v").collect()}
        assert {k: s for k, (s, _) in got.items()} == want
        assert all(abs(x - want[k] / (len(via[k[0]]) * len(via[k[1]])) ** 0.5) < 1e-9 for k, (_, x) in got.items())
    pairs = graph.dealt_pairs(df.distinct(), 4)
    assert pairs.count() == pairs.where("src < dst").count() == sum(len(via[a] & via[b]) for a, b in itertools.combinations(via, 2))


def test_shared_pairs_of_both_ways_in_bounded_parts(spark, monkeypatch):
    import itertools
    import random
    import re

    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(30)) for _ in range(300)}
    df = spark.createDataFrame([*edges, (1, None), (None, 2)], "n long, v long")
    monkeypatch.setattr(graph, "ROWS", 20)
    for node, via in (("n", "v"), ("v", "n")):
        own = {}
        for x, y in edges:
            x, y = (x, y) if node == "n" else (y, x)
            own.setdefault(x, set()).add(y)
        extra = {("n", 1): 1, ("v", 2): 1}
        size = {x: len(ys) + extra.get((node, x), 0) for x, ys in own.items()}
        want = {(a, b): (s, round(s / (size[a] * size[b]) ** 0.5, 9)) for a, b in itertools.combinations(sorted(own), 2) if (s := len(own[a] & own[b])) >= 2}
        found = graph.shared_pairs(df, node, via)
        assert {(r.src, r.dst): (r.shared, round(r.score, 9)) for r in found.collect()} == want
        assert max(map(int, re.findall(r"hashpartitioning\([^()]*, (\d+)\)", found._jdf.queryExecution().executedPlan().toString()))) >= 16
    mirrored = graph.mirrored(found)
    assert mirrored._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    assert mirrored.count() == 2 * len(want)


def test_places_and_quantiles_of_large_groups(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 2, 3000), rng.integers(0, 700, 3000), strict=True)] + [(7, None)]
    df = spark.createDataFrame(data, "g long, v double").repartition(5)
    got = {(r.g, r.v): r.place for r in jobs.place_in_group(df.where("v is not null"), "g", "v").collect()}
    for g in (0, 1):
        order = sorted({v for x, v in data if x == g})
        assert [got[g, v] for v in order] == list(range(1, len(order) + 1))
    for bracket in (1_000_000, 10):
        monkeypatch.setattr(jobs, "BRACKET", bracket)
        for r in jobs.exact_quantiles(df, "g", "v", [0.5, 0.95, 1.0]).where("g < 2").collect():
            values = [v for x, v in data if x == r.g]
            assert np.allclose([r.q_0, r.q_1, r.q_2], np.quantile(values, [0.5, 0.95, 1.0]))
            assert r.n == len(values)


def test_transfer_pairs_works_of_equal_keys_once(spark, monkeypatch):
    import itertools

    from quarry.operators import objects

    keys = {w: set("abc") if w < 40 else {"b", "c", str(w)} if w < 43 else {"z"} for w in range(45)}
    signs = spark.createDataFrame([(w, k) for w, ks in keys.items() for k in ks] + [(0, "a"), (7, None)], "work long, key string")
    paired, deal = [], objects.dealt_pairs
    monkeypatch.setattr(objects, "dealt_pairs", lambda e: paired.append(e.select("n").distinct().count()) or deal(e))
    monkeypatch.setattr(objects, "BLOCK", 6)
    one = lambda w: spark.createDataFrame([(w,)], "work long")
    for least in (1, 2):
        got = {(r.src, r.dst): (r.support, round(r.score, 2)) for r in objects.transfer(signs, one(2), one(3), least).collect()}
        want = {(a, b): n for a, b in itertools.permutations(keys, 2) if a != 3 and (n := len(keys[a] & keys[b])) >= least}
        assert got == {(a, b): (n, round(min(0.99, 0.35 + 0.2 * n + (0.15 if b == 2 else 0)), 2)) for (a, b), n in want.items()}
    assert paired == [5, 5]


def test_transfer_in_blocks_shuffles_no_pairs(spark, monkeypatch):
    import itertools

    from quarry.operators import objects

    keys = {f"w{w}": {str(k) for k in range(w % 7, 40, 2 + w % 5)} if w < 60 else {"1", "2"} for w in range(90)}
    signs = spark.createDataFrame([(w, k) for w, ks in keys.items() for k in ks] + [("w0", "0"), ("w7", None), (None, "1")], "work string, key string")
    monkeypatch.setattr(objects, "ROWS", 0, raising=False)
    monkeypatch.setattr(objects, "dealt_pairs", lambda e: pytest.fail("pairs are shuffled"))
    for name, value in {"NUMBERS": 100, "PIECE": 3, "STRIP": 50, "GIVEN": 7}.items():
        monkeypatch.setattr(objects, name, value, raising=False)
    some = lambda *w: spark.createDataFrame([(x,) for x in w], "work string")
    for least, blocked in ((1, None), (3, some("w3", "w70"))):
        got = [(r.src, r.dst, r.support, round(r.score, 2)) for r in objects.transfer(signs, some("w2", "w71"), blocked, least).collect()]
        want = {(a, b): n for a, b in itertools.permutations(keys, 2) if (blocked is None or a not in ("w3", "w70")) and (n := len(keys[a] & keys[b])) >= least}
        assert sorted(got) == sorted((a, b, n, round(min(0.99, 0.35 + 0.2 * n + (0.15 if b in ("w2", "w71") else 0)), 2)) for (a, b), n in want.items())


def test_contract_and_transfer(spark):
    from quarry.operators import objects

    works = spark.createDataFrame([(1, "A", "A profile likelihood fit sets an upper limit."), (2, "B", "Nothing."), (3, None, None), (4, "D", "BDT; upper limit")], "work_id long, title string, text string")
    found = objects.capsules(works, F.col("work_id") == 4)
    state = {r.work_id: (r.status, r.detail, r.capsule) for r in found.collect()}
    assert state[1] == ("ready", None, "A\nresults: upper limit\nmethods: profile likelihood")
    assert state[2][:2] == ("needs_review", "missing: result, method")
    assert state[4][0] == "partial"
    snapshot = spark.createDataFrame([(2, "odd", []), (4, "ready", [("measurement", "m", "e", 0.9)])], f"work_id long, status string, values array<{objects.VALUE}>")
    got = {r.work_id: (r.status, r.kind, r.confidence, r.source) for r in objects.objects(found, "results", snapshot).collect()}
    assert got == {1: ("ready", "upper_limit", 0.65, "chunks"), 2: ("failed", None, None, "chunks"), 3: ("failed", None, None, "metadata_only"), 4: ("ready", "measurement", 0.9, "structure_capsule")}
    values = objects.object_values(objects.objects(found, "results"))
    typed = objects.signature_objects(values, F.lit("ready"))
    assert typed.where(F.size(objects.violations(typed)) > 0).count() == 0
    bad = typed.limit(1).withColumn("status", F.lit("x")).withColumn("confidence", F.lit(2.0)).withColumn("derivation", F.lit(None).cast("string")).withColumn("source_refs", F.array(F.lit(" "))).withColumn("work_id", F.lit(None).cast("long"))
    assert bad.select(objects.violations(bad)).first()[0] == ["status", "derivation", "source_refs", "confidence", "work"]
    signs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "b"), (2, "b"), (4, None)], "work long, key string")
    edges = {(r.src, r.dst): (r.support, round(r.score, 2)) for r in objects.transfer(signs, spark.createDataFrame([(2,)], "work long"), spark.createDataFrame([(3,)], "work long")).collect()}
    assert edges == {(1, 2): (2, 0.9), (2, 1): (2, 0.75), (1, 3): (1, 0.55), (2, 3): (1, 0.55)}


def test_audit_and_fused_lists(spark):
    from quarry.operators import objects

    texts = spark.createDataFrame([(1, "chunk", "fine"), (1, "block", "x frac y"), (2, "chunk", "a , , b"), (3, "chunk", "Equation: a"), (4, "chunk", "Equation: a / b"), (5, "chunk", "see .. and ... dots - > x")], "doc_id long, level string, text string")
    got = {r.doc_id: (r.ready, r.recommendation) for r in objects.audit(texts).collect()}
    assert got == {1: (True, "none"), 2: (False, "repair_chunks"), 3: (False, "repair_equations"), 4: (True, "none"), 5: (False, "repair_chunks")}
    hits = spark.createDataFrame([("a", 0, 1, "article"), ("b", 0, 2, "note"), ("b", 1, 1, "note"), ("c", 1, 2, None)], "key string, list int, rank long, type string")
    fused = {r.key: r.score for r in objects.fused_lists(hits).collect()}
    assert fused["b"] == pytest.approx(1 / 62 + 1 / 61 - 0.003)
    groups = spark.createDataFrame([("a", "g", 1), ("b", "g", 2), ("c", "h", 1)], "key string, group string, richness int")
    assert [(r.key, r.members, r["rank"]) for r in objects.one_per_group(objects.fused_lists(hits), groups, 5).orderBy("rank").collect()] == [("b", 2, 1), ("c", 1, 2)]


def test_latest_status_survives_restarts(spark, tmp_path):
    from quarry.streaming import windows

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    stamp = lambda m: __import__("datetime").datetime(2024, 1, 1, 0, m)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k, batch in enumerate(([(1, stamp(1), 1, "a", 0.0), (2, stamp(2), 2, "b", 0.0)], [(3, stamp(3), 1, "c", 0.0)], [(4, stamp(0), 2, "z", 0.0)])):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        # The last query starts anew, without the checkpoint of those before.
        query = windows.latest_status(spark, spark.readStream.schema(schema).parquet(source), target, str(tmp_path / ("new" if k == 2 else "old")))
        query.awaitTermination(60)
    got = {r.job: r.s.event_type for r in windows.current(spark, target).collect()}
    assert got == {1: "c", 2: "b"}
    assert len(windows.versions(spark, target)) == 2


def test_edges_of_a_few_nodes_are_those_of_the_whole_graph(spark):
    rows = [(i % 23, (i * i) % 31) for i in range(400)] + [(None, 3), (5, None), (5, 3)]
    edges = spark.createDataFrame(rows, "n long, v long")
    whole = {(r.src, r.dst, r.shared, round(r.score, 12)) for r in graph.mirrored(graph.shared_pairs(edges, "n", "v")).collect() if r.src in (5, 7)}
    assert whole == {(r.src, r.dst, r.shared, round(r.score, 12)) for r in graph.shared_with(edges, "n", "v", [5, 7, 99]).collect()}
    assert whole
    assert graph.shared_with(edges, "n", "v", []).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_nearest_of_a_few_vectors_are_the_first_edges_of_the_whole_graph(spark, repeated):
    rows = [(i, [float((i * 7) % 5), float((i * 3) % 11) - 4, 1.0]) for i in range(60)]
    rows = [(i, [x / sum(y * y for y in v) ** 0.5 for x in v]) for i, v in rows] + [(70, None)]
    e = spark.createDataFrame(rows + rows[10:13] * repeated, "vec_id long, embedding array<double>")
    found = vectors.nearest_to(e, [3, 12, 99], 4).collect()
    for i in (3, 12):
        order = lambda r: (-round(r.score, 9), r.dst)
        want = sorted((r for r in graph.mirrored(vectors.knn_edges(e, 4)).collect() if r.src == i), key=order)[:4]
        got = sorted((r for r in found if r.src == i), key=order)[:4]
        assert [(r.dst, round(r.score, 9)) for r in got] == [(r.dst, round(r.score, 9)) for r in want]
    assert vectors.nearest_to(e, []).count() == 0


def test_hybrid_search_makes_no_edges_but_those_of_its_seeds(spark, monkeypatch):
    from quarry.plans import search as plans

    def whole(*_, **__):
        raise AssertionError("all edges made")

    monkeypatch.setattr(graph, "shared_pairs", whole)
    monkeypatch.setattr(vectors, "knn_edges", whole)
    assert plans.hybrid_works(spark, "/root/testdata/sf0.001").count() > 0
