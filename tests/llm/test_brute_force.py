"""Operators and their registered queries against plain versions of themselves, on the smallest tables."""

import hashlib
import math
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import html_layout, langid, scaled_sketch, unigram
from quarry.llm.queries import PIECE_BPE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ---- language identification


def test_character_grams_are_counted_one_by_one():
    """Texts of equal grams, counted as strings, have equal features; grams that differ seldom share one."""

    def grams(text):
        keep = []
        for c in text.lower():
            if c.isalpha():
                keep.append(c)
            elif keep and keep[-1] != " ":
                keep.append(" ")
        if not any(c.isalpha() for c in text):
            return None
        # What is no letter counts once, behind a letter; the text lies between two spaces.
        body = " " + "".join(keep).lstrip(" ") + " "
        return Counter(body[i : i + k] for k in range(1, langid.ORDER + 1) for i in range(len(body) - k + 1))

    for t in ("Été 1999, l'eau!", "a", "A  b", "ÄÖ\nß", "x9y", "中文 naïve"):
        c, want = langid.counts(t), grams(t)
        assert c.sum() == sum(want.values())
        assert sorted(c[c > 0].tolist()) == sorted(want.values()) or (c > 0).sum() < len(want)
    assert langid.counts("12 !?") is None and langid.counts("") is None
    assert (langid.counts("Abc,  d") == langid.counts("abc d")).all()


def test_leader_steps_by_the_book(monkeypatch):
    """FTRL with an elastic net, one coordinate after the other."""
    monkeypatch.setattr(langid, "BITS", 3)
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(8, 3, replace=False)), rng.random(3), int(rng.integers(0, 3))) for _ in range(12)]
    z, n = np.zeros((9, 3)), np.zeros((9, 3))

    def weight(i, k):
        if abs(z[i, k]) <= langid.L1:
            return 0.0
        return -(z[i, k] - math.copysign(langid.L1, z[i, k])) / ((langid.BETA + math.sqrt(n[i, k])) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for at, v, y in rows:
            pairs = [*zip(at.tolist(), v.tolist(), strict=True), (8, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in pairs for k in range(3)}
            s = [sum(x * w[i, k] for i, x in pairs) for k in range(3)]
            p = [math.exp(x) / sum(math.exp(u) for u in s) for x in s]
            for i, x in pairs:
                for k in range(3):
                    g = x * (p[k] - (k == y))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / langid.ALPHA * w[i, k]
                    n[i, k] += g * g
    got, bias = langid.fit_weights(rows, 3)
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(8)])
    assert np.allclose(bias, [weight(8, k) for k in range(3)])


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    s = rng.normal(0, 1, (400, 3))
    s[np.arange(400), y] += 1
    s *= 4

    def loss(t):
        z = s / t
        return np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(400), y])

    grid = np.exp(np.linspace(math.log(0.5), math.log(20), 400))
    assert abs(langid.fit_temperature(s, y) - grid[np.argmin([loss(t) for t in grid])]) < 0.1


# ---- fingerprints


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return {low[i : i + scaled_sketch.SHINGLE] for i in range(len(low) - scaled_sketch.SHINGLE + 1)} or ({low} if low else set())


def containment(a, b):
    if not a or not b:
        return float(not a and not b)
    return len(a & b) / min(len(a), len(b))


def test_fingerprints_against_whole_shingle_sets(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op9_scaled_sketch"](spark, SF).collect()}
    ids = sorted(texts)
    off = {"edited": [], "next": []}
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off["edited"].append(abs(got[i].near_edited - containment(shingles(t), shingles(edited))))
        off["next"].append(abs(got[i].near_next - containment(shingles(t), shingles(nxt))))
        # The sketch holds exactly the hashes below its reach: as many as the texts' shingles are, about one in SCALE.
        reach, kept = scaled_sketch.unpack(got[i].fingerprint)
        n = len(shingles(t))
        assert len(kept) >= min(n, scaled_sketch.FLOOR)
        if reach == scaled_sketch.LIMIT:
            assert abs(len(kept) - n / scaled_sketch.SCALE) <= 6 * math.sqrt(n / scaled_sketch.SCALE) + 1
    assert np.mean(off["edited"]) < 0.08
    assert np.percentile(off["edited"], 95) < 0.25
    assert np.mean(off["next"]) < 0.02
    same = {}
    for i in ids:
        same.setdefault(texts[i], set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_fingerprints_of_repeated_rows_and_missing_ids(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (None, "no id here at all"), (2, None)]
    got = scaled_sketch.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("x"))).collect()
    assert len(got) == 4
    first = [r for r in got if r.doc_id == 1]
    assert first[0].fingerprint == first[1].fingerprint
    assert sorted(r.near_next for r in first) == [0.0, 1.0]


# ---- token files, packing, pieces: the registered queries


def ids_of(path, texts, end):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = False
    return {i: [*plain.encode(t, add_special_tokens=False).ids, end] for i, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file_query(spark, texts, paths):
    want = ids_of(paths["word"], texts, 2)
    start = 0
    got = {r.doc_id: r for r in QUERIES["op1_token_file"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want[i]), crc(want[i]))
        start += len(want[i])


def test_packing_query(spark, texts, paths):
    want = ids_of(paths["byte"], texts, 0)
    by_doc, by_sequence = {}, {}
    for r in QUERIES["op6_packing"](spark, SF).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        assert r.doc_tokens == len(want[r.doc_id])
    for i, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[i])
    assert set(by_doc) == set(texts)
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * sum(map(len, want.values()))


def test_unigram_query(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op10_unigram"](spark, SF).collect()}
    assert set(got) == set(texts)
    assert all(r.same for r in got.values())
    own = unigram.processor(PIECE_BPE)
    some = sorted(texts)[:20]
    for i, ids in zip(some, own.encode([texts[i] for i in some]), strict=True):
        assert own.decode([ids]) == [texts[i]]


# ---- pages


BULLET = "-"


class Words(HTMLParser):
    """Every word of a page without style sheets, outside what is never shown."""

    HIDDEN = {"script", "style", "title", "template", "noscript", "head", "textarea", "select", "option"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN - {"head", "option"}:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in self.HIDDEN - {"head", "option"}:
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if not self.depth:
            self.words += data.split()


def test_pages_keep_their_words_in_order(spark):
    """On pages that hide nothing, the words are those of a plain parser, in its order."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in QUERIES["op7_html_layout"](spark, SF).collect()}
    assert set(got) == {r.page_id for r in pages}
    checked = 0
    for r in pages:
        low = (r.html or "").lower()
        if not low or any(x in low for x in ("display", "hidden", "<select", "<img", "<input", "<svg", "<math", "<iframe", "<ol", "<hr")):
            continue
        plain = Words()
        plain.feed(r.html)
        plain.close()
        # List marks are added, cells are aligned: without marks and blanks it is the same text.
        bare = lambda words: "".join(w for w in words if w != BULLET)
        assert bare((got[r.page_id] or "").split()) == bare(plain.words)
        checked += 1
    assert checked >= 20


def test_pages_repeat_clash_and_are_empty(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (None, "<p>b")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(7))
    got = html_layout.extract(df).collect()
    assert sorted((r.page_id or 0, r.text or "") for r in got) == [(0, "b"), (1, "a"), (1, "a"), (2, "")]
    assert html_layout.extract(df.where("page_id > 5")).count() == 0
