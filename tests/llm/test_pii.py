"""Personal data: the base against plain searches, the scores against plain loops, and what contexts discover."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from quarry.llm import pii
from quarry.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    twice = [2 * int(d) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kept = [
        ("email", list(EMAIL.finditer(text))),
        ("ip", [m for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]),
        ("card", [m for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]),
        ("phone", [m for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]),
    ]
    return [(k, len(ms), [f"{k}:{m.start()}:{m.end()}" for m in ms]) for k, ms in kept]


def check(docs, found):
    got = sorted(map(tuple, found.collect()), key=repr)
    want = []
    for r in docs.select("doc_id", "text").collect():
        kinds = base(r.text)
        want.append((r.doc_id, *(n for _, n, _ in kinds), hashlib.sha256(",".join(s for *_, spans in kinds for s in spans).encode()).hexdigest(), kinds))
    want.sort(key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: repr(x[:6])), sorted(want, key=lambda x: repr(x[:6])), strict=True):
        assert g[:6] == w[:6]
        assert {s for *_, spans in w[6] for s in spans} <= set(g[6].split(",") if g[6] else [])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_base_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    check(docs, QUERIES["op13_contextual_pii"](spark, f"/root/testdata/{sf}"))


def test_base_of_odd_texts(spark, odd_docs):
    texts = [
        "a@b.c_z@w.org x@y@z.de .@-.- a@b", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 99999999999.1.1.1", "4111 1111 1111 1111-4111111111111111 4111-1111-1111-1112",
        "+1 (377) 555-0271 . 5 +49-30-1234567, +1 2", "é+1 234 567 890 🙂 4111111111111111 ü@x.de", "1" * 5000 + " " + "9 " * 3000, "a." * 3000 + "@b.cc", "", None,
        " ".join(f"u{i}@h{i}.org" for i in range(1500)),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, pii.digests(pii.find(docs)))
    check(odd_docs, pii.digests(pii.find(odd_docs)))
    empty = docs.where("doc_id < 0")
    assert pii.digests(pii.find(empty)).count() == 0


def test_strict_pattern_within_long_runs_is_linear(spark):
    """A run of a million letters is read once, not once from each letter."""
    docs = spark.createDataFrame([(1, "a" * 1_000_000 + " x@y.org")], "doc_id long, text string")
    assert pii.digests(pii.find(docs)).first().spans == "email:1000001:1000008"


@pytest.fixture(scope="module")
def planted():
    pick = random.Random(3)
    words = "alpha beta gamma delta river stone house green paper light water under cloud".split()
    some = lambda n: " ".join(pick.choice(words) for _ in range(n))
    number = lambda: f"{pick.randint(100, 999)} 555-{pick.randint(1000, 9999)}"
    texts = [f"{some(5)} call me on +1 {number()} {some(3)}" for _ in range(20)]
    texts += [f"{some(5)} call me on {number()} {some(3)}" for _ in range(4)]
    texts += [f"{some(5)} write to {pick.choice(words)}{i}@mail.example.com {some(3)}" for i in range(20)]
    texts += [f"{some(5)} write to {pick.choice(words)}{i} at mail dot example dot com {some(3)}" for i in range(4)]
    texts += [f"{some(5)} order {pick.randint(10**15, 10**16)} {some(3)}" for _ in range(40)]
    texts += ["known: " + re.search(r"\+1 (.*555-\d+)", texts[0])[0].replace("+", "")]
    return texts


def test_contexts_discover_identifiers(spark, planted):
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    added = {}
    for r in pii.digests(pii.find(docs)).collect():
        own = {s for *_, spans in base(planted[r.doc_id]) for s in spans}
        added[r.doc_id] = [(k, planted[r.doc_id][int(a) : int(b)]) for k, a, b in (s.split(":") for s in r.spans.split(",") if s and s not in own)]
    assert all([k for k, _ in added[i]] == ["phone"] for i in range(20, 24))
    assert all(added[i][0][0] == "email" and added[i][0][1].endswith("dot com") for i in range(44, 48))
    assert [k for k, _ in added[len(planted) - 1]] == ["phone"]  # the same digits as one that the base knows
    assert not any(added[i] for i in [*range(20), *range(24, 44), *range(48, 88)])


def test_scores_follow_the_graph(spark, planted):
    """Three rounds over the edges in plain loops."""
    docs = spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string")
    found = pii.occurrences(pii.scan(docs))
    links = [tuple(r) for r in pii.edges(found).select("pattern", "instance").collect()]
    first = {r.instance: r for r in pii.instances(found).collect()}
    score = {i: [r[k] for k in pii.KINDS] for i, r in first.items()}
    for _ in range(pii.ROUNDS):
        total = defaultdict(lambda: [[0.0, 0.0] for _ in pii.KINDS])
        for p, i in links:
            for k, kind in enumerate(pii.KINDS):
                known = max(s for j, s in enumerate(score[i]) if j != k) >= pii.SURE
                total[p][k][0] += score[i][k]
                total[p][k][1] += (1 - score[i][k]) * (pii.UNKNOWN if first[i][f"may_{kind}"] and not known else 1.0)
        doubt = defaultdict(lambda: [1.0] * len(pii.KINDS))
        for p, i in links:
            for k, (part, rest) in enumerate(total[p]):
                n = part + rest
                share, z2 = part / n, pii.Z**2
                low = (share + z2 / (2 * n) - pii.Z * math.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
                if low >= pii.SURE:
                    doubt[i][k] *= 1 - low
        score = {i: [max(r[k], 1 - d) for k, d in zip(pii.KINDS, doubt[i] if i in doubt else [1.0] * 4)] for i, r in first.items()}
    got = {r.instance: [r[k] for k in pii.KINDS] for r in pii.scores(pii.edges(found), pii.instances(found)).collect()}
    assert got.keys() == score.keys()
    assert all(abs(a - b) < 1e-9 for i in got for a, b in zip(got[i], score[i]))


def test_no_python_in_the_plan(spark, capsys):
    pii.digests(pii.find(spark.createDataFrame([(1, "x@y.org")], "doc_id long, text string"))).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
