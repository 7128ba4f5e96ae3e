"""Token files, piece encoding and packing: exact against the libraries, round trips, odd inputs."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import cutting_stock, packing, token_file, unigram
from quarry.llm.encoding import CachedEncoder

ODD = ["", " ", "\n\n", "a  b", "a \n b  c", "  lead", "trail  ", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ é ｆ", "tab\t\tx\r\n\r\ny", "it's we'll 123 4.5 🙂🙂", "a\x1c\x1db", "Ǆ ﬁ", "foo.\n\nBar", "​　x", "ß" * 50, "x²3 a²b", "don't.'s", "word,!? (x)"]


@pytest.mark.parametrize(("name", "style"), [("word", "words"), ("byte", "spaced")])
def test_cached_encoding_is_the_library_s(paths, name, style):
    plain = Tokenizer.from_file(paths[name])
    own = CachedEncoder(paths[name], style)
    texts = ODD + [" ".join(ODD)] + [f"The {i}th text, with word{i % 7}." for i in range(300)]
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000, 140_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000)
    coder = token_file.Coder(token_file.frequencies(np.bincount(ids, minlength=49_409)))
    payload, points = coder.encode(ids)
    assert (coder.decode(payload, points, n) == ids).all()
    if n > 1000:
        p = np.bincount(ids) / n
        bound = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert len(payload) < 1.05 * bound + 8 * token_file.LANES


def test_frequencies_sum_to_a_power_of_two():
    for counts in ([1], [0, 5, 0], [1] * 5000, [10**9] + [1] * 3000):
        f = token_file.frequencies(np.array(counts))
        assert int(f.sum()).bit_count() == 1
        assert ((f > 0) == (np.array(counts) > 0)).all()


def test_token_file(spark, odd_docs, paths, tmp_path):
    path = str(tmp_path / "tokens")
    token_file.write(odd_docs, path, paths["word"], "words", 2)
    got = token_file.read(spark, path).orderBy("start").collect()
    plain = Tokenizer.from_file(paths["word"])
    docs = sorted((r.doc_id, r.text or "") for r in odd_docs.collect())
    start = 0
    for r, (i, t) in zip(got, docs, strict=True):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (i, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_damaged_token_file_is_noticed(spark, odd_docs, paths, tmp_path):
    from pyspark.sql import functions as F

    token_file.write(odd_docs, str(tmp_path / "a"), paths["word"], "words", 2)
    bad = spark.read.schema(token_file.SCHEMA).parquet(str(tmp_path / "a")).withColumn("payload_crc", F.col("payload_crc") + 1)
    bad.write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="damaged block"):
        token_file.read(spark, str(tmp_path / "b")).collect()


def test_empty_table(spark, odd_docs, paths, tmp_path):
    none = odd_docs.where("doc_id < 0")
    token_file.write(none, str(tmp_path / "t"), paths["word"], "words", 2)
    assert token_file.read(spark, str(tmp_path / "t")).count() == 0
    assert unigram.round_trip(none, paths["piece"]).count() == 0
    assert packing.pack_documents(none, paths["byte"], "spaced", 0).count() == 0


def test_unigram_matches_the_library(paths):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    own = unigram.processor(paths["piece"])
    model = pb.ModelProto()
    with open(paths["piece"], "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = float(own.score[i])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [t for t in ODD if "\x1c" not in t] + ["The quick brown fox " + str(i) for i in range(200)]
    cost = lambda ids: sum(own.score[i] if own.kind[i] == unigram.NORMAL else own.penalty / 3 for i in ids)
    for a, b in zip(own.encode(texts), library.encode(texts), strict=True):
        assert list(a) == b or abs(cost(a) - cost(b)) < 1e-3  # equally good paths


def test_unigram_search_is_the_best_path(paths):
    own = unigram.processor(paths["piece"])
    piece = {p: s for p, s, k in zip(own.pieces, own.score, own.kind, strict=True) if k == unigram.NORMAL}
    for word in (" thoughtful", " unbelievable", " zzq", "\n", "   x"):
        text = word.replace(" ", unigram.MARK)
        best = [0.0] + [-1e18] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                s = piece.get(text[start:end], own.penalty if end == start + 1 else None)
                if s is not None:
                    best[end] = max(best[end], best[start] + s)
        ids = np.frombuffer(own._search([word])[0], "<i4")
        assert abs(sum(own.score[i] if own.kind[i] == unigram.NORMAL else own.penalty for i in ids) - best[-1]) < 1e-6 or any(own.kind[i] == unigram.BYTE for i in ids)


def test_unigram_round_trip(odd_docs, paths):
    got = unigram.round_trip(odd_docs, paths["piece"]).collect()
    assert len(got) == 9
    assert all(r.same for r in got)
    decoded = {r.doc_id: r.text for r in unigram.decode(unigram.encode(odd_docs, paths["piece"]), paths["piece"]).collect()}
    assert decoded == {r.doc_id: r.text or "" for r in odd_docs.collect()}


def check_pieces(pieces, capacity, sizes):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, n in sizes.items():
        spans = sorted((r.start, r.length) for r in by_doc[i])
        assert sum(x for _, x in spans) == n
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(spark, paths):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 150, 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.pack_documents(docs, paths["byte"], "spaced", 0, capacity=64).collect()
    plain = Tokenizer.from_file(paths["byte"])
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    padding = check_pieces(pieces, 64, {i: len(x) for i, x in ids.items()})
    assert padding < 0.02 * sum(map(len, ids.values()))
    for r in pieces:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]


def test_packing_odd_documents(odd_docs, paths):
    pieces = packing.pack_documents(odd_docs.dropDuplicates(["doc_id"]), paths["byte"], "spaced", 0).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 6, 7, 8}
    check_pieces(pieces, 1024, {r.doc_id: r.doc_tokens for r in pieces})


def test_linear_program_meets_its_bound():
    rng = np.random.default_rng(0)
    lengths = np.arange(1, 64)
    demand = rng.integers(1, 200, 63)
    patterns, times, bound = cutting_stock.solve(lengths, demand, 64)
    assert (patterns @ lengths <= 64).all()
    assert (times @ patterns >= demand - 1e-6).all()
    assert bound - 1e-6 <= times.sum() <= bound * 1.01
    uses, left = cutting_stock.round_patterns(patterns, times, demand, np.ones(len(patterns), bool))
    assert (left >= 0).all()
    assert (uses @ patterns + left == demand).all()
