"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its character trigrams as written (hashed into 2**BITS) and its words' recurrences (how far back the same
word last stood, in powers of two, or that it is new).  Both are counted, damped by logarithms and weighted by inverse
document frequencies over all documents; recurrences have a fifth of a vector's squared length, trigrams the rest.  A
truncated singular value decomposition of the labelled vectors gives RANK latent dimensions.
The labelled vectors are broadcast: at most about SAMPLE of them, drawn by a hash of the id, whatever the corpus.  Each
block of documents takes its exact cosines with all of them as one matrix product; the K nearest vote with the POWER-th
power of their cosines.

Defined cases: null text is the empty text, which has the one trigram of an empty text and so a score; without any
label the score is 0.5; equal cosines: the earlier vector in order of hash is nearer; repeated rows each get a row; an
empty table gives an empty result.  Other columns pass through; result columns of the same name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import arrow_map, slices, texts_of, tune
from quarry.llm.sampling import hash_below

BITS = 12
RANK = 64
#: Labelled documents that are broadcast, about.
SAMPLE = 6000
K = 25
POWER = 8
#: Recurrence terms: a new word, and a gap's number of binary digits.
GAPS = 24
#: Length of a vector's recurrence block beside the trigram block of length 1.
GAP_WEIGHT = 0.5
FEATURES = (1 << BITS) + GAPS
CUT = 0.3
SLICE = 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def trigrams(text: str) -> np.ndarray:
    code = np.frombuffer((" " + text + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = code[:-2] * _ODD[0] + code[1:-1] * _ODD[1] + code[2:] * _ODD[2] if len(code) > 2 else code[:1]
    return np.bincount((fold(h)).astype(np.int64), minlength=1 << BITS)


def fold(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * _ODD[1] >> np.uint64(64 - BITS)


def recurrences(texts: list[str]) -> np.ndarray:
    """How many words of each text are new, and how many last stood each number of words back (by its binary digits)."""
    words = [t.encode().split() for t in texts]
    flat = [w for ws in words for w in ws]
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    key = doc * (len(number) + 1) + np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    order = np.argsort(key, kind="stable")
    gap = np.zeros(len(flat), np.int64)
    if len(flat):
        again = np.diff(key[order]) == 0
        gap[order[1:][again]] = np.diff(order)[again]
    digits = np.minimum(GAPS - 1, np.ceil(np.log2(gap + 1))).astype(np.int64)
    return np.bincount(doc * GAPS + digits, minlength=len(texts) * GAPS).reshape(len(texts), GAPS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: the trigram block of length 1 beside the recurrence block, then scaled."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        c = trigrams(t)
        at = np.flatnonzero(c)
        v = (1 + np.log(c[at])) * idf[at]
        out[i, at] = v / max(1e-12, np.sqrt(v @ v))
    gaps = np.log1p(recurrences(texts)) * idf[1 << BITS :]
    out[:, 1 << BITS :] = GAP_WEIGHT * gaps / np.maximum(1e-12, np.linalg.norm(gaps, axis=1, keepdims=True))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices([len(t) for t in texts], SLICE):
                for t in texts[a:b]:
                    df[: 1 << BITS] += trigrams(t) > 0
                df[1 << BITS :] += (recurrences(texts[a:b]) > 0).sum(0)
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.concatenate(([n], df)))], names=["feature", "n"])

    df, n = np.zeros(FEATURES, np.int64), 0
    for r in docs.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r.feature < 0:
            n = r.n
        else:
            df[r.feature] = r.n
    return df, n


class Model:
    def __init__(self, idf: np.ndarray, basis: np.ndarray, points: np.ndarray, labels: np.ndarray):
        self.idf, self.basis, self.points, self.labels = idf, basis.astype(np.float32), points.astype(np.float32), labels.astype(np.float64)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.zeros(len(texts))
        for a, b in slices([len(t) + 2000 for t in texts], SLICE):
            v = vectors(texts[a:b], self.idf) @ self.basis
            v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
            cosine = v @ self.points.T
            k = min(K, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(1e-6, np.take_along_axis(cosine, near, 1).astype(np.float64)) ** POWER
            out[a:b] = (w * self.labels[near]).sum(1) / w.sum(1)
        return np.clip(out, 0, 1)


def latent_basis(x: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors, by subspace iteration from a fixed start."""
    rank = max(1, min(rank, *x.shape))
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank]


def fit(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows where ``train`` (on the id) holds; frequencies come from all documents."""
    tune(docs.sparkSession)
    df, n = document_frequencies(docs.select(F.col(text).alias("text")))
    idf = np.log((1 + n) / (1 + df)) + 1
    marked = labels.where(train & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y")).withColumn("h", F.xxhash64(doc_id))
    total = marked.count()
    # At most about `sample` ids: small enough to broadcast.
    chosen = marked.where(hash_below("h", F.lit(0), min(1.0, sample / max(1, total)))).select(doc_id, "y", "h")
    rows = docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(chosen), doc_id).select("h", F.col("y").cast("double").alias("y"), "text")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = vectors(texts_of(batch, "text"), idf).astype(np.float16)
            return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array([x.tobytes() for x in v], pa.binary())], names=["h", "y", "v"])

        return f

    found = sorted(arrow_map(rows, "h bigint, y double, v binary", make).collect(), key=lambda r: (r.h, r.v))
    if not found:
        return Model(idf, np.zeros((1, 1)), np.zeros((0, 1)), np.zeros(0))
    x = np.stack([np.frombuffer(r.v, np.float16) for r in found]).astype(np.float32)
    basis = latent_basis(x, RANK)
    points = x @ basis
    return Model(idf, basis, points / np.maximum(1e-9, np.linalg.norm(points, axis=1, keepdims=True)), np.array([r.y for r in found]))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score and predicted."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("score", "predicted")
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]
    sent = spark.sparkContext.broadcast(model)  # SAMPLE x RANK and terms x RANK numbers

    def make():
        m = sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = m.scores(texts_of(batch, text))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*names, "score", "predicted"])

        return f

    return arrow_map(docs, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), make)
