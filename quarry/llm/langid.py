"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (1 to ORDER letters or spaces, lower case, other characters as spaces) hash into 2**BITS features.
Document frequencies count every training document.  The weights are learned by follow-the-regularised-leader (FTRL
proximal) with an elastic net, so that most of them are exactly 0, on a bounded sample: about PER_LANG documents of each
language, drawn by a hash of the id.  A part of the sample sets the temperature that calibrates the scores.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be
learned; a language with a single document still counts; of equally likely languages the first in order of name wins;
rows without text or language are not learned from; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import arrow_map, texts_of, tune
from quarry.llm.sampling import hash_below

ORDER = 3
BITS = 14
#: Documents of each language in the sample that the weights are fitted on.
PER_LANG = 600
#: The share of the sample that sets the temperature.
CALIBRATE = 0.2
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
UNKNOWN = "und"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _letters() -> np.ndarray:
    table = np.zeros(65536, bool)
    for c in range(65535):
        table[c] = chr(c).isalpha()
    return table


_TABLE: list[np.ndarray] = []


def counts(text: str) -> np.ndarray | None:
    """How often each feature occurs in the text; None for a text without a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _TABLE[0][np.minimum(code, 65535)]
    if len(high := np.flatnonzero(code > 0xFFFF)):
        letter[high] = [chr(c).isalpha() for c in code[high].tolist()]
    if not letter.any():
        return None
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate((code[:1] * 0 + np.uint64(32), code[keep], code[:1] * 0 + np.uint64(32)))
    h = np.zeros(len(code), np.uint64)
    out = np.zeros(1 << BITS, np.int64)
    for k in range(ORDER):
        h = h[: len(code) - k] * _ODD[1] + (code[k:] + np.uint64(k + 1)) * _ODD[0]
        out += np.bincount(((h ^ (h >> np.uint64(31))) * _ODD[2] >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return out


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(documents that have each feature, documents with a letter), over all rows; each task sends its sums."""

    def run(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in texts_of(batch, "text"):
                if (c := counts(t)) is not None:
                    df += c > 0
                    n += 1
        if n:
            hit = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], names=["feature", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in rows:
        if r.feature < 0:
            n = r.n
        else:
            df[r.feature] = r.n
    return df, n


def vector(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a text: logarithmic counts times inverse document frequencies, of length 1."""
    at = np.flatnonzero(c)
    v = (1 + np.log(c[at])) * idf[at]
    return at, v / max(1e-12, math.sqrt(float(v @ v)))


class Model:
    """weights[feature, language], bias, temperature; plain arrays, small enough to send to every task."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights.astype(np.float32), bias, temperature

    def predict(self, text: str) -> tuple[str, float]:
        c = counts(text) if self.langs else None
        if c is None:
            return UNKNOWN, 0.0
        at, v = vector(c, self.idf)
        z = (v @ self.weights[at].astype(np.float64) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(z))
        return self.langs[k], float(min(1.0, p[k] / p.sum()))


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL over the rows, in order, EPOCHS times."""
    size = (1 << BITS) + 1  # the last feature is the bias
    z, n = np.zeros((size, n_langs)), np.zeros((size, n_langs))

    def weight(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, v, y in rows:
            at, v = np.append(at, size - 1), np.append(v, 1.0)
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p[None, :]
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    w = weight(z, n)
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, between 1/2 (a sample that the weights separate would sharpen without end) and 20."""

    def loss(log_t: float) -> float:
        s = scores / math.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    a, b = -math.log(2), math.log(20)
    for _ in range(60):
        c, d = a + (b - a) * 0.382, a + (b - a) * 0.618
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Learn from the rows where ``train`` holds."""
    tune(docs.sparkSession)
    rows = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(size)
    if not langs:
        return Model([], np.zeros(1), np.zeros((1, 0)), np.zeros(0), 1.0)
    df, n = document_frequencies(rows, "text")
    idf = np.log((1 + n) / (1 + df)) + 1

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [counts(t) for t in texts_of(batch, "text")]
            ok = [i for i, c in enumerate(found) if c is not None]
            at = [np.flatnonzero(found[i]) for i in ok]
            pick = pa.array(ok, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("h").take(pick), batch.column("lang").take(pick), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([np.minimum(found[i][x], 65535).astype("<u2").tobytes() for i, x in zip(ok, at, strict=True)], pa.binary())],
                names=["h", "lang", "at", "n"],
            )

        return f

    chosen = rows.withColumn("h", F.xxhash64("id", "text")).where(hash_below("h", F.col("lang"), {k: per_lang / v for k, v in size.items()}))
    sample = sorted(arrow_map(chosen.select("h", "lang", "text"), T.StructType([T.StructField("h", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())]), make).collect(), key=lambda r: (r.h, r.lang))
    data = []
    for r in sample:
        c = np.zeros(1 << BITS, np.int64)
        c[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u2")
        data.append((*vector(c, idf), langs.index(r.lang)))
    if not data:
        return Model([], np.zeros(1), np.zeros((1, 0)), np.zeros(0), 1.0)
    held = int(len(data) * CALIBRATE)
    w, b = fit_weights(data[held:], len(langs))
    t = fit_temperature(np.array([v @ w[at] + b for at, v, _ in data[:held]]), np.array([y for *_, y in data[:held]])) if held >= 20 else 1.0
    return Model(langs, idf, w, b, t)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    sent = spark.sparkContext.broadcast(model)  # features x languages: bounded by the model's size, not by the data

    def make():
        m = sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [m.predict(t) for t in texts_of(batch, text)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

        return f

    return arrow_map(docs, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), make)
