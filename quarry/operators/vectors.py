"""Hashed vectors with inverse document frequencies, exact cosines, and k-nearest-neighbour edges in blocks.

A hashed vector has DIM slots, so it is folded within the row: one Arrow pass numbers the distinct words and pairs of a
batch, hashes each once and adds up signed weights.  Features are never rows and never shuffled; what leaves a task for the
document frequencies is one count for each slot.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.normalize import search_text
from quarry.functions.text import EMBEDDING_STOPWORDS, tokens
from quarry.operators.shared import spread, written

DIM = 768
#: Least vectors of a block, and blocks as soon as there are vectors for them: every pair of blocks is a task.
BLOCK, BLOCKS = 1024, 12
#: Most numbers in the vectors of a block: with more, there are more blocks.
NUMBERS = 1 << 22
#: Rows and columns that are multiplied at once.
STRIP, TILE = 256, 4096
#: Vectors whose nearest are ordered in one part.
SOURCES = 1 << 14
#: Rows that are folded together: rows times slots are held as an array.
ROWS = 1024
#: What the query language embeds a text as: a text's words, each hashed as ``md5`` (SQL can follow) or ``blake2b`` (as prescribed).
HASHES = ("md5", "blake2b")


def slot(feature: str, dim: int = DIM, kind: str = "md5") -> tuple[int, float]:
    """(slot, sign) of a feature."""
    if kind == "md5":
        digest = hashlib.md5(feature.encode(), usedforsecurity=False).hexdigest()
        return int(digest[:15], 16) % dim, 1.0 if int(digest[15], 16) & 1 else -1.0
    raw = hashlib.blake2b(feature.encode(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little") % dim, 1.0 if raw[8] & 1 else -1.0


def slots_of(features: list[bytes], dim: int = DIM, kind: str = "md5") -> tuple[np.ndarray, np.ndarray]:
    """``slot`` of many features: their digests are read as one array of numbers."""
    if kind == "md5":
        md5 = hashlib.md5
        x = np.frombuffer(b"".join([md5(f, usedforsecurity=False).digest() for f in features]), ">u8")[::2].astype(np.uint64)
        return (x >> np.uint64(4)).astype(np.int64) % dim, np.where(x & np.uint64(1), 1.0, -1.0)
    raw = np.frombuffer(b"".join([hashlib.blake2b(f, digest_size=16).digest() for f in features]), "<u8")
    return (raw[::2] % np.uint64(dim)).astype(np.int64), np.where(raw[1::2] & np.uint64(1), 1.0, -1.0)


def embedding_words(text: str | None) -> list[str]:
    """The words that are embedded: those of the searched form, folded, without the prescribed stop words."""
    return [w for w in (x.casefold() for x in re.findall(r"\w+", search_text(text))) if w not in EMBEDDING_STOPWORDS]


@F.arrow_udf(T.ArrayType(T.StringType()))
def embedding_tokens(texts: pa.Array) -> pa.Array:
    return pa.array([embedding_words(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def fold(lists: pa.Array, dim: int = DIM, kind: str = "md5") -> tuple[np.ndarray, np.ndarray]:
    """(values, present) of a column of word lists, one row each: signed sums of words (1 each) and adjacent pairs (1/2 each; so counts a word that holds ``__``), and which slots have any."""
    n = len(lists)
    flat = lists.flatten().dictionary_encode()
    index = flat.indices.to_numpy().astype(np.int64)
    words = flat.dictionary.to_pylist()
    size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(n), size)
    same = row[1:] == row[:-1]
    pair, number = np.unique((index[:-1] * len(words) + index[1:])[same], return_inverse=True)
    if not words:
        return np.zeros((n, dim)), np.zeros((n, dim), bool)
    raw = [w.encode() for w in words]
    left = [w + b"__" for w in raw]
    first, second = np.divmod(pair, len(words))
    at, sign = slots_of(raw + [left[i] + raw[j] for i, j in zip(first.tolist(), second.tolist(), strict=True)], dim, kind)
    weight = sign * 0.5
    weight[: len(words)] = sign[: len(words)] * np.array([0.5 if "__" in w else 1.0 for w in words])
    rows, which = np.concatenate((row, row[1:][same])), np.concatenate((index, number + len(words)))
    place = rows * dim + at[which]
    values = np.bincount(place, weights=weight[which], minlength=n * dim).reshape(n, dim)
    return values, np.bincount(place, minlength=n * dim).reshape(n, dim) > 0


def _folded(batch: pa.RecordBatch, dim: int, kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for a in range(0, batch.num_rows, ROWS):
        part = batch.slice(a, ROWS)
        yield part, *fold(pa.concat_arrays([part.column("toks")]), dim, kind)


def _worded(docs: DataFrame, doc_id: str, text: str, words: Callable[[Column], Column]) -> DataFrame:
    return spread(docs.select(F.col(doc_id), F.col(text).alias("_text"))).select(doc_id, words(F.col("_text")).alias("toks"))


def slot_idf(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dim: int = DIM, kind: str = "md5", words: Callable[[Column], Column] = tokens) -> np.ndarray:
    """The inverse document frequency of each slot; tasks send one count a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(dim + 1, np.int64)
        for batch in batches:
            for part, _, present in _folded(batch, dim, kind):
                count[:dim] += present.sum(0)
                count[dim] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(count)], names=["slot", "n"])

    found = np.zeros(dim + 1)
    for r in _worded(docs, doc_id, text, words).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # dim + 1 rows
        found[r.slot] = r.n
    return np.log((1.0 + found[dim]) / (1.0 + found[:dim])) + 1


def hash_vectors(docs: DataFrame, idf: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text", dim: int = DIM, kind: str = "md5", words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc_id, slots, weights): sparse vectors of unit length; without ``idf`` every slot weighs the same.  A text without words has none."""
    weight = np.ones(dim) if idf is None else idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values, _ in _folded(batch, dim, kind):
                x = values * weight
                x /= np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
                r, c = np.nonzero(x)
                ends = pa.array(np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x[r, c]))], names=[doc_id, "slots", "weights"])

    worded = _worded(docs, doc_id, text, words)
    return worded.mapInArrow(run, T.StructType([worded.schema[0], T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]))


def hash_sums(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dim: int = DIM, kind: str = "md5", words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc_id, slots, sums): the signed sums of the slots that a text has, those of zero too, as a table: texts are cut and hashed once for frequencies and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values, present in _folded(batch, dim, kind):
                r, c = np.nonzero(present)
                ends = pa.array(np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values[r, c]))], names=[doc_id, "slots", "sums"])

    worded = _worded(docs, doc_id, text, words)
    return written(worded.mapInArrow(run, T.StructType([worded.schema[0], T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("sums", T.ArrayType(T.DoubleType()))])), "sums")


def sums_idf(sums: DataFrame, dim: int = DIM) -> np.ndarray:
    """``slot_idf`` from ``hash_sums``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(dim + 1, np.int64)
        for batch in batches:
            count[:dim] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=dim)
            count[dim] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(count)], names=["slot", "n"])

    found = np.zeros(dim + 1)
    for r in sums.select("slots").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # dim + 1 rows
        found[r.slot] = r.n
    return np.log((1.0 + found[dim]) / (1.0 + found[:dim])) + 1


def _weights(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, weight, length of each row's vector) of a batch of ``hash_sums``."""
    row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
    at = batch.column(1).flatten().to_numpy()
    w = batch.column(2).flatten().to_numpy() * idf[at]
    return row, at, w, np.sqrt(np.bincount(row, weights=w * w, minlength=batch.num_rows))


def weighed(sums: DataFrame, idf: np.ndarray) -> DataFrame:
    """``hash_vectors`` from ``hash_sums``."""
    key = sums.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, w, length = _weights(batch, idf)
            keep = w != 0
            row, at, w = row[keep], at[keep], w[keep]
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(w / length[row]))], names=[key, "slots", "weights"])

    return sums.mapInArrow(run, T.StructType([sums.schema[0], T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]))


def hash_idf_vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dim: int = DIM) -> DataFrame:
    """(doc_id, bucket, weight): the vectors' entries as rows."""
    sums = hash_sums(docs, doc_id, text, dim)
    found = weighed(sums, sums_idf(sums, dim))
    return found.select(doc_id, F.explode(F.arrays_zip("slots", "weights")).alias("x")).select(doc_id, F.col("x.slots").cast("long").alias("bucket"), F.col("x.weights").alias("weight"))


def query_vector(words: list[str], idf: np.ndarray | None, dim: int = DIM, kind: str = "md5") -> np.ndarray:
    """A query's unit vector; all zeros without words."""
    values, _ = fold(pa.array([words], pa.list_(pa.string())), dim, kind)
    x = values[0] * (1.0 if idf is None else idf)
    return x / (np.linalg.norm(x) or 1.0)


def hash_cosine(docs: DataFrame, words: list[str], doc_id: str = "doc_id", text: str = "text", dim: int = DIM, kind: str = "md5", analyze: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc_id, score): cosines of all documents that have a vector with the query's; texts are folded in one pass."""
    sums = hash_sums(docs, doc_id, text, dim, kind, analyze)
    idf = sums_idf(sums, dim)
    q = query_vector(words, idf, dim, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, w, length = _weights(batch, idf)
            score = np.bincount(row, weights=w * q[at], minlength=batch.num_rows)
            keep = np.flatnonzero(length > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(score[keep] / length[keep])], names=[doc_id, "score"])

    return sums.mapInArrow(run, T.StructType([sums.schema[0], T.StructField("score", T.DoubleType())]))


# ---- indexes that stay


def write_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", dim: int = DIM, kind: str = "blake2b", words: Callable[[Column], Column] = embedding_tokens) -> None:
    """Vectors and their frequencies as two tables under ``path``; a new index replaces an old one only when it is whole."""
    spark = docs.sparkSession
    sums = hash_sums(docs, doc_id, text, dim, kind, words)
    idf = sums_idf(sums, dim)
    version = uuid.uuid4().hex
    weighed(sums, idf).write.parquet(f"{path}/{version}/vectors")
    spark.createDataFrame([(dim, kind, idf.tolist())], "dim int, kind string, idf array<double>").write.parquet(f"{path}/{version}/frequencies")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")


class Index:
    """An index that ``write_index`` wrote; one table scan a query, no text is read."""

    def __init__(self, spark: SparkSession, path: str):
        version = spark.read.parquet(f"{path}/current").first().version
        self.vectors = spark.read.parquet(f"{path}/{version}/vectors")
        r = spark.read.parquet(f"{path}/{version}/frequencies").first()
        self.dim, self.kind, self.idf = r.dim, r.kind, np.array(r.idf)

    def cosine(self, words: list[str], allowed: DataFrame | None = None) -> DataFrame:
        """(id, score) of every vector, or of those in ``allowed`` (its first column)."""
        q = query_vector(words, self.idf, self.dim, self.kind)
        key = self.vectors.columns[0]
        kept = self.vectors if allowed is None else self.vectors.join(allowed.select(F.col(allowed.columns[0]).alias(key)), key, "left_semi")
        weights = F.lit(q.tolist())
        return kept.select(key, F.aggregate(F.zip_with("slots", "weights", lambda s, w: w * F.get(weights, s)), F.lit(0.0), lambda a, x: a + x).alias("score"))


def dense_cosine_topk(vectors: DataFrame, query_id: int, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    q = vectors.where(F.col(vec_id) == query_id).select(vector).first()[0]
    dot = F.aggregate(F.zip_with(F.col(vector), F.array(*(F.lit(float(x)) for x in q)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    order = [F.round("score", 9).desc(), F.col(vec_id)]
    best = vectors.where(F.col(vec_id) != query_id).select(vec_id, dot.alias("score")).orderBy(*order).limit(k)
    return best.select(vec_id, F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def _best(src: np.ndarray, dst: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each source's k best, by score to nine digits and then the least id; in the order of sources."""
    order = np.lexsort((dst, -np.round(score, 9), src))
    return order[np.arange(len(order)) - np.searchsorted(src[order], src[order]) < k]


class _Found:
    """Pairs (row, id, score) that may be among the k best of their rows, which meet ids in ascending order; a row's ``cut`` rises as better ones are met."""

    def __init__(self, cut: np.ndarray, k: int):
        self.cut, self.k, self.parts, self.n = cut, k, [], 0

    def add(self, row: np.ndarray, dst: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.cut[row]
        self.parts.append((row[keep], dst[keep], score[keep]))
        self.n += len(self.parts[-1][0])
        if self.n > 4 * self.k * len(self.cut):
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, dst, score = (np.concatenate(z) for z in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        keep = _best(row, dst, score, self.k)
        row, dst, score = row[keep], dst[keep], score[keep]
        last = np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1
        # Whatever comes later has a larger id: it must be better by a ninth digit.
        self.cut[row[last]] = np.maximum(self.cut[row[last]], np.round(score[last], 9) + 4e-10)
        self.parts, self.n = [(row, dst, score)], len(row)
        return row, dst, score


def _nearest(x: np.ndarray, x_ids: np.ndarray, x_cut: np.ndarray, y: np.ndarray, y_ids: np.ndarray, y_cut: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(src, dst, score): each row of x with its k best of y from its cut on, and, with cuts of y, the other way round.  Ids ascend.

    Single precision finds what may reach a cut; scores are sums of double products."""
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    longest = lambda z: float(np.sqrt(np.einsum("ij,ij->i", z, z).max(initial=0.0)))
    slack = (x.shape[1] + 4) * 2.0**-22 * longest(x) * longest(y) + 1e-30
    back = None if y_cut is None else _Found(y_cut, k)
    for a in range(0, len(x), STRIP):
        some, found = slice(a, a + STRIP), _Found(x_cut[a : a + STRIP], k)
        for b in range(0, len(y), TILE):
            tile = slice(b, b + TILE)
            near = x32[some] @ y32[tile].T
            able = near >= (found.cut[:, None] - slack).astype(np.float32)
            if back is not None:
                able |= near >= (back.cut[None, tile] - slack).astype(np.float32)
            r, c = np.divmod(np.flatnonzero(able), able.shape[1])
            score = (x[some] @ y[tile].T)[r, c] if 32 * len(r) > able.size else np.einsum("ij,ij->i", x[a + r], y[b + c])
            other = x_ids[a + r] != y_ids[b + c]
            r, c, score = r[other], c[other], score[other]
            found.add(r, y_ids[b + c], score)
            if back is not None:
                back.add(b + c, x_ids[a + r], score)
        r, dst, score = found.prune()
        yield x_ids[a + r], dst, score
    if back is not None:
        r, dst, score = back.prune()
        yield y_ids[r], dst, score


def knn_edges(vectors: DataFrame, k: int = 10, least: float = 0.35, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(src, dst, score), src < dst: each vector's k nearest with a cosine of at least ``least``, as undirected edges.

    Vectors are dealt into blocks.  First each block is compared with itself: a vector's k-th best there bounds what can be among its
    best elsewhere.  Then every pair of blocks is a task, which multiplies the blocks once for both directions, strip by strip, and looks
    only at what reaches a bound: exact, whatever the size.  A vector goes to every other block; there are BLOCKS, and more only where
    a block would hold more than NUMBERS numbers.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col(vector).isNotNull())
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = max(1, min(BLOCKS, -(-n // BLOCK)), -(-n * (dim or 1) // NUMBERS))
    own = F.pmod(F.xxhash64(vec_id), F.lit(blocks)).cast("int")
    dealt = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), own.alias("own"))

    def numbers(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = group.column("id").to_numpy()
        return ids, group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)

    def within(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, x = numbers(group)
        src, dst, score = (np.concatenate(z) for z in zip(*_nearest(x, ids, np.full(len(ids), least), x, ids, None, k), strict=True))
        first, end = np.searchsorted(src, ids), np.searchsorted(src, ids, side="right")
        bound = np.full(len(ids), -np.inf)
        whole = end - first >= k
        bound[whole] = np.round(score[first[whole] + k - 1], 9)
        # Rows of one id, if there are any, share what either found.
        ends = np.where(np.r_[True, ids[1:] != ids[:-1]], end, first)
        offsets = pa.array(np.append(0, np.cumsum(ends - first)).astype(np.int32))
        return pa.table({"id": group.column("id"), "v": group.column("v"), "own": group.column("own"), "bound": bound, "dst": pa.ListArray.from_arrays(offsets, pa.array(dst, pa.int64())), "score": pa.ListArray.from_arrays(offsets, pa.array(score, pa.float64()))})

    def between(group: pa.Table) -> pa.Table:
        i = pc.equal(group.column("own"), group.column("i"))
        sides = []
        for side in (group.filter(i).sort_by("id"), group.filter(pc.invert(i)).sort_by("id")):
            sides += [*reversed(numbers(side)), np.maximum(least, side.column("bound").to_numpy() - 6e-10)]
        found = list(_nearest(*sides, k)) if len(sides[0]) and len(sides[3]) else []
        src, dst, score = (np.concatenate(z) for z in zip(*found, strict=True)) if found else ([], [], [])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "score": pa.array(score, pa.float64())})

    kind = T.StructType([*dealt.schema.fields, T.StructField("bound", T.DoubleType()), T.StructField("dst", T.ArrayType(T.LongType())), T.StructField("score", T.ArrayType(T.DoubleType()))])
    first = dealt.repartition(4 * blocks, "own").groupBy("own").applyInArrow(within, kind)
    near = lambda rows: rows.select(F.col("id").alias("src"), F.explode(F.arrays_zip("dst", "score")).alias("x")).select("src", "x.dst", "x.score")
    found = near(first)
    if blocks > 1:
        first = written(first, "blocks")
        pairs = first.select("id", "v", "bound", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).where("own <> other")
        pairs = pairs.select("id", "v", "bound", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).repartition(blocks * blocks, "i", "j")
        found = near(first).unionByName(pairs.groupBy("i", "j").applyInArrow(between, "src bigint, dst bigint, score double"))
        found = found.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SOURCES)), "src")
    nearest = Window.partitionBy("src").orderBy(F.round("score", 9).desc(), "dst")
    top = found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k)
    return top.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("score").alias("score"))


def nearest_to(vectors: DataFrame, ids: Sequence, k: int = 10, least: float = 0.35, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(src, dst, score): of each of ``ids``, a list of bounded length, the k first edges in ``mirrored(knn_edges(...))``, by one scan.

    These are its own k nearest: an edge that only the other end has among its nearest comes after them, and there is none where
    fewer than k are near enough.  That needs ids that don't repeat; where one does that is met here, all edges are made.
    """
    spark = vectors.sparkSession
    x = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    own = x.where(F.col("id").isin(list(ids))).collect()
    sources, queries = np.array([r.id for r in own], np.int64), np.array([r.v for r in own], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(sources):
                continue
            found = batch.column("id").to_numpy()
            score = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1).astype(np.float64) @ queries.T
            r, c = np.nonzero((score >= least) & (found[:, None] != sources))
            keep = _best(sources[c], found[r], score[r, c], k)
            yield pa.RecordBatch.from_arrays([pa.array(sources[c][keep]), pa.array(found[r][keep]), pa.array(score[r, c][keep])], names=["src", "dst", "score"])

    rows = x.mapInArrow(run, "src bigint, dst bigint, score double")
    nearest = Window.partitionBy("src").orderBy(F.round("score", 9).desc(), "dst")
    top = rows.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).drop("r")
    best = top.collect()  # k rows of each source
    if len(set(sources.tolist())) < len(sources) or len({(r.src, r.dst) for r in best}) < len(best):
        edges = knn_edges(vectors, k, least, vec_id, vector)
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
        return both.where(F.col("src").isin(list(ids)))
    return spark.createDataFrame(best, "src bigint, dst bigint, score double")
