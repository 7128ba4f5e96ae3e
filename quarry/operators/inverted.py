"""A positional inverted index as a Parquet table: rows are blocks of a word's postings.

A block has the documents of one batch that hold a word, by their keys, with their lengths, how often the word stands in each and where, and
whatever columns a search returns or orders by, as packed numbers: a search reads blocks and nothing else.  Blocks lie in folders by a hash of the word, in the
order of words within files: the words of a query are a few folders and, by the files' statistics, a few row groups.  The blocks of a
common word go to many tasks, so a word that is in every document is many files.  Documents that come later are another segment, a
folder beside the first; a reader takes the segments that the published version lists.  Deleting or changing a document needs a new
index.

The words of a document's fields stand one behind the other with a place left free between fields, so a phrase never reaches
from one field into the next.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import tokens
from quarry.operators.shared import spread
from quarry.operators.versions import Store, Target, Version, derived, stamp

BUCKETS = 64
#: A word is common if one in so many documents of a batch holds it; tasks that a common word's blocks are dealt to, for each one of a rare word's folder.
COMMON, SPREAD = 8, 8
#: Words whose postings are sorted at once.
WORDS = 1 << 20


def bucket(word: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word.encode()) % buckets


# ---- numbers of a block: seven bits a byte, low ones first, the last byte of a number below 128


def _signed(x: np.ndarray) -> np.ndarray:
    """Whole numbers as ones that are not negative: small ones stay small."""
    return (x.astype(np.int64) << 1 ^ x.astype(np.int64) >> 63).view(np.uint64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def packed(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each block begins and the last ends) of numbers whose blocks begin at ``starts``, in order."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        more = np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
        out[ends[at] - size[at] + k] = (values[at] >> np.uint64(7 * k)).astype(np.uint8) & 127 | more
    return out, np.append((ends - size)[starts], len(out)) if len(starts) else np.zeros(1, np.int64)


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of a block."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    size = last - first + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[at] |= (raw[first[at] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def _is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of whole numbers, null as 0 and others from 1 on."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.cast(pa.int64()).fill_null(0).to_numpy()
    return np.where(known, _signed(values) + np.uint64(1), np.uint64(0))


def blocks(rows: DataFrame, key: str, fields: Sequence[str], keep: Sequence[str] = (), analyze: Callable[[Column], Column] = tokens) -> DataFrame:
    """``word``, ``common``, ``n`` documents, ``total`` occurrences, ``data`` and lists of those kept columns that are no whole numbers; one row for each word of a batch.

    ``data`` has, each as n numbers, the differences of the keys, the documents' lengths, the kept whole numbers and how often the
    word stands in each document; then its places, the first of a document as such and the others as differences.  Documents without
    a key are left out."""
    listed = spread(rows.where(F.col(key).isNotNull()).select(key, *keep, *(f for f in fields if f not in (key, *keep)))).select(key, *keep, F.array(*(analyze(F.col(f)) for f in fields)).alias("fields"))
    if not _is_whole(listed.schema[key].dataType):
        raise TypeError(f"the key {key} is to be a whole number")
    whole = [c for c in keep if _is_whole(listed.schema[c].dataType)]
    other = [c for c in keep if c not in whole]
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("common", T.BooleanType()), T.StructField("n", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("data", T.BinaryType()), *(T.StructField(c, T.ArrayType(listed.schema[c].dataType)) for c in other)])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of documents of about WORDS words; a longer document stands alone."""
        for batch in batches:
            offsets = batch.column("fields").flatten().offsets.to_numpy()[:: len(fields)].astype(np.int64)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + WORDS, side="right")) - 1)
                yield batch.slice(a, b - a)
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            flat = batch.column("fields").flatten()
            per_field = np.diff(flat.offsets.to_numpy()) if len(flat) else np.empty(0, np.int64)
            words = flat.flatten().dictionary_encode()
            doc = np.repeat(np.repeat(np.arange(batch.num_rows), len(fields)), per_field)
            if not len(doc):
                continue
            lengths = np.bincount(doc, minlength=batch.num_rows)
            # A word's place: how many words of its document stand before it, and one more for each field before its own.
            place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(np.tile(np.arange(len(fields)), batch.num_rows), per_field)
            code, keys = words.indices.to_numpy(), batch.column(key).cast(pa.int64()).to_numpy()
            order = np.lexsort((place, keys[doc], code))
            doc, code, place = doc[order], code[order], place[order]
            posting = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])  # where each (word, document) begins
            first = np.flatnonzero(np.r_[True, code[posting][1:] != code[posting][:-1]])  # which posting begins each word
            own, tf = doc[posting], np.diff(np.append(posting, len(doc)))
            n = np.diff(np.append(first, len(posting)))
            columns = [_signed(_steps(keys[own], first)), lengths[own].astype(np.uint64), *(_numbers(batch.column(c))[own] for c in whole), tf.astype(np.uint64)]
            # A block's numbers: n of each column, then its places.
            many = n * len(columns) + np.add.reduceat(tf, first)
            base = np.cumsum(many) - many
            values = np.empty(many.sum(), np.uint64)
            within = np.arange(len(posting)) - np.repeat(first, n)
            for k, column in enumerate(columns):
                values[np.repeat(base + k * n, n) + within] = column
            begin = np.repeat(base + len(columns) * n, np.add.reduceat(tf, first))
            values[begin + np.arange(len(doc)) - np.repeat(posting[first], np.add.reduceat(tf, first))] = _steps(place, posting).astype(np.uint64)
            data, offsets = packed(values, base)
            binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            bounds = pa.array(np.append(first, len(posting)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, batch.column(c).take(pa.array(own))) for c in other]
            out = [words.dictionary.take(pa.array(code[posting][first])), pa.array(n * COMMON >= batch.num_rows), pa.array(n.astype(np.int32)), pa.array(np.add.reduceat(tf, first)), binary, *lists]
            yield pa.RecordBatch.from_arrays(out, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(schema.fields, out, strict=True)]))

    return listed.mapInArrow(run, schema)


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the number before, but where a run begins."""
    out = np.diff(x, prepend=0)
    out[starts] = x[starts]
    return out


def _sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums within runs of the given sizes."""
    total = np.cumsum(x)
    begin = np.cumsum(sizes) - sizes
    return total - np.repeat(total[begin] - x[begin], sizes)


def write_segment(rows: DataFrame, path: str, key: str, fields: Sequence[str], keep: Sequence[str] = (), analyze: Callable[[Column], Column] = tokens, buckets: int = BUCKETS) -> dict:
    """Write the blocks below ``path``; returns what a search needs of the segment: how many documents and words there are."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = -(-parts // buckets)
    code = F.crc32(F.col("word").cast("binary"))
    deal = F.when(F.col("common"), F.pmod(F.xxhash64(F.substring("data", 1, 12)), F.lit(SPREAD * each))).otherwise(F.floor(code / buckets) % each)
    found = blocks(rows, key, fields, keep, analyze).withColumn("bucket", (code % buckets).cast("int"))
    dealt = found.repartition(parts, "bucket", deal).drop("common").sortWithinPartitions("bucket", "word")
    dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    kept = rows.select(key, *keep).schema
    notes = {"documents": 0, "words": 0, "schema": dealt.schema.json(), "kept": kept.json(), "buckets": buckets}
    total = spark.read.schema(dealt.schema).parquet(path).agg(F.sum("total").alias("n")).first().n
    return notes | {"documents": rows.where(F.col(key).isNotNull()).count(), "words": int(total or 0)}


class Index:
    """An index as one version has it; ``segments`` are (path, notes) of ``write_segment``."""

    def __init__(self, spark: SparkSession, segments: Sequence[tuple[str, dict]]):
        self.spark, self.segments = spark, list(segments)
        notes = [n for _, n in self.segments]
        self.kept, self.buckets = T.StructType.fromJson(json.loads(notes[0]["kept"])), notes[0]["buckets"]
        self.key, *self.keep = self.kept.names
        self.n, total = sum(x["documents"] for x in notes), sum(x["words"] for x in notes)
        self.avgdl = total / self.n if self.n else 0.0
        schema = T.StructType.fromJson(json.loads(notes[0]["schema"]))
        tables = [spark.read.schema(schema).parquet(path) for path, x in self.segments if x["words"]]
        self.rows = tables[0] if tables else spark.createDataFrame([], schema)
        for t in tables[1:]:
            self.rows = self.rows.unionByName(t)

    def blocks(self, words: Sequence[str]) -> DataFrame:
        """The blocks of some words: only their folders are read."""
        names = sorted(set(words))
        return self.rows.where(F.col("bucket").isin(sorted({bucket(w, self.buckets) for w in names}))).where(F.col("word").isin(names)).drop("bucket")

    def postings(self, words: Sequence[str], places: bool = True) -> DataFrame:
        """The blocks' postings as rows: ``word``, the key, the kept columns, ``dl``, ``tf`` and, if asked for, ``places``."""
        whole = [f.name for f in self.kept.fields[1:] if _is_whole(f.dataType)]
        names, kinds = [f.name for f in self.kept.fields], {f.name: f for f in self.kept.fields}
        where = [T.StructField("places", T.ArrayType(T.IntegerType()))] if places else []
        schema = T.StructType([T.StructField("word", T.StringType()), *self.kept.fields, T.StructField("dl", T.LongType()), T.StructField("tf", T.IntegerType()), *where])

        def one(n: int, data: bytes) -> dict[str, pa.Array]:
            values = unpacked(data)
            columns = values[: n * (3 + len(whole))].reshape(3 + len(whole), n)
            tf = columns[-1].astype(np.int64)
            out = {self_key: pa.array(np.cumsum(_unsigned(columns[0]))), "dl": pa.array(columns[1].astype(np.int64)), "tf": pa.array(tf.astype(np.int32))}
            for c, x in zip(whole, columns[2:-1], strict=True):
                out[c] = pa.array(_unsigned(x - np.uint64(1)), mask=x == 0)
            if places:
                at = _sums(values[columns.size :].astype(np.int64), tf).astype(np.int32)
                out["places"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), pa.array(at))
            return out

        self_key = self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (word, n, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("word", "n", "data")), strict=True)):
                    found = one(n, data)
                    own = [found[c] if c in found else batch.column(c).slice(i, 1).flatten() for c in names]
                    columns = [pa.array([word] * n), *(x.cast(_arrow(kinds[c].dataType)) for c, x in zip(names, own, strict=True)), found["dl"], found["tf"], *([found["places"]] if places else [])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return self.blocks(words).mapInArrow(run, schema)

    def ids(self) -> DataFrame:
        """The keys of the documents that have words."""
        key = self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(_unsigned(unpacked(data)[:n])))], names=[key])

        return self.rows.select("n", "data").mapInArrow(run, f"`{key}` long").distinct()

    def frequencies(self, words: Sequence[str]) -> dict[str, int]:
        """How many documents hold each of some words: the blocks tell, their postings are not read."""
        found = self.blocks(words).groupBy("word").agg(F.sum("n").alias("n"))
        return dict.fromkeys(words, 0) | {r.word: r.n for r in found.collect()}  # a row a word

    def counted(self, phrases: Sequence[str]) -> DataFrame:
        """The key, kept columns, ``dl`` and ``tf``, the phrases' occurrences, of documents that hold any of the phrases' words."""
        split = [p.split() for p in phrases]
        longer = {w for ws in split if len(ws) > 1 for w in ws}
        names = list(dict.fromkeys(w for ws in split for w in ws))
        here = {w: F.col("word") == w for w in names}
        found = self.postings(names, places=bool(longer))
        own = [F.coalesce(F.sum(F.when(here[w], F.col("tf"))), F.lit(0)).cast("int").alias(f"tf_{i}") for i, w in enumerate(names)]
        own += [F.first(F.when(here[w], F.col("places")), ignorenulls=True).alias(f"at_{i}") for i, w in enumerate(names) if w in longer]
        rows = found.groupBy(self.key, *self.keep, "dl").agg(*own) if names else found.withColumn("tf_0", F.lit(0))

        def count(words: list[str]) -> Column:
            at = [names.index(w) for w in words]
            if len(words) == 1:
                return F.col(f"tf_{at[0]}")
            places = F.col(f"at_{at[0]}")
            for k, i in enumerate(at[1:], 1):
                places = F.array_intersect(places, _back(F.col(f"at_{i}"), k))
            return F.when(places.isNotNull(), F.size(places)).otherwise(0)

        tf = F.array(*(count(ws) for ws in split)) if split else F.array().cast("array<int>")
        return rows.select(self.key, *self.keep, "dl", tf.alias("tf"))


def _arrow(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def _back(places: Column, steps: int) -> Column:
    return F.transform(places, lambda x: x - steps)


def write(store: Store, name: str, rows: DataFrame, key: str, fields: Sequence[str], keep: Sequence[str] = (), analyze: Callable[[Column], Column] = tokens, inputs: Sequence[str] = ()) -> Version:
    """Build an index as a target of a store, unless it is current."""
    return store.build({name: target(rows, key, fields, keep, analyze, inputs)})


def target(rows: DataFrame, key: str, fields: Sequence[str], keep: Sequence[str] = (), analyze: Callable[[Column], Column] = tokens, inputs: Sequence[str] = ()) -> Target:
    """An index as something to build: its first segment holds all rows."""

    def make(path: str, others: dict) -> dict:
        return {"segments": [[f"{path}/first", write_segment(rows, f"{path}/first", key, fields, keep, analyze)]]}

    return Target(make, inputs, recipe=f"packed totals {key} {fields} {keep} {BUCKETS}")


def append(store: Store, name: str, rows: DataFrame, fields: Sequence[str], analyze: Callable[[Column], Column] = tokens, inputs: Sequence[str] = ()) -> Version:
    """Add new documents as another segment; the index then counts as made of ``inputs`` as they are now.  Ids that the index has are an error."""
    now = store.current()
    entry = now.targets[name]
    old = Index(store.spark, entry["notes"]["segments"])
    if not old.ids().join(rows.select(old.key), old.key, "left_semi").isEmpty():
        raise ValueError("some of these documents are in the index")
    path = f"{entry['path']}/{stamp(store.spark, entry['path'])}"
    notes = write_segment(rows, path, old.key, fields, old.keep, analyze, old.buckets)
    of = {**entry["of"], "files": stamp(store.spark, *inputs)}
    return store.publish({**now.targets, name: {**entry, "of": of, "notes": {"segments": [*entry["notes"]["segments"], [path, notes]]}}}, now)


def read(store: Store, name: str, version: Version | None = None) -> Index:
    return Index(store.spark, (version or store.current()).targets[name]["notes"]["segments"])


def of_table(spark: SparkSession, name: str, inputs: Sequence[str], rows: DataFrame, key: str, fields: Sequence[str], keep: Sequence[str] = (), analyze: Callable[[Column], Column] = tokens) -> Index:
    """The index of an input table, built once for the files that it has."""
    t = target(rows, key, fields, keep, analyze)
    found = derived(spark, f"words-{name}", inputs, t.make, t.recipe)
    return Index(spark, found["notes"]["segments"])
