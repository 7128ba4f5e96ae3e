"""Spelling variants: the words one edit away from each word, the form that each word varies, and the last form of the chain.

Two words are near if they differ by one inserted, deleted or replaced code point.  Let m be the shorter's length.  The edit
stands at one place of 0..m (in a run of equal letters at the run's end), so the pair agrees in all that lies before and after
that place.  Each word is keyed for both lengths that a pair with it can have, by all of it but one half of the places; keys of
more than ``GROUP`` words are halved again, until one place is left.  Tasks hold the words of whole keys.  There, for each place,
the words with the same beginning are an interval in forward order, those with the same end an interval in the order of the
reversed words, and a wavelet tree over the second order's ranks, in the first order, reports what lies in both.  So each pair is
found in one key, at one place, once from either side.

Defined cases: a null text has no words, an empty table gives no rows, a null ``doc_id`` reads as an empty text in the deleting
rule, repeated rows count each.  A word without near words has ``n_near`` 0, no form, and is its own root; ties of the largest
count go to the first in code-point order.  Only ``doc_id`` and ``text`` are read; other columns don't matter.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, trim, tune
from quarry.llm.wavelet import Wavelet

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, DELETES = 5, 3, 97
#: Words of a key, above which it is halved.
GROUP = 1 << 16
#: Keyed words of a task, about.
SHARD = 1 << 17
#: Ranges that are looked up at once.
CHUNK = 1 << 16
PLACE = ["m", "a", "b", "key"]


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word n``: runs of letters, of which one in ``DELETES`` (by its document and itself) lost a letter, counted over all texts."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    h, run = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.col("run")
    at = (h % F.length(run)).cast("int")
    word = F.when(h % DELETES == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(m: Column, a: Column, b: Column) -> Column:
    """All of the word but what lies at the places a..b-1 of m."""
    word, tail = F.col("word"), F.greatest(m - b, F.lit(0))
    return F.concat(word.substr(F.lit(1), a), F.lit(" "), word.substr(F.length(word) - tail + 1, tail))


def _placed(words: DataFrame) -> DataFrame:
    """Each word for each length ``m`` of a pair's shorter word and each half ``a..b-1`` of the places 0..m, with its key."""
    m, length = F.col("m"), F.length("word")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.floor(m / 2).cast("int").alias("b")), F.struct(F.floor(m / 2).cast("int").alias("a"), (m + 1).alias("b"))))
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).select("word", "n", "m", halves.alias("half")).select("word", "n", "m", "half.a", "half.b")
    return rows.withColumn("key", _key(F.col("m"), F.col("a"), F.col("b")))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b"))))
    rows = rows.select("word", "n", "m", halves.alias("half")).select("word", "n", "m", "half.a", "half.b")
    return rows.withColumn("key", _key(F.col("m"), F.col("a"), F.col("b")))


def keyed(words: DataFrame, group: int = GROUP) -> DataFrame:
    """The words under their keys; no key with more than one place has more than ``group`` words."""
    done, rows = [], _placed(words)
    while True:
        large = materialize(rows.groupBy(*PLACE).agg(F.count("*").alias("size")).where((F.col("size") > group) & (F.col("b") - F.col("a") > 1)).drop("size"), "large-keys")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        done.append(rows.join(large, PLACE, "left_anti"))
        rows = materialize(_halved(rows.join(large, PLACE, "left_semi")), "halved-keys")


class Block:
    """The words of one length, sorted, with the wavelet tree from forward to backward order."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words, kind="stable")
        self.words, self.counts, self.width = words[order], counts[order], words.dtype.itemsize // 4
        self.codes = self.words.view(np.uint32).reshape(-1, self.width)
        turned = np.ascontiguousarray(self.codes[:, ::-1]).view(words.dtype).ravel()
        self.by_end = np.argsort(turned, kind="stable")
        self.turned = turned[self.by_end]
        rank = np.empty(len(order), np.int64)
        rank[self.by_end] = np.arange(len(order))
        self.tree = Wavelet(rank)

    def near(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, number of a word) for the words that begin with ``starts[q]`` and end with ``ends[q]``."""
        first, last = _interval(self.words, starts, self.width)
        low, high = _interval(self.turned, np.ascontiguousarray(ends[:, ::-1]), self.width)
        query, value = self.tree.report(first, last, low, high)
        return query, self.by_end[value]


def _interval(ordered: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the ordered words those that begin so lie."""

    def found(fill: int, side: str) -> np.ndarray:
        full = np.full((len(begin), width), fill, np.uint32)
        full[:, : begin.shape[1]] = begin
        return np.searchsorted(ordered, full.view(f"<U{width}").ravel(), side=side)

    return found(0, "left"), found(0x10FFFF, "right")


def _links(m: int, a: int, b: int, short: Block | None, long: Block | None) -> Iterator[tuple[Block, np.ndarray, Block, np.ndarray]]:
    """(block, its words' numbers, block, near words' numbers) for all near pairs whose edit stands at a..b-1, from either side."""
    for i in range(a, b):
        for source, target, cut in ((short, short, i + 1), (short, long, i), (long, short, i + 1)):
            if source is None or target is None or source is target and i >= m:
                continue
            codes, rows = source.codes, np.arange(len(source.words))
            if source is long and i < m:  # a letter less: the last of a run goes
                rows = rows[codes[:, i] != codes[:, i + 1]]
            for k in range(0, len(rows), CHUNK):
                part = codes[rows[k : k + CHUNK]]
                query, other = target.near(part[:, :i], part[:, cut:])
                own = rows[k : k + CHUNK][query]
                if target is long and i < m or source is target:  # not the word itself, nor a run's earlier place
                    keep = target.codes[other, i] != codes[own, i]
                    own, other = own[keep], other[keep]
                yield source, own, target, other


def _shard(rows: pa.Table) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words found, largest count, first word of that count) for the words of a task's keys."""
    m, a, b = (rows.column(c).to_numpy() for c in "mab")
    words, counts = np.array(rows.column("word").to_pylist(), object), rows.column("n").to_numpy()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for place in sorted(set(zip(m.tolist(), a.tolist(), b.tolist(), strict=True))):
        here = (m == place[0]) & (a == place[1]) & (b == place[2])
        blocks = [Block(words[at].astype(f"<U{size}"), counts[at]) if (at := here & (lengths == size)).any() else None for size in (place[0], place[0] + 1)]
        for source in blocks:
            if source is None:
                continue
            near, best, form = np.zeros(len(source.words), np.int64), np.zeros(len(source.words), np.int64), [""] * len(source.words)
            for mine, own, target, other in _links(*place, *blocks):
                if mine is not source or not len(own):
                    continue
                near += np.bincount(own, minlength=len(near))
                order = np.lexsort((other, -target.counts[other], own))
                first = order[np.r_[True, np.diff(own[order]) != 0]]
                for w, n, y in zip(own[first].tolist(), target.counts[other[first]].tolist(), target.words[other[first]].tolist(), strict=True):
                    if n > best[w] or n == best[w] and y < form[w]:
                        best[w], form[w] = n, y
            for w in np.flatnonzero(near).tolist():
                yield str(source.words[w]), int(near[w]), int(best[w]), form[w]


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word n n_near best``: how many of the words are near, and the near word of the largest count as (minus n, word)."""
    tune(words.sparkSession)
    rows = keyed(words, group).select(*PLACE, "word", "n")
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * words.count() / SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if got:
            found = list(zip(*_shard(pa.Table.from_batches(got).select(["m", "a", "b", "word", "n"])), strict=True)) or [[]] * 4
            for k in range(0, len(found[0]), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + CHUNK], t) for x, t in zip(found, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "count", "other"])
        trim()

    found = rows.repartition(parts, *PLACE).mapInArrow(run, "word string, near long, count long, other string")
    best = F.when(F.col("near") > 0, F.struct((-F.col("count")).alias("minus_n"), F.col("other").alias("word")))
    both = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(0).cast("long").alias("count"), F.lit(None).cast("string").alias("other")).unionByName(found.withColumn("n", F.lit(None).cast("long")))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word root`` for the words that have a form: pointers are doubled until none leads on.

    A form's count is twice its word's at least, so a chain is as long as the logarithm of the largest count at most."""
    at = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        at = materialize(at, "roots")
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if at.join(onward, "root", "left_semi").isEmpty():
            return at
        at = at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word form root n n_near form_n`` for the counted words ``word n``."""
    found, n = near_words(words, group), -F.col("best.minus_n")
    is_form = n >= 2 * F.col("n")
    forms = materialize(found.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", "n_near", F.when(is_form, n).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """The spelling variants of all words of the documents."""
    return variants(materialize(vocabulary(docs), "vocabulary"))
