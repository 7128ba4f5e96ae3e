"""Quality rules: word, line and symbol statistics of a document against thresholds that each language and source sets itself.

Fixed cutoffs stay only in the base rules (too few words, too many repeated words).  Every other limit is a fence of the
document's own group (language, source): the group's highest tenth begins at some value, and the fence lies REACH times as
far beyond it as it lies from the median; lower fences mirror that with the lowest tenth.  Quantiles are read from a
mergeable sketch: counts of the values of a statistic after all but their leading ``BITS`` binary digits are cleared, so
that a quantile is at most 1/2**(BITS-1) below the true one.  Counts add up, hence sketches merge in any order and a rerun
gives the same thresholds.  Where nine in ten documents of a group agree, a statistic's grain stands for the distance.

Defined cases: null text has no words and fails; null language or source is a group of its own; a group of fewer than
``MIN_GROUP`` documents uses the merged sketch of its language, and a language of fewer that of the whole corpus; repeated
rows count as often as they occur; an empty table gives an empty result.  Other columns pass through; a column named like
a result column is replaced by it.  Repeated windows are found by 64-bit hashes of word numbers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import arrow_map, fmix64, slices, texts_of, tune, union_all

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
BITS = 7
MIN_GROUP = 200
#: Characters of text that are held as arrays at once.
SLICE = 1 << 21
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_adjacent")
#: Statistic: (numerator, denominator, factor, grain, has an upper fence, has a lower fence).
FENCES = {
    "symbol_rate": ("n_symbols", "n_words", 1000, 10, True, False),
    "upper_rate": ("n_upper", "n_letters", 1000, 5, True, False),
    "adjacent_rate": ("n_adjacent", "n_words", 1000, 5, True, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000, 50, True, False),
    "word_length": ("word_chars", "n_words", 10, 3, True, True),
    "letter_rate": ("n_letters", "word_chars", 1000, 10, False, True),
}
REACH = 6
LIMITS = [*(f"max_{k}" for k, v in FENCES.items() if v[4]), *(f"min_{k}" for k, v in FENCES.items() if v[5])]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Bits of a code point (those from 65535 on share the last entry): 1 letter, 2 upper case, 4 blank, 8 symbol."""
    table = np.zeros(65536, np.uint8)
    for c in range(65535):
        ch = chr(c)
        table[c] = ch.isalpha() | ch.isupper() << 1 | (ch in BLANKS) << 2 | (ch in SYMBOLS) << 3
    return table


def measure(texts: list[str]) -> np.ndarray:
    """STATS of each text, as an array of one row per text."""
    out = np.zeros((len(texts), len(STATS)), np.int64)
    for a, b in slices([len(t) for t in texts], SLICE):
        out[a:b] = _measure(texts[a:b])
    return out


def _measure(texts: list[str]) -> np.ndarray:
    n = len(texts)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    kind = _classes()[np.minimum(code, 65535)]
    ends = np.cumsum([len(t) for t in texts])

    def per_text(bit: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum((kind & bit) != 0, dtype=np.int64)))
        return np.diff(total[np.concatenate(([0], ends))])

    chars = np.diff(np.concatenate(([0], ends)))
    words = [t.encode().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(n), counts)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    dup_lines = n_lines - np.array([len(set(x)) for x in lines], np.int64)
    tally = lambda mask: np.bincount(doc[mask], minlength=n)
    return np.stack([counts, chars - per_text(4), per_text(8), dup_lines, tally(_repeated(ids, doc)), n_lines, per_text(1), per_text(2), tally(same)], 1)


def _repeated(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks of the words in a window of WINDOW words that is found twice or more in its text."""
    covered = np.zeros(len(ids), bool)
    m = len(ids) - WINDOW + 1
    if m < 2:
        return covered
    value = fmix64(ids.astype(np.uint64) + np.uint64(1))
    h = fmix64(doc[:m].astype(np.uint64))
    for k in range(WINDOW):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += value[k : m + k]
    h = fmix64(h)
    whole = doc[:m] == doc[WINDOW - 1 :]
    ordered = np.sort(h[whole])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        twice = np.unique(twice)
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        start = np.flatnonzero(whole & (twice[at] == h))
        step = np.zeros(len(ids) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + WINDOW, -1)
        covered = np.cumsum(step[:-1]) > 0
    return covered


def with_statistics(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with STATS as long columns; without the text column unless ``keep_text``."""
    tune(docs.sparkSession)
    docs = docs.drop(*STATS)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, *(T.StructField(s, T.LongType()) for s in STATS)])
    names = [f.name for f in fields]

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = measure(texts_of(batch, text))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(found[:, i]) for i in range(len(STATS)))], names=[*names, *STATS])

        return f

    return arrow_map(docs, schema, make)


def _value(name: str):
    over, under, factor, *_ = FENCES[name]
    return F.expr(f"if({under} > 0, ({factor} * {over}) div {under}, 0L)")


def _coarse(v: str):
    """The value with all but its leading BITS binary digits cleared."""
    cut = f"greatest(length(bin({v})) - {BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({v}, {cut}), {cut})")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Sketch rows of each group: lang, source, stat, value, n.  Counts of equal values add up to the merged sketch."""
    stats = F.array(*(F.struct(F.lit(k).alias("stat"), _value(k).alias("v")) for k in FENCES))
    return (
        measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(stats).alias("s"))
        .select("lang", "source", F.col("s.stat").alias("stat"), F.col("s.v").alias("v"))
        .groupBy("lang", "source", "stat", _coarse("v").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """One row per group (lang, source): the fences (LIMITS), from the group's sketch or the merged one above it."""
    base = sketches(measured, lang, source)
    levels = union_all(
        [
            base.select(F.lit(0).alias("level"), "lang", "source", "stat", "value", "n"),
            base.groupBy("lang", "stat", "value").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "stat", "value", "n"),
            base.groupBy("stat", "value").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "stat", "value", "n"),
        ]
    )
    # A sketch has a bounded number of values, so one group's rows are few however many documents it has.
    sketch = levels.groupBy("level", "lang", "source", "stat").agg(F.sum("n").alias("docs"), F.array_sort(F.collect_list(F.struct("value", "n"))).alias("bins"))

    def at(tenths: int) -> str:
        found = f"aggregate(bins, struct(0L AS seen, -1L AS hit), (a, b) -> struct(a.seen + b.n AS seen, if(a.hit < 0 and 10 * (a.seen + b.n) >= {tenths} * docs, b.value, a.hit) AS hit)).hit"
        return f"greatest({found}, 0L)"

    grain = F.create_map(*(F.lit(x) for k, v in FENCES.items() for x in (k, v[3])))[F.col("stat")].cast("long")
    low, middle, high = (F.expr(at(x)) for x in (1, 5, 9))
    fence = sketch.select("level", "lang", "source", "stat", "docs", (high + REACH * F.greatest(high - middle, grain)).alias("max"), (low - REACH * F.greatest(middle - low, grain)).alias("min"))
    wide = fence.groupBy("level", "lang", "source").agg(F.max("docs").alias("docs"), *(F.max(F.when(F.col("stat") == k[4:], F.col(k[:3]))).alias(k) for k in LIMITS))
    own, by_lang, whole = (wide.where(F.col("level") == i) for i in range(3))
    all_ = whole.select(F.struct(*LIMITS)).scalar()
    pick = lambda k: F.when(F.col("o.docs") >= min_group, F.col(f"o.{k}")).when(F.col("l.docs") >= min_group, F.col(f"l.{k}")).otherwise(all_.getField(k))
    joined = own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")))
    return joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), *(pick(k).alias(k) for k in LIMITS))


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with base_failed and kept.  The limits join by null-safe keys; Spark broadcasts them only while they are small."""
    measured = measured.drop("base_failed", "kept")
    cols = [F.col(f"m.`{c}`") for c in measured.columns]
    base = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words"
    inside = [_value(k[4:]) <= F.col(f"t.{k}") if k.startswith("max") else _value(k[4:]) >= F.col(f"t.{k}") for k in LIMITS]
    verdict = inside[0]
    for x in inside[1:]:
        verdict = verdict & x
    joined = measured.alias("m").join(limits.alias("t"), F.col(f"m.`{lang}`").eqNullSafe(F.col("t.lang")) & F.col(f"m.`{source}`").eqNullSafe(F.col("t.source")), "left")
    return joined.select(*cols, F.expr(base).alias("base_failed"), (~F.expr(base) & F.coalesce(verdict, F.lit(False))).alias("kept"))
