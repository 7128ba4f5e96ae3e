"""Aliases of concepts found in texts, word for word, and how sure each mention is.

Few aliases (at most ALIASES) are one automaton that every task runs over its texts: one pass, nothing shuffled.  More of them
meet the texts' runs of words in a join, where each run already carries the words that would verify it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aliases up to which they are sent to all tasks.
ALIASES = 200_000
#: Words of an alias that are the key of the join beyond that.
KEY = 3
# Fixed values that the data model prescribes: an alias's score.
BASE, PER_WORD, WORDS, LABEL, SAME, SPECIAL, CAP = 0.46, 0.08, 5, 0.06, 0.05, 0.04, 0.99
SPECIAL_KINDS = ("particle", "process", "decay")


def mentions(texts: DataFrame, aliases: DataFrame, key: str, alias_key: str) -> DataFrame:
    """(key, alias_key, words, chars), once for each alias that a text holds: ``texts`` (key, words), ``aliases`` (alias_key, words); empty aliases are in no text."""
    known = aliases.where("size(words) > 0")
    sized = known.select(alias_key, "words")
    if sized.limit(ALIASES + 1).count() <= ALIASES:
        return _by_automaton(texts, sized, key, alias_key)
    return _by_join(texts, sized, key, alias_key)


def _by_automaton(texts: DataFrame, aliases: DataFrame, key: str, alias_key: str) -> DataFrame:
    by_words: dict[str, list[int]] = {}
    for r in aliases.collect():  # at most ALIASES rows
        by_words.setdefault(" ".join(r.words), []).append(r[alias_key])
    sent = texts.sparkSession.sparkContext.broadcast(by_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase, ids in sent.value.items():
            automaton.add_word(f" {phrase} ", (phrase, ids))
        if sent.value:
            automaton.make_automaton()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = " " + " ".join(words or []) + " "
                for phrase, ids in dict(x for _, x in automaton.iter(text)).items() if sent.value else ():
                    for a in ids:
                        for column, v in zip(out, (i, a, phrase.count(" ") + 1, len(phrase)), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[key, alias_key, "words", "chars"])

    return texts.select(F.col(key).cast("long"), "words").mapInArrow(run, f"{key} bigint, {alias_key} bigint, words bigint, chars bigint")


def _by_join(texts: DataFrame, aliases: DataFrame, key: str, alias_key: str) -> DataFrame:
    longest = aliases.agg(F.max(F.size("words"))).first()[0]
    keyed = aliases.select(alias_key, F.col("words").alias("alias"), F.array_join(F.slice("words", 1, KEY), " ").alias("k"))
    sizes = range(1, min(KEY, longest) + 1)
    # Each run of words with as many as the longest alias has: what is joined can be verified without the text.
    runs = F.flatten(F.array(*(F.expr(f"transform(sequence(1, greatest(size(words), 1)), i -> struct(array_join(slice(words, i, {n}), ' ') AS k, slice(words, i, {longest}) AS run))") for n in sizes)))
    rows = texts.select(key, F.explode(F.array_distinct(runs)).alias("x")).select(key, "x.k", "x.run")
    found = rows.join(keyed, "k").where(F.slice("run", F.lit(1), F.size("alias")) == F.col("alias"))
    return found.select(key, alias_key, F.size("alias").cast("long").alias("words"), F.length(F.array_join("alias", " ")).cast("long").alias("chars")).distinct()


def alias_score(words: Column, confidence: Column, is_label: Column, same: Column, kind: Column) -> Column:
    """How sure a mention is: longer aliases, surer aliases, labels, and concepts of special kinds."""
    more = lambda c, x: F.when(c, x).otherwise(0.0)
    total = BASE + PER_WORD * F.least(words, F.lit(WORDS)) + F.least(confidence, F.lit(0.2)) + more(is_label, LABEL) + more(same, SAME) + more(kind.isin(*SPECIAL_KINDS), SPECIAL)
    return F.least(F.lit(CAP), total)
