"""BM25, the ladder and phrases over an inverted index of one field; word statistics of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.query import MatchQuery
from quarry.functions.text import tokens
from quarry.operators import search
from quarry.operators.inverted import Index


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, token, tf)."""
    return docs.select(doc_id, F.explode(tokens(F.col(text))).alias("token")).groupBy(doc_id, "token").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, df, cf): documents that hold the word, and its occurrences.  Each document's words are counted within its row."""
    return postings(docs, doc_id, text).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25_scores(index: Index, words: list[str]) -> DataFrame:
    """(doc_id, score, hits) of the documents that hold any of the words; a higher score is better."""
    rows, idf, norm = search.weighed(index, words)
    score, hits = F.lit(0.0), F.lit(0)
    for i, weight in enumerate(idf):
        f = F.col("tf")[i]
        score, hits = score + F.lit(weight) * f * (search.K1 + 1) / (f + norm), hits + (f > 0).cast("int")
    return rows.select(index.key, score.alias("score"), hits.cast("long").alias("hits")).where("hits > 0")


def ranked(scores: DataFrame, k: int, doc_id: str = "doc_id") -> DataFrame:
    """The k best with their rank; ties by id."""
    order = [F.round("score", 9).desc(), F.col(doc_id)]
    return scores.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def bm25_topk(index: Index, words: list[str], k: int) -> DataFrame:
    return ranked(bm25_scores(index, words), k).select("doc_id", F.round("score", 6).alias("score"), "rank")


def ladder(index: Index, words: list[str], limit: int) -> DataFrame:
    """All words first, then any word, then the first two: later stages only append what earlier ones lack.  Two passes in all."""
    each = tuple((w,) for w in words)
    queries = [MatchQuery(True, each), MatchQuery(False, each), MatchQuery(False, each[:2])]
    return search.search(index, queries, limit, [F.col("doc_id")]).select("doc_id", "stage", "rank")


def phrase_match(index: Index, phrase: list[str]) -> DataFrame:
    """(doc_id, occurrences) of adjacent words."""
    found = index.counted([" ".join(phrase)])
    return found.select("doc_id", F.col("tf")[0].cast("long").alias("occurrences")).where("occurrences > 0")


def agreement_filter(docs: DataFrame, groups: list[list[str]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hits, coverage) of the documents that agree with enough groups: min(2, all) at least, or three quarters."""
    hits, coverage = search.agreement(F.col("toks"), groups)
    rows = docs.select(doc_id, tokens(F.col(text)).alias("toks"))
    return rows.select(doc_id, hits.alias("hits"), coverage.alias("coverage")).where(search.agrees(groups))
