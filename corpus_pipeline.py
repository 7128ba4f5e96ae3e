"""The corpus pipeline: language ID, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import circulant_minhash, langid, packing, quality_rules
from quarry.llm.common import documents, materialize
from quarry.llm.queries import BYTE_BPE

#: A language is rejected if its calibrated score is lower.
LEAST_SCORE = 0.5
SHINGLE, PERCENT = 5, 80
END_ID = 0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language, with ``lang`` as recognised; learned from the documents' own marks."""
    model = langid.fit(docs, F.lit(True))
    found = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    measured = materialize(quality_rules.with_statistics(docs), "statistics")
    limits = materialize(quality_rules.thresholds(measured), "thresholds")
    return quality_rules.judge(measured, limits).where("kept").select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each group of near duplicates; see ``one_of_each`` for rows that repeat an id or have none."""
    return circulant_minhash.one_of_each(docs, SHINGLE, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 ids."""
    return packing.pack_documents(docs, BYTE_BPE, "spaced", END_ID)


STAGES = [("language ID", identify_language), ("quality rules", apply_quality_rules), ("near-duplicates", remove_near_duplicates), ("packing", pack)]

#: SQL can't express language ID, tokenizing and packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
