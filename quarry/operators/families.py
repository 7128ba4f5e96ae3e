"""Titles that are equal or nearly so, by their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import title, tokens


def title_classes(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, rep, words): documents of equal title words form one class, named by its least id; ``whole`` texts are titles themselves."""
    t = docs.select("doc_id", F.array_sort(F.array_distinct(tokens(F.col("text") if whole else title(F.col("text"))))).alias("words"))
    key = t.withColumn("key", F.array_join("words", " "))
    return key.join(key.groupBy("key").agg(F.min("doc_id").alias("rep")), "key").select("doc_id", "rep", "words")


def title_pairs(classes: DataFrame, percent: int = 92, least: int = 6) -> DataFrame:
    """(src, dst, shared, score) of class representatives by prefix filtering: a pair as similar shares one of its rarest words."""
    reps = classes.where("doc_id = rep").select("rep", "words").where(F.size("words") >= least)
    words = reps.select("rep", F.explode("words").alias("w"), F.size("words").alias("n"))
    rarity = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("rep").orderBy("df", "w")
    prefix = words.join(rarity, "w").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("rep", "w", "n")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent))
    near = near.select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst")).distinct()
    full = lambda c: reps.select(F.col("rep").alias(c), F.col("words").alias(f"{c}_words"))
    both = near.join(full("src"), "src").join(full("dst"), "dst")
    shared, union = F.size(F.array_intersect("src_words", "dst_words")), F.size(F.array_union("src_words", "dst_words"))
    return both.select("src", "dst", shared.cast("long").alias("shared"), (shared / union).alias("score"), union.alias("u")).where(f"shared >= {least} and 100 * shared >= {percent} * u").drop("u")
