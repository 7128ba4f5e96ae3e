"""Documents as sections, chunks and contexts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.pages import capsule
from quarry.functions.pages import sections as sections_of_page
from quarry.functions.text import TOKEN, sentences
from quarry.operators.shared import spread


def neighbour_text(rows: DataFrame, owner: str, position: str, value: Column) -> DataFrame:
    """``before`` and ``after``: the nearest values that are not null in front of and behind each row."""
    w = Window.partitionBy(owner).orderBy(position)
    v = rows.withColumn("_v", value)
    return (
        v.withColumn("before", F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("after", F.first("_v", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
        .drop("_v")
    )


def first_k(rows: DataFrame, owner: str, position: str, text: str, k: int) -> DataFrame:
    """(owner, blob): the first k texts, one a line."""
    w = Window.partitionBy(owner).orderBy(position)
    kept = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return kept.groupBy(owner).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(text).alias("t")))), lambda x: x.t), "\n").alias("blob"))


def chunk_roles(docs: DataFrame, parent_limit: int) -> DataFrame:
    """(doc_id, role, n): the first line as abstract, the whole as parent if it is short enough, the other lines as children."""
    body = F.coalesce("text", F.lit(""))
    lines = F.split(body, "\n")
    item = lambda role, x: F.struct(F.lit(role).alias("role"), F.length(x).cast("long").alias("n"), x.alias("t"))
    first = F.filter(F.slice(lines, 1, 1), lambda x: F.trim(x) != "")
    rest = F.filter(F.slice(lines, 2, 2147483646), lambda x: F.trim(x) != "")
    parent = F.filter(F.array(body), lambda x: (F.length(x) <= parent_limit) & (F.length(x) > 0))
    every = F.concat(F.transform(first, lambda x: item("abstract_chunk", x)), F.transform(parent, lambda x: item("section_parent", x)), F.transform(rest, lambda x: item("section_child", x)))
    return docs.select("doc_id", F.explode(every).alias("c")).select("doc_id", "c.role", "c.n")


def pack_chunks(docs: DataFrame, budget: int, overlap: int) -> DataFrame:
    """(doc_id, chunk, text, n_tokens): whole sentences up to a budget of tokens; the last ``overlap`` sentences begin the next chunk, as far as it has room.

    A document is one row, so packing needs no shuffle.  A sentence above the budget is a chunk of its own.
    """
    tokens_of = lambda s: F.size(F.regexp_extract_all(s, F.lit(rf"({TOKEN}|[^\s\p{{L}}\p{{N}}_])"), F.lit(1)))
    units = F.transform(sentences(F.col("text")), lambda s: F.struct(F.trim(s).alias("s"), tokens_of(s).alias("n")))
    unit, none = "struct<s:string,n:int>", F.array()
    start = F.struct(none.cast(f"array<{unit}>").alias("held"), none.cast("array<struct<text:string,n:int>>").alias("out"))
    total = lambda held: F.aggregate(held, F.lit(0), lambda acc, u: acc + u["n"])
    chunk = lambda held: F.array(F.struct(F.array_join(F.transform(held, lambda u: u["s"]), " ").alias("text"), total(held).alias("n")))

    def packed(acc: Column, u: Column) -> Column:
        full = (F.size(acc["held"]) > 0) & (total(acc["held"]) + u["n"] > budget)
        carried = acc["held"].cast(f"array<{unit}>")
        # Of the last sentences as many as leave room for the next one.
        tails = F.transform(F.sequence(F.lit(0), F.least(F.lit(overlap), F.size(carried))), lambda k: F.slice(carried, F.size(carried) - k + 1, k))
        fitting = F.filter(tails, lambda t: total(t) + u["n"] <= budget)
        kept = F.when(F.size(fitting) > 0, F.element_at(fitting, -1)).otherwise(none.cast(f"array<{unit}>"))
        return F.struct(F.concat(F.when(full, kept).otherwise(carried), F.array(u)).alias("held"), F.when(full, F.concat(acc["out"], chunk(carried))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(units, start, packed, lambda acc: F.when(F.size(acc["held"]) > 0, F.concat(acc["out"], chunk(acc["held"]))).otherwise(acc["out"]))
    rows = docs.select("doc_id", F.posexplode(done).alias("chunk", "c"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "c.text", F.col("c.n").cast("long").alias("n_tokens"))


def html_sections(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, section, level, title, parent, path, text, capsule, n_chars) of every section of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, s in enumerate(sections_of_page(text)):
                    for c, v in zip(out, (page, i, s.level, s.title, s.parent, s.path, s.text, capsule(s.title, s.text), len(s.text)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), *(pa.string(),) * 5, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["page_id", "section", "level", "title", "parent", "path", "text", "capsule", "n_chars"])

    return spread(pages.select(F.col(page_id).cast("long"), F.col(html))).mapInArrow(run, "page_id bigint, section bigint, level bigint, title string, parent string, path string, text string, capsule string, n_chars bigint")
