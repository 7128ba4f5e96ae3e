"""Parsed-document content lists as blocks, and the windows of text around formulas and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.fulltext import neighbour_text

ITEM = "struct<type:string, text:string, text_level:int, page_idx:int, page:int, page_no:int, latex:string, caption:string, image_path:string, html:string, table_caption:array<string>, image_caption:array<string>>"
#: Names under which a list may be wrapped, and what block types stand for.
WRAPPERS = ("content_list", "items", "data", "contents", "blocks")
KINDS = {"title": "text", "heading": "text", "header": "text", "paragraph": "text", "formula": "equation", "inline_formula": "equation", "figure": "image"}


def parse_list(raw: Column) -> Column:
    """The items of a JSON array, or of the first wrapper that an object has; anything else is empty."""
    wrapped = F.from_json(raw, "struct<" + ", ".join(f"{w}:array<{ITEM}>" for w in WRAPPERS) + ">")
    return F.coalesce(F.when(F.ltrim(raw).startswith("["), F.from_json(raw, f"array<{ITEM}>")), *(wrapped.getField(w) for w in WRAPPERS), F.from_json(F.lit("[]"), f"array<{ITEM}>"))


def decode(docs: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, position, kind, level, page, text, latex): blocks in order; discarded and empty ones dropped."""
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    item = docs.select(doc_id, F.posexplode(parse_list(F.col(content))).alias("position", "b"))
    kind = F.coalesce(kinds[F.lower("b.type")], F.lower("b.type"), F.lit("text"))
    caption = F.coalesce(F.nullif("b.caption", F.lit("")), F.array_join(F.coalesce("b.image_caption", "b.table_caption", F.array().cast("array<string>")), " "))
    text = F.coalesce(F.nullif(F.trim("b.text"), F.lit("")), F.nullif(F.trim(caption), F.lit("")), F.nullif(F.trim("b.latex"), F.lit("")), F.nullif(F.trim("b.html"), F.lit("")), F.when(F.col("b.image_path") != "", F.lit("")))
    rows = item.select(doc_id, F.col("position").cast("long").alias("position"), kind.alias("kind"), F.col("b.text_level").alias("level"), F.coalesce("b.page_idx", "b.page", "b.page_no").alias("page"), text.alias("text"), F.coalesce("b.latex", F.when(kind == "equation", F.col("b.text"))).alias("latex"))
    return rows.where("kind <> 'discarded' and text is not null")


def windows(blocks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, position, role, text): each formula between its nearest texts, each asset with its own text between them."""
    near = neighbour_text(blocks, doc_id, "position", F.when((F.col("kind") == "text") & (F.col("text") != ""), F.col("text")))
    own = F.when(F.col("kind") != "equation", F.nullif("text", F.lit("")))
    role = F.when(F.col("kind") == "equation", "formula_window").otherwise("asset_window")
    return near.where("kind in ('equation', 'image', 'table')").select(doc_id, "position", role.alias("role"), F.concat_ws("\n", "before", own, "after").alias("text"))
