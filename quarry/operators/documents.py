"""Parsed documents as tables: one Arrow pass from content lists to sections, blocks, formulas, assets, chunks and references.

A document is one row and comes out as many, so nothing is shuffled; the parts are views of one tagged table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import document as D
from quarry.operators.shared import spread

ITEMS = (
    "doc_id bigint, item string, id int, section int, role string, kind string, level int, number string, first_page int, last_page int, pages string, title string, path string, "
    "text string, raw string, latex string, caption string, asset string, heading boolean, searched boolean, excluded string, citations int, members array<int>, target_type string, target_id string"
)
#: Characters of documents whose items are given away together, about.
CHARS = 1 << 18
NAMES = [x.split()[0] for x in ITEMS.split(", ")]


def _rows(doc_id: int, d: D.Document) -> Iterator[dict]:
    for s in d.sections:
        yield {"item": "section", "id": s.id, "section": s.parent, "role": s.kind, "level": s.level, "number": s.number, "first_page": s.first_page, "last_page": s.last_page, "title": s.title, "path": s.path}
    paths = {s.id: s.path for s in d.sections}
    for b in d.blocks:
        own = {
            "id": b.order, "section": b.section, "role": b.role, "kind": b.kind, "level": b.level, "first_page": b.page, "last_page": b.page, "path": paths[b.section], "text": b.clean or b.text, "raw": b.text,
            "latex": b.latex, "caption": b.caption, "asset": b.path, "heading": b.heading, "searched": b.searched, "excluded": b.excluded, "citations": b.citations,
        }
        yield {"item": "block", **own}
        if b.kind == "equation" and b.latex:
            yield {"item": "formula", **own, "latex": " ".join(b.latex.split())}
        if b.kind in ("image", "table"):
            yield {"item": "asset", **own}
    for i, c in enumerate(d.chunks):
        yield {"item": "chunk", "id": i, "section": c.section, "role": c.role, "path": c.hint, "text": c.text, "raw": c.raw, "pages": c.pages, "members": list(c.blocks), "citations": c.citations, "searched": bool(c.text), "excluded": None if c.text else "empty_after_clean"}
    for i, e in enumerate(d.references):
        kind, target = D.reference_target(e)
        yield {"item": "reference", "id": i, "text": e, "target_type": kind, "target_id": target}


def materialize(docs: DataFrame, doc_id: str = "doc_id", title: str = "title", content: str = "content", chars: int = 2400, overlap: int = 1, parent_chars: int = 12000) -> DataFrame:
    """Every item of every document, tagged by ``item``.  Content that is no list has the root section alone; null titles count as empty."""
    schema = pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in ITEMS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, t, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows += ({"doc_id": i, **r} for r in _rows(i, D.build(c, t, chars, overlap, parent_chars)))
                size += len(c or "")
                if size > CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spread(docs.select(F.col(doc_id).cast("long"), F.col(title), F.col(content))).mapInArrow(run, ITEMS)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def part(items: DataFrame, item: str, *columns: str) -> DataFrame:
    """One kind of item, without the tag."""
    return items.where(F.col("item") == item).select("doc_id", *columns)


def text_as_content(text: Column, heading: str = "1 Introduction") -> Column:
    """A plain text as a content list: its first line as the title, then a heading, then a block for each other line."""
    block = lambda t, level: F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit(level).cast("int").alias("text_level"))
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    body = F.transform(F.slice(lines, 2, 2147483646), lambda x: block(x, None))
    return F.to_json(F.concat(F.array(block(F.element_at(lines, 1), 1), block(F.lit(heading), 1)), body))


def citations(references: DataFrame, works: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, target_type, target_id, target): the references' new citations; ``target`` is null where no work has that identifier.

    ``works``: (work_id, id_type, id_value); ``known``: (doc_id, target_type, target_id) that other sources already gave.
    """
    new = references.where("target_id is not null").select("doc_id", "target_type", "target_id").distinct().join(known, ["doc_id", "target_type", "target_id"], "left_anti")
    ids = works.groupBy(F.col("id_type").alias("target_type"), F.col("id_value").alias("target_id")).agg(F.min("work_id").alias("target"))
    return new.join(ids, ["target_type", "target_id"], "left").select("doc_id", "target_type", "target_id", "target")
