"""Which works an operation covers, and what is fetched, kept, skipped or cleared for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that mean no restriction, and a prefix that a name may have.
EVERYTHING = ("", "all", "*", "__all__", "all_collections")
PREFIX = "collection:"
#: Identifier types in the order in which a name is taken from them.
STEMS = ("arxiv", "inspire")


def collection_name(name: str | None) -> str | None:
    """The collection that a name means; None for everything."""
    plain = (name or "").strip()
    plain = plain[len(PREFIX) :].strip() if plain.lower().startswith(PREFIX) else plain
    return None if plain.lower() in EVERYTHING else plain


def in_scope(rows: DataFrame, members: DataFrame, name: str | None, key: str = "work_id") -> DataFrame:
    """The rows whose work is in the collection; ``members``: (collection, key)."""
    wanted = collection_name(name)
    return rows if wanted is None else rows.join(members.where(F.col("collection") == wanted).select(key).distinct(), key, "left_semi")


def selected(works: DataFrame, members: DataFrame, ids: list | None = None, name: str | None = None, key: str = "work_id") -> DataFrame:
    """The works that an operation covers: explicit ids before a collection before all."""
    if ids is not None:
        wanted = works.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], works.select(key).schema)
        return works.join(F.broadcast(wanted), key, "left_semi")  # as many as the caller named
    return in_scope(works, members, name, key)


def scopes(members: DataFrame, works: DataFrame) -> DataFrame:
    """(name, works, place): everything first, then the collections by name."""
    own = members.groupBy(F.col("collection").alias("name")).agg(F.countDistinct("work_id").alias("works"))
    first = works.agg(F.count(F.lit(1)).alias("works")).select(F.lit("all").alias("name"), "works", F.lit(0).cast("long").alias("place"))
    return first.unionByName(own.select("name", "works", F.row_number().over(Window.orderBy("name")).cast("long").alias("place")))


def has_collection(collections: Column, name: str | None) -> Column:
    """Whether a work's names between bars (``|a|b|``) hold a collection."""
    wanted = collection_name(name)
    return F.lit(True) if wanted is None else F.array_contains(F.split(F.coalesce(collections, F.lit("")), r"\|"), wanted)


def retrievable(searched: Column, text: Column) -> Column:
    return F.coalesce(searched, F.lit(False)) & (F.coalesce(text, F.lit("")) != "")


def hydrated(ranked: DataFrame, rows: DataFrame, key: str = "work_id") -> DataFrame:
    """The rows of ranked ids, in rank order; ids without a row fall out.  ``ranked`` is a list of bounded length."""
    return rows.join(F.broadcast(ranked.select(key, "rank")), key).orderBy("rank")


def without_edges(works: DataFrame, edges: DataFrame, key: str = "work_id", src: str = "src") -> DataFrame:
    """Works that have no edge yet."""
    return works.join(edges.select(F.col(src).alias(key)).distinct(), key, "left_anti")


def without_kind(works: DataFrame, ids: DataFrame, source: str, key: str = "work_id") -> DataFrame:
    """Works that neither come from a source nor have an identifier of its type."""
    return works.where(F.coalesce(F.col("canonical_source") != source, F.lit(True))).join(ids.where(F.col("id_type") == source).select(key).distinct(), key, "left_anti")


def dirty(marks: DataFrame, lane: str, since: str | None = None, ids: list | None = None, members: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """The marks (lane, kind, work_id, updated_at) of a lane's works, optionally from a time on, of some ids or a collection."""
    rows = marks.where((F.col("lane") == lane) & (F.col("kind") == "work"))
    if since is not None:
        rows = rows.where(F.col("updated_at") >= F.to_timestamp(F.lit(since)))
    if ids is not None:
        rows = rows.where(F.col("work_id").isin(ids))
    return rows if members is None else in_scope(rows, members, name)


def cleared(marks: DataFrame, done: DataFrame, lane: str) -> DataFrame:
    """The marks but for those of a lane's works that are done."""
    gone = done.select("work_id", F.lit(lane).alias("lane")).distinct()
    return marks.join(gone, ["lane", "work_id"], "left_anti")


def reparse_candidates(works: DataFrame, documents: DataFrame, pdfs: DataFrame, parser: str | None, replace: bool, limit: int) -> DataFrame:
    """The first works by id that have a PDF, were read by the parser (if one is named) and are not materialized (or are to be replaced)."""
    rows = works.join(pdfs.select("work_id").distinct(), "work_id", "left_semi").join(documents.select("work_id", "parser_name", "parse_status"), "work_id", "left")
    if parser:
        rows = rows.where(F.col("parser_name").isNull() | (F.col("parser_name") == parser))
    if not replace:
        rows = rows.where(F.coalesce("parse_status", F.lit("")) != "materialized")
    return rows.orderBy("work_id").limit(limit)


def first_collection(works: DataFrame, members: DataFrame, key: str = "work_id") -> DataFrame:
    """``works`` with the least collection that each is in, null if in none."""
    return works.join(members.groupBy(key).agg(F.min("collection").alias("collection")), key, "left")


def first_texts(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """``sections`` with the text of each one's first retrievable chunk."""
    own = chunks.where(retrievable(F.col("searched"), F.col("text"))).groupBy("section_id").agg(F.min_by("text", "chunk_id").alias("first_text"))
    return sections.join(own, "section_id", "left")


def annotated(hits: DataFrame, works: DataFrame, documents: DataFrame, pdfs: DataFrame, key: str = "work_id") -> DataFrame:
    """``hits`` with what is there of each work: known, has_pdf, has_document, parse_status."""
    flag = lambda df, name: df.select(key, F.lit(True).alias(name)).distinct()
    latest = documents.groupBy(key).agg(F.max_by("parse_status", "document_id").alias("parse_status"))
    rows = hits.join(flag(works, "known"), key, "left").join(flag(pdfs, "has_pdf"), key, "left").join(latest, key, "left").withColumn("has_document", F.col("parse_status").isNotNull())
    return rows.fillna(False, ["known", "has_pdf"])


def purged(works: DataFrame, source: str, patterns: list[str], children: dict[str, tuple[DataFrame, str]], key: str = "work_id") -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(works, children, gone): works of a source whose canonical id is like one of the patterns go, and with them what belongs to them.

    ``children``: tables by name with the column that names their work; ``gone`` has the works that went."""
    like = F.lit(False)
    for p in patterns:
        like = like | F.col("canonical_id").like(p)
    out = F.coalesce((F.col("canonical_source") == source) & like, F.lit(False))
    gone = works.where(out)
    ids = gone.select(key)
    return works.where(~out), {n: df.join(ids.withColumnRenamed(key, c), c, "left_anti") for n, (df, c) in children.items()}, gone


def rebuilt_edges(old: DataFrame, new: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Edges after a rebuild: of everything, the new ones; of a collection's works, the new ones beside the old that have an end outside."""
    if members is None:
        return new
    inside = members.select("work_id").distinct()
    side = lambda c: inside.select(F.col("work_id").alias(c), F.lit(True).alias(f"{c}_in"))
    kept = old.join(side("src"), "src", "left").join(side("dst"), "dst", "left").where("src_in is null or dst_in is null").select(*old.columns)
    return kept.unionByName(new)


def stale(old: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows that are there but were not seen again."""
    return old.join(seen.select(*key).distinct(), key, "left_anti")


def run_log(events: DataFrame) -> DataFrame:
    """(run, started, ended, status, steps): the latest state of each run of an append-only log (run, seq, at, status)."""
    return events.groupBy("run").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("steps"))


def storage_stems(works: DataFrame, ids: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, stem): the first identifier that is not empty, primary ones first, arXiv before the source's number before others; else the canonical id; else the work's own."""
    place = F.lit(len(STEMS))
    for i, k in enumerate(STEMS):
        place = F.when(F.col("id_type") == k, i).otherwise(place)
    named = ids.where(F.trim("id_value") != "")
    best = named.groupBy(key).agg(F.min_by(F.trim("id_value"), F.struct((~F.coalesce("is_primary", F.lit(False))).alias("a"), place.alias("b"), "id_type", "id_value")).alias("stem"))
    rows = works.join(best, key, "left")
    return rows.select(key, F.coalesce("stem", F.nullif(F.trim("canonical_id"), F.lit("")), F.concat(F.lit("work-"), F.col(key).cast("string"))).alias("stem"))


def sync(marks: DataFrame, lane: str, everything: bool, rebuild, count) -> dict:
    """One maintenance job: nothing to do without marks (unless everything is asked for), else a rebuild; its counts and what is left to do.

    ``rebuild()`` builds the target anew, ``count()`` counts it.  Returns status, selected, before, after, marks.
    """
    chosen = marks.where(F.col("lane") == lane)
    n = chosen.count()
    before = count()
    if not n and not everything:
        return {"status": "skipped", "selected": 0, "before": before, "after": before, "marks": marks}
    rebuild()
    return {"status": "succeeded", "selected": n, "before": before, "after": count(), "marks": cleared(marks, chosen, lane)}
