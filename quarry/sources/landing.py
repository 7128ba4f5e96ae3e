"""What comes in from outside: search plans, raw pages, parsed bundles, old rows, configuration."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years of publication that are asked for together.
BUCKETS = ((2010, 2014), (2015, 2018), (2019, 2021), (2022, 2026))
PAGE_SIZES = (1, 50)
# How identifiers look in folder names.
ARXIV_NEW, ARXIV_OLD, NUMBER = r"^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$", r"^[a-z-]+(\.[A-Z]{2})?[_/][0-9]{7}$", r"^[0-9]+$"


def search_query(query: str, published: bool = False, suffix: str = "") -> str:
    """A source's query: the words, only what is published if asked for, and a suffix."""
    parts = [f"({query.strip()})" if published and query.strip() else query.strip()]
    if published:
        parts.append("and collection:Published")
    if suffix.strip():
        parts.append(suffix.strip())
    return " ".join(p for p in parts if p)


def page_size(wanted: int) -> int:
    return min(max(wanted, PAGE_SIZES[0]), PAGE_SIZES[1])


def year_buckets(text: str | None) -> list[tuple[int, int]]:
    """``2010-2014,2015`` as ranges; nothing means the usual ones."""
    if not (text or "").strip():
        return list(BUCKETS)
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d{4})\s*(?:-\s*(\d{4}))?\s*", part)
        if not m:
            raise ValueError(f"not a range of years: {part!r}")
        first, last = int(m[1]), int(m[2] or m[1])
        out.append((min(first, last), max(first, last)))
    return out


#: Fields that a source is always asked for.
REQUIRED_FIELDS = ("control_number", "titles", "abstracts", "collaborations", "document_type", "earliest_date", "publication_info", "references")


def with_required(fields: list[str], required: tuple[str, ...] = REQUIRED_FIELDS) -> list[str]:
    """The wanted fields in their order, then what is required and missing."""
    return list(dict.fromkeys(x for x in (*(f.strip() for f in fields), *required) if x))


def shards(spark: SparkSession, queries: list[str], buckets: list[tuple[int, int]]) -> DataFrame:
    """(shard, query, first_year, last_year, text): every query in every range of years."""
    rows = [(i, q, a, b, f"{q} and date {a}->{b}") for i, (q, (a, b)) in enumerate(product(queries, buckets))]
    return spark.createDataFrame(rows, "shard int, query string, first_year int, last_year int, text string")


def land(pages: DataFrame, path: str) -> None:
    """Raw pages (run_id, shard, page, body) as JSON, by run and shard."""
    pages.write.mode("append").partitionBy("run_id", "shard").json(path)


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page int, body string, run_id string, shard string").json(path)


def hits_of(pages: DataFrame, body: str = "body") -> DataFrame:
    """(value): the hits of each page, as JSON; a page that can't be read has none."""
    found = F.from_json(F.get_json_object(body, "$.hits.hits"), "array<string>")
    return pages.select(F.explode(found).alias("value"))


#: The files of a bundle, by the ends of their names.
BUNDLE = {"content": "content_list.json", "text": "full.md", "model": "model.json"}
#: What a path inside a bundle must not be: absolute, with a scheme or a drive, or leading up.
HOSTILE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|[/\\])|(?:^|[/\\])\.\.(?:[/\\]|$)"


def safe_path(path: Column) -> Column:
    """A path inside a bundle; null for one that leads out of it."""
    return F.when(~path.rlike(HOSTILE), path)


def _bundled(files: DataFrame) -> DataFrame:
    one = lambda end: F.max(F.when(F.col("file").endswith(end), F.col("value")))
    return files.groupBy("folder").agg(*(one(end).alias(k) for k, end in BUNDLE.items())).where("content is not null")


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """(folder, content, text, model): the parsed bundles below a path, one folder each, by the ends of their files' names."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return _bundled(files.where(~F.col("file").endswith(".zip")).withColumn("folder", F.regexp_replace("file", "/[^/]*$", "")))


def zipped_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(folder, content, text, model, refused): bundles that are zip files, named after them; ``refused`` are entries whose paths lead out of them.

    What can't be read as a zip file has no row.  An archive is opened in the task that has it; only the bundle's texts are taken out."""
    hostile, ends = re.compile(HOSTILE), tuple(BUNDLE.values())

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for folder, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        for name in z.namelist():
                            if hostile.search(name):
                                out.append((folder, name, None))
                            elif name.endswith(ends):
                                out.append((folder, name, z.read(name).decode("utf-8", "replace")))
                except zipfile.BadZipFile:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ([], [], []))], names=["folder", "file", "value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    found = files.select(F.regexp_replace("path", r"\.zip$", "").alias("folder"), "content").mapInArrow(entries, "folder string, file string, value string")
    refused = found.groupBy("folder").agg(F.array_sort(F.collect_set(F.when(F.col("value").isNull(), F.col("file")))).alias("refused"))
    return _bundled(found.where("value is not null")).join(refused, "folder")


def manifest_rows(found: DataFrame, parser: str) -> DataFrame:
    """(folder, value): the manifest of each bundle as JSON: its parser and which of its files there are."""
    files = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in BUNDLE)))
    return found.select("folder", F.to_json(F.struct(F.lit(parser).alias("parser"), files.alias("files"), F.sha2("content", 256).alias("content_sha256"))).alias("value"))


def _with(raw: Column, name: str, value: Column) -> Column:
    """A JSON object's text with one field set; nulls take it out."""
    bare = F.regexp_replace(raw, rf'(?<!\\)"{name}"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^,{{}}\[\]"]+)\s*,?\s*', "")
    bare = F.regexp_replace(bare, r",\s*}$", "}")
    text = F.concat(F.lit(f'{{"{name}":'), value, F.when(bare.rlike(r"^\{\s*\}$"), "").otherwise(","), F.substring(bare, 2, 1 << 30))
    return F.when(value.isNull(), bare).otherwise(text)


def rejoined(parts: DataFrame) -> DataFrame:
    """(doc_id, content): documents that were parsed in parts (doc_id, part, start_page, content; folder), as one content list.

    Each part's pages are moved so that its first is the part's start page; items keep the order of parts and all their other
    fields.  Paths of images are put below the part's folder, if it has one; those that lead out of it are taken away."""
    folder = F.coalesce(F.col("folder"), F.lit("")) if "folder" in parts.columns else F.lit("")
    rows = parts.select("doc_id", "part", "start_page", folder.alias("folder"), F.posexplode(F.from_json("content", "array<string>")).alias("place", "x"))
    number = lambda c: F.get_json_object("x", f"$.{c}").cast("int")
    rows = rows.withColumn("page", F.coalesce(number("page_idx"), number("page"), number("page_no")))
    low = rows.groupBy("doc_id", "part").agg(F.min("page").alias("low"))
    item = F.col("x")
    for c in ("page", "page_no"):
        item = _with(item, c, F.lit(None).cast("string"))
    item = _with(item, "page_idx", (F.col("page") + F.col("start_page") - F.col("low")).cast("string"))
    for c in ("img_path", "image_path"):
        path = F.get_json_object("x", f"$.{c}")
        inside = safe_path(path)
        rooted = F.when(F.col("folder") == "", inside).otherwise(F.concat(F.col("folder"), F.lit("/"), inside))
        quoted = F.get_json_object(F.to_json(F.array(rooted)), "$").substr(F.lit(2), F.length(F.to_json(F.array(rooted))) - 2)
        item = F.when(path.isNull(), item).otherwise(_with(item, c, F.when(inside.isNotNull(), quoted)))
    moved = rows.join(low, ["doc_id", "part"]).select("doc_id", "part", "place", item.alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "x"))), lambda s: s["x"])
    return moved.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("content"))


def identity_of_folder(name: Column) -> Column:
    """struct(id_type, id_value) that a folder's name stands for; null if none."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("id_type"), value.alias("id_value"))
    return F.when(name.rlike(ARXIV_NEW), one("arxiv", name)).when(name.rlike(ARXIV_OLD), one("arxiv", F.replace(name, F.lit("_"), F.lit("/")))).when(name.rlike(NUMBER), one("inspire", name))


def manifests(folders: DataFrame, ids: DataFrame) -> DataFrame:
    """(folder, work_id): the works that parsed folders belong to, by their names."""
    named = folders.select("folder", identity_of_folder(F.element_at(F.split("folder", "/"), -1)).alias("i")).select("folder", "i.*").where("id_type is not null")
    return named.join(ids.groupBy("id_type", "id_value").agg(F.min("work_id").alias("work_id")), ["id_type", "id_value"]).select("folder", "work_id")


def old_rows(rows: DataFrame) -> DataFrame:
    """(value): rows of an older table (inspire_id, arxiv_id, doi, title, abstract, year) as hits; empty fields are left out."""
    have = lambda c: F.nullif(F.trim(c), F.lit(""))
    listed = lambda c, field: F.when(have(c).isNotNull(), F.array(F.struct(have(c).alias(field))))
    body = F.struct(
        F.expr("try_cast(inspire_id AS bigint)").alias("control_number"), listed("title", "title").alias("titles"), listed("abstract", "value").alias("abstracts"), listed("arxiv_id", "value").alias("arxiv_eprints"),
        listed("doi", "value").alias("dois"), F.when(F.col("year").isNotNull(), F.array(F.struct(F.col("year").cast("int").alias("year")))).alias("publication_info"),
    )
    return rows.select(F.to_json(F.struct(body.alias("metadata"))).alias("value"))


def site_pages(spark: SparkSession, root: str, pattern: str = "*.html", skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, html): a site's pages below a folder, without those whose names are to be skipped."""
    pages = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    name = F.element_at(F.split("path", "/"), -1)
    return pages.where(~name.isin(*skip)) if skip else pages


def configured(text: str) -> dict:
    """A collection's or a test run's configuration, as JSON."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration is an object")
    return found


def rewritten_queries(answer: str) -> list[str]:
    """The queries of a model's answer: a JSON list, an object with ``queries``, the first bracketed list, or its lines."""
    text = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", (answer or "").strip())
    for piece in (text, text[text.find("[") : text.rfind("]") + 1]):
        try:
            found = json.loads(piece)
        except ValueError:
            continue
        found = found.get("queries") if isinstance(found, dict) else found
        if isinstance(found, list):
            return list(dict.fromkeys(q for q in (str(x).strip() for x in found) if q))
    lines = (re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line).strip().strip('"') for line in text.splitlines())
    return list(dict.fromkeys(x for x in lines if x))
