"""An engine over a folder of tables: build its indexes, graphs and summaries, then search, retrieve, ask.

Tables, as Parquet below the folder (only ``works`` is needed): works (work_id, title, abstract, year; topics, collaborations
as arrays, if there are any), chunks (chunk_id, work_id, chunk_role, section, text), citations (src, dst), members
(collection, work_id), families (work_id, family, primary), similarity (src, dst, score).  What is built lies beside them in
``built``, as versions: a build makes anew what has changed and shows all of it at once.  Instead of being laid there, works,
citations and families can be made of a source's hits (``ingest``); they lie in ``library``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import query as Q
from quarry.functions.normalize import search_text
from quarry.operators import community, graph, inverted, records, scopes, search, summaries, vectors
from quarry.operators.families import title_classes, title_pairs
from quarry.operators.shared import written
from quarry.operators.versions import Store, Target, exists, stamp

SUMMARIES = 4
#: Edges are made anew if more than one in so many citations has changed.
REBUILD_SHARE = 5
EVIDENCE_CHARS = {"work": 700, "chunk": 500}
INSUFFICIENT = "There is not enough evidence to answer."


@F.arrow_udf(T.ArrayType(T.StringType()))
def index_words(texts: pa.Array) -> pa.Array:
    """The words that are indexed: those of the searched form, folded."""
    return pa.array([Q.words_of(search_text(t)) for t in texts.to_pylist()], pa.list_(pa.string()))


@dataclass
class Answer:
    strategy: str
    prompts: list[str]
    text: str
    evidence: list[dict]


def few(rows: DataFrame) -> DataFrame:
    """Ranked candidates, a few hundred rows at most, as a table of their own: what comes after doesn't search again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


class Engine:
    """Reads one version of what was built, from its making or its last ``build`` or ``refresh`` on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store, self.shelf = Store(spark, f"{self.folder}/built"), Store(spark, f"{self.folder}/library")
        self.version, self.library = self.store.current(), self.shelf.current()

    # ---- tables

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table: as it was made of ingested hits, or as it lies in the folder; one that is not there is empty if its ``schema`` is given."""
        if name in self.library.targets:
            return self.shelf.table(name, self.library)
        if schema is not None and not exists(self.spark, f"{self.folder}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def works(self) -> DataFrame:
        w = self.table("works")
        for c in ("topics", "collaborations"):
            w = w.withColumn(c, F.array_join(c, " ") if c in w.columns else F.lit(""))
        return w

    def chunks(self) -> DataFrame:
        return self.table("chunks", "chunk_id bigint, work_id bigint, chunk_role string, section string, text string")

    def members(self) -> DataFrame:
        return self.table("members", "collection string, work_id bigint")

    def families(self) -> DataFrame:
        return self.table("families", "work_id bigint, family bigint, primary bigint")

    # ---- ingesting

    def ingest(self, hits: DataFrame, log: Callable[[dict], None] = lambda row: None) -> dict[str, int]:
        """Add hits (value: JSON) to the library and make its tables of all hits so far: works, ids, citations, families.

        A work is what hits that share any identifier describe; its id is a hash of its name.  The same hits again change nothing but
        the files that hold them.  References to works that are not there yet are resolved when these come.  Afterwards ``build``
        makes what depends on the changed tables."""
        raw = f"{self.folder}/hits"
        hits.select("value").where("value IS NOT NULL").write.mode("append").text(raw)
        read = lambda others, name: self.spark.read.parquet(others[name]["path"])
        number = lambda c: F.xxhash64(c)

        def found(path: str, others: dict) -> None:
            records.merged(records.described(records.parse_hits(self.spark.read.text(raw).distinct()))).write.parquet(path)

        def works(path: str, others: dict) -> None:
            r = read(others, "records")
            listed = lambda df, column, name: df.groupBy("work").agg(F.array_sort(F.collect_set(column)).alias(name))
            topics, collaborations = listed(records.work_topics(r), "topic", "topics"), listed(records.work_collaborations(r), "collaboration", "collaborations")
            rows = records.works(r).join(topics, "work", "left").join(collaborations, "work", "left")
            none = F.array().cast("array<string>")
            rows.select(number("work").alias("work_id"), "work", "title", "abstract", "year", "citation_count", "source_url", "pdf_url", F.coalesce("topics", none).alias("topics"), F.coalesce("collaborations", none).alias("collaborations")).write.parquet(path)

        def ids(path: str, others: dict) -> None:
            records.work_ids(read(others, "records")).select(number("work").alias("work_id"), "id_type", "id_value", "is_primary").write.parquet(path)

        def citations(path: str, others: dict) -> None:
            r = read(others, "records")
            resolved = records.resolve_citations(records.citations(r), records.work_ids(r))
            resolved.select(number("work").alias("src"), F.when(F.col("dst").isNotNull(), number("dst")).alias("dst"), "dst_source", "dst_external_id").where("dst IS NULL OR src <> dst").write.parquet(path)

        def families(path: str, others: dict) -> None:
            r = read(others, "records")
            # A work is as its best record says: the one that gives it its title.
            best = r.groupBy("work").agg(F.max_by(F.struct(*(c for c in r.columns if c != "work")), F.struct("stage", F.coalesce("citation_count", F.lit(-1)), "title")).alias("b")).select(number("work").alias("work_id"), "b.*")
            best = written(best, "best-records")
            titles = written(title_classes(best.select(F.col("work_id").alias("doc_id"), F.col("title_normal").alias("text")), whole=True), "titles")
            names = best.select(F.col("work_id").alias("id"), "title_normal")
            alike = title_pairs(titles).select("src", "dst").join(names.select(F.col("id").alias("src"), F.col("title_normal").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("title_normal").alias("b")), "dst").select("a", "b").distinct()
            members = records.family_rows(best, records.family_pairs(best, alike))
            members.join(records.family_summary(members).select("family", "primary"), "family").select("work_id", "family", "primary").write.parquet(path)

        made = {"works": works, "ids": ids, "citations": citations, "families": families}
        targets = {"records": Target(found, [raw], recipe="merged"), **{k: Target(f, after=["records"]) for k, f in made.items()}}
        self.library = self.shelf.build(targets, log)
        return {k: self.shelf.table(k, self.library).count() for k in made}

    # ---- building

    def targets(self) -> dict[str, Target]:
        """What can be built, of what, and after what."""
        at = lambda *names: [self.library.targets[n]["path"] if n in self.library.targets else f"{self.folder}/{n}" for n in names]
        works, chunks = self.works(), self.chunks()
        titled = chunks.join(works.select("work_id", "title"), "work_id")

        def vectors_of(rows: DataFrame, key: str, inputs: list[str]) -> Target:
            return Target(lambda path, _: vectors.write_index(rows, path, key, "body"), inputs, recipe=vectors.HASHES[1])

        def edges(path: str, others: dict) -> None:
            self._write_edges(path, others["edges"])

        def communities_of(path: str, others: dict) -> None:
            self._write_communities(self.spark.read.parquet(f"{others['edges']['path']}/edges"), path)

        def facets_of(path: str, others: dict) -> None:
            summaries.facets(self._labels().select("work", F.col("kind").alias("facet"), F.col("value").alias("label")), self._described()).write.parquet(path)

        return {
            "words-works": inverted.target(works, "work_id", ["title", "abstract", "topics", "collaborations"], ["year"], index_words, at("works")),
            "words-chunks": inverted.target(titled, "chunk_id", ["title", "section", "text"], ["work_id", "chunk_role"], index_words, at("works", "chunks")),
            # A work is embedded as its title twice, its abstract and its topics; a chunk as title, section and text.
            "vectors-works": vectors_of(works.select("work_id", F.concat_ws(" ", "title", "title", "abstract", "topics").alias("body")), "work_id", at("works")),
            "vectors-chunks": vectors_of(titled.select("chunk_id", F.concat_ws(" ", "title", "section", "text").alias("body")), "chunk_id", at("works", "chunks")),
            "edges": Target(edges, at("citations"), recipe="mirrored"),
            "communities": Target(communities_of, at("works", "similarity"), ["edges"]),
            "facets": Target(facets_of, at("works")),
        }

    def build(self, log: Callable[[dict], None] = lambda row: None) -> dict[str, int]:
        """Build what is stale and publish it at once; returns the sizes of what there is.  ``log`` gets each target's outcome."""
        self.version = self.store.build(self.targets(), log)
        return {"works": self.works().count(), "chunks": self.chunks().count(), "edges": self.edges().where("src < dst").count()}

    def refresh(self) -> None:
        """Read the newest versions from now on."""
        self.version, self.library = self.store.current(), self.shelf.current()

    def built(self, name: str) -> DataFrame:
        return self.store.table(name, self.version)

    def edges(self) -> DataFrame:
        """Coupling and co-citation from both ends."""
        return self.spark.read.parquet(f"{self.version.targets['edges']['path']}/edges")

    def _write_edges(self, path: str, last: dict | None) -> None:
        """Edges of the citations, and the citations that they are of; if few of these have changed since the last time, only what they touch is made anew."""
        self.table("citations", "src bigint, dst bigint").where("dst is not null").select("src", "dst").distinct().write.parquet(f"{path}/cited")
        cited, made = self.spark.read.parquet(f"{path}/cited"), []
        old = changed = None
        if last is not None:
            old, before = (self.spark.read.parquet(f"{last['path']}/{x}") for x in ("edges", "cited"))
            changed = written(cited.join(before, ["src", "dst"], "left_anti").unionByName(before.join(cited, ["src", "dst"], "left_anti")), "changed-citations")
        few_changed = changed is not None and changed.count() * REBUILD_SHARE <= cited.count()
        for kind, node, via in (("bibliographic", "src", "dst"), ("co_citation", "dst", "src")):
            pairs = graph.updated_pairs(old.where((F.col("kind") == kind) & (F.col("src") < F.col("dst"))), cited, changed, node, via) if few_changed else graph.shared_pairs(cited, node, via)
            made.append(graph.mirrored(pairs.withColumn("kind", F.lit(kind))))
        made[0].unionByName(made[1]).sortWithinPartitions("src").write.parquet(f"{path}/edges")

    def similar(self) -> DataFrame:
        return self.table("similarity", "src bigint, dst bigint, score double")

    def _described(self) -> DataFrame:
        """(work, citations, year, title)."""
        cited = self.table("citations", "src bigint, dst bigint").where("dst is not null").groupBy(F.col("dst").alias("work_id")).agg(F.countDistinct("src").alias("citations"))
        return self.works().join(cited, "work_id", "left").select(F.col("work_id").alias("work"), F.coalesce("citations", F.lit(0)).alias("citations"), "year", "title")

    def _labels(self) -> DataFrame:
        """(work, kind, value) of topics and collaborations."""
        w, parts = self.table("works"), []
        for c, kind in (("topics", "topic"), ("collaborations", "collaboration")):
            if c in w.columns:
                parts.append(w.select(F.col("work_id").alias("work"), F.lit(kind).alias("kind"), F.explode(c).alias("value")))
        empty = self.spark.createDataFrame([], "work bigint, kind string, value string")
        return reduce(DataFrame.unionByName, parts, empty).where("trim(value) <> ''")

    def _write_communities(self, edges: DataFrame, path: str) -> None:
        """Both levels of communities as rows to search."""
        labels = self._labels()
        once = edges.where("src < dst")
        kind = lambda k: once.where(F.col("kind") == k).select("src", "dst", "shared", "score")
        keys = {k: labels.where(F.col("kind") == k).select("work", F.col("value").alias("key")) for k in ("topic", "collaboration")}
        weighted = community.weighted(community.signal_rows(self.similar(), kind("bibliographic"), kind("co_citation"), keys))
        strong = written(community.strong(weighted), "strong-edges")
        members = written(community.components(strong), "communities")
        own = written(summaries.communities(members, strong, self._described(), labels), "summaries")
        above = community.overviews(members, community.cross_weights(strong, members), community.top_labels(members, labels))
        summaries.with_overviews(own, above).write.parquet(path)

    # ---- search

    def _scope(self, collection: str | None) -> DataFrame | None:
        name = scopes.collection_name(collection)
        return None if name is None else self.members().where(F.col("collection") == name).select("work_id").distinct()

    def _found(self, target: str, profile: Q.Profile, allowed: DataFrame | None, limit: int) -> DataFrame:
        """(id, rank) by words."""
        words = inverted.read(self.store, f"words-{target}", self.version)
        # Statistics cover all rows; only works of the scope are returned.
        within = None if allowed is None else lambda rows: rows.join(allowed, "work_id", "left_semi")
        queries = Q.match_queries(profile)
        rank = search.search_works if target == "works" else search.search_chunks
        return rank(words, queries, limit, words.key, within=within).select(F.col(words.key).alias("id"), "rank")

    def _near(self, target: str, profile: Q.Profile, allowed: DataFrame | None, limit: int, words: DataFrame) -> DataFrame:
        """(id, score, hits, coverage, rank) by vectors."""
        index = vectors.Index(self.spark, self.version.targets[f"vectors-{target}"]["path"])
        ids = None
        if allowed is not None:
            ids = allowed if target == "works" else self.chunks().join(allowed, "work_id", "left_semi").select("chunk_id")
        scores = index.cosine(vectors.embedding_words(Q.embedded_form(profile)), ids)
        return search.vector_ranked(scores.select(F.col(scores.columns[0]).alias("id"), "score"), words, profile.groups, limit, analyze=index_words)

    def _texts(self, target: str) -> DataFrame:
        """(id, text) that may agree with a query: of works title and abstract, of chunks title, section and text."""
        if target == "works":
            return self.works().select(F.col("work_id").alias("id"), F.concat_ws(" ", "title", "abstract").alias("text"))
        titled = self.chunks().join(self.works().select("work_id", "title"), "work_id")
        return titled.select(F.col("chunk_id").alias("id"), F.concat_ws(" ", "title", "section", "text").alias("text"))

    def _fused(self, target: str, profile: Q.Profile, collection: str | None, limit: int) -> DataFrame:
        """Candidates of both lists with their reciprocal ranks, a few hundred rows, as a table of their own."""
        allowed, texts, groups = self._scope(collection), self._texts(target), profile.groups
        hits, coverage = search.agreement(F.col("words"), groups)
        found = few(self._found(target, profile, allowed, limit))
        found = texts.join(F.broadcast(found), "id").withColumn("words", index_words("text")).select("id", "rank", hits.alias("hits"), coverage.alias("coverage"))  # ``limit`` rows
        weights = search.WORKS_WEIGHTS if target == "works" else search.CHUNKS_WEIGHTS
        return few(search.fuse(found, self._near(target, profile, allowed, limit, texts), groups, weights))

    def search_works(self, query: str, collection: str | None = None, limit: int = 20, expand: int = 0, seeds: int = 5) -> DataFrame:
        """Ranked works, one of each family, with what is known of them; ``expand`` neighbours of the best support them."""
        profile = Q.analyze(query)
        fused = self._fused("works", profile, collection, max(3 * limit, 50))
        if expand:
            allowed = self._scope(collection)
            edges, similar = self.edges().select("src", "dst", "shared", "score"), graph.mirrored(self.similar())
            if allowed is not None:
                inside = lambda df: df.join(allowed.withColumnRenamed("work_id", "src"), "src", "left_semi").join(allowed.withColumnRenamed("work_id", "dst"), "dst", "left_semi")
                edges, similar = inside(edges), inside(similar)
            fused = search.inject(fused, edges, similar, profile.groups, expand, seeds)
        else:
            fused = fused.withColumn("graph_score", F.lit(0.0))
        ranked = search.one_per_family(search.rank_works(fused, limit), self.families().withColumnRenamed("work_id", "id"), limit)
        return scopes.hydrated(ranked.withColumnRenamed("id", "work_id"), self.works().select("work_id", "title", "abstract", "year").join(F.broadcast(ranked.select(F.col("id").alias("work_id"), "hits", "coverage", "hybrid", "versions")), "work_id"))

    def search_chunks(self, query: str, collection: str | None = None, limit: int = 20) -> DataFrame:
        fused = self._fused("chunks", Q.analyze(query), collection, max(3 * limit, 50))
        ranked = search.rank_chunks(fused, limit).withColumnRenamed("id", "chunk_id")
        return scopes.hydrated(ranked, self.chunks().join(F.broadcast(ranked.select("chunk_id", "hits", "coverage", "hybrid")), "chunk_id"), "chunk_id")

    def neighbours(self, work_id: int, limit: int = 10, kind: str = "all", collection: str | None = None) -> DataFrame:
        """(dst, shared, score, kind) of a work's neighbours in a collection: by coupling and co-citation (``all`` means both), or by ``similarity``."""
        if kind == "similarity":
            edges = graph.mirrored(self.similar()).select("src", "dst", F.lit(0).cast("long").alias("shared"), "score", F.lit(kind).alias("kind"))
        else:
            edges = self.edges().where(F.lit(True) if kind == "all" else F.col("kind") == kind)
        edges = edges.where(F.col("src") == work_id)
        allowed = self._scope(collection)
        if allowed is not None:
            edges = edges.join(allowed.withColumnRenamed("work_id", "dst"), "dst", "left_semi")
        return edges.orderBy(F.col("shared").desc(), F.round("score", 9).desc_nulls_last(), "dst", "kind").limit(limit)

    def search_communities(self, query: str, limit: int = 4, collection: str | None = None) -> DataFrame:
        """Ranked summaries of communities; with a collection those that a work of it stands for."""
        return summaries.search_communities(self._standing(self.built("communities"), collection), Q.analyze(query).groups, limit)

    def search_facets(self, query: str, limit: int = 4, collection: str | None = None) -> DataFrame:
        return summaries.search_facets(self._standing(self.built("facets"), collection), Q.analyze(query).groups, limit)

    def _standing(self, rows: DataFrame, collection: str | None) -> DataFrame:
        allowed = self._scope(collection)
        if allowed is None:
            return rows
        inside = rows.select("id", F.explode("representatives").alias("work_id")).join(allowed, "work_id", "left_semi").select("id").distinct()
        return rows.join(inside, "id", "left_semi")

    # ---- retrieval and answers

    def retrieve(self, query: str, collection: str | None = None, limit: int = 8, target: str | None = None) -> dict:
        """What the route asks for: works and the chunks that support them (their own first), chunks and the works that they come
        from, or summaries (``community``, ``facet``) and the works that stand for them.  Questions about relations and results also
        get summaries beside their works."""
        routed, expand = Q.route(query)
        target = target or routed
        some = min(limit, SUMMARIES)
        found = {"target": target, "collection": scopes.collection_name(collection) or "all", "summaries": Q.wants_summaries(query, target), "communities": None, "facets": None}
        if target == "community" or found["summaries"]:
            found["communities"] = self.search_communities(query, some, collection)
        if target == "facet" or found["summaries"]:
            found["facets"] = self.search_facets(query, some, collection)
        chunks = self.search_chunks(query, collection, 3 * limit)
        if target == "chunks":
            chunks = chunks.where(F.col("rank") <= limit)
            return found | {"works": self._works_of(chunks, limit), "chunks": chunks}
        if target == "works":
            works = self.search_works(query, collection, limit, expand)
        else:
            first = summaries.works_of(found["communities"] if target == "community" else found["facets"], limit).withColumnRenamed("work", "work_id")
            works = scopes.hydrated(first, self.works().select("work_id", "title", "abstract", "year"))
        own = F.broadcast(works.select("work_id", F.lit(1).alias("own")))
        near = chunks.join(own, "work_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        order = [F.col("own").desc(), F.col("rank")]
        near = near.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= limit)
        return found | {"works": works, "chunks": near.drop("rank", "own").withColumnRenamed("place", "rank").orderBy("rank")}

    def _works_of(self, chunks: DataFrame, limit: int) -> DataFrame:
        """The works that chunks come from, one of each family, by their best chunk."""
        first = chunks.groupBy("work_id").agg(F.min("rank").alias("rank")).withColumnRenamed("work_id", "id")
        one = search.one_per_family(first, self.families().withColumnRenamed("work_id", "id"), limit).select(F.col("id").alias("work_id"), "rank")
        return scopes.hydrated(one, self.works().select("work_id", "title", "abstract", "year"))

    def document(self, work_id: int) -> dict:
        """A work, its chunks by role, and how ready they are: retrievable chunks, empty ones, whether the indexes are of the tables as they are."""
        chunks = self.chunks().where(F.col("work_id") == work_id)
        roles = {r.chunk_role: r["count"] for r in chunks.groupBy("chunk_role").count().collect()}  # a handful of roles
        work = self.works().where(F.col("work_id") == work_id).first()
        empty = chunks.where("trim(coalesce(text, '')) = ''").count()
        stale = sorted(n for n, t in self.targets().items() if n not in self.version.targets or self.version.targets[n]["of"]["files"] != stamp(self.spark, *t.inputs))
        return {"work": work and work.asDict(), "chunks": roles, "empty_chunks": empty, "stale": stale, "ready": bool(roles) and not empty and not stale}

    def ideas(self, query: str, limit: int = 5, collection: str | None = None) -> list[dict]:
        """Communities as starting points: each with a score between 0.45 and 1, the works that stand for it, and the steps that led to it."""
        rows = self.search_communities(query, limit, collection).collect()  # ``limit`` rows
        top = max((r.score for r in rows), default=0.0) or 1.0
        ranked = [{"title": r.label, "score": round(min(1.0, 0.45 + 0.5 * r.score / top), 3), "works": list(r.representatives or ()), "steps": [f"query: {query}", f"community: {r.id}", f"hits: {r.hits}"]} for r in rows]
        return sorted(ranked, key=lambda x: (-x["score"], x["title"]))

    def evidence(self, found: dict) -> list[dict]:
        """Works and chunks with their references, shortened; repeats are counted once."""
        out: list[dict] = []
        for lane, mark, rows, text in (("work", "W", found["works"], "abstract"), ("chunk", "C", found["chunks"], "text")):
            for i, r in enumerate(rows.collect(), 1):  # at most the limit of the retrieval
                body = " ".join(str(r[text] or "").split())
                limit = EVIDENCE_CHARS[lane]
                out.append({"ref": f"{mark}{i}", "lane": lane, "key": f"{lane}:{r['work_id' if lane == 'work' else 'chunk_id']}", "title": r["title"] if lane == "work" else r["section"], "text": body if len(body) <= limit else body[: limit - 1].rstrip() + "…"})
        return out

    def units(self, found: dict) -> list[dict]:
        """What a survey is answered by: each overview with its communities, the facets whose words it shares, and the works that stand for any of them."""
        if found["communities"] is None:
            return []
        rows, facets = found["communities"].collect(), found["facets"].collect()  # a few rows each
        out = []
        for o in (r for r in rows if r.level == "overview"):
            parts = [r for r in rows if r.parent == o.id][: summaries.SHOWN_CHILDREN]
            words = set(Q.words_of(" ".join(r.label for r in (o, *parts))))
            near = [f for f in facets if words & set(Q.words_of(f.label))]
            works = dict.fromkeys(w for r in (o, *parts, *near) for w in r.representatives or ())
            text = "; ".join([o.text, *(r.label for r in parts), *(f.label for f in near)])
            out.append({"label": o.label, "text": text, "work_ids": list(works)})
        return out

    def ask(self, query: str, answer: Callable[[str], str], collection: str | None = None, limit: int = 8, overviews: list[dict] | None = None) -> Answer:
        """An answer from evidence by a language model that is called as a function.

        Without evidence the model is not asked.  A survey with overviews (label, text, work_ids; those of the communities found, if
        none are given) is answered unit by unit and the notes are put together; anything else in one pass.
        """
        found = self.retrieve(query, collection, limit)
        items = self.evidence(found)
        overviews = self.units(found) if overviews is None else overviews
        how = Q.strategy(len(overviews), len(items), found["summaries"])
        if how == "insufficient_evidence":
            return Answer(how, [], INSUFFICIENT, [])
        shown = lambda rows: "\n".join(f"[{x['ref']}] {x['title'] or ''}: {x['text']}" for x in rows)
        if how == "single_pass":
            prompts = [f"Question: {query}\n\nEvidence:\n{shown(items)}\n\nAnswer with references."]
            return Answer(how, prompts, answer(prompts[0]), items)
        prompts, notes = [], []
        for i, o in enumerate(overviews, 1):
            keys = {f"work:{w}" for w in o.get("work_ids", ())}
            own = [x for x in items if x["key"] in keys] or items[:2]
            prompts.append(f"Question: {query}\n\n[G{i}] {o['label']}: {o.get('text', '')}\n{shown(own)}\n\nNote what bears on the question.")
            notes.append(f"[G{i}] {answer(prompts[-1])}")
        prompts.append(f"Question: {query}\n\nNotes:\n" + "\n".join(notes) + "\n\nPut them together, with references.")
        return Answer(how, prompts, answer(prompts[-1]), items)

    def status(self) -> dict[str, int]:
        """How many rows the tables have."""
        return {n: f().count() for n, f in (("works", self.works), ("chunks", self.chunks), ("members", self.members), ("families", self.families))}
