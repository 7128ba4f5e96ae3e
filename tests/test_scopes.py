"""Scopes, selections, logs, and what comes in from outside."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import records, scopes
from quarry.sources import landing


def ids(df, c="work_id"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame([(1, "inspire", "11"), (2, "pdg", "x"), (3, "arxiv", " "), (4, None, None)], "work_id long, canonical_source string, canonical_id string")


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame([("b", 1), ("a", 1), ("a", 3), ("b", 2)], "collection string, work_id long")


def test_scopes_of_works(spark, works, members):
    for name in (None, "", "all", "*", "ALL_collections", "collection:all"):
        assert ids(scopes.in_scope(works, members, name)) == [1, 2, 3, 4]
    assert ids(scopes.in_scope(works, members, " collection:a ")) == [1, 3]
    assert ids(scopes.selected(works, members, [4, 4, 9], "a")) == [4]
    assert ids(scopes.selected(works, members, None, "b")) == [1, 2]
    assert [(r.name, r.works) for r in scopes.scopes(members, works).orderBy("place").collect()] == [("all", 4), ("a", 2), ("b", 2)]
    bars = spark.createDataFrame([("|a|bc|",), (None,)], "c string")
    assert [r[0] for r in bars.select(scopes.has_collection(F.col("c"), "b")).collect()] == [False, False]
    assert [r[0] for r in bars.select(scopes.has_collection(F.col("c"), "bc")).collect()] == [True, False]
    assert {r.work_id: r.collection for r in scopes.first_collection(works, members).collect()} == {1: "a", 2: "b", 3: "a", 4: None}


def test_selections_and_annotations(spark, works):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert ids(scopes.without_edges(works, edges)) == [2, 3, 4]
    known = spark.createDataFrame([(3, "pdg", "p", False), (1, "doi", "d", False), (1, "arxiv", "2401.1", False), (1, "inspire", "11", True), (3, "zzz", "q", False)], "work_id long, id_type string, id_value string, is_primary boolean")
    assert ids(scopes.without_kind(works, known, "pdg")) == [1, 4]
    assert {r.work_id: r.stem for r in scopes.storage_stems(works, known).collect()} == {1: "11", 2: "x", 3: "p", 4: "work-4"}
    ranked = spark.createDataFrame([(3, 1), (9, 2), (1, 3)], "work_id long, rank long")
    assert [r.work_id for r in scopes.hydrated(ranked, works).collect()] == [3, 1]
    docs = spark.createDataFrame([(1, 1, "m", "materialized"), (2, 2, "m", "failed"), (2, 5, "m", "registered")], "work_id long, document_id long, parser_name string, parse_status string")
    pdfs = spark.createDataFrame([(1,), (2,), (3,)], "work_id long")
    one = docs.where("document_id < 5")
    assert ids(scopes.reparse_candidates(works, one, pdfs, "m", False, 9)) == [2, 3]
    assert ids(scopes.reparse_candidates(works, one, pdfs, "n", True, 9)) == [3]
    assert ids(scopes.reparse_candidates(works, one, pdfs, None, True, 2)) == [1, 2]
    got = {r.work_id: (r.known, r.has_pdf, r.has_document, r.parse_status) for r in scopes.annotated(spark.createDataFrame([(1,), (2,), (8,)], "work_id long"), works, docs, pdfs).collect()}
    assert got == {1: (True, True, True, "materialized"), 2: (True, True, True, "registered"), 8: (False, False, False, None)}
    chunks = spark.createDataFrame([(1, 3, "late", True), (1, 2, "first", True), (1, 1, "no", False), (2, 4, "", True)], "section_id long, chunk_id long, text string, searched boolean")
    assert {r.section_id: r.first_text for r in scopes.first_texts(spark.range(1, 3).withColumnRenamed("id", "section_id"), chunks).collect()} == {1: "first", 2: None}


def test_rebuilds_marks_and_runs(spark, members):
    old = spark.createDataFrame([(1, 3, 5), (1, 2, 5), (2, 9, 5)], "src long, dst long, shared int")
    new = spark.createDataFrame([(1, 3, 7)], "src long, dst long, shared int")
    got = sorted(map(tuple, scopes.rebuilt_edges(old, new, members.where("collection = 'a'")).collect()))
    assert got == [(1, 2, 5), (1, 3, 7), (2, 9, 5)]
    assert scopes.rebuilt_edges(old, new).count() == 1
    assert ids(scopes.stale(old, new, ["src", "dst"]), "dst") == [2, 9]
    marks = spark.createDataFrame([("search", "work", 1, "2024-01-02"), ("search", "work", 2, "2024-01-01"), ("graph", "work", 1, "2024-01-01"), ("search", "x", 7, "2024-01-09")], "lane string, kind string, work_id long, at string").withColumn("updated_at", F.to_timestamp("at"))
    assert ids(scopes.dirty(marks, "search")) == [1, 2]
    assert ids(scopes.dirty(marks, "search", since="2024-01-02 00:00:00")) == [1]
    assert ids(scopes.dirty(marks, "search", ids=[2, 7])) == [2]
    assert ids(scopes.dirty(marks, "search", members=members, name="a")) == [1]
    built = []
    done = scopes.sync(marks, "search", False, lambda: built.append(1), lambda: len(built))
    assert (done["status"], done["selected"], done["before"], done["after"], done["marks"].count()) == ("succeeded", 3, 0, 1, 1)
    assert scopes.sync(marks, "none", False, lambda: built.append(1), lambda: len(built))["status"] == "skipped"
    assert scopes.sync(marks, "none", True, lambda: built.append(1), lambda: len(built))["after"] == 2
    log = spark.createDataFrame([("r", 1, 10, "running"), ("r", 2, 20, "succeeded"), ("s", 1, 5, "failed")], "run string, seq int, at int, status string")
    assert sorted(map(tuple, scopes.run_log(log).collect())) == [("r", 10, 20, "succeeded", 2), ("s", 5, 5, "failed", 1)]


def test_search_plans(spark):
    assert landing.search_query("higgs", True, "and topcite 10+") == "(higgs) and collection:Published and topcite 10+"
    assert landing.search_query(" higgs ") == "higgs"
    assert [landing.page_size(n) for n in (0, 7, 900)] == [1, 7, 50]
    assert landing.year_buckets("2010-2014, 2016") == [(2010, 2014), (2016, 2016)]
    assert landing.year_buckets(None)[0] == (2010, 2014)
    with pytest.raises(ValueError, match="range"):
        landing.year_buckets("x")
    plan = landing.shards(spark, ["a", "b"], [(2010, 2014), (2015, 2015)])
    assert [r.text for r in plan.orderBy("shard").collect()][1] == "a and date 2015->2015"
    assert landing.rewritten_queries('```json\n{"queries": ["a", "b", "a"]}\n```') == ["a", "b"]
    assert landing.rewritten_queries('Sure: ["x", "y"] ok') == ["x", "y"]
    assert landing.rewritten_queries("- one\n2. two\n\n* \"three\"") == ["one", "two", "three"]


def test_landed_pages_bundles_and_old_rows(spark, tmp_path):
    hit = {"metadata": {"control_number": 5, "titles": [{"title": "T"}]}}
    pages = spark.createDataFrame([("r1", "s0", 1, json.dumps({"hits": {"hits": [hit, hit]}})), ("r1", "s0", 2, "broken")], "run_id string, shard string, page int, body string")
    landing.land(pages, str(tmp_path / "raw"))
    back = landing.landed(spark, str(tmp_path / "raw"))
    found = records.parse_hits(landing.hits_of(back))
    assert [r.control_number for r in found.collect()] == [5, 5]
    folder = tmp_path / "parsed" / "2401.00001"
    folder.mkdir(parents=True)
    (folder / "p_content_list.json").write_text('[{"type": "text", "text": "a\\nb"}]')
    (folder / "p_full.md").write_text("# T\n\nx")
    (tmp_path / "parsed" / "empty").mkdir()
    (tmp_path / "parsed" / "empty" / "other.txt").write_text("no")
    b = landing.bundles(spark, str(tmp_path / "parsed")).collect()
    assert [(r.folder.rsplit("/", 1)[-1], r.text, r.model) for r in b] == [("2401.00001", "# T\n\nx", None)]
    folders = spark.createDataFrame([("x/2401.00001",), ("x/hep-ph_9901234",), ("x/77",), ("x/other",)], "folder string")
    known = spark.createDataFrame([(4, "arxiv", "2401.00001"), (5, "arxiv", "hep-ph/9901234"), (6, "inspire", "77")], "work_id long, id_type string, id_value string")
    assert sorted(map(tuple, landing.manifests(folders, known).collect())) == [("x/2401.00001", 4), ("x/77", 6), ("x/hep-ph_9901234", 5)]
    old = spark.createDataFrame([("9", "", "10.1/A", "Title", None, 2020), ("x", None, None, " ", None, None)], "inspire_id string, arxiv_id string, doi string, title string, abstract string, year int")
    got = records.described(records.parse_hits(landing.old_rows(old))).collect()
    assert [(r.inspire, r.arxiv, r.doi, r.title, r.year) for r in got] == [("9", None, "10.1/a", "Title", 2020)]
    site = landing.site_pages(spark, str(tmp_path / "parsed"), "*.md", ("none.md",))
    assert [r.html for r in site.collect()] == ["# T\n\nx"]


def test_parts_of_a_document_are_rejoined(spark):
    part = lambda *pages: json.dumps([{"type": "text", "text": f"t{p}", "page_idx": p} for p in pages])
    parts = spark.createDataFrame([(1, 2, 10, part(0, 1)), (1, 1, 0, part(3, 4))], "doc_id long, part int, start_page int, content string")
    got = json.loads(landing.rejoined(parts).first().content)
    assert [(x["text"], x["page_idx"]) for x in got] == [("t3", 0), ("t4", 1), ("t0", 10), ("t1", 11)]


def test_rejoined_parts_keep_all_fields_and_safe_paths(spark):
    a = [{"type": "image", "img_path": 'images/a "b.png', "page_idx": 2, "text_format": "latex", "nested": {"k": [1, {"z": "}"}]}}, {"type": "image", "img_path": "../../etc/passwd", "page_no": 3}]
    b = [{"page": 0, "image_path": "x/y.png", "table_body": '<td>"page": 9</td>'}, {"page_idx": 1, "image_path": "/abs"}, {"page_idx": 5}, {"image_path": "file:///x", "text": "no page"}]
    parts = spark.createDataFrame([(1, 1, 0, "p1", json.dumps(a)), (1, 2, 10, "p2", json.dumps(b)), (2, 1, 0, None, json.dumps(a[:1]))], "doc_id long, part int, start_page int, folder string, content string")
    got = {r.doc_id: json.loads(r.content) for r in landing.rejoined(parts).collect()}
    assert got[1] == [
        {"type": "image", "img_path": "p1/" + a[0]["img_path"], "page_idx": 0, "text_format": "latex", "nested": {"k": [1, {"z": "}"}]}}, {"type": "image", "page_idx": 1},
        {"page_idx": 10, "image_path": "p2/x/y.png", "table_body": b[0]["table_body"]}, {"page_idx": 11}, {"page_idx": 15}, {"text": "no page"},
    ]
    assert got[2][0]["img_path"] == a[0]["img_path"]


def test_zipped_bundles_refuse_hostile_paths(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "2401.00001.zip", "w") as z:
        z.writestr("out/p_content_list.json", "[]")
        z.writestr("out/full.md", "# T")
        z.writestr("../../escape_content_list.json", "[1]")
        z.writestr("/abs/full.md", "x")
        z.writestr("images/a.png", b"123")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    found = landing.zipped_bundles(spark, str(tmp_path))
    assert [(r.folder.rsplit("/", 1)[-1], r.content, r.text, r.model, r.refused) for r in found.collect()] == [("2401.00001", "[]", "# T", None, ["../../escape_content_list.json", "/abs/full.md"])]
    manifest = json.loads(landing.manifest_rows(found, "reader").first().value)
    assert (manifest["parser"], manifest["files"]) == ("reader", ["content", "text"])
    paths = spark.createDataFrame([("a/b.png",), ("..",), ("a/../b",), ("C:\\x",), ("http://x",), ("a..b/c",)], "p string")
    assert [r.p for r in paths.select(landing.safe_path(F.col("p")).alias("p")).collect()] == ["a/b.png", None, None, None, None, "a..b/c"]


def test_required_fields_and_rewrites():
    from quarry.functions import query as Q

    assert landing.with_required([" titles", "dois", "", "titles"]) == ["titles", "dois", "control_number", "abstracts", "collaborations", "document_type", "earliest_date", "publication_info", "references"]
    assert Q.needs_rewrite("rare decays") and not Q.needs_rewrite("  ") and not Q.needs_rewrite(None)
    assert not Q.needs_rewrite("Title: decays") and not Q.needs_rewrite("x", enabled=False) and not Q.needs_rewrite("x", model=False) and not Q.needs_rewrite("x", most=1)
