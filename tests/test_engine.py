"""The engine over a small folder of tables."""

import pytest

from quarry.engine import Engine

WORKS = [
    (801, "Four muons from one eta meson", "Counting the rare decay of eta mesons to four muons over a decade of running.", 2021, []),
    (802, "Looking for odd decays of the Higgs boson", "An exotic Higgs boson might end in photons; none is seen.", 2022, []),
    (901, "How same-sign W boson pairs are polarized", "CMS splits same-sign W boson pairs with two jets by their polarization, in vector boson scattering.", 2020, ["CMS"]),
    (902, "Two W bosons of one charge beside two jets", "CMS sees electroweak same-sign W boson pairs with two jets.", 2018, ["CMS"]),
    (903, "Same-sign W boson pairs, measured and read", "ATLAS measures same-sign W boson pairs with two jets.", 2023, ["ATLAS"]),
    (904, "Ten years of cross sections at CMS", "What the CMS programme has measured, from common to rare, and what comes next.", 2024, ["CMS"]),
    (701, "An exotic Higgs boson and four photons", "Decays of exotic Higgs bosons, broadly.", 2019, []),
    (702, "An exotic Higgs boson, two muons and two b quarks", "Another exotic Higgs boson decay.", 2019, []),
]
TOPICS = {801: ["rare decays"], 802: ["Higgs"], 901: ["polarization", "same-sign WW"], 902: ["same-sign WW"], 903: ["same-sign WW"], 904: ["cross sections"], 701: ["Higgs"], 702: ["Higgs"]}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("engine"))
    spark.createDataFrame([(*w[:4], w[4], TOPICS[w[0]]) for w in WORKS], "work_id long, title string, abstract string, year int, collaborations array<string>, topics array<string>").write.parquet(f"{folder}/works")
    chunks = [(1, 801, "abstract_chunk", "Abstract", "Eta mesons end in four muons."), (2, 801, "section_child", "Yield", "The efficiency of four muons is low."), (3, 802, "section_child", "Limits", "Photons of the Higgs boson.")]
    spark.createDataFrame(chunks, "chunk_id long, work_id long, chunk_role string, section string, text string").write.parquet(f"{folder}/chunks")
    spark.createDataFrame([(s, d) for s in (701, 702) for d in (801, 802)], "src long, dst long").write.parquet(f"{folder}/citations")
    spark.createDataFrame([("ww", i) for i in (901, 902, 903, 904)], "collection string, work_id long").write.parquet(f"{folder}/members")
    spark.createDataFrame([(701, 701, 702), (702, 701, 702)], "work_id long, family long, primary long").write.parquet(f"{folder}/families")
    e = Engine(spark, folder)
    assert e.build() == {"works": 8, "chunks": 3, "edges": 2}
    return e


def test_works_are_found_and_ranked(engine):
    assert engine.search_works("综述一下 rare decay four muons 相关工作", limit=5).first().work_id == 801
    got = [r.work_id for r in engine.search_works("CMS current SSWW best results", "collection:ww", 4).collect()]
    assert got[0] == 901
    assert got[1] in (902, 904)
    assert set(got) <= {901, 902, 903, 904}


def test_families_and_graph_support(engine):
    rows = {r.work_id: r for r in engine.search_works("exotic Higgs boson decays", limit=5, expand=3).collect()}
    assert 702 in rows and 701 not in rows
    assert rows[702].versions == [701]
    assert [(r.dst, r.shared) for r in engine.neighbours(701).collect()] == [(702, 2)]
    assert engine.search_works("zzz qqq", limit=5).where("hits > 0").count() == 0


def test_chunks_retrieval_and_answers(engine):
    assert engine.search_chunks("efficiency four muons", limit=2).first().chunk_id == 2
    found = engine.retrieve("four muons efficiency")
    assert found["target"] == "chunks"
    assert found["works"].first().work_id == 801
    found = engine.retrieve("overview of four muons", limit=3)
    assert found["target"] == "works" and found["summaries"]
    assert [r.chunk_id for r in found["chunks"].collect()][0] in (1, 2)
    asked = []
    reply = lambda p: asked.append(p) or f"answer {len(asked)}"
    got = engine.ask("four muons efficiency", reply, limit=2)
    assert (got.strategy, got.text, len(asked)) == ("single_pass", "answer 1", 1)
    assert "[C1]" in asked[0] and got.evidence[0]["ref"] == "W1"
    got = engine.ask("overview of four muons", reply, limit=2, overviews=[{"label": "Rare decays", "work_ids": [801]}])
    assert (got.strategy, len(got.prompts)) == ("community_map_reduce", 2)
    assert "[G1]" in got.prompts[0]
    assert engine.status()["works"] == 8


def test_summaries_of_communities_and_facets(engine):
    rows = {r.id: r for r in engine.built("communities").collect()}
    higgs = rows["fine:701"]
    assert higgs.label == "Higgs community"
    assert (higgs.level, higgs.works, sorted(higgs.representatives)) == ("fine", 2, [701, 702])
    assert "topics: Higgs=2" in higgs.text and "signals: bibliographic=1" in higgs.text
    facets = {(r.facet, r.label): (r.works, list(r.representatives)) for r in engine.built("facets").collect()}
    assert facets["topic", "same-sign WW"] == (3, [903, 901, 902])
    assert facets["collaboration", "CMS"][0] == 3 and ("topic", "rare decays") not in facets
    found = engine.retrieve("overview of Higgs boson decays", limit=4)
    assert found["communities"].first().label == "Higgs community"
    assert ("topic", "Higgs") in {(r.facet, r.label) for r in found["facets"].collect()}
    found = engine.retrieve("Higgs", limit=4, target="community")
    assert {701, 702} <= {r.work_id for r in found["works"].collect()} <= {701, 702, 801, 802}
    assert [r.label for r in engine.search_facets("same-sign CMS", collection="ww").collect()][:1] in (["CMS"], ["same-sign WW"])
    assert engine.search_communities("Higgs", collection="ww").count() == 0


def test_ideas_and_documents(engine):
    ideas = engine.ideas("Higgs decays")
    assert ideas[0]["score"] == 0.95 and set(ideas[0]["works"]) in ({701, 702}, {801, 802})
    doc = engine.document(801)
    assert doc["chunks"] == {"abstract_chunk": 1, "section_child": 1} and doc["ready"] and doc["stale"] == []
    assert not engine.document(901)["ready"]


def test_neighbours_by_kind_and_scope(engine):
    assert [(r.dst, r.kind) for r in engine.neighbours(801).collect()] == [(802, "co_citation")]
    assert engine.neighbours(801, kind="bibliographic").count() == engine.neighbours(801, collection="ww").count() == engine.neighbours(801, kind="similarity").count() == 0


def test_a_build_makes_only_what_changed(engine, spark):
    log = []
    number = engine.version.number
    engine.build(log.append)
    assert {r["state"] for r in log} == {"current"} and engine.version.number == number
    old = Engine(spark, engine.folder)
    spark.createDataFrame([(i, i + 1) for i in range(5000, 5040)], "src long, dst long").write.mode("append").parquet(f"{engine.folder}/citations")
    engine.build()
    spark.createDataFrame([(903, 801), (903, 802)], "src long, dst long").write.mode("append").parquet(f"{engine.folder}/citations")
    log.clear()
    engine.build(log.append)
    assert {r["target"] for r in log if r["state"] == "built"} == {"edges", "communities"}
    rebuilt = Engine(spark, engine.folder)
    rebuilt.store = type(rebuilt.store)(spark, f"{engine.folder}/anew")
    rebuilt.build()
    assert sorted(map(tuple, engine.edges().collect())) == sorted(map(tuple, rebuilt.edges().collect()))
    assert engine.neighbours(903).count() == 2 and old.neighbours(903).count() == 0
    old.refresh()
    assert old.neighbours(903).count() == 2


def test_command_line(engine, capsys):
    from quarry.__main__ import main

    main(["list"])
    assert "hybrid_works" in capsys.readouterr().out.split()
    main(["profile", "CMS current SSWW best results"])
    assert '"target": "works"' in capsys.readouterr().out
    main(["status", engine.folder])
    assert '"works": 8' in capsys.readouterr().out
    main(["neighbours", engine.folder, "701"])
    assert '"dst": 702' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "nothing", engine.folder])


def test_hits_become_a_library(spark, tmp_path):
    import json

    def hit(number, title, **more):
        return json.dumps({"metadata": {"control_number": number, "titles": [{"title": title}], "publication_info": [{"year": 2020}], **more}})

    title = "Cold glass stacks shrink a little and then settle on their shelves"
    first = [
        hit(1, title, document_type=["article"], dois=[{"value": "10.1/A"}], collaborations=[{"value": "Hall"}], keywords=[{"value": "Glass"}], references=[{"control_number": 2}, {"control_number": 9}]),
        json.dumps({"metadata": {"titles": [{"title": title}], "dois": [{"value": "10.1/a"}], "abstracts": [{"value": "shelves"}]}}),
        hit(3, f"{title} again", document_type=["conference paper"], collaborations=[{"value": "hall"}], references=[{"control_number": 2}, {"control_number": 9}]),
        "no json",
    ]
    engine = Engine(spark, str(tmp_path))
    lines = lambda rows: spark.createDataFrame([(r,) for r in rows], "value string")
    assert engine.ingest(lines(first)) == {"works": 2, "ids": 3, "citations": 4, "families": 2}
    works = {r.title: r for r in engine.table("works").collect()}
    assert (works[title].topics, works[title].collaborations, works[title].work) == (["Glass"], ["hall"], "doi:10.1/a")
    assert {r.family for r in engine.families().collect()} == {min(r.work_id for r in works.values())}
    assert {r.primary for r in engine.families().collect()} == {works[title].work_id}
    log = []
    assert engine.ingest(lines(first[:1]), log.append)["works"] == 2
    assert engine.table("citations").where("dst IS NOT NULL").count() == 0
    engine.ingest(lines([hit(2, "Older glass"), hit(9, "Oldest glass")]))
    assert engine.table("citations").where("dst IS NOT NULL").count() == 4
    assert engine.build()["edges"] == 2
    found = engine.search_works("cold glass stacks", limit=5).collect()
    assert found[0].title == title and len(found[0].versions) == 1
    assert engine.neighbours(works[title].work_id).first().shared == 2
