"""What the plans must look like: no cross products, filters and columns pushed to the scan."""

import pytest

from quarry.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: Queries whose plan can be read without running part of them.
LAZY = ["term_stats", "hash_idf_vectors", "biblio_coupling", "graph_neighbors", "citation_backfill", "alias_grounding", "facet_summaries", "transfer_candidates", "structure_status", "dirty_clear", "scope_filter", "event_prune", "document_audit"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_product(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["event_tail"](spark, FOLDER))
    assert "GreaterThan(event_id,500)" in text
    assert "EqualTo(user_id,8)" in text


def test_only_needed_columns_are_read(spark):
    text = plan(catalog.QUERIES["biblio_coupling"](spark, FOLDER))
    assert "l_extendedprice" not in text


def test_a_null_in_a_key_is_no_key(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE part AS SELECT i AS p_partkey, CASE WHEN i % 2 = 0 THEN 'Ring' END AS p_name, 'B' AS p_brand, (i // 4)::INT AS p_size FROM range(12) t(i)")
    con.sql("CREATE TABLE lineitem AS SELECT i AS l_partkey, s AS l_suppkey, CASE s WHEN 1 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(12) t(i), range(3) u(s)")
    for name in ("part", "lineitem"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    want = con.sql(catalog.SQL["transfer_candidates"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["transfer_candidates"](spark, str(tmp_path)).collect())) == sorted(want)
