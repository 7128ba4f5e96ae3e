"""Versioned stores: staleness, order, failures, concurrent builds, readers."""

import pytest

from quarry.operators.shared import new_path
from quarry.operators.versions import Conflict, Store, Target, derived, ordered, stamp


@pytest.fixture
def store(spark):
    return Store(spark, new_path(spark, "store"))


def doubling(spark, source):
    return lambda path, others: spark.read.parquet(source).selectExpr("2 * n AS n").write.parquet(path)


def after(spark, name):
    return lambda path, others: spark.read.parquet(others[name]["path"]).selectExpr("n + 1 AS n").write.parquet(path)


def numbers(df):
    return sorted(r.n for r in df.collect())


def test_only_what_is_stale_is_built(spark, store):
    source, other = new_path(spark, "in"), new_path(spark, "in")
    for p in (source, other):
        spark.createDataFrame([(1,), (2,)], "n long").write.parquet(p)
    targets = {"b": Target(after(spark, "a"), after=["a"]), "a": Target(doubling(spark, source), [source]), "c": Target(doubling(spark, other), [other])}
    log = []
    run = lambda: (log.clear(), store.build(targets, log.append), {r["target"]: r["state"] for r in log})[1:]
    one, states = run()
    assert states == {"a": "built", "b": "built", "c": "built"} and [r["target"] for r in log].index("a") < [r["target"] for r in log].index("b")
    same, states = run()
    assert set(states.values()) == {"current"} and same.number == one.number == 1
    spark.createDataFrame([(5,)], "n long").write.mode("append").parquet(source)
    two, states = run()
    assert states == {"a": "built", "b": "built", "c": "current"} and two.number == 2
    assert numbers(store.table("b")) == [3, 5, 11]
    assert numbers(store.table("b", one)) == [3, 5]  # the older version is still there
    targets["c"] = Target(doubling(spark, other), [other], recipe="another way")
    assert run()[1] == {"a": "current", "b": "current", "c": "built"}


def test_a_failed_build_changes_nothing(spark, store):
    source = new_path(spark, "in")
    spark.createDataFrame([(1,)], "n long").write.parquet(source)
    store.build({"a": Target(doubling(spark, source), [source])})
    spark.createDataFrame([(7,)], "n long").write.mode("append").parquet(source)

    def broken(path, others):
        raise RuntimeError("disk is gone")

    log = []
    with pytest.raises(RuntimeError):
        store.build({"a": Target(doubling(spark, source), [source]), "b": Target(broken, after=["a"])}, log.append)
    assert [(r["target"], r["state"]) for r in log] == [("a", "built"), ("b", "failed")]
    assert store.current().number == 1 and numbers(store.table("a")) == [2]


def test_two_builds_of_one_version(spark, store):
    before = store.current()
    store.publish({"x": {"path": "p"}}, before)
    with pytest.raises(Conflict):
        store.publish({"y": {"path": "q"}}, before)
    assert store.current().targets == {"x": {"path": "p"}}


def test_order(spark):
    made = lambda *names: Target(lambda path, others: None, after=names)
    assert ordered({"c": made("b"), "b": made("a"), "a": made()}) == ["a", "b", "c"]
    for wrong in ({"a": made("b"), "b": made("a")}, {"a": made("nowhere")}):
        with pytest.raises(ValueError):
            ordered(wrong)


def test_derived_tables_follow_their_files(spark):
    source, made = new_path(spark, "in"), []
    spark.createDataFrame([(1,)], "n long").write.parquet(source)

    def make(path, others):
        made.append(path)
        doubling(spark, source)(path, others)

    first = derived(spark, "t", [source], make)
    assert derived(spark, "t", [source], make) == first and len(made) == 1
    spark.createDataFrame([(4,)], "n long").write.mode("append").parquet(source)
    assert numbers(spark.read.parquet(derived(spark, "t", [source], make)["path"])) == [2, 8] and len(made) == 2
    assert stamp(spark, f"{source}-nowhere") == stamp(spark, f"{source}-nowhere")
