"""Logs of transitions: the state before and after each event, which events were not allowed, and the state that a key is in.

A machine is a table of (state, event) to the next state; any other event is not allowed and changes nothing.  An event is a
function from states to states, and functions compose, so a key's log is dealt in blocks: each block is composed to one function,
the functions give the state in which each block begins, and each block is then run from there.  A key with any number of events
is thus many tasks' work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.jobs import place_in_group
from quarry.operators.shared import written

Machine = Mapping[tuple[str, str], str]
#: Events of a block, and functions that are composed at once.
BLOCK = 1024
#: A parsed document, and a run, as the data model has them.
PARSE: Machine = {
    ("", "registered"): "registered", ("registered", "submitted"): "submitted", ("submitted", "materialized"): "materialized", ("submitted", "failed"): "failed",
    ("failed", "submitted"): "submitted", ("materialized", "submitted"): "submitted", ("registered", "failed"): "failed",
}
RUN: Machine = {("", "started"): "started", ("started", "progress"): "running", ("running", "progress"): "running", ("started", "finished"): "finished", ("running", "finished"): "finished", ("started", "failed"): "failed", ("running", "failed"): "failed"}


def states_of(machine: Machine, start: str) -> list[str]:
    return list(dict.fromkeys([start, *(s for s, _ in machine), *machine.values()]))


def _function(machine: Machine, names: list[str], event: Column) -> Column:
    """The event's function: for each state's number the next one's; null if the event is nowhere allowed."""
    table = {e: [names.index(machine.get((s, e), s)) for s in names] for _, e in machine}
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in table.items() for x in kv))
    return F.element_at(known, event)


def _composed(functions: Column, names: list[str]) -> Column:
    same = F.array(*(F.lit(i) for i in range(len(names))))
    return F.aggregate(functions, same, lambda acc, f: F.when(f.isNull(), acc).otherwise(F.transform(acc, lambda s: F.get(f, s))))


def _run(functions: Column, first: Column) -> Column:
    """The states before each of the functions, and the one after the last."""
    return F.aggregate(functions, F.array(first), lambda acc, f: F.concat(acc, F.array(F.when(f.isNull(), F.element_at(acc, -1)).otherwise(F.get(f, F.element_at(acc, -1))))))


def _entries(blocks: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """(key, block, entry): the state's number in which each block (key, block, f) begins."""
    some = blocks.withColumn("above", F.floor(F.col("block") / BLOCK))
    group = some.groupBy(*key, "above").agg(F.sort_array(F.collect_list(F.struct("block", "f"))).alias("fs"))
    if (group.agg(F.max("above")).first()[0] or 0) == 0:
        first = group.withColumn("entry", F.lit(0))
    else:
        group = written(group, "blocks")
        first = group.join(_entries(group.select(*key, F.col("above").alias("block"), _composed(F.transform("fs", lambda x: x["f"]), names).alias("f")), key, names).withColumnRenamed("block", "above"), [*key, "above"])
    run = _run(F.transform("fs", lambda x: x["f"]), F.col("entry"))
    return first.select(*key, F.explode(F.arrays_zip(F.transform("fs", lambda x: x["block"]).alias("block"), F.slice(run, F.lit(1), F.size("fs")).alias("entry"))).alias("x")).select(*key, "x.block", "x.entry")


def history(events: DataFrame, machine: Machine, key: str, event: str, order: Sequence[str], start: str = "") -> DataFrame:
    """``events`` (key, event, the order's columns) with ``place``, ``before``, ``after`` and ``allowed``.

    The order's columns tell a key's events apart; rows that repeat all of them are one event."""
    names = states_of(machine, start)
    rows = events.select(key, event, *order).distinct().withColumn("_order", F.struct(*order))
    placed = place_in_group(rows, key, "_order").withColumn("block", F.floor((F.col("place") - 1) / BLOCK)).withColumn("f", _function(machine, names, F.col(event)))
    fields = ["place", *order, event, "f"]
    blocks = written(placed.groupBy(key, "block").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("e")), "blocks")
    entries = _entries(blocks.select(key, "block", _composed(F.transform("e", lambda x: x["f"]), names).alias("f")), [key], names)
    ran = blocks.join(entries, [key, "block"]).withColumn("s", _run(F.transform("e", lambda x: x["f"]), F.col("entry")))
    name = F.array(*map(F.lit, names))
    each = F.transform("e", lambda x, i: F.struct(x.alias("x"), F.get(F.col("s"), i).alias("b"), F.get(F.col("s"), i + 1).alias("a")))
    flat = ran.select(key, F.explode(each).alias("x")).select(key, *(F.col(f"x.x.{c}").alias(c) for c in ("place", *order, event)), F.get(name, F.col("x.b")).alias("before"), F.get(name, F.col("x.a")).alias("after"))
    legal = F.concat_ws("\x00", "before", event).isin([f"{s}\x00{e}" for s, e in machine])
    return flat.withColumn("allowed", legal)


def current(log: DataFrame, key: str) -> DataFrame:
    """(key, state, events, refused): where each key's history has led."""
    return log.groupBy(key).agg(F.max_by("after", "place").alias("state"), F.count(F.lit(1)).alias("events"), F.count_if(~F.col("allowed")).alias("refused"))


def merged(known: DataFrame, events: DataFrame, machine: Machine, key: str, event: str, order: Sequence[str], start: str = "") -> tuple[DataFrame, DataFrame]:
    """(states, refused) after new events over known states (key, state, last: the order's columns as a struct).

    Events that are not behind a key's ``last`` have been merged before and are left out, so merging a batch again changes nothing."""
    fresh = events.join(known.select(key, "state", "last"), key, "left").where(F.col("last").isNull() | (F.struct(*order) > F.col("last"))).select(key, event, *order, "state")
    # A known state is an event that leads there from the start.
    to = {("", f"\x01{s}"): s for s in states_of(machine, start)}
    to = {(start, e): s for (_, e), s in to.items()}
    begun = known.join(fresh.select(key).distinct(), key, "left_semi").select(key, F.concat(F.lit("\x01"), F.col("state")).alias(event), *(F.col("last")[c].alias(c) for c in order))
    log = history(fresh.select(key, event, *order).unionByName(begun), {**to, **machine}, key, event, order, start)
    real = ~F.col(event).startswith("\x01")
    last = log.groupBy(key).agg(F.max_by("after", "place").alias("state"), F.max_by(F.struct(*order), "place").alias("last"))
    kept = known.select(key, "state", "last").join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(key, "state", "last")), log.where(real & ~F.col("allowed")).select(key, event, *order, "before")
