"""Graphs over edge tables: coupling, co-citation, neighbours, injection, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.shared import written

#: Edges of a vertex from which it is a hub.
HUB = 100_000
#: Edges that one task joins.
SMALL = 200_000
#: Nodes with a common neighbour that one task pairs with each other.
BLOCK = 2048
#: Rows of a part of a shuffle of neighbours or pairs.
ROWS = 1_000_000


def dealt_pairs(edges: DataFrame, block: int = 0) -> DataFrame:
    """(src, dst), src < dst, once for each common neighbour of ``edges`` (n, v; distinct).

    The nodes of one neighbour are dealt in blocks, and a task pairs two blocks of bounded size, however many there are.
    """
    blocks = edges.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK)).cast("int").alias("blocks"))
    own = edges.join(blocks, "v").withColumn("own", F.pmod(F.xxhash64("n"), "blocks").cast("int"))
    left = own.select("v", F.col("n").alias("x"), F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"))
    right = own.select("v", F.col("n").alias("y"), F.explode(F.expr("sequence(0, own)")).alias("i"), F.col("own").alias("j"))
    both = left.join(right, ["v", "i", "j"]).where("(i = j and x < y) or i < j")
    return both.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))


def shared_pairs(edges: DataFrame, node: str, via: str, least: int = 2) -> DataFrame:
    """(src, dst, shared, score), src < dst: nodes with at least ``least`` common neighbours; score shared / sqrt(degrees).

    Where some neighbour has more than BLOCK nodes, its pairs are not all made: two nodes with so many in common share one
    that is not among the ``least - 1`` most frequent of either, which makes candidates; these are counted exactly on their
    whole lists.
    Elsewhere pairs are made through neighbours or, where that is less, each node's pairs of neighbours meet: two nodes with s in
    common meet s * (s - 1) / 2 times.  Shuffles have a part for every ROWS rows, so that a task's memory stays as it is.
    """
    spark = edges.sparkSession
    parts = lambda rows: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    many = parts(edges.count())
    e = edges.select(F.col(node).alias("n"), F.col(via).alias("v")).repartition(many, "n").distinct()
    e = written(e.withColumn("deg", F.count(F.lit(1)).over(Window.partitionBy("n"))), "neighbours")
    by_via = e.repartition(many, "v")
    sizes = by_via.groupBy("v").agg(F.count(F.lit(1)).alias("f"))
    pairs_of = lambda c: F.floor(F.sum(F.col(c) * (F.col(c) - 1)) / 2).alias("pairs")
    largest, through = sizes.agg(F.max("f"), pairs_of("f")).first()
    widest, between = e.agg(F.max("deg"), F.floor(F.sum(F.col("deg") - 1) / 2)).first()
    score = lambda shared, a, b: shared / F.sqrt(a * b)
    if (largest or 0) <= BLOCK:
        ends = [F.col("a.n").alias("src"), F.col("b.n").alias("dst"), F.col("a.deg").alias("src_deg"), F.col("b.deg").alias("dst_deg")]
        if least == 2 and widest and widest <= BLOCK and between < through:
            lists = e.where("n is not null and v is not null").repartition(many, "n").groupBy("n", "deg").agg(F.sort_array(F.collect_list("v")).alias("vs"))
            two = lists.select("n", "deg", "vs", F.posexplode("vs").alias("at", "v")).select("n", "deg", "v", F.explode(F.slice("vs", F.col("at") + 2, F.size("vs"))).alias("w"))
            two = two.repartition(parts(between), "v", "w")
            met = two.alias("a").join(two.alias("b"), ["v", "w"]).where("a.n < b.n").select(*ends).groupBy("src", "dst", "src_deg", "dst_deg").agg(F.count(F.lit(1)).alias("met"))
            pairs = met.withColumn("shared", F.round((1 + F.sqrt(1 + 8 * F.col("met"))) / 2).cast("long"))
        else:
            met = by_via.alias("a").join(by_via.alias("b"), "v").where("a.n < b.n").select(*ends).repartition(parts(through or 0), "src", "dst")
            pairs = met.groupBy("src", "dst", "src_deg", "dst_deg").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
        return pairs.select("src", "dst", "shared", score(F.col("shared"), F.col("src_deg"), F.col("dst_deg")).alias("score"))
    e = e.drop("deg")
    frequent = e.join(sizes, "v").withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.col("f").desc(), F.col("v").desc())))
    near = dealt_pairs(frequent.where(F.col("r") >= least).select("n", "v")).distinct()
    lists = e.groupBy("n").agg(F.collect_list("v").alias("vs"))
    side = lambda c: lists.select(F.col("n").alias(c), F.col("vs").alias(f"{c}_vs"))
    shared = F.size(F.array_intersect("src_vs", "dst_vs")).cast("long")
    rows = near.join(side("src"), "src").join(side("dst"), "dst")
    return rows.select("src", "dst", shared.alias("shared"), score(shared, F.size("src_vs"), F.size("dst_vs")).alias("score")).where(F.col("shared") >= least)


def shared_with(edges: DataFrame, node: str, via: str, ids: Sequence, least: int = 2) -> DataFrame:
    """(src, dst, shared, score): what ``mirrored(shared_pairs(...))`` has for the sources ``ids``, a list of bounded length.

    Only the pairs of these nodes are made, through their own neighbours, and only the degrees of their ends are counted."""
    e = edges.select(F.col(node).alias("n"), F.col(via).alias("v"))
    # Written, so that the size of what the table is joined with is known.
    own = written(e.where(F.col("n").isin(list(ids))).distinct().select(F.col("n").alias("src"), "v"), "own-neighbours")
    met = e.select(F.col("n").alias("dst"), "v").join(own, "v").where("src <> dst").distinct()
    pairs = written(met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least), "own-pairs")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    degrees = e.join(ends, "n", "left_semi").distinct().groupBy("n").agg(F.count(F.lit(1)).alias("deg"))
    end = lambda c: degrees.select(F.col("n").alias(c), F.col("deg").alias(f"{c}_deg"))
    rows = pairs.join(end("src"), "src").join(end("dst"), "dst")
    return rows.select("src", "dst", "shared", (F.col("shared") / F.sqrt(F.col("src_deg") * F.col("dst_deg"))).alias("score"))


def updated_pairs(pairs: DataFrame, edges: DataFrame, changed: DataFrame, node: str, via: str, least: int = 2) -> DataFrame:
    """``shared_pairs`` of ``edges``, given those of an older table and the rows that came or went since (``changed``).

    Pairs of two nodes of which no row changed stay as they were.  A pair with a touched node is counted anew, found through the
    touched node's neighbours but its ``least - 1`` most frequent ones: pairs with so many in common also share another."""
    e = edges.select(F.col(node).alias("n"), F.col(via).alias("v")).distinct()
    touched = changed.select(F.col(node).alias("n")).distinct()
    own = e.join(touched, "n", "left_semi")
    sizes = e.join(own.select("v").distinct(), "v", "left_semi").groupBy("v").agg(F.count(F.lit(1)).alias("f"))
    rarer = own.join(sizes, "v").withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.col("f").desc(), F.col("v").desc()))).where(F.col("r") >= least)
    near = rarer.select(F.col("n").alias("x"), "v").join(e.select(F.col("n").alias("y"), "v"), "v").where("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()
    lists = e.join(near.select(F.explode(F.array("src", "dst")).alias("n")).distinct(), "n", "left_semi").groupBy("n").agg(F.collect_list("v").alias("vs"))
    side = lambda c: lists.select(F.col("n").alias(c), F.col("vs").alias(f"{c}_vs"))
    shared = F.size(F.array_intersect("src_vs", "dst_vs")).cast("long")
    anew = near.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", shared.alias("shared"), (shared / F.sqrt(F.size("src_vs").cast("double") * F.size("dst_vs"))).alias("score")).where(F.col("shared") >= least)
    end = lambda c: touched.select(F.col("n").alias(c))
    kept = pairs.select("src", "dst", "shared", "score").join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti")
    return kept.select("src", "dst", "shared", "score").unionByName(anew)


def mirrored(edges: DataFrame) -> DataFrame:
    """Every undirected edge from both ends."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(ends.alias("e"), *rest).select("e.src", "e.dst", *rest)


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k first neighbours in mirrored edges: most shared, then best score, then least id."""
    order = Window.partitionBy("src").orderBy(F.col("shared").desc(), F.round("score", 9).desc_nulls_last(), "dst")
    return edges.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def injected(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(id, graph_score, votes, shared_max): what the neighbours of ranked seeds (id, rank, support) gain from them.

    ``edges`` are mirrored, ``seeds`` a list of bounded length: only the seeds' edges are ranked."""
    own = neighbours(edges.join(F.broadcast(seeds.select(F.col("id").alias("src"))), "src", "left_semi"), k)
    near = own.join(F.broadcast(seeds), F.col("src") == F.col("id")).select("dst", "shared", (0.5 * F.col("support") / (60 + F.col("seed_rank") + F.col("rank"))).alias("boost"))
    return near.groupBy(F.col("dst").alias("id")).agg(F.sum("boost").alias("graph_score"), F.count(F.lit(1)).alias("votes"), F.max("shared").alias("shared_max"))


# ---- connected components: alternating large-star and small-star steps (Kiveris and others, 2014)
#
# Every step is a grouped minimum and a join.  A vertex of any degree is combined before the shuffle; the edges of a hub (more
# than HUB) stay where they are and meet its minimum by broadcast: there are at most as many hubs as edges over HUB.  Each
# round's edges are a table in the shared folder: lineage stays short.  Once at most SMALL edges are left, a bounded number of
# bytes, one task joins them by pointer jumping, which spares the many small rounds; the result is the same.


def _with_least(edges: DataFrame, hub: int) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "v").alias("m"), "n")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m")))
    marked = edges.join(hubs, "u", "left")
    light = marked.where("hub_m is null").select("u", "v").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return light.unionByName(marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    near = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), hub)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(u, v) with v the component's least vertex; the edges are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        u, v = (pa.concat_arrays([b.column(c) for b in parts]) for c in ("u", "v"))
        names = pc.unique(pa.concat_arrays([u, v]))
        names = names.take(pc.array_sort_indices(names))
        a, b = (pc.index_in(x, value_set=names).to_numpy() for x in (u, v))
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            # Each end, and the vertex that it points to, points to the lower of the two labels.
            for x in (a, b, label[a], label[b]):
                np.minimum.at(new, x, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(label[moved]))], names=["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, edges.select("u", "v").schema)


def components(edges: DataFrame, a: str = "src", b: str = "dst", small: int = SMALL, hub: int = HUB) -> DataFrame:
    """(node, component) of every vertex of the edges but the components' least vertices, which name them."""
    state = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0)).alias("s")).alias("state")
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = now.agg(state).first().state
    while seen.n:
        if seen.n <= small:
            now = written(_in_one_task(now), "edges")
            break
        now = written(_small_star(_large_star(now, hub), hub), "edges")
        last, seen = seen, now.agg(state).first().state
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge, loops too."""
    found = written(components(edges, a, b), "components")
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
