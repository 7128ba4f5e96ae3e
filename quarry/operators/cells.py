"""A vector index of cells: each vector lies in the folder of its nearest centre, a search reads the folders of the nearest cells.

Centres come from k-means over at most ``SAMPLE`` vectors (a bounded sample; every vector is then indexed), about the square root
of the number of vectors and at most ``CELLS``: so what is sent to all tasks is bounded.  A cell's radius is the largest angle
between its centre and its vectors.  A search first probes the nearest cells of each query; with ``exact`` it then probes every
other cell that could hold anything as good as the k-th best, by the angle to its centre less its radius: the result is that of a
comparison with all vectors.  How many cells an inexact search probes is measured when the index is written: so many that the
nearest neighbours of ``TRIED`` vectors, found exactly among all vectors, lie in them ``RECALL`` of the time.  Vectors are of unit length or zero (the latter are nobody's neighbours); ties go to the lesser id.
A cell of any size is dealt in blocks, its queries too, and a task compares a block of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.shared import written
from quarry.operators.versions import exists

SAMPLE, CELLS, BLOCK = 50_000, 4096, 4096
#: Cells that an exact search probes first; queries and neighbours by which the probes of an inexact one are set, and the recall that they shall have.
PROBES, TRIED, NEIGHBOURS, RECALL = 8, 200, 10, 0.93
#: What rounding may add to a bound.
SLACK = 1e-6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def write(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> dict:
    """Write the cells and their centres below ``path``; nulls have no cell.  Returns how many vectors and cells there are."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    n = rows.count()
    k = max(1, min(CELLS, round(math.sqrt(n))))
    some = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).where(F.exists("v", lambda x: x != 0)).select(array_to_vector("v").alias("features"))
    centres = np.array(KMeans(k=k, seed=1, maxIter=8, distanceMeasure="cosine").fit(some).clusterCenters()) if k > 1 and n else np.zeros((1, len((rows.first() or [0, [0.0]])[1])))
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    sent = spark.sparkContext.broadcast(centres)  # CELLS rows at most

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = _matrix(b.column("v")) @ sent.value.T
            at = cosine.argmax(1) if b.num_rows else np.empty(0, np.int64)
            angle = np.arccos(np.clip(cosine[np.arange(b.num_rows), at], -1, 1)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(at.astype(np.int32)), pa.array(angle)], names=["id", "v", "cell", "angle"])

    found = rows.mapInArrow(nearest, "id long, v array<double>, cell int, angle double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/vectors")
    radii = spark.read.schema(found.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("size"))
    known = {r.cell: r for r in radii.collect()}  # a row a cell
    table = [(i, c.tolist(), known[i].radius, known[i].size) for i, c in enumerate(centres) if i in known]
    spark.createDataFrame(table, "cell int, centre array<double>, radius double, size long").coalesce(1).write.parquet(f"{path}/centres")
    tried = rows.orderBy(F.xxhash64("id", F.lit(1))).limit(TRIED)
    probes = Index(spark, path)._needed(tried) if n else PROBES
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    return {"vectors": n, "cells": len(table)}


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.vectors = spark.read.schema("id long, v array<double>, angle double, cell int").parquet(f"{path}/vectors")
        self.centres = sorted(spark.read.parquet(f"{path}/centres").collect())  # CELLS rows at most
        self.probes = spark.read.parquet(f"{path}/probes").first().probes if exists(spark, f"{path}/probes") else PROBES

    def _needed(self, tried: DataFrame) -> int:
        """How many of the nearest cells hold ``RECALL`` of the tried vectors' nearest neighbours."""
        found = self.search(tried, NEIGHBOURS, "id", "v")
        place = {r.cell: i for i, r in enumerate(self.centres)}
        centres = np.array([c.centre for c in self.centres])
        queries = {r.id: np.argsort(np.argsort(-(centres @ np.array(r.v)), kind="stable")) for r in tried.collect()}  # TRIED rows
        ranks = sorted(int(queries[r.qid][place[r.cell]]) for r in found.join(self.vectors.select("id", "cell"), "id").select("qid", "cell").collect())  # TRIED * NEIGHBOURS rows
        return 1 + (ranks[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)))] if ranks else 0)

    def _cells(self, queries: DataFrame, probes: int, known: bool) -> DataFrame:
        """(qid, q, cell): the nearest cells of each query; with ``known`` (qid, q, least) the cells beyond those that might hold a score of ``least``."""
        names = np.array([c.cell for c in self.centres], np.int32)
        sent = self.spark.sparkContext.broadcast((np.array([c.centre for c in self.centres]), np.array([c.radius for c in self.centres]), names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radii, names = sent.value
            for b in batches:
                if not b.num_rows or not len(names):
                    continue
                cosine = np.clip(_matrix(b.column("q")) @ centres.T, -1, 1)
                order = np.argsort(-cosine, axis=1, kind="stable")
                if known:
                    most = np.cos(np.maximum(0, np.arccos(cosine) - radii)) + SLACK
                    wanted = most >= b.column("least").to_numpy(zero_copy_only=False)[:, None]
                    np.put_along_axis(wanted, order[:, :probes], False, axis=1)
                else:
                    wanted = np.zeros(cosine.shape, bool)
                    np.put_along_axis(wanted, order[:, :probes], True, axis=1)
                row, cell = np.nonzero(wanted)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("qid").take(at), b.column("q").take(at), pa.array(names[cell])], names=["qid", "q", "cell"])

        return queries.mapInArrow(run, "qid long, q array<double>, cell int")

    def _compared(self, assigned: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
        """(qid, id, score): each query's k best in each block that it meets."""
        sizes = self.spark.createDataFrame([(c.cell, -(-c.size // BLOCK)) for c in self.centres], "cell int, blocks long")
        asked = assigned.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("rounds"))
        shape = F.broadcast(sizes.join(asked, "cell"))  # a row a cell
        here = vectors.select("id", "v", "cell").join(shape, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).alias("round"))
        there = assigned.join(shape, "cell").select("qid", "q", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("qid"), "rounds").alias("round"))

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            if left.num_rows and right.num_rows:
                ids, qids = left.column("id").to_numpy(), right.column("qid").to_numpy()
                sort = np.argsort(ids, kind="stable")
                score = _matrix(right.column("q")) @ _matrix(left.column("v"))[sort].T
                score[qids[:, None] == ids[sort][None, :]] = -np.inf
                order = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]
                got = np.take_along_axis(score, order, axis=1)
                row, col = np.nonzero(np.isfinite(got))
                out = [qids[row], ids[sort][order[row, col]], got[row, col]]
            return pa.table(dict(zip(("qid", "id", "score"), map(pa.array, out), strict=True)))

        on = ["cell", "block", "round"]
        return here.groupBy(*on).cogroup(there.groupBy(*on)).applyInArrow(best, "qid long, id long, score double")

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", allowed: DataFrame | None = None, exact: bool = True, probes: int | None = None) -> DataFrame:
        """(qid, id, score, rank) of each query's k nearest other vectors, of those in ``allowed`` (its first column) if it is given."""
        probes = probes or (PROBES if exact else self.probes)
        q = queries.select(F.col(key).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("q")).where("q IS NOT NULL")
        vectors = self.vectors if allowed is None else self.vectors.join(allowed.select(F.col(allowed.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
        vectors = vectors.where(F.exists("v", lambda x: x != 0))
        order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
        top = lambda rows: rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
        first = top(self._compared(self._cells(q, probes, False), vectors, k))
        if not exact or probes >= len(self.centres):
            return first
        first = written(first.drop("rank"), "cells-first")
        last = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("least"))
        more = q.join(last, "qid", "left").select("qid", "q", F.coalesce("least", F.lit(-2.0)).alias("least"))
        return top(first.unionByName(self._compared(self._cells(more, probes, True), vectors, k)))

    def pruned(self, vector: list[float], probes: int | None = None) -> DataFrame:
        """The vectors of one query's nearest cells: only their folders are read."""
        cosine = [(-float(np.dot(c.centre, vector)), c.cell) for c in self.centres]
        return self.vectors.where(F.col("cell").isin([c for _, c in sorted(cosine)[: probes or self.probes]]))
