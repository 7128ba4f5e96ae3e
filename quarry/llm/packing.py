"""Packing documents into sequences of a fixed number of ids: cutting-stock column generation over the length histogram.

Every document gives full sequences and one remainder.  The histogram of remainders is the demand of a cutting-stock
program (``cutting_stock``); its rounded patterns say which lengths share a sequence.  Documents of one remainder are
ranked, and the rank alone decides the pattern's copy and the place in it.  The few remainders that well-filled whole
patterns don't cover form a stream that is cut at sequence ends; its tail is cut into powers of two, which need no padding.

Ranks come without a sort: encoding writes a table in which each task has numbered its own remainders, and the tasks'
counts add up to where its numbers begin.  No task or driver holds more than one batch, the histogram and the patterns.

Defined cases: a null text is empty and still has its end id; a document of exactly full sequences has no remainder; long
documents are cut, never dropped; repeated ids are documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize, trim, tune
from quarry.llm.cutting_stock import round_patterns, solve
from quarry.llm.encoding import encoder

CAPACITY = 1024
#: A pattern that leaves more than this unused is not applied; its pieces join the stream.
SLACK = 2
#: Bytes of rank offsets up to which they are broadcast; beyond, they meet the documents in a shuffle.
BROADCAST = 32 << 20
TOKENS = "shard int, id bigint, n bigint, remainder int, rank bigint, full_rank bigint, ids binary"


def encode(docs: DataFrame, vocabulary_file: str, style: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of the documents' ids with their numbers within the task: rank among its remainders of that length, full_rank among its full sequences."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_file, style)
        end = np.array([end_id], enc.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        seen, full = np.zeros(capacity, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = enc.column(batch.column("text"), end)
            n = pc.binary_length(ids).to_numpy().astype(np.int64) // enc.dtype.itemsize
            rest = n % capacity
            order = np.argsort(rest, kind="stable")
            run_start = np.concatenate(([True], np.diff(rest[order]) != 0))
            begin = np.maximum.accumulate(np.where(run_start, np.arange(len(n)), 0))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - begin + seen[rest[order]]
            seen += np.bincount(rest, minlength=capacity)
            whole = n // capacity
            first = full + np.cumsum(whole) - whole
            full += int(whole.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), batch.column("id"), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(rank), pa.array(first), ids],
                names=["shard", "id", "n", "remainder", "rank", "full_rank", "ids"],
            )
        trim()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, TOKENS), "packing-ids")


class Plan:
    """Where the r-th remainder of a length goes: arrays of at most as many entries as the patterns have lengths."""

    def __init__(self, demand: np.ndarray, capacity: int, full: int):
        self.capacity = capacity
        lengths = np.flatnonzero(demand[:capacity])
        lengths = lengths[lengths > 0]
        patterns, times, self.bound = solve(lengths, demand[lengths], capacity)
        uses, left = round_patterns(patterns, times, demand[lengths], patterns @ lengths >= capacity - SLACK)
        base = full
        entries: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity)]
        covered = np.zeros(capacity, np.int64)
        for j in np.flatnonzero(uses):
            offset = 0
            for i in np.flatnonzero(patterns[j])[::-1]:
                length, copies = int(lengths[i]), int(patterns[j][i])
                entries[length].append((int(covered[length]), copies, base, offset))
                covered[length] += copies * int(uses[j])
                offset += length * copies
            base += int(uses[j])
        self.covered = covered
        self.entries = [np.array(e, np.int64).reshape(-1, 4) for e in entries]
        self.stream_first = base
        rest = np.zeros(capacity, np.int64)
        rest[lengths] = left
        size = rest * np.arange(capacity)
        self.stream_base = np.cumsum(size) - size
        total = int(size.sum())
        self.stream_whole = total // capacity
        # The tail: sequences that begin at these places of the stream, each a power of two long.
        tail = total % capacity
        starts, at = [], self.stream_whole * capacity
        for bit in reversed(range(capacity.bit_length())):
            if tail >> bit & 1:
                starts.append(at)
                at += 1 << bit
        self.tail = np.array(starts, np.int64)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the remainder, length, sequence, offset) of its pieces."""
        if rank < self.covered[length]:
            e = self.entries[length]
            first, copies, base, offset = e[np.searchsorted(e[:, 0], rank, side="right") - 1]
            k = rank - first
            return [(0, length, int(base + k // copies), int(offset + k % copies * length))]
        s = int(self.stream_base[length] + (rank - self.covered[length]) * length)
        end, at, out = s + length, s, []
        limit = self.stream_whole * self.capacity
        while at < end:
            if at < limit:
                q = at // self.capacity
                begin, stop, number = q * self.capacity, (q + 1) * self.capacity, q
            else:
                i = int(np.searchsorted(self.tail, at, side="right")) - 1
                begin, number = int(self.tail[i]), self.stream_whole + i
                stop = int(self.tail[i + 1]) if i + 1 < len(self.tail) else end
            n = min(end, stop) - at
            out.append((at - s, n, self.stream_first + number, at - begin))
            at += n
        return out


PIECES = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(tokens: DataFrame, vocabulary_dtype: str = "<u2", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of the encoded documents: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    by_task = tokens.groupBy("shard", "remainder").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("remainder").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    full = tokens.groupBy("shard").agg(F.sum(F.expr(f"n div {capacity}")).alias("full"))
    full = full.withColumn("full_before", F.coalesce(F.sum("full").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # At most `capacity` rows for each task, however many documents it had.
    starts = offsets.join(full, "shard").select("shard", "remainder", "before", "full_before")
    demand = np.zeros(capacity, np.int64)
    for r in by_task.groupBy("remainder").agg(F.sum("n").alias("n")).collect():
        demand[r.remainder] = r.n
    size = full.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("full"), F.lit(0)).alias("full")).first()
    plan = Plan(demand, capacity, size.full)
    sent = tokens.sparkSession.sparkContext.broadcast(plan)  # bounded by the sequence length
    if size.shards * capacity * 16 <= BROADCAST:
        starts = F.broadcast(starts)
    dtype = np.dtype(vocabulary_dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("id", "n", "remainder", "rank", "full_rank", "ids", "before", "full_before")}
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                ids = np.frombuffer(rows["ids"][i], dtype).astype("<u4").tobytes()
                n, rest = rows["n"][i], rows["remainder"][i]
                first = rows["full_before"][i] + rows["full_rank"][i]
                pieces = [(k * capacity, capacity, first + k, 0) for k in range(n // capacity)]
                if rest:
                    pieces += [(n - rest + s, m, q, o) for s, m, q, o in p.place(rest, rows["before"][i] + rows["rank"][i])]
                for s, m, q, o in pieces:
                    for c, v in zip(out, (rows["id"][i], s, m, ids[4 * s : 4 * (s + m)], n, q, o), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(out)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        trim()

    return tokens.join(starts, ["shard", "remainder"]).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, vocabulary_file: str, style: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    tokens = encode(docs, vocabulary_file, style, end_id, capacity, doc_id, text)
    return pack(tokens, encoder(vocabulary_file, style).dtype.str, capacity).withColumnRenamed("id", doc_id)
