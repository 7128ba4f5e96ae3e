"""Token-id files: static range asymmetric numeral coding (rANS) of token ids, in blocks that decode independently.

A file (a run of documents of about FILE ids within one range of document ids, in ascending order) has a shared frequency
table and blocks; a task holds the ids of one file, however large its range.  A block holds whole
documents, about BLOCK ids: its symbols are dealt round-robin to LANES interleaved 64-bit coders that write 32-bit words
to one stream.  The block's header has the documents' ids and lengths, a checksum of the ids, one of the payload, and
checkpoints: every STRIDE steps the coders' states and the place in the stream, so that a block can be decoded from
several places at once.  The container is a Parquet table with one block a row and the table in the file's first row:
Spark commits it whole or not at all, on any file system, and files are read in parallel.

Defined cases: a null text is empty; a document without tokens still has its end id; ids may repeat (each row is a
document of its own, ties ordered by text); a document longer than BLOCK is a block of its own; an empty table gives a
folder without blocks, read back as no rows.  Other columns are not stored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, slices, trim, tune
from quarry.llm.encoding import encoder
from quarry.llm.ranges import range_bounds, range_index, range_parts

LANES = 512
BLOCK = 1 << 18
#: Ids of a file, about: what a task holds before it writes.
FILE = 1 << 24
STRIDE = 128
LOW = np.uint64(1 << 31)
#: Bytes of frequency tables up to which a reader broadcasts them; beyond, blocks and tables meet in a shuffle.
TABLES = 64 << 20
SCHEMA = "shard bigint, block int, first_token bigint, n_tokens bigint, doc_ids binary, doc_lengths binary, freq binary, checkpoints binary, payload binary, ids_crc bigint, payload_crc bigint"
_32 = np.uint64(32)


# ---- the coder


def scale_bits(counts: np.ndarray) -> int:
    """Binary digits of the frequencies' sum: room for every symbol that occurs, 12 at least."""
    return max(12, int(np.count_nonzero(counts)).bit_length() + 2)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a power of two; a symbol that occurs keeps at least 1."""
    total = 1 << scale_bits(counts)
    if not counts.any():
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, counts * total // counts.sum()), 0)
    over = int(f.sum() - total)
    order = np.argsort(-f, kind="stable")
    if over < 0:
        f[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        cut = min(over, int(f[i]) - 1, max(1, int(f[i]) // 4))
        f[i] -= cut
        over -= cut
    while (over := int(f.sum() - total)) > 0:
        i = int(np.argmax(f))
        f[i] -= min(over, int(f[i]) - 1)
    return f


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.bits = np.uint64(max(0, int(freq.sum()).bit_length() - 1))
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(payload, checkpoints): the payload is the words in the order of decoding; symbol i goes to lane i % LANES at step i // LANES."""
        steps = -(-len(ids) // LANES)
        x = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        top = (LOW >> self.bits) << _32
        every, begin = self.freq[ids], self.start[ids]
        for s in range(steps - 1, -1, -1):
            f = every[s * LANES : (s + 1) * LANES]
            y = x[: len(f)]
            full = y >= top * f
            if full.any():
                out = (y[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                words.append(out)
                written += len(out)
                y = np.where(full, y >> _32, y)
            q = y // f
            x[: len(f)] = (q << self.bits) + (y - q * f) + begin[s * LANES : (s + 1) * LANES]
            if s % STRIDE == 0:
                marks.append((written, x.copy()))
        payload = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        # Decoding runs forward, so a mark's place counts from the front.
        points = b"".join(np.array([written - w], "<u8").tobytes() + state.astype("<u8").tobytes() for w, state in reversed(marks))
        return payload.astype("<u4").tobytes(), points

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The n ids; all segments between checkpoints are decoded side by side."""
        if not n:
            return np.empty(0, np.int64)
        words = np.concatenate((np.frombuffer(payload, "<u4").astype(np.uint64), np.zeros(1, np.uint64)))
        points = np.frombuffer(checkpoints, "<u8").reshape(-1, LANES + 1)
        at = points[:, 0].astype(np.int64)
        x = points[:, 1:].astype(np.uint64)
        steps = -(-n // LANES)
        k = len(points)
        out = np.zeros((k, STRIDE, LANES), np.int64)
        left = np.minimum(n - np.arange(k) * STRIDE * LANES, STRIDE * LANES)
        mask = np.uint64((1 << int(self.bits)) - 1)
        for s in range(min(STRIDE, steps)):
            live = np.arange(LANES)[None, :] < (left - s * LANES)[:, None]
            slot = x & mask
            sym = self.symbol[slot.astype(np.int64)]
            out[:, s] = sym
            y = self.freq[sym] * (x >> self.bits) + slot - self.start[sym]
            need = live & (y < LOW)
            rank = np.cumsum(need, 1)
            place = np.minimum(at[:, None] + rank - 1, len(words) - 1)
            y = np.where(need, (y << _32) | words[np.maximum(place, 0)], y)
            x = np.where(live, y, x)
            at += rank[:, -1]
        return out.reshape(-1)[:n]


def pack_table(freq: np.ndarray) -> bytes:
    """A frequency table as compressed 32-bit numbers, headed by its length."""
    return zlib.compress(freq.astype("<u4").tobytes(), 6)


def unpack_table(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)


def shard_blocks(shard: int, doc_ids: list, ids: list[np.ndarray], vocabulary: int) -> Iterator[dict]:
    """The blocks of one file."""
    counts = np.zeros(vocabulary, np.int64)
    for a, b in slices([len(x) for x in ids], BLOCK):
        counts += np.bincount(np.concatenate(ids[a:b]), minlength=vocabulary)
    freq = frequencies(counts)
    coder = Coder(freq)
    first = 0
    for block, (a, b) in enumerate(slices([len(x) for x in ids], BLOCK)):
        flat = np.concatenate(ids[a:b]).astype(np.int64)
        total = len(flat)
        payload, points = coder.encode(flat)
        yield {
            "shard": shard, "block": block, "first_token": first, "n_tokens": total, "doc_ids": np.array(doc_ids[a:b], "<i8").tobytes(),
            "doc_lengths": np.array([len(x) for x in ids[a:b]], "<u4").tobytes(), "freq": None if block else pack_table(freq), "checkpoints": zlib.compress(points, 1),
            "payload": payload, "ids_crc": zlib.crc32(flat.astype("<u4").tobytes()), "payload_crc": zlib.crc32(payload),
        }
        first += total


# ---- writing and reading with Spark


def write(docs: DataFrame, path: str, vocabulary_file: str, style: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the blocks to ``path``; files number the ranges of ids in their upper 32 binary digits."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = range_bounds(docs, "id", range_parts(docs))
    rows = docs.withColumn("part", range_index("id", bounds)).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_file, style)
        vocabulary = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        end = np.array([end_id], enc.dtype).tobytes()
        doc_ids: list = []
        ids: list[np.ndarray] = []
        shard = held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not ids:
                # A range's files are numbered within the range.
                shard = max(shard, batch.column("part")[0].as_py() << 32)
            found = enc.column(batch.column("text"), end)
            cut = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1] // enc.dtype.itemsize
            flat = np.frombuffer(found.buffers()[2], enc.dtype)
            ids += [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            doc_ids += batch.column("id").fill_null(-(1 << 63)).to_pylist()
            held += int(cut[-1] - cut[0])
            if held >= FILE:
                for x in shard_blocks(shard, doc_ids, ids, vocabulary):
                    yield pa.RecordBatch.from_pylist([x], schema=_ARROW)
                doc_ids, ids, shard, held = [], [], shard + 1, 0
        if ids:
            for x in shard_blocks(shard, doc_ids, ids, vocabulary):
                yield pa.RecordBatch.from_pylist([x], schema=_ARROW)
        trim()

    rows.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(path)


_ARROW = pa.schema(
    [("shard", pa.int64()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_lengths", pa.binary())]
    + [("freq", pa.binary()), ("checkpoints", pa.binary()), ("payload", pa.binary()), ("ids_crc", pa.int64()), ("payload_crc", pa.int64())]
)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a token file in its order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids unless ``digest``.

    A block whose checksums do not hold fails the read.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    tables = blocks.where("block = 0").select("shard", F.col("freq").alias("table"))
    if (tables.agg(F.sum(F.length("table"))).first()[0] or 0) <= TABLES:
        tables = F.broadcast(tables)
    blocks = blocks.drop("freq").join(tables, "shard")
    # One row per file: few, whatever the number of documents.
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    schema = "shard bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ("" if digest else ", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, coder = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if r["table"] != raw:
                    raw, coder = r["table"], Coder(unpack_table(r["table"]))
                if zlib.crc32(r["payload"]) != r["payload_crc"]:
                    raise ValueError(f"token file: damaged block {r['shard']}/{r['block']}")
                flat = coder.decode(r["payload"], zlib.decompress(r["checkpoints"]), r["n_tokens"]).astype("<u4")
                if zlib.crc32(flat.tobytes()) != r["ids_crc"]:
                    raise ValueError(f"token file: wrong ids in block {r['shard']}/{r['block']}")
                n = np.frombuffer(r["doc_lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                doc = np.frombuffer(r["doc_ids"], "<i8")
                cols = [
                    pa.array(np.full(len(n), r["shard"], np.int64)),
                    pa.array(doc, mask=doc == np.int64(-(1 << 63))),
                    pa.array(r["first_token"] + ends - n),
                    pa.array(n),
                    pa.array(np.array([zlib.crc32(flat[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)], np.int64)),
                ]
                if not digest:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "doc_id", "at", "n_tokens", "ids_crc32", *([] if digest else ["ids"])])

    found = blocks.mapInArrow(run, schema).join(bases, "shard")
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *([] if digest else ["ids"]))


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quarry/tokens-{uuid.uuid4().hex}"
