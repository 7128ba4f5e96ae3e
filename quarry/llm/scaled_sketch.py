"""Document fingerprints: threshold-scaled sketches of character shingles.

Every distinct hash of SHINGLE consecutive code points (A-Z in lower case) below 2**64 / SCALE stays; a text with fewer
than FLOOR such hashes keeps its FLOOR smallest, so that short texts have a sketch too.  A sketch's reach is the hash
below which it is complete.  Two sketches compare below the smaller reach: likeness is what the smaller set shares, a
containment that holds for very unequal texts, if the smaller one has a hash there: one of n distinct shingles in a much
longer text has none with probability (1 - 1 / SCALE)**n, 1 % at 72 shingles and 15 % at 30.  Then there is no estimate
(None); the query writes 0 for it.  The sketch of a concatenation is (but for shingles across the seam) the
union of the parts' sketches below the smallest reach: ``merge``.

A fingerprint is text: base64 of the reach and the ascending hashes, six bytes each (the upper 48 bits).  Defined cases:
null is the empty text, whose fingerprint is ''; a text shorter than a shingle is one shingle; two empty texts have
likeness 1, an empty and another 0; documents are ordered by id (nulls first), ties by text; a lone document is its own
next one; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fmix64, slices, texts_of, tune
from quarry.llm.ranges import begins_range, range_bounds, range_index, range_parts

SHINGLE = 12
SCALE = 16
FLOOR = 8
WHOLE = 1 << 48
LIMIT = WHOLE // SCALE
SLICE = 1 << 20
_B = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def sketch(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(reach, ascending 48-bit hashes) of each text."""
    out: list[tuple[int, np.ndarray]] = []
    for a, b in slices([len(t) for t in texts], SLICE):
        out += _sketch(texts[a:b])
    return out


def _sketch(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    # Short texts are padded to one shingle with a code that no text has.
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(t if len(t) >= SHINGLE else t + "\0" * (SHINGLE - len(t)) for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    code += ((code >= 65) & (code <= 90)).astype(np.uint64) * np.uint64(32)
    width = np.maximum(sizes, SHINGLE)
    ends = np.cumsum(width)
    for i in np.flatnonzero(sizes < SHINGLE):
        code[ends[i] - SHINGLE + sizes[i] : ends[i]] = 0x110000 + sizes[i]
    g1 = (code + np.uint64(1)) * _B[0]
    g1 ^= g1 >> np.uint64(29)
    g2 = g1[:-1] * _B[1] + g1[1:]
    g4 = g2[:-2] * _B[2] + g2[2:]
    g8 = g4[:-4] * _B[3] + g4[4:]
    h = fmix64(g8[:-4] * _B[1] + g4[8:]) >> np.uint64(16)
    starts = ends - width
    counts = width - SHINGLE + 1
    low = np.flatnonzero(h < np.uint64(LIMIT))
    which = np.searchsorted(ends, low, side="right")
    inside = low <= ends[which] - SHINGLE
    low, which = low[inside], which[inside]
    first = np.searchsorted(which, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        if not sizes[i]:
            out.append((WHOLE, np.empty(0, np.uint64)))
            continue
        kept = np.unique(h[low[first[i] : first[i + 1]]])
        reach = LIMIT
        if len(kept) < FLOOR:
            every = np.unique(h[starts[i] : starts[i] + counts[i]])
            kept, reach = (every, WHOLE) if len(every) <= FLOOR else (every[:FLOOR], int(every[FLOOR]))
        out.append((reach, kept))
    return out


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float | None:
    """The share of the smaller sketch that the other has too, below the smaller reach; None if nothing of the smaller lies there."""
    reach = np.uint64(min(a[0], b[0]))
    x, y = (s[1][: np.searchsorted(s[1], reach)] for s in (a, b))
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    least = min(len(x), len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / least if least else None


def merge(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of both shingle sets together."""
    reach = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return reach, both[: np.searchsorted(both, np.uint64(reach))]


def pack(s: tuple[int, np.ndarray]) -> str:
    """Sketch to text."""
    if not len(s[1]):
        return ""
    all_ = np.concatenate((np.array([s[0] - 1], np.uint64), s[1]))
    return base64.b64encode(np.ascontiguousarray(all_.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def unpack(text: str) -> tuple[int, np.ndarray]:
    """Text to sketch."""
    if not text:
        return WHOLE, np.empty(0, np.uint64)
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    x = wide.reshape(-1).view(">u8").astype(np.uint64)
    return int(x[0]) + 1, x[1:]


SCHEMA = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form: the second half replaced by the beginning of the next document.

    One shuffle by ranges of ids; the document that begins a range also goes to the range before it, as its end.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = range_bounds(docs, "id", range_parts(docs))
    first = docs.select("id").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("m")).first().m
    own = docs.withColumn("part", range_index("id", bounds)).withColumn("guest", F.lit(False))
    n = len(bounds) + 1
    guests = docs.where(F.col("id").eqNullSafe(F.lit(first.id if first else None)) | begins_range("id", bounds))
    # The first of all follows the last; the first of range i follows range i - 1.
    guests = guests.withColumn("part", F.pmod(F.when(F.col("id").eqNullSafe(F.lit(first.id if first else None)), F.lit(n - 1)).otherwise(range_index("id", bounds) - 1), F.lit(n)))
    rows = own.unionByName(guests.withColumn("guest", F.lit(True))).repartitionById(n, F.col("part")).sortWithinPartitions("guest", F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        done = False
        for batch in batches:
            guest = batch.column("guest").to_pylist()
            new_ids, new_texts = batch.column("id").to_pylist(), texts_of(batch)
            own_rows = guest.index(True) if True in guest else len(guest)
            ids += new_ids[:own_rows]
            texts += new_texts[:own_rows]
            after = None
            if own_rows < len(guest) and not done:
                after, done = new_texts[own_rows], True
            if after is not None:
                if ids:
                    yield from _rows(ids, texts, [*texts[1:], after])
                ids, texts = [], []
            elif not done and len(ids) > 1:
                yield from _rows(ids[:-1], texts[:-1], texts[1:])
                ids, texts = ids[-1:], texts[-1:]

    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", doc_id)


def _rows(ids: list, texts: list[str], after: list[str]) -> Iterator[pa.RecordBatch]:
    for a, b in slices([len(t) for t in texts], SLICE):
        own, nxt = texts[a:b], after[a:b]
        half = [len(t) // 2 for t in own]
        edited = [t[: len(t) - h] + x[:h] for t, h, x in zip(own, half, nxt, strict=True)]
        s = sketch([*own, nxt[-1]])
        e = sketch(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[a:b], pa.int64()),
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([pack(x) for x in s[:-1]]),
                pa.array([pack(x) for x in e]),
                pa.array([likeness(x, y) or 0.0 for x, y in zip(s[:-1], e, strict=True)], pa.float64()),
                pa.array([likeness(x, y) or 0.0 for x, y in zip(s[:-1], s[1:], strict=True)], pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
