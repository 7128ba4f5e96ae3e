"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Scores of a unigram model are used as they are.  A BPE model has ranks instead; a piece of rank r then gets the log
probability of Zipf's and Mandelbrot's law, -ln(r + 2.7) - ln(sum of 1 / (s + 2.7) over all ranks s): nothing is trained.
A code point without a piece becomes its UTF-8 bytes' pieces; without byte pieces, the unknown id.  Spaces become the
marker U+2581, and one stands before a text; decoding undoes both.  Of equally good paths the longer last piece wins.

The search runs over many distinct words at once: all starting places walk the trie together, then the best paths grow
place by place.  Pieces never join a marker or a line end to what stands before it, so words are searched apart and
their ids are kept in a bounded cache.

Defined cases: a null or empty text has no ids; a text may be of any length, with or without spaces; a literal U+2581
decodes to a space; repeated rows each get a row; an empty table gives an empty result; other columns are not kept.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, slices, texts_of, tune

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHE = 200_000
SLICE = 1 << 20
_PIECES = re.compile(" *[^ \n]+|\n| +")


def _fields(raw: bytes):
    """(number, value) of a protobuf message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[i : i + n]
            i += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, raw[i : i + n]
            i += n


def load_pieces(model: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces, log scores, kinds) of a model file."""
    pieces, scores, kinds, model_type = [], [], [], 1
    for k, v in _fields(model):
        if k == 1:
            f = dict(_fields(v))
            pieces.append(f[1].decode())
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        elif k == 2:
            model_type = dict(_fields(v)).get(3, 1)
    score, kind = np.array(scores, np.float64), np.array(kinds, np.int8)
    if model_type != 1:
        text = kind == NORMAL
        mass = math.log(np.sum(1 / (2.7 - score[text])))
        score = np.where(text, -np.log(2.7 - np.minimum(score, 0)) - mass, 0.0)
    return pieces, score.astype(np.float32).astype(np.float64), kind


class DoubleArray:
    """A trie of byte strings in two arrays: the child of state s by byte b is base[s] + b where check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values, strict=True):
            s = 0
            for b in key:
                if b not in tree[s]:
                    tree[s][b] = len(tree)
                    tree.append({})
                    value.append(-1)
                s = tree[s][b]
            value[s] = v
        size = 1 << 14
        base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        place = {0: 0}
        free, hint, taken = 1, 1, bytearray(size)
        taken[0] = 1
        for s in range(len(tree)):  # children have larger numbers than their parent
            if not (kids := sorted(tree[s])):
                continue
            at = place[s]
            if size - max(free, hint) < 8192:
                base, check, leaf = (np.concatenate((x, np.full(size, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (leaf, -1)))
                taken += bytes(size)
                size *= 2
            if len(kids) == 1:
                free = taken.index(0, max(free, kids[0] + 1))
                b = free - kids[0]
            else:
                # Nodes of several children search on from the last such place; those of one fill the holes.
                kid = [c - kids[0] for c in kids]
                look = max(hint, kids[0] + 1)
                while any(taken[look + c] for c in kid):
                    look = taken.index(0, look + 1)
                b = look - kids[0]
                hint = look
            base[at] = b
            for c in kids:
                check[b + c] = at
                taken[b + c] = 1
                leaf[b + c] = value[tree[s][c]]
                place[tree[s][c]] = b + c
        used = int(np.flatnonzero(check >= 0).max()) + 257
        self.base, self.check, self.leaf = (np.concatenate((x, np.full(257, fill, np.int32)))[:used] for x, fill in ((base, 0), (check, -1), (leaf, -1)))
        self.longest = max((len(k) for k in keys), default=0)

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into starts, end, value) of each key that begins at a start and ends by that start's end."""
        at, state = np.arange(len(starts)), np.zeros(len(starts), np.int32)
        found = []
        for d in range(self.longest):
            live = starts[at] + d < ends[at]
            at, state = at[live], state[live]
            if not len(at):
                break
            nxt = self.base[state] + data[starts[at] + d]
            live = (self.check[nxt] == state) & (nxt > 0)
            at, state = at[live], nxt[live]
            v = self.leaf[state]
            hit = v >= 0
            found.append((at[hit], starts[at[hit]] + d + 1, v[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


class Unigram:
    """encode(texts) gives arrays of ids, decode(arrays) texts."""

    def __init__(self, model: bytes):
        self.pieces, self.score, self.kind = load_pieces(model)
        text = [i for i in range(len(self.pieces)) if self.kind[i] in (NORMAL, USER)]
        if any(MARK in self.pieces[i].lstrip(MARK) or "\n" in self.pieces[i] for i in text):
            raise ValueError("a piece holds a marker or line end behind other characters")
        self.trie = DoubleArray([self.pieces[i].encode() for i in text], text)
        self.unknown = next((i for i, k in enumerate(self.kind) if k == UNKNOWN), 0)
        byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kind[i] == BYTE}
        self.byte_ids = np.array([byte[b] for b in range(256)]) if len(byte) == 256 else None
        self.penalty = float(self.score[text].min()) - UNKNOWN_PENALTY
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kind, strict=True)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        cut = [_PIECES.findall(" " + t) if t else [] for t in texts]
        new = set().union(*cut) - self.young.keys()
        for p in list(new):
            if (v := self.old.get(p)) is not None:
                self.young[p] = v
                new.discard(p)
        order = sorted(new, key=len)
        for a, b in slices([len(p) for p in order], SLICE // 8):
            self.young.update(zip(order[a:b], self._search(order[a:b]), strict=True))
        get = self.young.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), "<i4") for c in cut]

    def _search(self, words: list[str]) -> list[bytes]:
        coded = [w.replace(" ", MARK).encode() for w in words]
        size = np.array([len(c) for c in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.int32)
        ends = np.cumsum(size)
        first = ends - size
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        word = np.searchsorted(ends, starts, side="right")
        step = np.arange(len(starts)) - np.searchsorted(starts, first)[word]
        nxt = np.append(starts[1:], len(data))
        k, end, piece = self.trie.matches(data, starts, ends[word])
        single = np.zeros(len(starts), bool)
        single[k[end == nxt[k]]] = True
        lone = np.flatnonzero(~single)
        k, end, piece = np.concatenate((k, lone)), np.concatenate((end, nxt[lone])), np.concatenate((piece, np.full(len(lone), -1)))
        score = np.where(piece >= 0, self.score[piece], self.penalty)
        # A place in the path: the byte after a piece, moved on by the word's number so that words don't share places.
        source, target = starts[k] + word[k], end + word[k]
        order = np.argsort(step[k], kind="stable")
        source, target, piece, score = source[order], target[order], piece[order], score[order]
        cuts = np.searchsorted(step[k][order], np.arange(int(step.max(initial=-1)) + 2))
        best = np.full(len(data) + len(words), -np.inf)
        best[first + np.arange(len(words))] = 0
        back = np.full(len(best), -1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found = best[source[a:b]] + score[a:b]
            better = found > best[target[a:b]]
            to = target[a:b][better]
            best[to] = found[better]
            back[to] = np.arange(a, b)[better]
        at, who = ends + np.arange(len(words)), np.arange(len(words))
        whose, edges = [], []
        begin = first + np.arange(len(words))
        while len(who):
            e = back[at]
            whose.append(who)
            edges.append(e)
            at = source[e]
            live = at != begin[who]
            at, who = at[live], who[live]
        whose, edges = np.concatenate(whose)[::-1], np.concatenate(edges)[::-1]
        order = np.argsort(whose, kind="stable")
        whose, edges = whose[order], edges[order]
        ids, width = piece[edges], np.ones(len(edges), np.int64)
        unknown = ids < 0
        if self.byte_ids is None:
            ids = np.where(unknown, self.unknown, ids)
        else:
            width = np.where(unknown, target[edges] - source[edges], 1)
        flat = np.repeat(ids, width)
        if self.byte_ids is not None and unknown.any():
            inner = np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)
            place = np.repeat(source[edges] - whose, width) + inner
            fall = flat < 0
            flat[fall] = self.byte_ids[data[place[fall]]]
        count = np.bincount(whose, weights=width, minlength=len(words)).astype(np.int64)
        raw = flat.astype("<i4").tobytes()
        stop = np.cumsum(count) * 4
        return [raw[s - 4 * n : s] for s, n in zip(stop.tolist(), count.tolist(), strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        raw = self.raw
        out = []
        for x in ids:
            t = b"".join([raw[i] for i in x.tolist()]).decode(errors="replace")
            out.append(t[1:] if t.startswith(" ") else t)
        return out


@lru_cache(2)
def processor(path: str) -> Unigram:
    """The process's processor for a model file."""
    with open(path, "rb") as f:
        return Unigram(f.read())


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every text."""
    tune(docs.sparkSession)

    def make():
        sp = processor(model)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = sp.encode(texts_of(batch, "text"))
            ends = np.cumsum([0, *(len(x) for x in ids)])
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))], names=["id", "ids"])

        return f

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>", make).withColumnRenamed("id", doc_id)


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids are the empty text."""
    tune(encoded.sparkSession)

    def make():
        sp = processor(model)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sp.decode(rows), pa.string())], names=["id", "text"])

        return f

    rows = encoded.select(F.col(doc_id).alias("id"), F.col(ids).alias("ids"))
    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, text string", make).withColumnRenamed("id", doc_id)


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text encoded and decoded again: doc_id, ids, n_ids, n_byte_ids, decoded_crc32 (of its UTF-8), same (it is the text)."""
    tune(docs.sparkSession)

    def make():
        sp = processor(model)
        is_byte = sp.kind == BYTE

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "text")
            ids = sp.encode(texts)
            again = sp.decode(ids)
            ends = np.cumsum([0, *(len(x) for x in ids)])
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            byte_total = np.concatenate(([0], np.cumsum(is_byte[flat], dtype=np.int64)))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(np.diff(byte_total[ends])),
                    pa.array(np.array([zlib.crc32(t.encode()) for t in again], np.int64)),
                    pa.array([a == b for a, b in zip(texts, again, strict=True)], pa.bool_()),
                ],
                names=["id", "ids", "n_ids", "n_byte_ids", "decoded_crc32", "same"],
            )

        return f

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, n_ids bigint, n_byte_ids bigint, decoded_crc32 bigint, same boolean", make).withColumnRenamed("id", doc_id)
