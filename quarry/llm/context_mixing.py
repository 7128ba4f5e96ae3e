"""Language-model scoring: online logistic context mixing (``mixing``), trained on and applied to whole texts.

1. Texts (A-Z in lower case) become blocks of about BLOCK characters: the distinct words and the documents as numbers of
   them.  A block is a row of a table in the shared folder; everything after works on blocks.
2. Word counts: each block sends each distinct word's hash and count once, packed by hash range; one task per range adds
   them up exactly and answers every block.  So counts cover all training documents, and a word of every document costs
   one entry per block.
3. The most frequent words (``tree_words``: their number grows with the training tokens) get the leaves of the code tree.
4. Each block sends the distinct pairs of context and symbol of its texts, with how often its training documents have them,
   packed by hash range; one task per range adds them up exactly and answers every block with the log odds along its
   pairs' paths.  So no table is of fixed size, none is sent to all tasks, and a task holds about PAIRS pairs.
5. One in CALIBRATE training documents is first scored by the counts of the others: what the mixer has learned at its end,
   averaged, is where every document's weights begin.  The counts by which all documents are scored have these too.
6. The code's counts are sent to all tasks; each block meets its answers and is scored, a share of the blocks (``WAVES``)
   after the other: what is shuffled for that lies on disk beside the answers for one share only.

Defined cases: a null or empty text is its end token alone; without training documents every base probability is 1 (its
logarithm 0) and the model knows only the escape and bytes; repeated ids each get a row; an empty table gives none; a
document longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing
from quarry.llm.common import materialize, shuffles_removed, slices, trim, tune, union_all
from quarry.llm.mixing import Code, Symbols, counted, distinct, numbered, ranges, tree_words

BLOCK = 1 << 22
#: Distinct words of all blocks that one range of hashes adds up, about.
RANGE = 1 << 21
#: Pairs of all blocks that one range of hashes adds up, about.
PAIRS = 1 << 20
#: Shares of the blocks that meet their answers one after the other, where there are SHARE blocks or more in each.
WAVES, SHARE = 4, 8
#: One in so many training documents sets the mixer's first weights, by the counts of the others.
CALIBRATE = 16
BLOCKS = "block bigint, ids binary, held binary, sizes binary, words binary, tokens binary, train binary"
END = b""


def _pack(x: np.ndarray) -> bytes:
    return x.tobytes()


def blocks(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents as blocks; the first word of a block is the end token, written as an empty word."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        held: list[np.ndarray] = []
        number: dict[bytes, int] = {END: 0}
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, size, number
            every, n, part = np.concatenate(tokens), np.concatenate(sizes), np.concatenate(held)
            # Frequent words get small numbers, which pack well; the end token keeps 0.
            order = np.concatenate(([0], 1 + np.argsort(-np.bincount(every, minlength=len(number))[1:], kind="stable")))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            every, words = rank[every], list(number)
            train = np.bincount(every[np.repeat(part != 1, n)], minlength=len(number))
            row = {
                "block": (shard << 24) + made, "ids": _pack(np.concatenate(ids).astype("<i8")), "held": _pack(part.astype(np.uint8)),
                "sizes": _pack(n.astype("<i8")), "words": _zipped(b" ".join([words[k] for k in order])), "tokens": _zipped(_planes(every.astype("<u4"))), "train": _pack(train.astype("<u4")),
            }
            made += 1
            size, number = 0, {END: 0}
            for x in (ids, held, tokens, sizes):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for a, b in slices(np.diff(offsets).tolist(), BLOCK // 4):
                chars = int(offsets[b] - offsets[a])
                if size and size + chars > BLOCK:
                    yield flush()
                words, index, n = _words(texts.slice(a, b - a))
                place = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                # Each document's words, and the end token behind them.
                ends = np.cumsum(n)
                tokens.append(np.insert(place[index], ends, 0))
                sizes.append(n + 1)
                ids.append(batch.column("id").slice(a, b - a).fill_null(-(1 << 63)).to_numpy())
                held.append(batch.column("held").slice(a, b - a).to_numpy())
                size += chars
        if ids:
            yield flush()
        trim()

    # 0: training, 1: held out, 2: training, and sets the mixer's first weights.
    part = F.when(held_out, 1).when(F.pmod(F.xxhash64(doc_id, text), F.lit(CALIBRATE)) == 0, 2).otherwise(0)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), part.alias("held"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, BLOCKS), "blocks")


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the numbers of all words, words of each text): A-Z in lower case, cut at ASCII white space."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = solid[first]
    start = np.flatnonzero(begins)
    place = np.concatenate(([0], np.cumsum(solid)))
    data = data[solid]
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    cuts = np.append(place[start], place[-1]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.diff(np.searchsorted(start, offsets))


_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "held", "sizes", "words", "tokens", "train"))])


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _zipped(raw: bytes) -> bytes:
    return np.array([len(raw)], "<i8").tobytes() + _ZSTD.compress(raw, asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int(np.frombuffer(data[:8], "<i8")[0]), asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _tokens(data: bytes) -> np.ndarray:
    """A block's word numbers."""
    return np.ascontiguousarray(np.frombuffer(_unzipped(data), np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def split_words(data: bytes) -> list[bytes]:
    return _unzipped(data).split(b" ")


TOTALS = "block bigint, part int, counts binary, n bigint, distinct bigint, hist binary, hashes binary, totals binary"


def word_totals(table: DataFrame, parts: int) -> DataFrame:
    """For each block and range: the training counts of its words (in order of hash); and for each range (block -1) its words
    with their totals, the sum, the number of distinct words, and how many have which power of two as their count."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, w, t in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "train")), strict=True):
                h, n = word_hashes(split_words(w)), np.frombuffer(t, "<u4")
                order = np.argsort(h)
                h, n = h[order], n[order]
                cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(parts, b)), pa.array(np.arange(parts, dtype=np.int32)),
                        pa.array([_press(np.diff(h[x:y], prepend=np.uint64(0))) for x, y in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array(np.diff(cut).astype(np.int32)), pa.array([_press(n[x:y]) for x, y in zip(cut, cut[1:], strict=False)], pa.binary()),
                    ],
                    names=["block", "part", "hashes", "size", "counts"],
                )

    def add(group: pa.Table) -> pa.Table:
        h = [np.cumsum(_unpress(x, n, np.uint64), dtype=np.uint64) for x, n in zip(group.column("hashes").to_pylist(), group.column("size").to_pylist(), strict=True)]
        n = [_unpress(x, len(k), np.uint32).astype(np.int64) for x, k in zip(group.column("counts").to_pylist(), h, strict=True)]
        keys, where = np.unique(np.concatenate(h), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, np.concatenate(n))
        ends = np.cumsum([len(x) for x in h])
        seen = total > 0
        hist = np.bincount(np.log2(np.maximum(total[seen], 1)).astype(np.int64), minlength=64)
        part = group.column("part")[0].as_py()
        rows = [
            {"block": b, "part": part, "counts": _press(total[where[e - len(x) : e]]), "n": len(x), "distinct": None, "hist": None, "hashes": None, "totals": None}
            for b, e, x in zip(group.column("block").to_pylist(), ends, h, strict=True)
        ]
        rows.append(
            {"block": -1, "part": part, "counts": None, "n": int(total.sum()), "distinct": int(seen.sum()), "hist": hist.astype("<i8").tobytes(), "hashes": keys[seen].tobytes(), "totals": total[seen].astype("<i8").tobytes()}
        )
        return pa.Table.from_pylist(rows, schema=_TOTALS)

    sent = table.select("block", "words", "train").mapInArrow(send, "block bigint, part int, hashes binary, size int, counts binary")
    with shuffles_removed(table.sparkSession):
        return materialize(sent.groupBy("part").applyInArrow(add, TOTALS), "word-totals")


_TOTALS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64()), ("hist", pa.binary()), ("hashes", pa.binary()), ("totals", pa.binary())])


def make_code(totals: DataFrame, bytes_: np.ndarray, words: int | None = None) -> tuple[Code, int, int]:
    """(code, training tokens, distinct words): the tree holds the words whose count is at least the power of two that leaves at most ``words`` (by default as ``tree_words`` has it), and some of the next."""
    own = totals.where("block = -1")
    n = distinct = 0
    hist = np.zeros(64, np.int64)
    for r in own.select("n", "distinct", "hist").toLocalIterator():
        n, distinct, hist = n + r.n, distinct + r.distinct, hist + np.frombuffer(r["hist"], "<i8")
    words = tree_words(n) if words is None else words
    above = np.cumsum(hist[::-1])[::-1]
    level = next((k for k in range(64) if above[k] <= words), 0)
    room = words - int(above[level]) if level else 0
    share = room / max(1, int(hist[level - 1])) if level else 0.0
    least = 1 << level

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t in zip(batch.column("hashes").to_pylist(), batch.column("totals").to_pylist(), strict=True):
                h, t = np.frombuffer(h, np.uint64), np.frombuffer(t, "<i8")
                sure = t >= least
                # Of the next lower counts a share by hash, so that about `words` are taken in all.
                some = (t >= least // 2) & ~sure & ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.float64) < share * (1 << 24))
                take = sure | some
                yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(t[take])], names=["h", "n"])

    # At most about `words` rows, whatever the corpus.
    chosen = own.select("hashes", "totals").mapInArrow(pick, "h bigint, n bigint").toArrow()
    h, t = chosen.column("h").to_numpy().view(np.uint64), chosen.column("n").to_numpy()
    # What is outside the tree, and as many new words as words were seen once (Good and Turing).
    return Code(h, t, n - int(t.sum()) + int(hist[0]), bytes_, mixing.context_bits(n)), n, distinct


def byte_counts(table: DataFrame) -> np.ndarray:
    """How often the words of all training blocks hold each byte, and how many there are (each distinct word of a block once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257, np.int64)
        for batch in batches:
            for w, t in zip(batch.column("words").to_pylist(), batch.column("train").to_pylist(), strict=True):
                keep = np.frombuffer(t, "<u4") > 0
                total[:256] += np.bincount(np.frombuffer(b"".join(x for x, k in zip(split_words(w), keep, strict=True) if k), np.uint8), minlength=256)
                total[256] += int(keep.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(total)], names=["byte", "n"])

    out = np.zeros(257, np.int64)
    for r in table.select("words", "train").mapInArrow(run, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def _block(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    words = split_words(row["words"])
    return words, word_hashes(words), _tokens(row["tokens"]), np.frombuffer(row["sizes"], "<i8")


def _press(x: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, compressed."""
    return _ZSTD.compress(_planes(x), asbytes=True)


def _unpress(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(data, n * size, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


_ZSTD = pa.Codec("zstd", compression_level=1)


class _Answers:
    """Odds of pairs by one or more counts, as ``odds_by_counts`` gives them, and those of some pairs as one piece of bytes."""

    def __init__(self, pairs: np.ndarray, code: Code, *counts: np.ndarray):
        self.pairs, self.code = pairs, code
        self.split, self.odds = mixing.odds_by_counts(pairs, code, *counts)
        self.place = np.cumsum(self.split, dtype=np.int64) - self.split

    def packed(self, own: np.ndarray, which: int) -> bytes:
        split, (alone, odds) = self.split[own], self.odds[which]
        shared = mixing.inherited(self.pairs[own], split, self.code)
        raw = b"".join(x.tobytes() for x in (alone[own], split, odds[ranges(self.place[own] + shared, split - shared)]))
        return np.array([len(raw)], "<i8").tobytes() + _ZSTD.compress(raw, asbytes=True)

    @staticmethod
    def read(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = _ZSTD.decompress(data[8:], int(np.frombuffer(data[:8], "<i8")[0]), asbytes=True)
        return np.frombuffer(raw, np.int8, n), np.frombuffer(raw, np.uint8, n, n), np.frombuffer(raw, np.int8, -1, 2 * n)


def _symbols(row: dict, code: Code) -> tuple[Symbols, np.ndarray, np.ndarray, tuple]:
    """(the block's documents as symbols; tokens; tokens of each document; the block)."""
    words, hashes, tokens, sizes = block = _block(row)
    first = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return Symbols(tokens, first, words, hashes, code), tokens, sizes, block


PAIR_ROWS = "block bigint, part int, size int, pairs binary, train binary, first binary"
ANSWERS = "block bigint, part int, size int, odds binary, first_size int, first_odds binary"
_ANSWERS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("odds", pa.binary()), ("first_size", pa.int32()), ("first_odds", pa.binary())])


#: Ranges of the pairs of the longer contexts are numbered from here.
LONGER = 1 << 26


def pair_odds(table: DataFrame, code: Broadcast, parts: int, longer: bool) -> DataFrame:
    """For each block and range: the log odds of the block's pairs in ascending order; and of those of its calibration documents, by the other documents' counts.

    The pairs of the shorter or of the longer contexts: one kind after the other halves what lies on disk at once.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = code.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in ("block", "words", "tokens", "sizes", "held", "train")}
                text, tokens, sizes, (words, _, _, _) = _symbols(row, c)
                every = text.both if longer else text.one
                pairs = distinct(every)
                part = np.repeat(np.repeat(np.frombuffer(row["held"], np.uint8), sizes), text.n)
                yield _dealt(row["block"], pairs, *(counted(pairs, every[part == k]) for k in (0, 2)), parts)
                # Words seen once in all are spelled even if they have a leaf: they are what new words look like.
                once = np.flatnonzero(text.known & (np.append(c.counts, 0)[text.leaf] == 1) & (np.frombuffer(row["train"], "<u4") > 0))
                if len(once):
                    _, _, two, four, size, _ = mixing.spelled([words[k] for k in once], c)
                    mark = np.zeros(len(words), np.uint8)
                    mark[tokens] = np.maximum(mark[tokens], np.repeat(np.where(np.frombuffer(row["held"], np.uint8) == 2, 2, 0), sizes))
                    every = four if longer else two
                    pairs = distinct(every)
                    part = np.repeat(mark[once], size)
                    yield _dealt(-1, pairs, *(counted(pairs, every[part == k]) for k in (0, 2)), parts)
        trim()

    def add(group: pa.Table) -> pa.Table:
        c = code.value
        rows = group.to_pylist()
        lists = [_unpress_pairs(r["pairs"], r["size"]) for r in rows]
        pairs = distinct(np.concatenate(lists))
        number = np.concatenate([np.searchsorted(pairs, x) for x in lists])  # each list ascends, so this is a walk
        del lists
        first = [_unpress(r["first"], r["size"], np.uint32) for r in rows]
        train = np.bincount(number, weights=np.concatenate([_unpress(r["train"], r["size"], np.uint32) for r in rows]), minlength=len(pairs)).astype(np.int64)
        early = np.bincount(number, weights=np.concatenate(first), minlength=len(pairs)).astype(np.int64)
        early += train
        # By the counts of all documents, and by those of all but the calibration documents.
        found = _Answers(pairs, c, early, train)
        del pairs, train, early
        out, a = [], 0
        for r, f in zip(rows, first, strict=True):
            own = number[a : a + r["size"]]
            a += r["size"]
            if r["block"] >= 0:
                early = own[f > 0]
                out.append({"block": r["block"], "part": r["part"] + LONGER * longer, "size": len(own), "odds": found.packed(own, 0), "first_size": len(early), "first_odds": found.packed(early, 1)})
        del found, number
        return pa.Table.from_pylist(out, schema=_ANSWERS)

    sent = table.select("block", "words", "tokens", "sizes", "held", "train").mapInArrow(send, PAIR_ROWS)
    with shuffles_removed(table.sparkSession):
        return materialize(sent.groupBy("part").applyInArrow(add, ANSWERS), "pair-odds")


def _press_pairs(pairs: np.ndarray) -> bytes:
    """Ascending pairs: the steps of their contexts, then their symbols."""
    steps = _press(np.diff(pairs >> np.uint64(mixing.SYMBOL), prepend=np.uint64(0)))
    return np.array([len(steps)], "<i8").tobytes() + steps + _press((pairs & np.uint64((1 << mixing.SYMBOL) - 1)).astype(np.uint32))


def _unpress_pairs(data: bytes, n: int) -> np.ndarray:
    cut = 8 + int(np.frombuffer(data[:8], "<i8")[0])
    return np.cumsum(_unpress(data[8:cut], n, np.uint64), dtype=np.uint64) << np.uint64(mixing.SYMBOL) | _unpress(data[cut:], n, np.uint32).astype(np.uint64)


def _dealt(block: int, pairs: np.ndarray, train: np.ndarray, first: np.ndarray, parts: int) -> pa.RecordBatch:
    """Ascending pairs by range of hashes."""
    cut = np.searchsorted((pairs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
    some = [(k, x, y) for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if y > x]
    columns = [pa.array([f(v[x:y]) for _, x, y in some], pa.binary()) for f, v in ((_press_pairs, pairs), (_press, train), (_press, first))]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array([k for k, _, _ in some], pa.int32()), pa.array([y - x for _, x, y in some], pa.int32()), *columns], names=["block", "part", "size", "pairs", "train", "first"])


def _paths(text: Symbols, code: Code, answers: tuple[list, list]) -> tuple[list[np.ndarray], np.ndarray]:
    """(where the log odds of each symbol's two pairs begin, the log odds of all paths); ``answers``: those of the distinct pairs of either kind in ascending order."""
    where, known, at = [], [], 0
    none = (np.empty(0, np.int8), np.empty(0, np.uint8), np.empty(0, np.int8))
    for own, found in zip((text.one, text.both), answers, strict=True):
        pairs, number = numbered(own)
        odds, place = mixing.whole_paths(pairs, *(np.concatenate(x) for x in zip(none, *found, strict=True)), code)
        where.append(at + place[number])
        known.append(odds)
        at += len(odds)
    return where, np.concatenate(known)


#: A block's answers come before the block, in order of range: first those on its words, then those on its pairs.
MET = ("block", "part", "size", "counts", "odds", "ids", "held", "sizes", "words", "tokens")
ODDS, BODY = 1 << 29, 1 << 30


def _met(table: DataFrame, answers: DataFrame, totals: DataFrame | None) -> DataFrame:
    empty = {"size": F.lit(None).cast("int"), **{c: F.lit(None).cast("binary") for c in MET[3:]}}
    row = lambda df, part, **cols: df.select("block", part.alias("part"), *(cols.get(c, empty[c]).alias(c) for c in MET[2:]))
    out = row(answers, F.col("part") + ODDS, size=F.col("size"), odds=F.col("odds")).unionByName(row(table, F.lit(BODY), **{c: F.col(c) for c in MET[5:]}))
    if totals is not None:
        out = out.unionByName(row(totals.where("block >= 0"), F.col("part"), size=F.col("n").cast("int"), counts=F.col("counts")))
    return out.repartition("block").sortWithinPartitions("block", "part")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[np.ndarray], tuple[list, list]]]:
    """(block, its answers on words, those on its pairs of either kind)."""
    key, counts, odds = None, [], ([], [])
    for batch in batches:
        for i in range(batch.num_rows):
            row = {x: batch.column(x)[i].as_py() for x in MET}
            if row["block"] != key:
                key, counts, odds = row["block"], [], ([], [])
            if row["part"] == BODY:
                yield row, counts, odds
            elif row["part"] >= ODDS:
                odds[row["part"] - ODDS >= LONGER].append(_Answers.read(row["odds"], row["size"]))
            else:
                counts.append(_unpress(row["counts"], row["size"], np.int64))


def calibration(table: DataFrame) -> DataFrame:
    """The calibration documents of each block, as a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in ("block", "held", "sizes", "words", "tokens")}
                if 2 not in row["held"]:
                    continue
                words, tokens, sizes = split_words(row["words"]), _tokens(row["tokens"]), np.frombuffer(row["sizes"], "<i8")
                keep = np.frombuffer(row["held"], np.uint8) == 2
                here, local = np.unique(tokens[ranges((np.cumsum(sizes) - sizes)[keep], sizes[keep])], return_inverse=True)
                # The end token, the empty word, is in every document and so comes first again.
                out = {"block": row["block"], "ids": None, "held": b"\2" * int(keep.sum()), "sizes": _pack(sizes[keep]), "words": _zipped(b" ".join([words[k] for k in here])), "tokens": _zipped(_planes(local.astype("<u4"))), "train": None}
                yield pa.RecordBatch.from_pylist([out], schema=_ARROW)

    return table.mapInArrow(run, BLOCKS)


def first_weights(table: DataFrame, code: Broadcast, answers: DataFrame) -> np.ndarray:
    """The weights that the calibration documents end with, averaged by the decisions at each gate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = np.zeros((3, mixing.GATES))
        for row, _, odds in _bodies(batches):
            text, _, sizes, _ = _symbols(row, code.value)
            mixing.score(text, sizes, code.value, *_paths(text, code.value, odds), learned=learned)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(learned.size)), pa.array(learned.reshape(-1))], names=["k", "x"])

    early = answers.where("first_size > 0").select("block", "part", F.col("first_size").alias("size"), F.col("first_odds").alias("odds"))
    learned = np.zeros((3, mixing.GATES))
    sums = _met(calibration(table), early, None).mapInArrow(run, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x"))
    with shuffles_removed(table.sparkSession):
        for r in sums.collect():
            learned[divmod(r.k, mixing.GATES)] = r.x
    seen = learned[2] > 1000
    return np.where(seen, learned[:2] / np.maximum(1, learned[2]), mixing.START)


SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """Every document's base and model score (log10 probabilities), and the model's bits per byte of its words and their ends."""
    table = blocks(docs, held_out, doc_id, text)
    size, made = table.agg(F.coalesce(F.sum(F.length("train")), F.lit(0)), F.count(F.lit(1))).first()
    totals = word_totals(table, max(1, -(-(size // 4) // RANGE)))
    code, n, distinct = make_code(totals, byte_counts(table), words)
    code_sent = table.sparkSession.sparkContext.broadcast(code)  # at most about ``tree_words`` counts
    del code
    # A pair a token of either kind, and those of spelled words, less what repeats in a block.
    found = []
    for longer in (False, True):
        found.append(pair_odds(table, code_sent, max(1, -(-n // PAIRS)), longer))
    answers = found[0].unionByName(found[1])
    # Rounded, so that the order in which sums arrive leaves no trace in the scores.
    start = np.round(first_weights(table, code_sent, answers), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, counts, odds in _bodies(batches):
            text_, tokens, sizes, (words_, hashes, _, _) = _symbols(row, code_sent.value)
            total = np.empty(len(words_), np.int64)
            total[np.argsort(hashes)] = np.concatenate(counts)
            starts = np.cumsum(sizes) - sizes
            value = np.log10((total + 0.1) / (n + 0.1 * (distinct + 1)))
            width = np.array([len(w) + 1 for w in words_], np.int64)
            bits = mixing.score(text_, sizes, code_sent.value, *_paths(text_, code_sent.value, odds), start)
            ids = np.frombuffer(row["ids"], "<i8")
            held = np.frombuffer(row["held"], np.uint8) == 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=ids == np.int64(-(1 << 63))), pa.array(held), pa.array(sizes), pa.array(np.add.reduceat((total > 0)[tokens].astype(np.int64), starts)),
                    pa.array(np.full(len(ids), n)), pa.array(np.add.reduceat(value[tokens], starts)), pa.array(-bits * np.log10(2)), pa.array(bits / np.add.reduceat(width[tokens], starts)),
                ],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
            )
        trim()

    waves = max(1, min(WAVES, made // SHARE))
    scores = []
    for k in range(waves):
        own = [x.where(F.pmod(F.xxhash64("block"), F.lit(waves)) == k) for x in (table, answers, totals)]
        with shuffles_removed(table.sparkSession):
            scores.append(materialize(_met(*own).mapInArrow(run, SCORES), "scores"))
    return union_all(scores).withColumnRenamed("id", doc_id)
