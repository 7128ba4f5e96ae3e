"""Near-duplicate documents: circulant MinHash signatures, banding, exact Jaccard verification, connected components.

1. Every whole text becomes its set of word shingles; equal sets are one class, known by a 128-bit digest of the set, so
   exact copies cost nothing further, however many there are.
2. Classes that agree on all ROWS coordinates of a band share a bucket.  So many bands are used that a pair at the
   threshold is missed with probability 1e-6 at most.
3. Every member of a bucket is compared with the bucket's least class, on the full sets, exactly: one comparison a member,
   however large the bucket.  The confirmed links connect the members of a group of near copies.
4. What a bucket then still leaves open are pairs in different components, neither of them the least class.  Its strays (the
   members outside its largest component) are compared with each other and with the rest, dealt in blocks of bounded size;
   buckets of the same members are dealt once.  Only confirmed links ever connect classes.
5. The links' components are named by their least document id.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle of them all; rows that repeat an id each get the component of their own text; a document
without id is in a group like any other, but never its name (a group of such documents alone has none); an empty table
gives an empty result; other columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, materialize, slices, texts_of, trim, tune
from quarry.llm.components import connected_components
from quarry.llm.shingles import band_keys, bands_for, shingle_sets, signatures

ROWS = 5
#: Shingles, and as many again as a quarter of this for each 256 classes, that a block holds about; a larger set is a block of its own.
BLOCK = 1 << 18
#: Columns of a 0/1 matrix that are multiplied at once.
COLUMNS = 4096
#: Candidates up to which their keys are broadcast to the scan that fetches their texts; beyond, the two meet in a shuffle.
BROADCAST_ROWS = 1_000_000
SLICE = 1 << 20


def row_key(text: str = "text") -> list:
    """Two columns that stand for a text: a hash and a length."""
    return [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.coalesce(F.length(text), F.lit(-1)).alias("chars")]


def sketch(docs: DataFrame, width: int, percent: int, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark and chars (the row's text), n_shingles, set_key (a 128-bit digest of the set; null if empty) and band keys of every document."""
    tune(docs.sparkSession)
    bands = bands_for(percent / 100, rows)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, "text")
            n, digest, keys = [], [], []
            for a, b in slices([len(t) for t in texts], SLICE):
                sets = shingle_sets(texts[a:b], width)
                n += [len(s) for s in sets]
                digest += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys.append(band_keys(signatures(sets, bands * rows), rows).view(np.int64))
            flat = pa.array(np.concatenate(keys).reshape(-1))
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "mark", "chars")), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), flat)],
                names=["id", "mark", "chars", "n_shingles", "set_key", "keys"],
            )

        return f

    rows_ = docs.select(F.col(doc_id).cast("long").alias("id"), *row_key(text), F.col(text).alias("text"))
    return arrow_map(rows_, "id bigint, mark bigint, chars int, n_shingles bigint, set_key binary, keys array<bigint>", make)


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(key, cls, n, low, low_n, members) of the classes (cls, n, keys) in buckets that hold two and more; ``low`` is the bucket's least class."""
    entries = classes.select("cls", "n", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return entries.join(buckets.select("key", F.col("low.cls").alias("low"), F.col("low.n").alias("low_n"), "members"), "key")


def class_sets(docs: DataFrame, wanted: DataFrame, width: int, text: str = "text") -> DataFrame:
    """(cls, shingles): the full sets of the wanted classes (cls, mark, chars), from the texts of ``docs``."""
    keys = wanted.select("mark", "chars").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = docs.select(*row_key(text), F.col(text).alias("text")).join(keys, ["mark", "chars"], "left_semi")

    def make():
        seen: set[bytes] = set()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[bytes, bytes] = {}
            words = texts_of(batch, "text")
            for a, b in slices([len(t) for t in words], SLICE):
                for s in shingle_sets(words[a:b], width):
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    if key not in seen:  # copies of one text go out once a task
                        seen.add(key)
                        found[key] = s.tobytes()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["cls", "shingles"])

        return f

    return arrow_map(texts.select("text"), "cls binary, shingles binary", make).dropDuplicates(["cls"])


def links(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which pairs are linked; ``sets_b`` None: pairs within ``sets_a``."""
    every = sets_a + (sets_b or [])
    size = np.array([len(s) for s in every], np.int64)
    values, column, times = np.unique(np.concatenate([np.empty(0, np.uint64), *every]), return_inverse=True, return_counts=True)
    common = times[column] > 1
    number = np.cumsum(times > 1) - 1
    col, row = number[column[common]], np.repeat(np.arange(len(every)), size)[common]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    width = int(col[-1]) + 1 if len(col) else 0
    n = len(sets_a)
    both = np.zeros((n, len(every) - n if sets_b is not None else n), np.float64)
    for c in range(0, width, COLUMNS):
        a, b = np.searchsorted(col, (c, c + COLUMNS))
        m = np.zeros((len(every), min(COLUMNS, width - c)), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        both += m[:n] @ (m[n:] if sets_b is not None else m).T
    other = size[n:] if sets_b is not None else size
    union = size[:n, None] + other[None, :] - both
    return 100 * both >= percent * union


def spanning(ids_a: list[bytes], ids_b: list[bytes] | None, linked: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links that connect what the matrix links: one for each member of a group but the first."""
    if ids_b is None:
        ids, near = ids_a, linked
    else:
        n = len(ids_a)
        ids = ids_a + ids_b
        near = np.zeros((len(ids), len(ids)), bool)
        near[:n, n:] = linked
        near[n:, :n] = linked.T
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(ids)).min(1, initial=len(ids)))
        if (new == label).all():
            break
        label = new
    return [(ids[i], ids[int(j)]) for i, j in enumerate(label) if i != j and ids[i] != ids[int(j)]]


DEALT = "unit bigint, i int, j int, side int, cls binary, component binary, shingles binary"


def confirmed(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what is linked within each (unit, i, j) of the dealt rows: between its sides 0 and 1, or within side 0 if i = j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def finish() -> list[tuple[bytes, bytes]]:
            first, second = [x for x in group if x[0] == 0], [x for x in group if x[0] == 1]
            if not first or len(group) < 2 or (key[1] != key[2] and not second):
                return []
            found = links([x[3] for x in first], [x[3] for x in second] if second else None, percent)
            if not second:
                np.fill_diagonal(found, False)
            return spanning([x[1] for x in first], [x[1] for x in second] if second else None, found)

        def rows(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            columns = [batch.column(c).to_pylist() for c in ("unit", "i", "j", "side", "cls", "component", "shingles")]
            for u, i, j, side, cls, component, s in zip(*columns, strict=True):
                if (u, i, j) != key:
                    if key is not None:
                        out += finish()
                    key, group = (u, i, j), []
                group.append((side, cls, component, np.frombuffer(s, np.uint64)))
            if out:
                yield rows(out)
        if key is not None and (out := finish()):
            yield rows(out)
        trim()

    return dealt.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "side").mapInArrow(run, "a binary, b binary")


def _blocks(weight: str = "n") -> F.Column:
    return F.ceil(F.sum(F.col(weight) + BLOCK // 1024) / BLOCK).cast("int")


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(cls, n, low): each bucket's members beside its least class, where the sizes allow a link."""
    sizes = F.expr(f"100 * least(n, low_n) >= {percent} * greatest(n, low_n)")
    return shared.where("cls <> low").where(sizes).select("cls", "n", "low").distinct()


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The confirmed ones of ``pairs``.  A class beside many is copied to blocks of them."""
    blocks = pairs.groupBy("low").agg(_blocks().alias("blocks"))
    unit = F.xxhash64("low").alias("unit")
    place = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    members = pairs.join(blocks, "low").select(unit, place.alias("i"), F.lit(-1).alias("j"), F.lit(1).alias("side"), "cls", F.col("low").alias("component")).join(sets, "cls")
    lows = blocks.select(unit, F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), F.col("low").alias("cls"), F.col("low").alias("component")).join(sets, "cls")
    return confirmed(lows.unionByName(members), percent)


def open_units(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(unit, cls, n, component, main): the members, but the least class, of buckets whose members the links so far leave in several components."""
    known = found.select(F.col("node").alias("cls"), "component")
    rest = shared.where("members > 2 and cls <> low").select("key", "cls", "n").join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    rest = materialize(rest, "open")
    # Buckets of the same members are one unit: told apart by their number and two sums of hashes.
    same = (F.count(F.lit(1)).alias("members"), F.sum(F.pmod(F.xxhash64("cls"), F.lit(1 << 40))).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x"))
    split = rest.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), *same).where("least <> most")
    units = split.groupBy("members", "s", "x").agg(F.min("key").alias("key")).select("key")
    rows = rest.join(units, "key")
    main = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("m")).select("key", F.col("m.component").alias("main"))
    return rows.join(main, "key").select(F.col("key").alias("unit"), "cls", "n", "component", (F.col("component") == F.col("main")).alias("main"))


def open_links(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The confirmed links of a unit's strays with each other and with its main component: blocks of strays against blocks of both."""
    blocks = units.groupBy("unit").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(~F.col("main"), F.col("n") + BLOCK // 1024).otherwise(0)) / BLOCK)).cast("int").alias("strays"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("main"), F.col("n") + BLOCK // 1024).otherwise(0)) / BLOCK)).cast("int").alias("mains"),
    )
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("strays"))).cast("int")
    rows = units.join(blocks, "unit").withColumn("own", own)
    # Tasks (i, j): strays' block i beside strays' block j >= i; or, j <= -1, beside block -1 - j of the main component.
    strays = rows.where("not main").withColumn("other", F.explode(F.expr("concat(sequence(0, strays - 1), transform(sequence(0, mains - 1), m -> -1 - m))")))
    strays = strays.withColumn("i", F.expr("if(other < 0, own, least(own, other))")).withColumn("j", F.expr("if(other < 0, other, greatest(own, other))")).withColumn("side", F.expr("if(other < 0 or own = i, 0, 1)"))
    mains = rows.where("main").withColumn("i", F.explode(F.expr("sequence(0, strays - 1)"))).withColumn("j", F.expr("-1 - own")).withColumn("side", F.lit(1))
    dealt = strays.select("unit", "i", "j", "side", "cls", "component").unionByName(mains.select("unit", "i", "j", "side", "cls", "component"))
    return confirmed(dealt.join(sets, "cls"), percent)


def grouped(docs: DataFrame, width: int, percent: int, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark, chars, n_shingles, group (the digest that names the row's component; null without words), component_id of every row."""
    sketched = materialize(sketch(docs, width, percent, rows, doc_id, text), "sketches")
    # Equal sets have equal keys, so any row's will do; the text is fetched by one row's mark.
    named = sketched.where("set_key is not null").groupBy(F.col("set_key").alias("cls"))
    classes = materialize(named.agg(F.min("id").alias("least_id"), F.min(F.struct("mark", "chars")).alias("at"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    shared = materialize(shared_buckets(classes), "buckets")
    pairs = materialize(star_pairs(shared, percent), "pairs")
    ends = pairs.select("cls").unionByName(pairs.select(F.col("low").alias("cls")))
    wide = shared.where("members > 2").select("cls")  # what later may be left open
    wanted = ends.unionByName(wide).distinct().join(classes.select("cls", "at.mark", "at.chars"), "cls")
    sets = materialize(class_sets(docs, materialize(wanted, "wanted"), width, text), "sets")
    found = connected_components(star_links(pairs, sets, percent), "a", "b")
    units = materialize(open_units(shared, found), "units")
    if not units.isEmpty():
        more = open_links(units, sets, percent).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = connected_components(more, "a", "b")
    group = classes.select("cls", "least_id").join(found.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "least_id", F.coalesce("component", "cls").alias("group"))
    group = materialize(group, "groups")
    names = group.groupBy("group").agg(F.min("least_id").alias("component_id"))
    return sketched.drop("keys").join(group.join(names, "group").select(F.col("cls").alias("set_key"), "group", "component_id"), "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, width: int, percent: int, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links; without words its own), kept (it is the document's own) of every row.

    A document without id is kept only where its group has no id at all.
    """
    found = grouped(docs, width, percent, rows, doc_id, text)
    component = F.coalesce("component_id", "id")
    return found.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int, percent: int, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near duplicates: that of the least id (one without id last), of the least text hash among equals.

    Rows that repeat an id and a text are one row where the text has words, whatever their other columns (the least stays);
    all texts without words stay.  Texts are read where they lie: only the keys of what goes are broadcast, behind a check
    of their number, or meet the texts in a shuffle beyond it.
    """
    key = ["id", "mark", "chars"]
    seen = grouped(docs, width, percent, rows, doc_id, text).where("group is not null").groupBy("group", *key).agg(F.count(F.lit(1)).alias("copies"))
    rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark", "chars")
    seen = materialize(seen, "rows")
    first = seen.groupBy("group").agg(F.min(rank).alias("first"), F.sum("copies").alias("size")).where("size > 1")
    # Of each group of several rows: what goes, and, to be taken down to one, what stays but is there more than once.
    marks = seen.join(first, "group").select(*key, "copies", (rank == F.col("first")).alias("stays")).where("not stays or copies > 1")
    marks = materialize(marks, "marks")
    few = marks.count() <= BROADCAST_ROWS
    known = lambda df: F.broadcast(df) if few else df
    cols = [F.col(f"`{c}`") for c in docs.columns]
    hidden = [F.col(doc_id).cast("long").alias("__id"), *(c.alias(f"__{n}") for c, n in zip(row_key(text), ("mark", "chars"), strict=True))]
    keyed = docs.select(*cols, *hidden)
    m = marks.select(*(F.col(c).alias(f"m_{c}") for c in key), "stays")
    meet = F.col("__id").eqNullSafe(F.col("m_id")) & (F.col("__mark") == F.col("m_mark")) & (F.col("__chars") == F.col("m_chars"))
    left = keyed.join(known(m), meet, "left_anti").select(*cols)
    again = keyed.join(known(m.where("stays")), meet, "left_semi").groupBy("__id", "__mark", "__chars").agg(F.min(F.struct(*cols)).alias("row"))
    return left.unionByName(again.select(*(F.col(f"row.`{c}`") for c in docs.columns)))
