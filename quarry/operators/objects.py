"""Derived objects of works: capsules, result and method objects with values, transfer between works; their contract; audits.

Everything is a column expression over a work's text, so one pass makes the objects; only transfer joins works with each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import METHOD_PATTERNS, RESULT_PATTERNS, snippet
from quarry.operators.graph import BLOCK, ROWS, dealt_pairs
from quarry.operators.shared import written

# Fixed values that the data model prescribes.
VERSION = "v1"
STATUSES = ("ready", "partial", "needs_review", "failed")
DERIVATIONS = ("extracted", "normalized", "aggregated", "ranked", "summarized", "inferred")
LABELS = {
    "measurement": "measurement", "upper_limit": "upper limit", "significance": "significance", "exclusion": "exclusion", "statistical_fit": "profile likelihood",
    "multivariate": "multivariate", "background_estimation": "background estimation", "reconstruction": "reconstruction",
}
REVIEW_TYPES = ("review", "review article")
CONFIDENCE = 0.65
TRANSFER_BASE, TRANSFER_STEP, TRANSFER_RESULT, TRANSFER_CAP = 0.35, 0.2, 0.15, 0.99
NOISE = {
    "latex_frac_literal": r"(?i)\bfrac\b",
    "style_command_literal": r"(?i)\b(?:mathnormal|boldsymbol|textcircled|operatorname)\b",
    "array_artifact": r"(?i)\b(?:begin|end)\s+array\b",
    "arrow_split": r"(?<=[A-Za-zΑ-Ωα-ω0-9])\s+-\s+>(?=\s*[A-Za-zΑ-Ωα-ω0-9(])",
    "double_punct": r"(?:,\s*,|,,|(?<!\.)\.\s*\.(?!\.))",
    "orphan_citation_phrase": r"(?i)\bdetailed\s+in(?:\s+(?:Ref(?:s)?\.?|reference(?:s)?))?(?=\s*(?:[.,;:]|$))",
}
CHUNK_NOISE, BLOCK_NOISE, EQUATION_SHARE = 0, 1, 0.6

# Transfer in blocks: keys and works of a block, works of a unit; counts and meetings of a strip; rows given away at once.
NUMBERS, WORKS, PIECE, STRIP, GIVEN = 1 << 23, 1 << 15, 512, 1 << 22, 1 << 18

VALUE = "struct<kind:string, label:string, evidence:string, confidence:double>"


def signature_values(text: Column, patterns: dict[str, str], confidence: float = CONFIDENCE) -> Column:
    """What of the patterns occurs, in their order: kind, label, the text around the first match, confidence."""
    value = lambda k, p: F.when(text.rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(LABELS.get(k, k)).alias("label"), snippet(text, p).alias("evidence"), F.lit(confidence).alias("confidence")))
    return F.array_compact(F.array(*(value(k, p) for k, p in patterns.items())))


def capsules(works: DataFrame, review: Column, results: dict[str, str] = RESULT_PATTERNS, methods: dict[str, str] = METHOD_PATTERNS, work: str = "work_id", title: str = "title", text: str = "text") -> DataFrame:
    """(work, title, has_text, results, methods, is_review, status, anomaly, detail, capsule): reviews are partial; works that lack a result or a method signature need review."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = works.select(F.col(work), F.coalesce(F.trim(title), F.lit("")).alias("title"), (F.trim(body) != "").alias("has_text"), signature_values(body, results).alias("results"), signature_values(body, methods).alias("methods"), review.alias("is_review"))
    missing = F.array_compact(F.array(F.when(F.size("results") == 0, "result"), F.when(F.size("methods") == 0, "method")))
    status = F.when(F.col("is_review"), "partial").when(F.size(missing) > 0, "needs_review").otherwise("ready")
    names = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.transform(c, lambda v: v.label), ", ")))
    capsule = F.concat_ws("\n", F.nullif("title", F.lit("")), names("results", "results: "), names("methods", "methods: "), F.when(F.col("is_review"), "type: review"))
    flagged = F.col("status") == "needs_review"
    return rows.withColumn("status", status).withColumn("anomaly", F.when(flagged, "missing_required_signatures")).withColumn("detail", F.when(flagged, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))).withColumn("capsule", capsule)


def known_status(value: Column) -> Column:
    """A status as it is recorded; nothing or an unknown one counts as failed."""
    return F.when(F.trim(value).isin(*STATUSES), F.trim(value)).otherwise("failed")


def objects(capsules_: DataFrame, kind: str, snapshot: DataFrame | None = None, work: str = "work_id") -> DataFrame:
    """(work, object_key, label, kind, status, confidence, source, summary, values) of each work's ``kind`` ("results" or "methods").

    ``snapshot`` (work, status, values): what a capsule recorded earlier.  Its values, if any, take precedence over those
    found in the text; a work that it leaves in review or failed stays so, and an unknown status of it counts as failed.
    """
    rows = capsules_.select(F.col(work), "title", "has_text", F.col(kind).alias("found"))
    if snapshot is None:
        rows = rows.withColumn("recorded", F.lit(None).cast("string")).withColumn("held", F.lit(None).cast(f"array<{VALUE}>"))
    else:
        rows = rows.join(snapshot.select(F.col(work), known_status(F.col("status")).alias("recorded"), F.col("values").alias("held")), work, "left")
    use = F.coalesce(F.size("held"), F.lit(0)) > 0
    values = F.when(use, F.col("held")).otherwise(F.col("found"))
    status = F.when(F.col("recorded").isin("needs_review", "failed"), F.col("recorded")).when(F.size("values") > 0, "ready").when(F.col("has_text"), "partial").otherwise("failed")
    rows = rows.withColumn("values", values).withColumn("source", F.when(use, "structure_capsule").when(F.col("has_text"), "chunks").otherwise("metadata_only"))
    label = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("work-"), F.col(work).cast("string")))
    signs = F.when(F.size("values") > 0, F.concat(F.lit(f"{kind[:-1]} signatures: "), F.array_join(F.transform("values", lambda v: v.label), ", ")))
    return rows.select(
        F.col(work), F.lit("default").alias("object_key"), label.alias("label"), F.get("values", F.lit(0)).kind.alias("kind"), status.alias("status"), F.array_max(F.transform("values", lambda v: v.confidence)).alias("confidence"),
        "source", F.concat_ws(" | ", F.nullif("title", F.lit("")), signs, F.concat(F.lit("source="), "source")).alias("summary"), "values",
    )


def object_values(objects_: DataFrame, work: str = "work_id") -> DataFrame:
    """(work, place, kind, label, evidence, confidence), a row for each value."""
    return objects_.select(F.col(work), F.posexplode("values").alias("place", "v")).select(F.col(work), (F.col("place") + 1).cast("long").alias("place"), "v.*")


def application_links(methods: DataFrame, results: DataFrame, work: str = "work_id") -> DataFrame:
    """(work, method_status, result_status): a work's method is applied to its own default result, where it has both."""
    m, r = methods.where("size(values) > 0").select(work, F.col("status").alias("method_status")), results.select(work, F.col("status").alias("result_status"))
    return m.join(r, work)


def transfer(signatures: DataFrame, supported: DataFrame, blocked: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(src, dst, support, score): from each work to those that share method signatures with it.

    ``signatures``: (work, key); ``supported``: works with result values; ``blocked``: works whose structure needs review or
    failed, which give no candidates.  Works with the same keys are one class.  Where classes meet at few keys (ROWS pairs at most), only
    the classes' least works are paired and counted, in blocks, and the members' pairs are joined to that at the end, where nothing is
    shuffled any more.  Elsewhere no pair is shuffled at all: blocks of works meet with their keys, and a task counts and gives away the
    pairs of two blocks piece by piece.
    """
    own = written(signatures.select("work", "key").where("work is not null and key is not null"), "signatures")
    # Numbers of the keys, fixed by being written.
    keys = written(own.select("key").distinct().withColumn("number", F.monotonically_increasing_id()), "signature-keys")
    numbered = own.join(keys, "key").groupBy("work").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    kind = T.StructType([own.schema["work"], T.StructField("support", T.LongType()), T.StructField("same", T.BinaryType())])
    sets = written(numbered.mapInArrow(_packed, kind), "signature-sets")
    classes = sets.groupBy("same").agg(F.min("work").alias("rep"), F.first("support").alias("support"), F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    classes = written(classes, "signature-classes")
    reps = own.join(classes.select(F.col("rep").alias("work")), "work", "left_semi")
    pairs = reps.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    score = F.least(F.lit(TRANSFER_CAP), TRANSFER_BASE + TRANSFER_STEP * F.col("support") + F.when(F.col("has") == 1, TRANSFER_RESULT).otherwise(0.0))
    if (pairs or 0) > ROWS:
        return _block_pairs(sets, classes, supported, blocked, least).select("src", "dst", "support", score.alias("score"))
    members = sets.select("work", "same").join(classes.select("same", "rep", "blocks"), "same").select("work", "rep", F.pmod(F.xxhash64("work"), "blocks").cast("int").alias("block"))
    counted = dealt_pairs(reps.select(F.col("work").alias("n"), F.col("key").alias("v")).distinct()).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    links = written(counted, "class-pairs")
    links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "support"))
    links = links.unionByName(classes.where((F.col("size") > 1) & (F.col("support") >= least)).select(F.col("rep").alias("src"), F.col("rep").alias("dst"), "support"))
    parts = lambda c, n: classes.select(F.col("rep").alias(c), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(n))
    links = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "support").join(parts("a", "i"), "a").join(parts("b", "j"), "b")
    givers = members if blocked is None else members.join(blocked.select("work").distinct(), "work", "left_anti")
    takers = members.join(supported.select("work", F.lit(1).alias("has")).distinct(), "work", "left")
    both = links.join(givers.select(F.col("rep").alias("a"), F.col("block").alias("i"), F.col("work").alias("src")), ["a", "i"])
    both = both.join(takers.select(F.col("rep").alias("b"), F.col("block").alias("j"), F.col("work").alias("dst"), "has"), ["b", "j"]).where("src <> dst")
    return both.select("src", "dst", "support", score.alias("score"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(work, numbers) to (work, support, same): the sorted numbers by their steps, in few bytes."""
    for batch in batches:
        lists = batch.column("numbers")
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        same = [zlib.compress(np.diff(flat[x:y], prepend=0).tobytes(), 1) for x, y in pairwise(ends)]
        yield pa.RecordBatch.from_arrays([batch.column("work"), pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.binary())], names=["work", "support", "same"])


def _block_pairs(sets: DataFrame, classes: DataFrame, supported: DataFrame, blocked: DataFrame | None, least: int) -> DataFrame:
    """(src, dst, support, has): classes (of more than BLOCK works: parts) dealt in blocks, every pair of blocks counted by one task; a block is
    sent once to each other one.

    Twelve blocks; more only where a block would hold more than NUMBERS keys or WORKS works.
    """
    n, total = sets.agg(F.count(F.lit(1)), F.sum("support")).first()
    blocks = max(min(12, n), -(-total // NUMBERS), -(-n // WORKS))
    works = sets.join(classes.select("same", F.col("blocks").alias("parts")), "same").withColumn("part", F.pmod(F.xxhash64("work"), "parts"))
    works = works.join(supported.select("work", F.lit(1).alias("has")).distinct(), "work", "left")
    gives = F.lit(True)
    if blocked is not None:
        works, gives = works.join(blocked.select("work", F.lit(1).alias("held")).distinct(), "work", "left"), F.col("held").isNull()
    member = F.struct("work", gives.alias("gives"), "has")
    units = works.groupBy(F.pmod(F.xxhash64("same", "part"), F.lit(blocks)).cast("int").alias("own"), "part", "same").agg(F.collect_list(member).alias("members"))
    sent = units.select("own", "same", "members", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    sent = sent.select("own", "same", "members", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    work, limits = sets.schema["work"].dataType, (PIECE, STRIP, GIVEN)
    kind = T.StructType([T.StructField("src", work), T.StructField("dst", work), T.StructField("support", T.LongType()), T.StructField("has", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            ij = np.stack([batch.column(c).to_numpy() for c in "ij"])
            cuts = [0, *(np.flatnonzero((ij[:, 1:] != ij[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for x, y in pairwise(cuts):
                if x < y:
                    now = tuple(ij[:, x])
                    if held and now != at:
                        yield from _two_blocks(pa.Table.from_batches(held), *at, least, *limits)
                        held = []
                    at = now
                    held.append(batch.slice(x, y - x))
        if held:
            yield from _two_blocks(pa.Table.from_batches(held), *at, least, *limits)

    return sent.repartition(blocks * blocks, "i", "j").sortWithinPartitions("i", "j").mapInArrow(run, kind)


class _Side:
    """A block: units of at most ``piece`` works with the same keys."""

    def __init__(self, rows: pa.Table, piece: int):
        sets = [np.cumsum(np.frombuffer(zlib.decompress(x), np.int64)) for x in rows.column("same").to_pylist()]
        lists = rows.column("members").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        members, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        self.work, self.gives, self.has = (members.field(c) for c in ("work", "gives", "has"))
        self.gives = self.gives.to_numpy(zero_copy_only=False)
        pieces = [(u, s, min(piece, y - s)) for u, (x, y) in enumerate(pairwise(ends)) for s in range(x, y, piece)]
        self.first, self.size = (np.array([p[k] for p in pieces], np.int64) for k in (1, 2))
        self.keys = np.concatenate([sets[p[0]] for p in pieces])
        self.unit = np.repeat(np.arange(len(pieces)), [len(sets[p[0]]) for p in pieces])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _two_blocks(rows: pa.Table, i: int, j: int, least: int, piece: int, strip: int, given: int) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks' works, both ways; or those of one block."""
    first = pc.equal(rows.column("own"), int(i))
    x = _Side(rows.filter(first), piece) if pc.any(first).as_py() else None
    y = x if i == j else _Side(rows.filter(pc.invert(first)), piece) if not pc.all(first).as_py() else None
    if x is None or y is None:
        return
    order = np.argsort(y.keys, kind="stable")
    known, begin = np.unique(y.keys[order], return_index=True)
    begin, units, wide = np.append(begin, len(order)), y.unit[order], len(y.size)
    place = np.minimum(np.searchsorted(known, x.keys), len(known) - 1)
    met = known[place] == x.keys
    place, unit = place[met], x.unit[met]
    sizes = begin[place + 1] - begin[place]
    # Strips of x's units: a bounded number of counts, and of meetings unless one unit alone has more.
    cost = np.cumsum(np.bincount(unit, sizes, len(x.size)).astype(np.int64))
    at = 0
    while at < len(x.size):
        end = min(at + max(1, strip // wide), int(np.searchsorted(cost, (cost[at - 1] if at else 0) + strip, side="right")))
        end = max(end, at + 1)
        lo, hi = np.searchsorted(unit, [at, end])
        meet = np.repeat((unit[lo:hi] - at) * wide, sizes[lo:hi]) + units[_ranges(begin[place[lo:hi]], sizes[lo:hi])]
        counts = np.bincount(meet, minlength=(end - at) * wide)
        hits = np.flatnonzero(counts >= max(1, least))
        a, b, support = at + hits // wide, hits % wide, counts[hits]
        yield from _spelled(x, y, a, b, support, given)
        if x is not y:
            order = np.argsort(b, kind="stable")
            yield from _spelled(y, x, b[order], a[order], support[order], given)
        at = end


def _spelled(x: _Side, y: _Side, a: np.ndarray, b: np.ndarray, support: np.ndarray, given: int) -> Iterator[pa.RecordBatch]:
    """Pairs of units as pairs of their works, about ``given`` rows at a time."""
    total = np.cumsum(x.size[a] * y.size[b])
    cuts = np.flatnonzero(np.diff(total // given)) + 1
    for lo, hi in pairwise([0, *cuts, len(a)]):
        if lo == hi:
            continue
        # Pair by pair: runs of the same works side by side take little room in the result's files.
        src, pair = _ranges(x.first[a[lo:hi]], x.size[a[lo:hi]]), np.repeat(np.arange(lo, hi), x.size[a[lo:hi]])
        src, pair = src[x.gives[src]], pair[x.gives[src]]
        sizes = y.size[b[pair]]
        src, dst, n = np.repeat(src, sizes), _ranges(y.first[b[pair]], sizes), np.repeat(support[pair], sizes)
        if x is y:
            other = src != dst
            src, dst, n = src[other], dst[other], n[other]
        yield pa.RecordBatch.from_arrays([x.work.take(pa.array(src)), y.work.take(pa.array(dst)), pa.array(n, pa.int64()), y.has.take(pa.array(dst))], names=["src", "dst", "support", "has"])


# ---- contract


def envelope(object_type: str, object_id: Column, status: Column, derivation: str, refs: Column, source_kind: str = "extraction") -> list[Column]:
    """The columns that every typed object has."""
    return [
        F.lit(VERSION).alias("contract_version"), F.lit(object_type).alias("object_type"), object_id.alias("object_id"), F.lit(source_kind).alias("source_kind"),
        status.alias("status"), F.lit(derivation).alias("derivation"), refs.alias("source_refs"),
    ]


def signature_objects(values: DataFrame, status: Column, kind: str = "result_signature", work: str = "work_id") -> DataFrame:
    """Typed objects of values (work, place, kind, label, evidence, confidence)."""
    key = F.concat_ws(":", F.lit(kind), F.col(work).cast("string"), F.col("place").cast("string"))
    refs = F.array(F.concat(F.lit("work:"), F.col(work).cast("string")), F.concat(F.lit("value:"), F.col("place").cast("string")))
    return values.select(*envelope(kind, key, status, "normalized", refs), F.col(work).alias("work_id"), "kind", "label", "confidence", F.array(F.struct(F.concat(F.lit("work:"), F.col(work).cast("string")).alias("evidence_key"), F.col("evidence").alias("text"))).alias("items"))


def violations(rows: DataFrame) -> Column:
    """The rules that a typed object breaks, by name.  ``confidence``, ``items`` and ``work_id`` are checked where the columns exist."""
    have = set(rows.columns)
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = {
        "version": F.coalesce(F.col("contract_version") != VERSION, F.lit(True)),
        "object_type": empty("object_type"),
        "object_id": empty("object_id"),
        "source_kind": empty("source_kind"),
        "status": F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True)),
        "derivation": F.coalesce(~F.col("derivation").isin(*DERIVATIONS), F.lit(True)),
        "source_refs": F.coalesce(F.size(F.filter("source_refs", lambda r: F.trim(r) != "")), F.lit(0)) == 0,
    }
    if "confidence" in have:
        rules["confidence"] = F.coalesce((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit(False))
    if "items" in have:
        rules["items"] = F.exists(F.coalesce("items", F.filter("items", lambda x: F.lit(False))), lambda x: F.coalesce(F.trim(x.evidence_key), F.lit("")) == "")
    if "work_id" in have:
        rules["work"] = F.col("object_type").endswith("_signature") & F.col("work_id").isNull()
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))


# ---- audit


def noise(text: Column) -> list[Column]:
    """Which noise patterns a text has, 0 or 1 each."""
    return [F.coalesce(text, F.lit("")).rlike(p).cast("int").alias(k) for k, p in NOISE.items()]


def audit(texts: DataFrame, document: str = "doc_id", level: str = "level", text: str = "text") -> DataFrame:
    """(document, noise counts, equations, structured, ready, recommendation) of searched chunks and blocks (``level``).

    Ready: no noise in chunks, at most one noisy block pattern, and most equations with some structure.
    """
    hits = sum((F.col(k) for k in NOISE), F.lit(0))
    equation = F.coalesce(F.col(text), F.lit("")).contains("Equation:")
    structured = equation & (F.col(text).contains("/") | F.col(text).contains(" x "))
    rows = texts.select(document, level, equation.cast("int").alias("equation"), structured.cast("int").alias("structure"), *noise(F.col(text)))
    of = lambda name: F.sum(F.when(F.col(level) == name, hits).otherwise(0))
    found = rows.groupBy(document).agg(*(F.sum(k).alias(k) for k in NOISE), of("chunk").alias("chunk_noise"), of("block").alias("block_noise"), F.sum("equation").alias("equations"), F.sum("structure").alias("structured"))
    share = F.when(F.col("equations") > 0, F.col("structured") / F.col("equations")).otherwise(1.0)
    ready = (F.col("chunk_noise") <= CHUNK_NOISE) & (F.col("block_noise") <= BLOCK_NOISE) & (share >= EQUATION_SHARE)
    what = F.when(F.col("chunk_noise") > CHUNK_NOISE, "repair_chunks").when(F.col("block_noise") > BLOCK_NOISE, "repair_blocks").when(share < EQUATION_SHARE, "repair_equations").otherwise("none")
    return found.withColumn("ready", ready).withColumn("recommendation", what)


# ---- several ranked lists

TYPE_BONUS = {"article": 0.003, "review": 0.0015, "note": -0.0015, "conference paper": -0.001, "proceedings article": -0.001}
RRF = 60


def fused_lists(hits: DataFrame) -> DataFrame:
    """(key, score, lists, first_list, first_rank) of hits (key, list, rank, type): reciprocal ranks and the type's bonus at every appearance."""
    bonus = F.coalesce(F.create_map(*(F.lit(x) for kv in TYPE_BONUS.items() for x in kv))[F.col("type")], F.lit(0.0))
    first = F.min(F.struct("list", "rank"))
    rows = hits.groupBy("key").agg(F.sum(1.0 / (RRF + F.col("rank")) + bonus).alias("score"), F.count(F.lit(1)).alias("lists"), first.alias("first"))
    return rows.select("key", "score", "lists", F.col("first.list").alias("first_list"), F.col("first.rank").alias("first_rank"))


def one_per_group(fused: DataFrame, groups: DataFrame, limit: int) -> DataFrame:
    """Fused hits with those of a group (key, group, richness) as one, at the place of its best; the richest stands for it."""
    order = [F.round("score", 9).desc(), F.col("first_list"), F.col("first_rank"), F.col("key")]
    ranked = fused.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a few lists of bounded length
    rows = ranked.join(groups, "key")
    best = rows.groupBy("group").agg(F.max_by(F.struct("key", "score", "lists"), F.struct("richness", -F.col("place"))).alias("b"), F.min("place").alias("place"), F.count(F.lit(1)).alias("members"))
    top = best.orderBy("place").limit(limit)
    return top.select("b.key", F.round("b.score", 6).alias("score"), "b.lists", "members", F.row_number().over(Window.orderBy("place")).cast("long").alias("rank"))
