"""Personal data in texts: four kinds by strict patterns, and identifiers that only their contexts give away.

Strict patterns find the base: e-mail addresses, IP addresses, card and telephone numbers.  A loose pattern finds whatever is
written like an identifier, the base included.  Each such occurrence has up to five lexical patterns, from the words beside it:
one, two or three before, one on each side, two behind.  Occurrences with the same digits, or the same address once ``at`` and
``dot`` are read as signs, are one instance.  Patterns and instances form a graph.  Instances that the base knows score 1 for
their kind.  In each round a pattern's confidence in a kind is the lower end of Wilson's interval for the share of that kind
among its distinct instances (unknown ones that may be of the kind weigh half); patterns at ``SURE`` or above raise their
instances to one minus the product of what each of them leaves in doubt.  After ``ROUNDS`` rounds, occurrences outside the base whose instance scores ``SURE`` or more become spans of
the kind they score most for, among those their form allows.

Everything is an expression or a join: texts are scanned once, spans and occurrences are written to the shared folder, and what
is shuffled are occurrences.  A pattern or an instance that is met very often is summed before it is sent; joins with scores meet
one row a key, so a hot key can be split.

Defined cases: a null text is empty; a text without identifiers has counts of zero, an empty list of spans and the hash of the
empty text; repeated rows are rows of their own and count as one instance; an empty table gives no rows; words beyond 100
characters from an occurrence are no context; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns, so written that a search never reads the same run twice: a match begins where a run or a match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: What a text must have before a strict pattern is tried.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"

_NAME, _HOST = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++", r"[\p{L}\p{N}-]++"
_AT, _DOT = r"(?:\s?[(\[{]\s?(?:at|AT|@)\s?[)\]}]\s?|\s(?:at|AT)\s)", r"(?:\s?[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]\s?|\s(?:dot|DOT)\s|\.)"
ADDRESS = rf"{_NAME}(?:@{_HOST}(?:\.{_HOST})*+|{_AT}{_HOST}(?:{_DOT}{_HOST})++)"
COLONS = r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{0,4}(?![\p{L}\p{N}:])"
NUMBER = r"(?<![\p{L}\p{N}_])\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9])*+(?![\p{L}\p{N}_])"
#: What is written like an identifier, and a sign that there may be one.
LOOSE, LOOSE_SIGN = f"{ADDRESS}|{COLONS}|{NUMBER}", r"[@0-9]|(?:dot|DOT)"

#: Confidence that patterns and instances need, rounds of scoring, deviations of Wilson's interval (nine in ten), and what an
#: unknown instance of a fitting form weighs against a pattern.
SURE, ROUNDS, Z, UNKNOWN = 0.7, 3, 1.28, 0.5
#: Characters beside an occurrence that are read for context; items whose sums are made at once.
WINDOW, BLOCK = 100, 512


def _running(sizes: Column) -> Column:
    """The sum of the items before each item, in blocks: an array that is appended to is copied."""

    def sums(items: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(items, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)).cast("long"), F.lit(BLOCK).cast("long")), lambda at: F.slice(sizes, (at + 1).cast("int"), BLOCK))
    totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(blocks, sums(totals), lambda block, before: F.transform(sums(block), lambda x: x + before)))


def _matches(text: Column, pattern: str) -> Column:
    """Each match of the text with its place and what stands between it and the matches beside it."""
    values, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(values, F.slice(parts, 1, F.size(values)), lambda v, p: F.length(p).cast("long") + F.length(v))
    starts = F.zip_with(_running(steps), parts, lambda at, p: at + F.length(p))
    return F.transform(values, lambda v, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(v)).alias("end"), v.alias("value"), F.get(parts, i).alias("before"), F.get(parts, i + 1).alias("behind")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a card number's digits check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a strict pattern's match counts."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"\A{PART}(?:\.{PART}){{3}}\z")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    found = F.filter(_matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
    spans = F.transform(found, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"], m["end"]))
    return F.when(text.rlike(SIGNS[kind]), spans).otherwise(F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), F.lower)


def _occurrence(match: Column) -> Column:
    before = F.reverse(F.concat(F.array(F.lit("^"), F.lit("^"), F.lit("^")), _words(F.right(match["before"], F.lit(WINDOW)))))
    behind = F.concat(_words(F.left(match["behind"], F.lit(WINDOW))), F.array(F.lit("$"), F.lit("$")))
    return F.struct(match["start"], match["end"], match["value"], F.slice(before, 1, 3).alias("before"), F.slice(behind, 1, 2).alias("behind"))


def _looks_so(value: Column) -> Column:
    """Whether a loose match has enough to it: seven digits, four numbers with dots, letters and colons, or an address."""
    return (F.length(_digits(value)) >= 7) | value.rlike(r"\A[0-9]+(?:\.[0-9]+){3}\z|[^0-9 ().\-/+]")


def scan(docs: DataFrame) -> DataFrame:
    """Each row with a number of its own, its base spans and its occurrences, written to the shared folder."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    loose = F.transform(F.filter(_matches(F.col("text"), LOOSE), lambda m: _looks_so(m["value"])), _occurrence)
    found = F.when(F.col("text").rlike(LOOSE_SIGN), loose).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:array<string>,behind:array<string>>>"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*(_spans(F.col("text"), k) for k in KINDS)).alias("base"), found.alias("found")), "pii")


def _instance(value: Column) -> Column:
    """One spelling for all ways to write an identifier."""
    address = F.lower(F.regexp_replace(F.regexp_replace(value, _AT, "@"), _DOT, "."))
    return F.when(value.rlike(f"@|{_AT}"), address).when(value.rlike(":"), F.lower(value)).when(value.rlike(r"\A[0-9]+(?:\.[0-9]+){3}\z"), value).otherwise(_digits(value))


def _seed(kind: str, value: Column) -> Column:
    """Whether the strict pattern finds the kind in an occurrence."""
    return F.when(value.rlike(SIGNS[kind]), F.exists(F.regexp_extract_all(value, F.lit(PATTERNS[kind]), F.lit(0)), lambda x: _holds(kind, x))).otherwise(False)


def _allowed(kind: str, value: Column) -> Column:
    """Whether an occurrence's form can be of the kind at all."""
    n, address = F.length(_digits(value)), value.rlike(f"@|{_AT}")
    colons = ~address & value.rlike(":")
    number = ~address & ~colons
    return {"email": address, "ip": colons | number & value.rlike(r"\A[0-9]+(?:\.[0-9]+){3}\z"), "card": number & n.between(12, 19), "phone": number & n.between(7, 15)}[kind]


def occurrences(scanned: DataFrame) -> DataFrame:
    """One row an occurrence: ``row start end value instance before behind seed`` (a flag a kind)."""
    one = scanned.select("row", F.explode("found").alias("o")).select("row", "o.*")
    seeds = F.array(*(_seed(k, F.col("value")) for k in KINDS))
    return one.withColumns({"instance": _instance(F.col("value")), "seed": seeds, "allowed": F.array(*(_allowed(k, F.col("value")) for k in KINDS))})


def edges(found: DataFrame) -> DataFrame:
    """The distinct (pattern, instance) of the occurrences; patterns that see no word at all are left out."""
    b, a = F.col("before"), F.col("behind")
    views = [("l1", b[0]), ("l2", F.concat_ws(" ", b[1], b[0])), ("l3", F.concat_ws(" ", b[2], b[1], b[0])), ("lr", F.concat_ws(" ", b[0], a[0])), ("r2", F.concat_ws(" ", a[0], a[1]))]
    patterns = F.array(*(F.concat(F.lit(f"{name} "), view) for name, view in views))
    return found.select("instance", F.explode(patterns).alias("pattern")).where(F.col("pattern").rlike(r"\A\w\w .*\p{L}")).distinct()


def wilson(part: Column, whole: Column, z: float = Z) -> Column:
    """The lower end of Wilson's interval for the share ``part / whole``."""
    p = part / whole
    return (p + z * z / (2 * whole) - z * F.sqrt(p * (1 - p) / whole + z * z / (4 * whole * whole))) / (1 + z * z / whole)


def instances(found: DataFrame) -> DataFrame:
    """One row an instance: its first scores by kind, and the kinds that it may be of."""
    first = [F.max(F.col("seed")[i].cast("double")).alias(k) for i, k in enumerate(KINDS)]
    return found.groupBy("instance").agg(*first, *(F.bool_or(F.col("allowed")[i]).alias(f"may_{k}") for i, k in enumerate(KINDS)))


def _against(kind: str, sure: float) -> Column:
    """How far an instance speaks against a kind: half if it is unknown but may be of the kind."""
    others = F.greatest(*(k for k in KINDS if k != kind))
    return (1 - F.col(kind)) * F.when(F.col(f"may_{kind}") & (others < sure), UNKNOWN).otherwise(1.0)


def scores(links: DataFrame, first: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """The instances with their scores after some rounds; each round is written, so a plan never holds more than one."""
    current = first
    for _ in range(rounds):
        judged = current.select("instance", *KINDS, *(_against(k, sure).alias(f"not_{k}") for k in KINDS))
        total = links.join(judged, "instance").groupBy("pattern").agg(*(F.sum(c).alias(c) for k in KINDS for c in (k, f"not_{k}")))
        trust = total.select("pattern", *(wilson(F.col(k), F.col(k) + F.col(f"not_{k}")).alias(k) for k in KINDS)).where(F.greatest(*KINDS) >= sure)
        trust = trust.select("pattern", *(F.when(F.col(k) >= sure, F.log1p(-F.col(k))).alias(k) for k in KINDS))
        doubt = links.join(trust, "pattern").groupBy("instance").agg(*(F.coalesce(F.sum(k), F.lit(0.0)).alias(f"doubt_{k}") for k in KINDS))
        raised = [F.greatest(F.col(k), F.coalesce(1 - F.exp(f"doubt_{k}"), F.lit(0.0))).alias(k) for k in KINDS]
        current = materialize(first.join(doubt, "instance", "left").select("instance", *raised, *(f"may_{k}" for k in KINDS)), "pii-scores")
    return current


def find(docs: DataFrame) -> DataFrame:
    """``doc_id base spans`` of each row: the base, and the base with what the contexts add, as ``kind start end`` in order."""
    scanned = scan(docs)
    found = materialize(occurrences(scanned), "pii-occurrences")
    first = materialize(instances(found), "pii-instances")
    links = materialize(edges(found), "pii-edges")
    best = F.array_max(F.array(*(F.when(F.col("allowed")[i] & (F.col(k) >= SURE), F.struct(F.col(k).alias("score"), F.lit(-i).alias("kind"))) for i, k in enumerate(KINDS))))
    plain = found.where(~F.array_contains("seed", True))
    known = scores(links, first).where(F.greatest(*KINDS) >= SURE)
    added = plain.join(known, "instance").withColumn("best", best).where(F.col("best").isNotNull())
    added = added.groupBy("row").agg(F.collect_list(F.struct((-F.col("best.kind")).alias("kind"), "start", "end")).alias("added"))
    fresh = F.filter(F.coalesce("added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return scanned.drop("found").join(added, "row", "left").select("doc_id", "base", F.sort_array(F.concat("base", fresh)).alias("spans"))


def written_out(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base by kind, its digest and all spans."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
