"""Concepts from section paths, as tables: the distinct prefixes of all paths, what their headings are, which of them count.

A path's headings below its roots give one prefix each.  Prefixes are made distinct before anything is decided, so what follows
works on as many rows as there are different sections, not on as many as there are texts.  Headings are classified once, by
column expressions; labels, parents and aliases are joins and expressions over the classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize_display, normalize_search, safe_key

# Fixed values that the data model prescribes.
HEADING_NUMBER = r"(?i)^\s*(?:[A-Za-z]?\d+(?:\.\d+)*|[IVXLCDM]+(?=[.)]))\s*[\].:)\-]?\s*"
REVIEW_OF = (r"(?i)^\s*PDG\s+review\s+of\s+", r"(?i)^\s*review\s+of\s+")
IN_BRACKETS = r"\(([^()]{2,24})\)"
SUBJECTS = (
    r"(?i)\b(CKM matrix)\b",
    r"(?i)\b(PMNS matrix)\b",
    r"(?i)\b([A-Za-z0-9+-]+\s+mesons?)\b",
    r"(?i)\b([A-Za-z0-9+-]+\s+bosons?)\b",
    r"(?i)\b([A-Za-z0-9+-]+\s+quarks?)\b",
    r"(?i)\b([A-Za-z0-9+-]+\s+leptons?)\b",
    r"(?i)\b([A-Za-z0-9+-]+\s+neutrinos?)\b",
    r"(?i)\b(Higgs boson)\b",
    r"(?i)\b(vector boson scattering)\b",
)
GENERIC = (
    "abstract", "acknowledgements", "acknowledgments", "appendix", "background", "bibliography", "conclusion", "conclusions", "contents", "discussion", "figure",
    "figures", "index", "introduction", "overview", "references", "review", "summary", "supplement", "table", "tables",
)
CONTEXTUAL = (
    "branching fractions", "branching ratio", "branching ratios", "coupling", "couplings", "cross section", "cross sections", "decay", "decays", "form factor",
    "form factors", "interactions", "lifetime", "lifetimes", "mass", "masses", "mixing", "parameter", "parameters", "production", "properties", "property",
    "scattering", "spectroscopy", "width", "widths",
)
#: Hints of each kind, in order of precedence; a label without any is a section.
HINTS = {
    "decay": ("decay", "branching", "lifetime", "width"),
    "process": ("annihilation", "collision", "fusion", "interaction", "jet tagging", "production", "scattering", "vector boson scattering"),
    "parameter": ("ckm", "pmns", "coupling", "constant", "matrix element", "parameter"),
    "observable": ("cross section", "mass", "width", "asymmetry", "lifetime", "form factor", "mixing"),
    "particle": (
        "boson", "baryon", "hadron", "meson", "quark", "gluon", "photon", "electron", "muon", "tau", "neutrino", "higgs", "proton", "neutron", "kaon", "pion",
        "lambda", "sigma", "omega", "charm", "bottom", "top", "strange",
    ),
}
PHYSICAL = r"\b(?:qcd|ckm|pmns|lhc|hl lhc|bsm|eft|vbs|ssww|cms|atlas)\b|\b[a-z]+\d+\b|\b(?:b|d|k|w|z)\s+mesons?\b"
KIND_RANK = {"particle": 5, "process": 4, "decay": 4, "parameter": 3, "observable": 3, "section": 1}
PLURALS = {"property": "properties", "parameter": "parameters"}
ROOT_PREFIX = "pdg"
ALIAS_CHARS, WORD_CHARS, SUBJECTS_OF_A_TEXT = 3, 4, 4
ALIAS_BASE, ALIAS_PER_WORD, ALIAS_CAP = 0.55, 0.08, 0.92


def folded(text: Column) -> Column:
    return F.lower(normalize_search(text))


def heading(text: Column) -> Column:
    """A heading without its number and what introduces it."""
    for pattern in (HEADING_NUMBER, *REVIEW_OF):
        text = F.regexp_replace(text, pattern, "")
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" .:-"))


def _holds(text: Column, hints: Sequence[str]) -> Column:
    return text.rlike("|".join(hints))


def is_physical(text: Column) -> Column:
    """Whether a folded text names anything of the field."""
    return _holds(text, [h for hints in HINTS.values() for h in hints]) | text.rlike(PHYSICAL)


def kind(text: Column) -> Column:
    first = F.lit("section")
    for name, hints in reversed(HINTS.items()):
        first = F.when(_holds(text, hints), name).otherwise(first)
    return first


def steps(sections: DataFrame, roots: Sequence[str] = (), source: str = "source", path: str = "path") -> DataFrame:
    """One row for each heading of each path below its roots: ``source level own parent key``; the key spells all headings so far.

    A null or empty path has none; the last heading stays even if it looks like a root of the reference book."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "/"), normalize_display), lambda x: x != "")
    known = [F.lower(normalize_search(heading(F.lit(r)))) for r in roots]
    rows = sections.select(F.col(source).alias("source"), F.transform(parts, heading).alias("parts"))
    is_root = F.transform("parts", lambda x, i: folded(x).isin(*known) | (folded(x).startswith(ROOT_PREFIX) & (i < F.size("parts") - 1)) if known else folded(x).startswith(ROOT_PREFIX) & (i < F.size("parts") - 1))
    first = F.array_position(is_root, F.lit(False)).cast("int")
    below = F.when(first > 0, F.filter(F.slice("parts", first, F.size("parts")), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("source", below.alias("parts")).select("source", "parts", F.posexplode("parts").alias("at", "own"))
    names = F.transform(F.slice("parts", F.lit(1), F.col("at") + 1), lambda x: F.coalesce(F.nullif(safe_key(x), F.lit("")), F.lit("unknown")))
    return rows.select("source", (F.col("at") + 1).alias("level"), "own", F.get("parts", F.col("at") - 1).alias("parent"), F.array_join(names, "/").alias("key"))


def classes(prefixes: DataFrame) -> DataFrame:
    """The distinct headings with what they are: ``own name generic contextual physical``."""
    rows = prefixes.select("own").distinct().withColumn("name", folded(F.col("own")))
    return rows.select("own", "name", ((F.col("name") == "") | F.col("name").isin(*GENERIC)).alias("generic"), F.col("name").isin(*CONTEXTUAL).alias("contextual"), is_physical(F.col("name")).alias("physical"))


def accepted(taken: DataFrame) -> DataFrame:
    """The prefixes that count, once each spelling: ``key level own parent label kind contextual``.

    Generic headings never do; others do below a heading of the field, and by themselves if they are of the field and need no context."""
    prefixes = taken.select("key", "level", "own", "parent").distinct()
    known = classes(prefixes)
    above = known.select(F.col("own").alias("parent"), F.col("physical").alias("below_physical"))
    rows = prefixes.join(known, "own").join(above, "parent", "left")
    rows = rows.where(~F.col("generic") & (F.coalesce("below_physical", F.lit(False)) | F.col("physical") & ~F.col("contextual")))
    plural = F.col("name")
    for one, many in PLURALS.items():
        plural = F.when(F.col("name") == one, many).otherwise(plural)
    in_context = F.col("contextual") & F.col("parent").isNotNull()
    rows = rows.withColumn("label", F.when(in_context, F.concat_ws(" ", "parent", plural)).otherwise(F.col("own")))
    return rows.select("key", "level", "own", "parent", "label", kind(folded(F.col("label"))).alias("kind"), "contextual")


def contains(rows: DataFrame) -> DataFrame:
    """(parent, child): each concept's nearest concept above."""
    keys = rows.select("key").distinct()
    above = keys.select("key", F.split("key", "/").alias("parts")).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))).alias("parent")).where("parent <> key")
    found = above.join(keys.select(F.col("key").alias("parent")), "parent")
    return found.groupBy("key").agg(F.max_by("parent", F.length("parent")).alias("parent")).select("parent", F.col("key").alias("child"))


def taxonomy(taken: DataFrame) -> DataFrame:
    """(key, label, kind, level, parent, mentions): of a concept's spellings the longest label and the most telling kind; how many sources name it."""
    rows = accepted(taken)
    rank = F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv))[F.col("kind")]
    named = rows.groupBy("key").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("label"), F.max_by("kind", F.struct(rank, "kind")).alias("kind"), F.min("level").cast("long").alias("level"))
    heard = taken.groupBy("key").agg(F.countDistinct("source").alias("mentions"))
    return named.join(contains(rows).withColumnRenamed("child", "key"), "key", "left").join(heard, "key").select("key", "label", "kind", "level", "parent", "mentions")


def alias_rows(taken: DataFrame) -> DataFrame:
    """(key, alias, alias_kind, confidence): what a concept may be called, once each folded form, the label before longer and these before shorter ones.

    A heading that needs no context is an alias itself, one that does is one of its heading above; both lose or give their brackets."""
    rows = accepted(taken)
    in_context = F.col("contextual") & F.col("parent").isNotNull()
    texts = F.array("label", "own")
    bare = F.transform(texts, lambda t: normalize_display(F.regexp_replace(t, r"\([^()]*\)", " ")))
    inside = F.flatten(F.transform(texts, lambda t: F.transform(F.regexp_extract_all(t, F.lit(IN_BRACKETS), F.lit(1)), normalize_display)))
    other = F.array_compact(F.array(F.when(~F.col("contextual"), F.col("own")), F.when(in_context, F.concat_ws(" of ", "own", "parent"))))
    flat = rows.select("key", "label", F.explode(F.array_distinct(F.concat(F.array("label"), other, inside, bare))).alias("alias")).withColumns({"form": normalize_search(F.col("alias")), "own_form": normalize_search(F.col("label"))})
    is_label = F.col("form") == F.col("own_form")
    n = F.size(F.split("form", " "))
    flat = flat.where(is_label & (F.col("form") != "") | (F.length("form") >= ALIAS_CHARS) & ~F.lower("form").isin(*GENERIC) & ((n > 1) | (F.length("form") >= WORD_CHARS)))
    sure = F.when(is_label, 1.0).otherwise(F.least(F.lit(ALIAS_CAP), ALIAS_BASE + ALIAS_PER_WORD * n))
    flat = flat.select("key", "form", "alias", F.when(is_label, "label").otherwise("alias").alias("alias_kind"), sure.alias("confidence"), (F.col("alias") == F.col("label")).alias("exact"))
    best = F.max_by(F.struct("alias", "alias_kind", "confidence"), F.struct("confidence", "exact", "alias")).alias("a")
    return flat.groupBy("key", "form").agg(best).select("key", "a.*")


def subjects(text: Column) -> Column:
    """What a text is about, by the patterns in turn; four at most, none for null."""
    plain = normalize_display(text)
    found = F.flatten(F.array(*(F.regexp_extract_all(plain, F.lit(p), F.lit(1)) for p in SUBJECTS)))
    named = F.transform(found, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"(?i)^(?:the|a|an)\s+", "")), r"\s+", " "))
    matrix = F.transform(named, lambda x: F.when(x.rlike(r"(?i)^\S+ matrix"), F.concat(F.upper(F.split_part(x, F.lit(" "), F.lit(1))), F.lit(" Matrix"))).when(x.rlike("^[a-z] "), F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 10000))).otherwise(x))
    return F.slice(F.array_distinct(F.filter(matrix, lambda x: (x != "") & is_physical(folded(x)))), 1, SUBJECTS_OF_A_TEXT)
