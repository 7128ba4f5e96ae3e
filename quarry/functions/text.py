"""Column expressions for text: tokens, normal forms, sentences, identifiers.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"

# Fixed values that the data model prescribes.
EMBEDDING_STOPWORDS = (
    "search", "searches", "observation", "observations", "measurement", "measurements", "result", "results", "study", "studies", "paper", "presents",
    "presented", "reported", "report", "collision", "collisions", "proton", "pp", "tev", "sqrt", "final", "state", "states",
)
RESULT_PATTERNS = {
    "measurement": r"(?i)\b(measure(?:ment|d|s)?|determination|branching fraction|branching ratio|cross section)\b",
    "upper_limit": r"(?i)\b(upper limit|95%\s*cl|limit at 95% cl|set limits?)\b",
    "significance": r"(?i)\b(significance|significant excess|observed excess)\b",
    "exclusion": r"(?i)\b(exclude(?:d|s|ion)|exclusion limit)\b",
}
METHOD_PATTERNS = {
    "statistical_fit": r"(?i)\b(profile likelihood|likelihood fit|template fit|maximum likelihood)\b",
    "multivariate": r"(?i)\b(boosted decision tree|\bbdt\b|neural network|deep neural network|multivariate)\b",
    "background_estimation": r"(?i)\b(background estimation|data[- ]driven|control region)\b",
    "reconstruction": r"(?i)\b(reconstruction|unfolding|matrix element|tagger)\b",
}
INLINE_CITATIONS = r"\[[0-9,\s;–-]+\]"
DOI = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[\"(]*[A-Z0-9ΔΣΩ])"
#: Entities and tags that the search form drops, in order.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
PUNCTUATION = r"[$^_{}()\[\],;:|/–-]"


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def title(text: Column) -> Column:
    """The first line, 80 characters at most."""
    return F.substring(F.split(F.coalesce(text, F.lit("")), "\n").getItem(0), 1, 80)


def normalize_search(text: Column) -> Column:
    """The form that is searched: entities resolved, tags and punctuation as spaces, white space collapsed."""
    out = F.coalesce(text, F.lit(""))
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    out = F.regexp_replace(out, r"</?[A-Za-z][^>]*?>", " ")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalize_display(text: Column) -> Column:
    """The form that is shown: entities resolved, tags as spaces, no space before closing marks or behind opening ones."""
    out = F.coalesce(text, F.lit(""))
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    out = F.regexp_replace(out, r"</?[A-Za-z][^>]*?>", " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = F.regexp_replace(out, r" ([.,;:!?)\]])", "$1")
    return F.regexp_replace(out, r"([(\[]) ", "$1")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: F.trim(s) != "")


def strip_inline_citations(text: Column) -> tuple[Column, Column]:
    """(text without bracketed reference numbers, how many there were)."""
    body = F.coalesce(text, F.lit(""))
    return F.regexp_replace(body, INLINE_CITATIONS, ""), F.regexp_count(body, F.lit(INLINE_CITATIONS)).cast("long")


def safe_key(text: Column) -> Column:
    """Lower case, runs of other characters as underscores, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""))


def snippet(text: Column, pattern: str, before: int = 80, after: int = 120) -> Column:
    """What surrounds the first match, on one line; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.trim(F.regexp_replace(F.substring(text, start, at - start + after), r"\s+", " ")))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def text_or_null(value: Column) -> Column:
    """Trimmed; null for what is empty."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def int_or_null(value: Column) -> Column:
    """A whole number; null for anything else."""
    return F.when(F.trim(value.cast("string")).rlike(r"^[+-]?[0-9]+$"), F.trim(value.cast("string")).try_cast("bigint"))


def float_or_null(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")
