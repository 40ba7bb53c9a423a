"""Scalar functions as column expressions, so that they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search.
STOP_WORDS = [
    "find", "show", "search", "get", "list", "where", "is", "are", "the", "a", "an", "for", "with", "in", "me", "dataset", "datasets", "table", "tables",
    "column", "columns", "all", "what", "which", "who", "how", "tell", "about",
]

#: Parts of an id that make an undeclared endpoint a Dataset, when a snapshot is loaded and when sources are ingested.
SNAPSHOT_DATASET_WORDS = ["source", "raw", "db.", "table"]
INGEST_DATASET_WORDS = ["source", "raw", "db.", "table", "model", "stg", "fct", "dim", "users", "orders", "customers"]

#: Names of a scope that mean the whole graph.
GLOBAL_SCOPES = ["", "all", "enterprise", "global", "none"]

#: Words of a message that ask for downstream impact, and for upstream origin.
DOWNSTREAM_WORDS = ["blast", "impact", "affected", "break", "change", "downstream"]
UPSTREAM_WORDS = ["root cause", "upstream", "why", "origin", "source", "parent"]

#: LaTeX commands and the characters they stand for; those of a line share a character.
LATEX_SYMBOLS = [
    (["rightarrow", "to"], "→"), (["leftarrow"], "←"), (["Rightarrow"], "⇒"), (["Leftarrow"], "⇐"), (["leftrightarrow"], "↔"), (["Leftrightarrow"], "⇔"),
    (["longrightarrow", "mapsto", "implies"], "⟶"), (["approx"], "≈"), (["neq"], "≠"), (["le", "leq"], "≤"), (["ge", "geq"], "≥"), (["times"], "×"),
    (["cdot"], "·"), (["dots", "cdots"], "..."),
]
LATEX_ARROWS = "→←⇒⇐↔⇔⟶⟵⟹↦"

#: White space as Python knows it.
SPACES = r"(?U)[\s\x1C-\x1F]+"


def iso_to_epoch_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO 8601 text in UTC. A time given without a fraction means the end of its second (+999 ms). Invalid and null give null."""
    clean = F.trim(text)
    ms = F.unix_millis(F.try_to_timestamp(F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}"), clean)))
    return F.when(clean != "", ms + F.when(text.contains("T") & ~text.contains("."), 999).otherwise(0))


def epoch_ms_to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def search_terms(text: Column) -> Column:
    """The phrase without stop words, its words, and the raw text, each once, of two characters or more. Null gives null."""
    raw = F.regexp_replace(F.lower(text), rf"^{SPACES}|{SPACES}$", "")
    words = F.filter(F.split(raw, SPACES), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    phrase = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(phrase, words, F.array(raw))), lambda t: F.length(t) >= 2)


def last_segment(ident: Column) -> Column:
    """What follows the last dot; the whole id if it has none."""
    return F.substring_index(ident, ".", -1)


def strip_dots(ident: Column) -> Column:
    return F.trim(ident, F.lit("."))


def join_parts(*parts: Column) -> Column:
    """The non-empty parts joined by dots, without dots at the ends."""
    return strip_dots(F.concat_ws(".", *[F.when(p != "", p) for p in parts]))


def has_any(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def endpoint_type(ident: Column, words: list[str] = SNAPSHOT_DATASET_WORDS) -> Column:
    return F.when(has_any(F.lower(ident), words), "Dataset").otherwise("Pipeline")


def is_global_scope(scope: Column) -> Column:
    return scope.isNull() | F.lower(F.trim(scope)).isin(GLOBAL_SCOPES)


def latex_to_unicode(text: Column) -> Column:
    """LaTeX maths in a text as plain characters. Null and '' stay as they are."""
    for wrap in ("text", "mathrm", "mathbf", "mathit"):
        text = F.regexp_replace(text, rf"\\{wrap}\{{([^}}]+)\}}", "$1")
    text = F.regexp_replace(text, r"\\_", "_")
    for names, char in LATEX_SYMBOLS:
        name = "(?:" + "|".join(names) + ")"
        text = F.regexp_replace(text, rf"\$\s*\\+{name}\s*\$", char)
        text = F.regexp_replace(text, rf"\\+{name}\b", char)
    text = F.regexp_replace(text, rf"\$([^$\n]*?[{LATEX_ARROWS}][^$\n]*?)\$", "$1")
    return F.regexp_replace(text, rf"\{{([{LATEX_ARROWS}])\}}", "$1")


def html_escape(text: Column) -> Column:
    """& < > escaped; null gives ''."""
    safe = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(F.replace(safe, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def intent(message: Column) -> Column:
    """'downstream', 'upstream' or 'search'."""
    low = F.lower(F.trim(message))
    return F.when(has_any(low, DOWNSTREAM_WORDS), "downstream").when(has_any(low, UPSTREAM_WORDS), "upstream").otherwise("search")


def table_refs(query: Column) -> Column:
    """Names after FROM and JOIN, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?i)(?:FROM|JOIN)\s+([a-zA-Z0-9_\.]+)"), 1))


def join_predicates(query: Column) -> Column:
    """Pairs of dotted names that are compared for equality, as often as they occur."""
    pattern = F.lit(r"([a-zA-Z0-9_]+\.[a-zA-Z0-9_\.]+)\s*=\s*([a-zA-Z0-9_]+\.[a-zA-Z0-9_\.]+)")
    return F.arrays_zip(F.regexp_extract_all(query, pattern, 1).alias("left"), F.regexp_extract_all(query, pattern, 2).alias("right"))
