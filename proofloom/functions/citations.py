"""DOIs, reference lists and signs of second-hand reporting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import doi_key
from .text import col, strip

# The form of a DOI, and the marker that opens a list entry.
DOI_PATTERN = r"""(?i)(10\.\d{4,9}/[^\s,;\]\)>"']+)"""
ENTRY_MARKER = r"(?m)^\s*(?:\[\d+\]|\(\d+\)|\d+[\.\)])\s+"
MIN_ENTRY_CHARS = 15

# Signs that a sentence reports the work of others.
_NAME = r"[A-Z][A-Za-zÀ-ſ\-]+"
_YEAR = r"(?:18|19|20)\d{2}[a-z]?"
SECONDHAND = [
    ("numeric_citation", r"\[\s*\d+(?:\s*[,\-–]\s*\d+)*\s*\]"),
    ("narrative_citation",
     rf"\b{_NAME}\s+(?:et\s+al\.?|and\s+{_NAME}|&\s+{_NAME})[\s,]*\(?\s*{_YEAR}"),
    ("single_paren_citation", rf"\b{_NAME}\s*\(\s*{_YEAR}\s*\)"),
    ("paren_author_year", rf"\([^)]*?(?:{_NAME}|\bet\s+al\.?)[^)]*?{_YEAR}[^)]*?\)"),
    ("et_al", r"(?i)\bet\s+al\.?"),
    ("attribution_phrase", r"(?i)" + "|".join([
        r"\b(?:previous|prior|earlier|existing|past|other|recent)\s+"
        r"(?:study|studies|work|works|research|reports?|literature|findings?|"
        r"evidence|trials?|reviews?|investigations?|authors?)\b",
        r"\bother\s+(?:researchers?|investigators?|groups?)\b",
        r"\baccording\s+to\b",
        r"\bas\s+(?:reported|shown|demonstrated|noted|described|reviewed|suggested)\s+"
        r"(?:by|in|elsewhere|previously)\b",
        r"\bhas\s+been\s+(?:reported|shown|demonstrated|suggested|documented|established)\b",
        r"\bhave\s+been\s+(?:reported|shown|demonstrated|suggested|documented)\b",
        r"\b(?:it\s+is|it\s+has\s+been)\s+(?:well[\s\-])?"
        r"(?:established|known|documented|recognised|recognized)\b",
        r"\bin\s+the\s+literature\b",
    ])),
]


def secondhand_markers(text: Column | str) -> Column:
    """`label:first match` for each sign found, in a fixed order."""
    t = col(text)
    found = [F.when(t.rlike(p), F.concat(F.lit(f"{label}:"), F.trim(F.regexp_extract(t, p, 0))))
             for label, p in SECONDHAND]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def extract_dois(text: Column | str) -> Column:
    """All DOIs of a text, cleaned, in order of first appearance."""
    raw = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(DOI_PATTERN), 1)
    return F.array_distinct(F.filter(
        F.transform(raw, lambda d: doi_key(d, "harvest")), lambda d: d != ""))


def split_references(block: Column | str, limit: int | None = None) -> Column:
    """Entries of a reference list: by markers, else blank lines, else lines; the first `limit` (None: all)."""
    b = strip(F.coalesce(col(block), F.lit("")))
    parts = (F.when(b.rlike(ENTRY_MARKER), F.split(b, ENTRY_MARKER))
             .when(F.contains(b, F.lit("\n\n")), F.split(b, "\n\n"))
             .otherwise(F.split(b, "\n")))
    flat = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    kept = F.filter(flat, lambda p: F.length(p) >= MIN_ENTRY_CHARS)
    if limit is not None:
        kept = F.slice(kept, 1, limit)
    return F.transform(kept, lambda p: F.struct(
        p.alias("raw"),
        F.coalesce(F.get(extract_dois(p), F.lit(0)), F.lit("")).alias("doi")))
