"""Identity keys. Each is an equality of its own; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, missing, strip

# Fixed values.
MIN_TITLE_KEY = 25
CANDIDATE_TITLE_CHARS = 120
HASH_CHARS = 12


def title_key(title: Column | str) -> Column:
    """Lower case; everything but ASCII letters and digits to single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"[^a-z0-9]+", " "))


def title_usable(title: Column | str) -> Column:
    """Short titles are too generic to link records by."""
    return F.length(title_key(title)) >= MIN_TITLE_KEY


def echo_title_key(title: Column | str) -> Column:
    """Title key of an echoed title, without a leading [year] marker."""
    return title_key(F.regexp_replace(F.coalesce(col(title), F.lit("")),
                                      r"^\s*\[?\s*(19|20)\d{2}\s*\]?\s*", ""))


def doi_key(doi: Column | str, mode: str = "catalog") -> Column:
    """Normalised DOI; an absent DOI gives the empty string.

    catalog: trim and lower case. harvest: also drops resolver and `doi:`
    prefixes and closing punctuation. venue: drops only the https resolver.
    """
    raw = F.coalesce(col(doi), F.lit(""))
    if mode == "catalog":
        return F.lower(strip(raw))
    if mode == "harvest":
        bare = F.regexp_replace(strip(raw), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
        bare = F.regexp_replace(bare, r"(?i)^doi:\s*", "")
        return F.lower(F.regexp_replace(bare, r"""[ ).,;>"'\]]+$""", ""))
    if mode == "venue":
        return F.lower(strip(F.replace(raw, F.lit("https://doi.org/"), F.lit(""))))
    raise ValueError(f"unknown DOI key mode {mode!r}")


def paper_id(doi: Column | str, title: Column | str) -> Column:
    """`doi:` and the DOI, else `hash:` and a short hash of the title."""
    hashed = F.substring(F.md5(F.lower(strip(F.coalesce(col(title), F.lit(""))))), 1, HASH_CHARS)
    return F.when(~missing(doi), F.concat(F.lit("doi:"), doi_key(doi))).otherwise(
        F.concat(F.lit("hash:"), hashed))


def candidate_key(doi: Column | str, title: Column | str) -> Column:
    """Key of a cited work that may only be known by its title."""
    return F.when(~missing(doi), F.concat(F.lit("doi:"), doi_key(doi, "harvest"))).otherwise(
        F.concat(F.lit("title:"), F.substring(title_key(title), 1, CANDIDATE_TITLE_CHARS)))


def quote_key(quote: Column | str) -> Column:
    """Lower case; runs of non-word characters to one blank."""
    return F.trim(F.regexp_replace(F.lower(col(quote)), r"[^\p{L}\p{N}_]+", " "))
