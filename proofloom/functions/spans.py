"""Positions of pattern matches, and tokens of assembled texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, running

# The tokens of an assembled text.
QUOTE_TOKEN = r"\[\[Q\d+\]\]"
STUDY_TOKEN = r"\[\[S\d+\]\]"
ANY_TOKEN = r"\[\[[SQ]\d+\]\]"


def pattern_spans(text: Column | str, pattern: str) -> Column:
    """All matches as (start, end, found); offsets count characters from 0."""
    t = F.coalesce(col(text), F.lit(""))

    def place(pieces: Column) -> Column:
        def with_found(found: Column) -> Column:
            before = running(F.transform(found, lambda m, i: F.length(F.get(pieces, i))
                                         + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))))
            return F.transform(F.arrays_zip(before.alias("start"), found.alias("found")), lambda x: F.struct(
                x["start"].alias("start"), (x["start"] + F.length(x["found"])).alias("end"), x["found"].alias("found")))
        return let(F.regexp_extract_all(t, F.lit(f"({pattern})"), 1), with_found)

    return let(F.split(t, pattern, -1), place)


def tokens(text: Column | str) -> Column:
    """All tokens in text order, without the brackets."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\[\[([SQ]\d+)\]\]"), 1)


def dedupe_tokens(text: Column | str) -> Column:
    """Keep the first occurrence of each token and tidy the gaps."""
    t = col(text)

    def rebuild(found: Column) -> Column:
        pieces = F.split(t, ANY_TOKEN, -1)
        kept = F.transform(found, lambda x, i: F.when(
            F.array_position(found, x) == i + 1, F.concat(F.lit("[["), x, F.lit("]]"))).otherwise(F.lit("")))
        body = F.array_join(F.transform(F.arrays_zip(
            pieces.alias("p"), F.concat(kept, F.array(F.lit(""))).alias("k")), lambda x: F.concat(x["p"], x["k"])), "")
        return F.regexp_replace(F.regexp_replace(body, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")

    return let(tokens(t), rebuild)
