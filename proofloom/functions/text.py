"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters kept in a token, and the shortest token kept.
NON_TOKEN = r"[^\p{L}\p{N}_\s]"
MIN_TOKEN = 3
# Quotation marks that are unified before comparing texts.
CURLY_DOUBLE = "“”"
CURLY_SINGLE = "‘’"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind a computed value once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column) -> Column:
    """Inclusive running sums of an array of integers, in as many passes as its size has bits."""
    def passes(a: Column) -> Column:
        steps = F.sequence(F.lit(0), F.length(F.bin(F.size(a))))
        return F.aggregate(steps, a, lambda s, k: F.transform(
            s, lambda v, i: v + F.coalesce(F.get(s, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))

    return let(numbers, passes)


def strip(c: Column | str) -> Column:
    """Drop white space at both ends, line ends included."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def blank(c: Column | str) -> Column:
    """Missing, or nothing but white space."""
    return F.coalesce(strip(c), F.lit("")) == ""


def missing(c: Column | str) -> Column:
    """Null or the empty string; both count as an absent value."""
    return F.coalesce(col(c), F.lit("")) == ""


def normalize_text(c: Column | str) -> Column:
    """White-space runs to one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def unify_quotes(c: Column | str) -> Column:
    """Same as `normalize_text`, but keeps case and straightens quotation marks."""
    straight = F.translate(col(c), CURLY_DOUBLE + CURLY_SINGLE, "\"\"''")
    return F.trim(F.regexp_replace(straight, r"\s+", " "))


def words(c: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def tokenize(c: Column | str) -> Column:
    """Search tokens: lower case, word characters only, longer than two."""
    parts = F.split(F.regexp_replace(F.lower(col(c)), NON_TOKEN, " "), r"\s+")
    return F.filter(parts, lambda t: F.length(t) >= MIN_TOKEN)


def strip_tags(c: Column | str) -> Column:
    """Remove markup tags from an abstract and trim it."""
    return strip(F.regexp_replace(col(c), r"<[^>]+>", ""))


def html_to_text_simple(c: Column | str) -> Column:
    """Tags to blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"<[^>]+>", " "), r"\s+", " "))


def numbers_in(c: Column | str) -> Column:
    """Numbers that carry meaning: 12, 0.001, 1,234."""
    return F.regexp_extract_all(col(c), F.lit(r"(\d+(?:[.,]\d+)*)"), 1)


def numbers_subset(quote: Column | str, found: Column | str) -> Column:
    return F.size(F.array_except(numbers_in(quote), numbers_in(found))) == 0


def key_phrases(c: Column | str) -> Column:
    """First five, last five and, for long texts, the middle five words."""
    def pick(w: Column) -> Column:
        n = F.size(w)
        mid = F.floor(n / 2).cast("int")
        ends = F.array(F.array_join(F.slice(w, 1, 5), " "),
                       F.array_join(F.slice(w, F.greatest(n - 4, F.lit(1)), F.lit(5)), " "))
        middle = F.array(F.array_join(F.slice(w, F.greatest(mid - 1, F.lit(1)), F.lit(5)), " "))
        return (F.when(n >= 12, F.concat(ends, middle)).when(n >= 6, ends)
                .otherwise(F.array().cast("array<string>")))
    return let(words(c), pick)


def text_budget(c: Column | str, max_chars: int, marker: str) -> Column:
    """Head and tail of a long text with a marker for the part left out."""
    t = col(c)
    head = int(max_chars * 0.6)
    tail = max_chars - head
    return F.when(F.length(t) <= max_chars, t).otherwise(
        F.concat(F.substring(t, 1, head), F.lit(marker), F.right(t, F.lit(tail))))


def preview(c: Column | str, n: int) -> Column:
    """First n characters, with dots when something is cut."""
    t = col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def abstract_from_index(index: Column | str) -> Column:
    """Rebuild a text from a word -> positions map."""
    pairs = F.flatten(F.transform(F.map_entries(col(index)), lambda e: F.transform(
        e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(col(index)) > 0,
                  F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " "))
