"""Author names, in-text citations and reference entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, missing, strip

# Particles that stay with the surname.
NAME_PARTICLES = [
    "de", "del", "della", "der", "den", "da", "di", "do", "dos",
    "du", "la", "le", "van", "von", "ter", "ten", "bin", "al",
    "st", "st.", "mac", "mc"]


def _letters(token: Column) -> Column:
    return F.regexp_replace(token, "[^A-Za-z]", "")


def _is_initials(token: Column) -> Column:
    bare = _letters(token)
    return F.length(bare).between(1, 3) & (bare == F.upper(bare))


def _chars(text: Column) -> Column:
    return F.filter(F.split(F.upper(text), ""), lambda c: c != "")


def _initials(tokens: Column) -> Column:
    """A block of initials gives each letter, a full name its first letter."""
    return F.flatten(F.transform(tokens, lambda t: F.when(
        _is_initials(t), _chars(_letters(t))).otherwise(
            _chars(F.substring(_letters(t), 1, 1)))))


def _name(surname: Column, initials: Column) -> Column:
    return F.struct(surname.alias("surname"), initials.alias("initials"))


def split_author(author: Column | str) -> Column:
    """Surname and initials of a name in any of the common orders.

    `Surname, F. M.`; `Surname FM` (closing block of initials); `Given Surname`
    with lower-case particles kept in front of the surname.
    """
    none = F.array().cast("array<string>")

    def from_parts(parts: Column) -> Column:
        n = F.size(parts)
        # Distance from the end to the last token that is not a block of initials.
        tail = F.array_position(F.reverse(F.transform(parts, _is_initials)), F.lit(False)).cast("int")
        surname_first = _name(F.array_join(F.slice(parts, F.lit(1), n - tail + 1), " "),
                              _initials(F.slice(parts, n - tail + 2, F.greatest(tail - 1, F.lit(0)))))
        # Distance from the last given name to the end of the given names.
        given = F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))
        particle = F.transform(given, lambda t: F.regexp_replace(
            F.lower(t), r"^\.+|\.+$", "").isin(NAME_PARTICLES))
        back = F.array_position(F.reverse(particle), F.lit(False)).cast("int")
        start = F.when(back == 0, F.lit(0)).otherwise(n - back)
        given_first = _name(F.array_join(F.slice(parts, start + 1, n - start), " "),
                            _initials(F.slice(parts, F.lit(1), start)))
        return (F.when(n == 1, _name(F.get(parts, F.lit(0)), none))
                .when(tail > 1, surname_first).otherwise(given_first))

    def split_name(a: Column) -> Column:
        comma = F.instr(a, ",")
        inverted = _name(strip(F.substring(a, F.lit(1), comma - 1)),
                         _chars(_letters(F.substring(a, comma + 1, F.length(a)))))
        return (F.when(a == "", _name(F.lit(""), none)).when(comma > 0, inverted)
                .otherwise(let(F.split(a, r"\s+"), from_parts)))

    return let(strip(F.coalesce(col(author), F.lit(""))), split_name)


def surname(author: Column | str) -> Column:
    a = col(author)
    return let(split_author(a)["surname"],
               lambda s: F.when(s != "", s).otherwise(strip(F.coalesce(a, F.lit("")))))


def surnames(authors: Column | str) -> Column:
    named = F.filter(F.coalesce(col(authors), F.array().cast("array<string>")), lambda a: ~missing(a))
    return F.transform(named, surname)


def _year(year: Column | str) -> Column:
    y = col(year).cast("string")
    return F.when(missing(y) | (y == "0"), F.lit("n.d.")).otherwise(y)


def apa_in_text(authors: Column | str, year: Column | str) -> Column:
    """(A, year), (A & B, year), (A et al., year), (Anonymous, n.d.)."""
    y = _year(year)

    def cite(names: Column) -> Column:
        first = F.get(names, F.lit(0))
        who = (F.when(F.size(names) == 0, F.lit("Anonymous"))
               .when(F.size(names) == 1, first)
               .when(F.size(names) == 2, F.concat(first, F.lit(" & "), F.get(names, F.lit(1))))
               .otherwise(F.concat(first, F.lit(" et al."))))
        return F.concat(F.lit("("), who, F.lit(", "), y, F.lit(")"))

    return let(surnames(authors), cite)


def last_first(author: Column | str) -> Column:
    """One author as `Surname, F. M.`; names that hold a comma stay as they are."""
    a = strip(F.coalesce(col(author), F.lit("")))

    def render(n: Column) -> Column:
        dotted = F.array_join(F.transform(n["initials"], lambda i: F.concat(i, F.lit("."))), " ")
        return (F.when(n["surname"] == "", a)
                .when(F.size(n["initials"]) == 0, n["surname"])
                .otherwise(F.concat(n["surname"], F.lit(", "), dotted)))

    return F.when(F.contains(a, F.lit(",")), a).otherwise(let(split_author(a), render))


def apa_reference(authors, year, title, venue, doi) -> Column:
    """Reference-list entry from the fields at hand."""
    listed = F.filter(F.transform(
        F.coalesce(col(authors), F.array().cast("array<string>")), last_first), lambda x: x != "")

    def block(names: Column) -> Column:
        n = F.size(names)
        last = F.element_at(names, -1)
        who = (F.when(n == 0, F.lit("Anonymous")).when(n == 1, F.get(names, F.lit(0)))
               .when(n <= 20, F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
                                       F.lit(", & "), last))
               .otherwise(F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", ... "), last)))
        return F.when(F.endswith(who, F.lit(".")), who).otherwise(F.concat(who, F.lit(".")))

    t = F.when(missing(title), F.lit("Untitled")).otherwise(col(title))
    d = strip(F.coalesce(col(doi), F.lit("")))
    return F.concat(
        let(listed, block), F.lit(" ("), _year(year), F.lit("). "), t, F.lit("."),
        F.when(missing(venue), F.lit("")).otherwise(F.concat(F.lit(" "), col(venue), F.lit("."))),
        F.when(missing(doi), F.lit(""))
        .when(F.startswith(F.lower(d), F.lit("http")), F.concat(F.lit(" "), d))
        .otherwise(F.concat(F.lit(" https://doi.org/"), d)))


def reference_sort_key(authors: Column | str, year: Column | str) -> Column:
    """Lower-case first surname and year; absent values sort last."""
    who = F.when(F.size(F.coalesce(col(authors), F.array().cast("array<string>"))) > 0,
                 F.lower(surname(F.get(col(authors), F.lit(0))))).otherwise(F.lit("zzzz"))
    return F.concat(who, F.lit("|"), F.coalesce(col(year).cast("string"), F.lit("9999")))


def narrative_cite(citation: Column | str) -> Column:
    """(X, 2022) to X (2022); anything else stays as it is."""
    c = col(citation)
    bare = strip(c)
    pattern = r"^\((.*),\s*(\d{4}[a-z]?)\)$"
    return F.when(bare.rlike(pattern), F.regexp_replace(bare, pattern, "$1 ($2)")).otherwise(c)


def parse_citation(citation: Column | str) -> Column:
    """Names and year of a parenthetical citation."""
    inner = F.regexp_replace(strip(citation), r"^[()]+|[()]+$", "")
    year_pattern = r"\b(1[7-9]\d{2}|20\d{2}|21\d{2})\b"

    def parse(text: Column) -> Column:
        year = F.nullif(F.regexp_extract(text, year_pattern, 1), F.lit(""))
        head = F.when(year.isNull(), text).otherwise(F.regexp_replace(
            F.substring(text, F.lit(1), F.instr(text, year) - 1), r"[, ]+$", ""))
        head = strip(head)
        parts = (F.when(F.contains(F.lower(head), F.lit(" et al")),
                        F.slice(F.split(head, r"(?i)\s+et\s+al"), 1, 1))
                 .when(F.contains(head, F.lit("&")), F.split(head, "&"))
                 .otherwise(F.split(head, r"(?i)\band\b")))
        names = F.filter(F.transform(parts, strip), lambda n: n != "")
        return F.struct(names.alias("names"), year.alias("year"))

    return let(inner, parse)
