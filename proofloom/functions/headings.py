"""Section headings: which lines are headings and what part of a paper they open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, running, strip

# Limits of a heading line.
MAX_HEADING_CHARS = 90
MAX_HEADING_WORDS = 10
WHITE_SPACE = " \t\n\x0b\f\r"

# Section vocabulary.
EVIDENCE_PRIMARY = [
    "results", "result", "findings", "finding", "key findings", "principal findings",
    "main findings", "primary findings", "major findings", "study findings",
    "discussion", "discussions", "general discussion", "main discussion",
    "conclusion", "conclusions", "concluding remarks", "concluding remark",
    "interpretation", "interpretations", "outcome", "outcomes",
    "results and findings", "summary", "summary and conclusions",
    "summary and conclusion", "outlook and summary", "summary and outlook"]
EVIDENCE_SECONDARY = [
    "analysis", "analyses", "recommendations", "recommendation",
    "implications", "implication", "clinical implications", "future directions",
    "future work", "future research", "limitations", "limitation", "perspectives",
    "significance", "comments", "outlook"]
ABSTRACT = ["abstract", "structured abstract", "summary", "graphical abstract summary"]
METHODS = [
    "methods", "method", "materials and methods", "methods and materials",
    "method and materials", "material and methods", "methodology", "methodologies",
    "study design", "study designs", "experimental design", "experimental setup",
    "experimental procedures", "experimental section", "data collection",
    "participants", "subjects", "procedure", "procedures", "measures", "measurements",
    "materials", "statistical analysis", "statistical analyses", "statistical methods",
    "data analysis", "analytic strategy", "analysis strategy", "sample", "samples",
    "study population", "intervention", "interventions", "design", "setting",
    "research design", "data and methods", "patients and methods",
    "subjects and methods"]
EXCLUDE = [
    "introduction", "background", "background and significance", "significance",
    "related work", "related works", "related literature", "literature review",
    "review of literature", "review of the literature", "prior work", "previous work",
    "prior literature", "previous literature", "theoretical background",
    "theoretical framework", "rationale", "motivation", "overview", "preface"]
TERMINAL = [
    "references", "reference", "bibliography", "works cited", "literature cited",
    "acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments",
    "funding", "funding statement", "funding sources", "funding information",
    "conflict of interest", "conflicts of interest", "competing interests",
    "competing interest", "declaration of interest", "declarations of interest",
    "declaration of competing interest", "author contributions",
    "authors contributions", "author contribution", "contributorship",
    "data availability", "data availability statement", "code availability",
    "ethics statement", "ethical approval", "ethics approval",
    "ethical considerations", "ethics", "abbreviations", "appendix", "appendices",
    "supplementary material", "supplementary materials", "supplementary information",
    "supporting information", "disclosure", "disclosures", "highlights",
    "graphical abstract", "keywords", "key words", "notes", "footnotes",
    "consent", "informed consent", "credit authorship contribution statement"]
EVIDENCE_NOUNS = [
    "results", "result", "findings", "finding", "discussion", "discussions",
    "conclusion", "conclusions", "outcome", "outcomes", "interpretation",
    "interpretations", "observation", "observations"]
METHODS_NOUNS = [
    "methods", "method", "methodology", "methodologies", "materials", "material",
    "procedure", "procedures", "participants", "subjects", "measures", "measure",
    "measurement", "measurements", "intervention", "interventions", "apparatus",
    "protocol", "protocols", "analysis", "analyses"]
EXCLUDE_NOUNS = [
    "introduction", "background", "motivation", "rationale", "overview", "preface",
    "prologue", "foreword"]
QUALIFIERS = [
    "main", "primary", "key", "principal", "major", "study", "overall", "general",
    "empirical", "experimental", "present", "current", "final", "detailed", "brief",
    "summary", "further", "additional", "new", "initial", "preliminary", "core",
    "central", "important", "selected", "statistical", "quantitative", "qualitative",
    "data"]
STOP_WORDS = [
    "and", "or", "the", "of", "in", "for", "to", "a", "an", "with", "on", "vs", "versus",
    "our", "from", "section", "part", "chapter"]
STRONG = [
    "abstract", "introduction", "background", "methods", "method", "methodology",
    "materials and methods", "results", "result", "findings", "discussion",
    "discussions", "conclusion", "conclusions", "references", "bibliography",
    "acknowledgements", "acknowledgments"]
REFERENCE_HEADINGS = ["references", "reference", "bibliography", "works cited", "literature cited"]

# Patterns of captions, prefixes and connectives.
CAPTION = (r"(?i)^(?:figure|fig|table|tab|scheme|equation|eq|algorithm|chart|plate|box|exhibit|"
           r"appendix\s+figure|appendix\s+table)\s*\.?\s*\d")
MARKDOWN = r"^#{1,6}\s*"
LABEL = r"(?i)^(?:section|chapter|part)\b[\s:.\-]*"
NUMBER = r"(?i)^(?:\d+(?:\.\d+)*[.):]?|[ivxlcdm]+[.):]?|[a-z][.):])(?:\s+|$)"
ANY_NUMBER = r"(?i)^(?:\d+(?:\.\d+)*|[ivxlcdm]+|[a-z])[.):]?(?:\s|$)"
CONNECTIVE = r"(?i)\s*&\s*|\s*/\s*|\s*,\s*|\s*;\s*|\s+and\s+|\s*\+\s*"


def heading_core(line: Column | str) -> Column:
    """Heading without markup, numbering and labels, in lower case."""
    c = strip(F.regexp_replace(strip(line), r"^[*_`]+|[*_`]+$", ""))
    for prefix in (MARKDOWN, r"^\|\s*", LABEL, NUMBER, NUMBER, r"^\|\s*"):
        c = F.regexp_replace(c, prefix, "")
    c = F.lower(strip(F.regexp_replace(strip(c), r"^[:.#*\-]+|[:.#*\-]+$", "")))
    c = F.regexp_replace(c, r"\s+", " ")
    c = F.regexp_replace(c, r"\s+sections?$", "")
    return F.regexp_replace(c, r"^(?:the|our)\s+", "")


def _tokens(core: Column) -> Column:
    return F.filter(F.transform(F.split(core, CONNECTIVE), strip), lambda t: t != "")


def _noun_category(core: Column) -> Column:
    """Decisive nouns among nothing but qualifiers and stop words."""
    known = sorted({*EVIDENCE_NOUNS, *METHODS_NOUNS, *EXCLUDE_NOUNS, *QUALIFIERS, *STOP_WORDS})

    def decide(words: Column) -> Column:
        pure = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(known))
        return (F.when(~pure, None)
                .when(F.exists(words, lambda w: w.isin(EXCLUDE_NOUNS)), F.lit("EXCLUDE"))
                .when(F.exists(words, lambda w: w.isin(EVIDENCE_NOUNS)), F.lit("EVIDENCE"))
                .when(F.exists(words, lambda w: w.isin(METHODS_NOUNS)), F.lit("METHODS")))

    return let(F.regexp_extract_all(core, F.lit("([a-z]+)"), 1), decide)


def _phrase_category(core: Column) -> Column:
    def decide(toks: Column) -> Column:
        def hits(vocabulary):
            return core.isin(vocabulary) | F.exists(toks, lambda t: t.isin(vocabulary))
        evidence = (F.forall(toks, lambda t: t.isin(EVIDENCE_PRIMARY + EVIDENCE_SECONDARY))
                    & F.exists(toks, lambda t: t.isin(EVIDENCE_PRIMARY)))
        return (F.when(F.size(toks) == 0, None)
                .when(F.startswith(core, F.lit("appendix")) | F.get(toks, F.lit(0)).isin("appendix", "appendices"),
                      F.lit("REFS"))
                .when(hits(TERMINAL), F.lit("REFS"))
                .when(hits(EXCLUDE), F.lit("EXCLUDE"))
                .when(hits(METHODS), F.lit("METHODS"))
                .when(core.isin(ABSTRACT), F.lit("ABSTRACT"))
                .when(evidence, F.lit("EVIDENCE")))

    return let(_tokens(core), decide)


def _shaped(line: Column) -> Column:
    """Looks like a heading: capital first letter, numbering, markup or a colon."""
    return (line.rlike(r"^[^\p{L}]*\p{Lu}") | line.rlike(MARKDOWN) | line.rlike(LABEL)
            | line.rlike(ANY_NUMBER) | F.endswith(line, F.lit(":")))


def classify_heading(line: Column | str) -> Column:
    """EVIDENCE, ABSTRACT, METHODS, EXCLUDE, REFS, or null for other lines."""
    raw = col(line)
    # White space is cut natively first: most lines are prose, far too long for a heading, and a pattern
    # would try every place in them. A pattern's line end also stands before these three marks.
    short = (F.length(F.btrim(raw, F.lit(WHITE_SPACE))) <= MAX_HEADING_CHARS) | raw.substr(-1, 1).isin("\u0085", "\u2028", "\u2029")

    def classify(s: Column) -> Column:
        possible = (F.length(s).between(1, MAX_HEADING_CHARS)
                    & (F.size(F.split(s, r"\s+")) <= MAX_HEADING_WORDS)
                    & ~s.rlike(CAPTION))

        def by_core(core: Column) -> Column:
            nouns = _noun_category(core)
            allowed = _shaped(s) | core.isin(STRONG) | (F.coalesce(nouns, F.lit("")) == "EVIDENCE")
            return F.when((core != "") & allowed, F.coalesce(_phrase_category(core), nouns))

        return F.when(possible, let(heading_core(s), by_core))

    return F.when(short, let(strip(raw), classify))


def sections(text: Column | str) -> Column:
    """Headings of a text with half-open regions, as an array in text order.

    Each entry is (start, end, category, heading); offsets count characters
    from 0 and a region runs from its heading to the next one. The whole map is
    built inside the row of the text, so nothing is shuffled.
    """
    t = F.coalesce(col(text), F.lit(""))

    def from_lines(lines: Column) -> Column:
        tagged = F.filter(
            F.transform(lines, lambda l, i: F.struct(
                i.alias("i"), l.alias("line"),
                classify_heading(l).alias("category"))),
            lambda x: x["category"].isNotNull())

        def from_headings(found: Column) -> Column:
            # Each heading adds the lines since the one before, so all lines are measured once.
            gaps = F.transform(found, lambda x, k: let(
                F.coalesce(F.get(found, k - 1)["i"], F.lit(0)),
                lambda a: F.aggregate(F.slice(lines, a + 1, x["i"] - a), F.lit(0), lambda n, l: n + F.length(l) + 1)))
            return let(gaps, lambda g: F.transform(F.arrays_zip(found.alias("x"), running(g).alias("start")), lambda z: F.struct(
                z["start"].alias("start"), z["x"]["category"].alias("category"), strip(z["x"]["line"]).alias("heading"))))

        # Bound once, or every heading would classify all lines again.
        return let(let(tagged, from_headings), lambda heads: F.transform(heads, lambda h, i: F.struct(
            h["start"].alias("start"),
            F.coalesce(F.get(heads, i + 1)["start"], F.length(t)).alias("end"),
            h["category"].alias("category"), h["heading"].alias("heading"))))

    return let(F.split(t, "\n"), from_lines)


def section_at(section_map: Column | str, position: Column | str) -> Column:
    """The heading at or before a position; UNKNOWN in front of the first one. The ordered map is halved until one place is left."""
    m, place = col(section_map), col(position)
    size = F.coalesce(F.size(m), F.lit(0))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        before = F.coalesce(F.get(m, middle)["start"] <= place, F.lit(False))
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(
            F.when(before, middle + 1).otherwise(s["low"]).alias("low"), F.when(before, s["high"]).otherwise(middle).alias("high")))

    later = F.aggregate(steps, F.struct(F.lit(0).alias("low"), size.alias("high")), half)["low"]
    return F.coalesce(let(later, lambda k: F.when(k > 0, F.get(m, k - 1))), F.struct(
        F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"),
        F.lit("UNKNOWN").alias("category"), F.lit("").alias("heading")))


def references_block(text: Column | str, section_map: Column | str) -> Column:
    """Text below the first reference heading, up to the next real section."""
    t, m = col(text), col(section_map)

    def is_reference(h: Column) -> Column:
        def core_ok(core: Column) -> Column:
            return (core.isin(REFERENCE_HEADINGS)
                    | F.exists(_tokens(core), lambda x: x.isin(REFERENCE_HEADINGS))
                    | F.startswith(core, F.lit("reference")) | F.startswith(core, F.lit("bibliograph")))
        return (h["category"] == "REFS") & let(heading_core(h["heading"]), core_ok)

    def cut(head: Column) -> Column:
        after = F.substring(t, head["start"] + 1, F.length(t))
        newline = F.instr(after, "\n")
        begin = head["start"] + F.when(newline > 0, newline).otherwise(F.lit(0))
        later = F.filter(m, lambda s: (s["start"] > head["start"]) & (s["category"] != "REFS"))
        stop = F.coalesce(F.get(later, F.lit(0))["start"], F.length(t))
        return strip(F.substring(t, begin + 1, F.greatest(stop - begin, F.lit(0))))

    return F.coalesce(let(F.get(F.filter(m, is_reference), F.lit(0)), lambda h: F.when(h.isNotNull(), cut(h))),
                      F.lit(""))
