"""Attribution checks over an assembled review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.authors import parse_citation, surname
from ..functions.spans import pattern_spans
from ..functions.text import let, normalize_text, strip, unify_quotes, words
from ..session import cut_lineage
from . import passages as P
from . import quotes as Q
from .prefix import first_n_per_key
from .registry import cited_in_body, token_lookup

# Display text that must not appear in prose.
SCAFFOLDS = [
    ("summary line", r"(?i)expands to\s*:"),
    ("citation line", r"(?i)CITE AS\s*:"),
    ("quote line", r"(?i)\(\s*\d+\s+words?\s*\)\s*[—-]"),
    ("context line", r"(?i)\(context\s*:"),
    ("quotes header", r"(?i)VERIFIED QUOTES?\s*[—-]")]
MAX_CITED_ISSUES = 8
MIN_INLINE, TAIL_CHARS, MIN_BLOCK_WORDS, MIN_BLOCK_CHARS = 20, 200, 40, 40
CITATION = r"\(([^()]+?\d{4}[^()]*)\)"
_HAS_YEAR = r"\([^()]*\b(?:1[7-9]\d{2}|20\d{2}|21\d{2})\b[^()]*\)"


def scaffold_leaks(reviews: DataFrame) -> DataFrame:
    """Every piece of display text in a review, with its place."""
    def labelled(label: str, pattern: str) -> Column:
        return F.transform(pattern_spans("text", pattern), lambda s: F.struct(
            F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end")))

    parts = [labelled(*scaffold) for scaffold in SCAFFOLDS]
    # The outer form keeps the optimizer from testing for matches first, which would search twice.
    return reviews.select("review_id", F.explode_outer(F.concat(*parts)).alias("s")).where("s is not null").select("review_id", "s.*")


def intro_order_guard(lookup: DataFrame) -> DataFrame:
    """Quoted studies whose introduction is missing or comes after a quotation."""
    number = F.substring("token", 2, 20).cast("bigint")
    intros = lookup.where(F.startswith("token", F.lit("S"))).groupBy("review_id", number.alias("study_index")).agg(
        F.min("start").alias("intro"))
    quotes = lookup.where("valid and not is_summary").groupBy("review_id", "study_index").agg(F.min("start").alias("quoted"))
    both = quotes.join(intros, ["review_id", "study_index"], "left")
    return both.withColumn("type", F.when(F.col("intro").isNull(), F.lit("missing_study_intro")).when(
        F.col("intro") > F.col("quoted"), F.lit("study_intro_after_quote"))).where("type is not null")


def cap_issue_type(issues: DataFrame, n: int = MAX_CITED_ISSUES) -> DataFrame:
    """The first n issues of each type and review."""
    return first_n_per_key(issues, ["review_id", "type"], n, F.col("study_index"))


def quoted_spans(reviews: DataFrame, question: str = "") -> DataFrame:
    """Hand-typed quotations with the citation that follows, if any.

    Inline: twenty or more characters in straight marks. Block: an indented
    paragraph of forty or more words that ends in a citation.
    """
    asked = question.strip().rstrip("?. ").lower()

    def excluded(q: Column) -> Column:
        if not asked:
            return F.lit(False)
        bare = F.lower(F.regexp_replace(q, r"[?. ]+$", ""))
        return F.contains(F.lit(asked), bare) | F.contains(bare, F.lit(asked))

    def inline(flat: Column) -> Column:
        found = F.transform(pattern_spans(flat, f'"[^"]{{{MIN_INLINE},}}"'), lambda s: F.struct(
            strip(F.substring(s["found"], F.lit(2), F.length(s["found"]) - 2)).alias("quote"),
            F.regexp_extract(F.substring(flat, s["end"] + 1, F.lit(TAIL_CHARS)), CITATION, 0).alias("citation_text"),
            F.lit("inline").alias("kind")))
        return F.filter(found, lambda x: ~x["quote"].rlike(_HAS_YEAR) & ~excluded(x["quote"]))

    def block(para: Column) -> Column:
        flat = unify_quotes(para)
        cite = F.regexp_extract(flat, CITATION + r"\s*\.?\s*$", 0)
        body = F.regexp_replace(strip(F.substring(flat, F.lit(1), F.length(flat) - F.length(cite))), r"\.+$", "")
        indented = para.rlike(r"^[ \t]{2,}") & (F.size(words(flat)) >= MIN_BLOCK_WORDS) & (cite != "")
        return F.when(indented & (F.length(body) >= MIN_BLOCK_CHARS) & ~excluded(body), F.struct(
            body.alias("quote"), cite.alias("citation_text"), F.lit("block").alias("kind")))

    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n"), block), lambda x: x.isNotNull())
    return reviews.select("review_id", F.posexplode(F.concat(
        let(unify_quotes("text"), inline), blocks)).alias("n", "q")).select("review_id", "n", "q.*")


def citation_to_study(cited: DataFrame, studies: DataFrame) -> DataFrame:
    """Studies a citation may mean: first surname, and the year if both have one."""
    c = cited.withColumn("_p", parse_citation("citation_text")).withColumn(
        "_name", F.lower(surname(F.get("_p.names", F.lit(0))))).withColumn("_year", F.col("_p.year")).where("_name is not null")
    s = studies.select("review_id", "study_index", "doc_id", "paper_title",
                       F.lower(surname(F.get("paper_authors", F.lit(0)))).alias("_name"),
                       F.col("paper_year").cast("string").alias("_paper_year")).where("_name <> ''")
    joined = c.join(s, ["review_id", "_name"]).where(
        F.col("_year").isNull() | F.col("_paper_year").isNull() | (F.col("_year") == F.col("_paper_year")))
    return joined.select(*cited.columns, "study_index", "doc_id", "paper_title")


def _holds(pairs: DataFrame, texts: DataFrame, confidence: float = Q.AUDIT_CONFIDENCE) -> DataFrame:
    """(quotation, document) pairs whose text holds the quotation.

    Whole texts are searched for verbatim matches first. Of the other pairs,
    those whose text satisfies what a match implies are cut into chunks and
    reach the approximate strategies.
    """
    key = ["review_id", "n", "doc_id"]

    @F.pandas_udf("boolean")
    def possible(quotes: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([bool(q and t and fuzzy.possible_holders([q], t, confidence)) for q, t in zip(quotes, found)])

    # A text moves to its quotations once, for both tests.
    whole = pairs.select(*key, "quote").join(texts.select("doc_id", "text"), "doc_id").withColumn(
        "sure", Q.verbatim_match(F.col("quote"), F.col("text")).isNotNull())
    tested = whole.withColumn("maybe", possible.asNondeterministic()(F.when(~F.col("sure"), F.col("quote")), "text"))
    tested = cut_lineage(tested.where("sure or maybe").select(*key, "quote", "sure"), "possible-holders")
    sure = tested.where("sure").select(*key).distinct()
    rest = tested.where("not sure").select(*key, "quote").join(sure, key, "left_anti")
    chunks = P.chunk_offsets(texts.join(rest.select("doc_id").distinct(), "doc_id", "left_semi"))
    tried = Q.match_cascade(rest.join(chunks.select("doc_id", "chunk"), "doc_id"))
    return sure.unionByName(tried.where(F.col("confidence") >= confidence).select(*key)).distinct()


#: Quotations that are tried on a text together.
BLOCK = 64


def _met(open_quotes: DataFrame, studies: DataFrame, texts: DataFrame) -> DataFrame:
    """(review_id, doc_id, q, text): the texts of a review beside each block of its quotations.

    The open quotations of a review are dealt into blocks, and a text meets each
    block of its review once. A review of very many studies or quotations is
    many rows, which a skewed join spreads.
    """
    sizes = open_quotes.groupBy("review_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    asked = (open_quotes.join(sizes, "review_id").withColumn("block", F.pmod(F.xxhash64("n", "quote"), F.col("blocks")))
             .groupBy("review_id", "block").agg(F.collect_list(F.struct(F.col("n").cast("bigint").alias("n"), "quote")).alias("q")))
    return studies.select("review_id", "doc_id").distinct().join(asked, "review_id").join(texts.select("doc_id", "text"), "doc_id")


def source_candidates(open_quotes: DataFrame, studies: DataFrame, texts: DataFrame, least: float = Q.AUDIT_CONFIDENCE) -> DataFrame:
    """(review_id, n, doc_id): studies of the same review whose text may hold a quotation with a confidence of `least`.

    A quotation stays beside a text if the whole text satisfies what a match of
    some strategy implies, so no holder is left out.
    """
    @F.pandas_udf("array<bigint>")
    def holders(numbers: pd.Series, quotes: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[int(n[i]) for i in fuzzy.possible_holders(list(q), t, least)] if t else []
                          for n, q, t in zip(numbers, quotes, found)])

    return (_met(open_quotes, studies, texts)
            .select("review_id", "doc_id", F.explode(holders("q.n", "q.quote", "text")).alias("n"))
            .select("review_id", F.col("n").cast(open_quotes.schema["n"].dataType).alias("n"), "doc_id").distinct())


def verbatim_sources(quotes: DataFrame, studies: DataFrame, texts: DataFrame) -> DataFrame:
    """(review_id, n, study_index): studies of the review that hold a quotation but for case and white space."""
    held = F.filter("q", lambda x: F.contains(F.col("flat"), normalize_text(x["quote"])) & (normalize_text(x["quote"]) != ""))
    met = _met(quotes.select("review_id", "n", "quote"), studies, texts).withColumn("flat", normalize_text("text"))
    found = met.select("review_id", "doc_id", F.explode_outer(F.transform(held, lambda x: x["n"])).alias("n")).where("n is not null")
    return found.withColumn("n", F.col("n").cast(quotes.schema["n"].dataType)).join(
        studies.select("review_id", "doc_id", "study_index"), ["review_id", "doc_id"]).select(
            "review_id", "n", "study_index").distinct()


def quote_sources(quotes: DataFrame, studies: DataFrame, texts: DataFrame) -> DataFrame:
    """Verdict on each hand-typed quotation.

    missing_citation, unknown_citation, attributed, misattributed_quote (with
    the first other study of the review that holds it) or fabricated_quote. All
    studies that fit a citation are tried.
    """
    # The steps below branch several times; each table is written once.
    quotes = cut_lineage(quotes, "typed-quotes")
    bare = quotes.where("citation_text = ''").withColumn("verdict", F.lit("missing_citation"))
    cited = quotes.where("citation_text <> ''")
    matches = cut_lineage(citation_to_study(cited, studies), "cited-studies")
    known = matches.select("review_id", "n").distinct()
    held = _holds(matches.select("review_id", "n", "quote", "doc_id"), texts).select("review_id", "n").distinct()
    flagged = cited.join(known.withColumn("_known", F.lit(True)), ["review_id", "n"], "left").join(
        held.withColumn("_held", F.lit(True)), ["review_id", "n"], "left")
    # Quotations that no cited study holds are looked for in the others.
    flagged = cut_lineage(flagged, "held-quotes")
    open_quotes = flagged.where("_known and _held is null").select("review_id", "n", "quote")
    others = cut_lineage(source_candidates(open_quotes, studies, texts).join(
        matches.select("review_id", "n", "doc_id"), ["review_id", "n", "doc_id"], "left_anti"), "candidate-sources")
    found = _holds(others.join(open_quotes, ["review_id", "n"]), texts).join(
        studies.select("review_id", "doc_id", "study_index"), ["review_id", "doc_id"]).groupBy("review_id", "n").agg(
            F.min("study_index").alias("true_study"))
    judged = flagged.join(found, ["review_id", "n"], "left").withColumn(
        "verdict", F.when(F.col("_known").isNull(), F.lit("unknown_citation")).when(F.col("_held"), F.lit("attributed"))
        .when(F.col("true_study").isNotNull(), F.lit("misattributed_quote")).otherwise(F.lit("fabricated_quote")))
    return judged.drop("_known", "_held").unionByName(bare.withColumn("true_study", F.lit(None).cast("bigint")))


def cited_not_quoted(reviews: DataFrame, studies: DataFrame, lookup: DataFrame) -> DataFrame:
    used = lookup.where("valid").select("review_id", "paper_id").distinct()
    idle = studies.join(used, ["review_id", "paper_id"], "left_anti")
    return cited_in_body(idle, reviews).select("review_id", "study_index").withColumn("type", F.lit("cited_but_not_quoted"))


def token_issues(reviews: DataFrame, lookup: DataFrame) -> DataFrame:
    """Placeholders without an entry, display text in prose, introductions that are missing or late."""
    invalid = lookup.where("not valid").select("review_id", "token").distinct().select(
        "review_id", F.when(F.startswith("token", F.lit("Q")), F.lit("invalid_quote_placeholder"))
        .otherwise(F.lit("invalid_summary_placeholder")).alias("type"), F.col("token").alias("detail"))
    leaks = scaffold_leaks(reviews).select("review_id", F.lit("scaffolding_leak").alias("type"),
                                           F.concat_ws("@", "label", "start").alias("detail"))
    intros = intro_order_guard(lookup).select("review_id", "type", _study())
    return invalid.unionByName(leaks).unionByName(intros)


def _study() -> Column:
    return F.concat(F.lit("study "), "study_index").alias("detail")


def citation_issues(reviews: DataFrame, studies: DataFrame, lookup: DataFrame, limit: int | None = None) -> DataFrame:
    """Studies that are cited but not quoted; the first `limit` of a review (None: all)."""
    idle = cited_not_quoted(reviews, studies, lookup)
    return (idle if limit is None else cap_issue_type(idle, limit)).select("review_id", "type", _study())


def attribution_audit(reviews: DataFrame, registry: DataFrame, studies: DataFrame, texts: DataFrame,
                      question: str = "", max_cited: int | None = MAX_CITED_ISSUES) -> DataFrame:
    """All deterministic issues of each review; of studies that are cited but not quoted the first `max_cited` (None: all)."""
    lookup = cut_lineage(token_lookup(reviews, registry), "tokens")
    verdicts = quote_sources(quoted_spans(reviews, question), studies, texts).where("verdict <> 'attributed'").select(
        "review_id", F.col("verdict").alias("type"), F.col("quote").alias("detail"))
    every = token_issues(reviews, lookup).unionByName(citation_issues(reviews, studies, lookup, max_cited)).unionByName(verdicts)
    return with_severity(every)


def with_severity(issues: DataFrame) -> DataFrame:
    return issues.withColumn("severity", F.when(F.col("type") == "cited_but_not_quoted", F.lit("moderate")).otherwise(F.lit("critical")))


def issue_severity(issues: DataFrame, keys: list[str], require_no_moderate: bool = True) -> DataFrame:
    counts = issues.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "moderate", "minor")])
    clean = F.col("critical") == 0
    return counts.withColumn("clean", clean & (F.col("moderate") == 0) if require_no_moderate else clean)


def pass_diff(issues: DataFrame) -> DataFrame:
    """Descriptions resolved or newly introduced from one pass to the next."""
    seen = issues.select("review_id", "pass", "description").distinct()
    passes = issues.select("review_id", "pass").distinct()
    follow = passes.withColumn("pass", F.col("pass") + 1).join(passes, ["review_id", "pass"])
    shifted = seen.withColumn("pass", F.col("pass") + 1)
    keys = ["review_id", "pass", "description"]
    resolved = shifted.join(follow, ["review_id", "pass"], "left_semi").join(seen, keys, "left_anti").withColumn("change", F.lit("resolved"))
    new = seen.join(follow, ["review_id", "pass"], "left_semi").join(shifted, keys, "left_anti").withColumn("change", F.lit("new"))
    return resolved.unionByName(new)

