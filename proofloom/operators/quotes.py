"""Locating, accepting and rejecting quotations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.citations import secondhand_markers
from ..functions.headings import section_at, sections
from ..functions.keys import quote_key
from ..functions.text import let, missing, normalize_text, numbers_subset, running, tokenize, words
from . import passages as P
from ..session import cut_lineage, spread
from .prefix import first_n_per_key, first_per_key

# Acceptance and gating.
MIN_SIMILARITY = 0.95
MIN_QUOTE_CHARS = 20
MAX_LEADING_CHARS = 8000
SEARCH_WORDS = 10
AUDIT_CONFIDENCE = 0.6

GRAM_WORDS = 4


def _folded_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _gram_hashes(w: Column) -> Column:
    """Hashes of all runs of four words."""
    last = F.size(w) - GRAM_WORDS
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(GRAM_WORDS)]))).otherwise(
            F.array().cast("array<bigint>"))


def _char_grams(text: Column, n: int) -> Column:
    """Hashes of all runs of n characters."""
    def grams(flat: Column) -> Column:
        last = F.length(flat) - (n - 1)
        return F.when(last >= 1, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.lit("c"), F.substring(flat, i, F.lit(n)))))
        ).otherwise(F.array().cast("array<bigint>"))

    return let(normalize_text(text), grams)


def candidate_pairs(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, doc_id) pairs that may match but for case and white space.

    All words of a quotation but its first and last are whole words of any text
    that holds it. One run of four such words (one word, for short quotations;
    three characters, for very short ones) is looked up by an equi-join on its
    hash, so every holder is found. Quotations of fewer than three characters are
    looked up by runs of their own length. The least frequent of the runs in the
    texts is the one that is looked up, so boilerplate in a quotation does not
    bring all its holders together.
    """
    q = quotes.select("quote_id", F.col("quote").alias("_q"), _folded_words(F.col("quote")).alias("w"))
    n = F.size("w")
    flat = F.length(normalize_text("_q"))
    inner = F.slice("w", F.lit(2), F.greatest(n - 2, F.lit(0)))
    tier = (F.when(n >= GRAM_WORDS + 2, F.lit("gram")).when(n >= 3, F.lit("word")).when(flat >= 3, F.lit("char3"))
            .when(flat == 2, F.lit("char2")).when(flat == 1, F.lit("char1")))
    asked = q.withColumn("inner", inner).withColumn("tier", tier).where("tier is not null")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("inner") - GRAM_WORDS, F.lit(0))),
                       lambda i: F.xxhash64(*[F.get("inner", i + k) for k in range(GRAM_WORDS)]))
    keys = F.when(F.col("tier") == "gram", runs).when(
        F.col("tier") == "word", F.transform("inner", lambda x: F.xxhash64(F.lit("w"), x)))
    for k in (3, 2, 1):
        keys = keys.when(F.col("tier") == f"char{k}", _char_grams(F.col("_q"), k))
    asked = asked.select("quote_id", "tier", F.explode(F.array_distinct(keys)).alias("anchor"))
    w = _folded_words(F.col("text"))
    grams = {"gram": F.array_distinct(let(w, _gram_hashes)),
             "word": F.transform(F.array_distinct(w), lambda x: F.xxhash64(F.lit("w"), x)),
             **{f"char{k}": _char_grams(F.col("text"), k) for k in (3, 2, 1)}}
    # At most five tiers exist; only the runs that are needed are made. What no quotation asks for is not shuffled on.
    tiers = sorted(r["tier"] for r in asked.select("tier").distinct().collect())
    if not tiers:
        return q.select("quote_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id")).limit(0)
    index = docs.select("doc_id", F.explode(F.concat(*[grams[t] for t in tiers])).alias("anchor"))
    index = cut_lineage(index.join(asked.select("anchor").distinct(), "anchor", "left_semi"), "quote-anchors")
    df = index.groupBy("anchor").agg(F.count("*").alias("df"))
    # A run that no text holds makes a quotation impossible: its frequency 0 is the least.
    ranked = asked.join(df, "anchor", "left").groupBy("quote_id").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "anchor")).alias("m"))
    rarest = ranked.where("m.df > 0").select("quote_id", F.col("m.anchor").alias("anchor"))
    return index.join(rarest, "anchor").select("quote_id", "doc_id").distinct()


def occurrences(text: Column, quote: Column) -> Column:
    """Start offsets of all occurrences, overlapping ones included."""
    safe = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.transform(F.split(text, safe), F.length)
    # A look-ahead split starts a piece at each occurrence but one at offset 0.
    starts = let(pieces, lambda p: F.transform(F.arrays_zip(running(p).alias("end"), p.alias("n")), lambda x: x["end"] - x["n"]))
    return F.filter(starts, lambda s: (s > 0) | F.startswith(text, quote))


def exact_quote_scan(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Every occurrence of every quotation in every document."""
    pairs = candidate_pairs(quotes, docs).join(quotes.select("quote_id", "quote"), "quote_id")
    hits = docs.select("doc_id", "text").join(pairs, "doc_id").where(F.contains("text", "quote"))
    return hits.select("quote_id", "doc_id", F.explode(occurrences(F.col("text"), F.col("quote"))).alias("start"),
                       F.length("quote").alias("_n")).select(
        "quote_id", "doc_id", "start", (F.col("start") + F.col("_n")).alias("end"))


def space_pattern(quote: Column | str) -> Column:
    """Pattern of a quotation with any white space between its words."""
    quoted = F.transform(words(quote), lambda w: F.concat(
        F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?iu)"), F.array_join(quoted, "\\s+"))


def verbatim_match(quote: Column, passage: Column) -> Column:
    """Exact match, else a match but for case and white space, else null."""
    # Each blank of the pattern takes a character, so no shorter passage can hold a match; the pattern of a very
    # long quotation is too deep to compile.
    found = F.when(F.length(passage) >= F.length(F.array_join(words(quote), " ")), F.regexp_substr(passage, space_pattern(quote)))

    def spaced(m: Column) -> Column:
        at = F.instr(passage, m)
        return F.when(m.isNotNull(), F.struct(
            F.lit("normalized").alias("method"), (at - 1).alias("start"),
            (at - 1 + F.length(m)).alias("end"), F.lit(0.95).alias("confidence")))

    at = F.instr(passage, quote)
    exact = F.struct(F.lit("exact").alias("method"), (at - 1).alias("start"),
                     (at - 1 + F.length(quote)).alias("end"), F.lit(1.0).alias("confidence"))
    return F.when(at > 0, exact).otherwise(let(found, spaced))


def locate_in_corpus(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Where each quotation stands in any document, exactly or but for case and
    white space: first exact span of the pair, else first normalised span."""
    pairs = candidate_pairs(quotes, docs).join(quotes.select("quote_id", "quote"), "quote_id")
    hits = docs.select("doc_id", "text").join(pairs, "doc_id").withColumn(
        "m", verbatim_match(F.col("quote"), F.col("text"))).where(F.col("m").isNotNull())
    return hits.select("quote_id", "doc_id", "m.method", "m.start", "m.end")


def accept_match(similarity: Column | str, quote: Column | str, found: Column | str,
                 threshold: float = MIN_SIMILARITY) -> Column:
    """High similarity and, short of containment, no changed number."""
    s = F.col(similarity) if isinstance(similarity, str) else similarity
    return (s >= threshold) & ((s >= 1.0) | numbers_subset(normalize_text(quote), normalize_text(found)))


MATCH_TYPE = "struct<method:string,start:int,end:int,confidence:double,similarity:double>"


def approximate_matches(pairs: DataFrame, min_similarity: float = 0.0,
                        where: Column | None = None, reached: bool = False) -> DataFrame:
    """Add `a`, the outcome of the approximate strategies on each pair.

    With a least similarity, pairs that cannot reach it are skipped by a
    necessary condition on shared character grams; with `reached`, by that of an
    expanded match, and outcomes below it count as none. Pairs that fail `where`
    reach the Python step as nulls and cost nothing there.
    """
    possible = fuzzy.sentence_may_reach if reached else fuzzy.may_reach

    @F.pandas_udf(MATCH_TYPE)
    def match(quotes: pd.Series, chunks: pd.Series) -> pd.DataFrame:
        rows = []
        for q, c in zip(quotes, chunks):
            hit = None
            if q and c and (min_similarity <= 0 or possible(q, c, min_similarity)):
                hit = fuzzy.approximate_match(q, c)
            if hit:
                method, start, end, confidence = hit
                hit = (method, start, end, confidence, fuzzy.similarity(q, c[start:end]))
            if hit and not (reached and hit[-1] < min_similarity):
                rows.append(hit)
            else:
                rows.append((None, None, None, None, None))
        out = pd.DataFrame(rows, columns=["method", "start", "end", "confidence", "similarity"])
        return out.astype({"start": "Int32", "end": "Int32", "confidence": "float64", "similarity": "float64"})

    # Deterministic steps are run again below the shuffle for each filter on their outcome.
    match = match.asNondeterministic()
    wanted = F.lit(True) if where is None else where
    return pairs.withColumn("a", match(F.when(wanted, F.col("quote")), F.when(wanted, F.col("chunk")))).withColumn(
        "a", F.when(F.col("a.method").isNotNull(), F.col("a")))


def match_cascade(pairs: DataFrame) -> DataFrame:
    """First successful strategy on each (quote, chunk) pair. Verbatim matches
    are found natively; only the rest reaches the approximate strategies."""
    m = pairs.withColumn("v", verbatim_match(F.col("quote"), F.col("chunk")))
    sure = m.where(F.col("v").isNotNull()).select(
        *pairs.columns, F.col("v.method").alias("method"), F.col("v.start").alias("m_start"),
        F.col("v.end").alias("m_end"), F.col("v.confidence").alias("confidence"))
    rest = approximate_matches(spread(m.where(F.col("v").isNull()).drop("v"), F.xxhash64("quote", "chunk"))).where(F.col("a").isNotNull()).select(
        *pairs.columns, F.col("a.method").alias("method"), F.col("a.start").alias("m_start"),
        F.col("a.end").alias("m_end"), F.col("a.confidence").alias("confidence"))
    return sure.unionByName(rest)


def candidate_chunks(proposals: DataFrame, chunks: DataFrame) -> DataFrame:
    """(quote_id, doc_id, chunk_index, rank): all chunks of the quotation's own paper, in the order of search.

    Those ranked for its first words come first, the others follow in text
    order. No text is carried.
    """
    ask = proposals.select(F.col("quote_id").alias("query_id"), "doc_id", tokenize(P.first_words("quote", SEARCH_WORDS)).alias("terms"))
    ranked = cut_lineage(P.rank_passages(ask, chunks, None).select(
        F.col("query_id").alias("quote_id"), "doc_id", "chunk_index", "rank"), "ranked-chunks")
    every = proposals.select("quote_id", "doc_id").join(chunks.select("doc_id", "chunk_index"), "doc_id").distinct()
    last = ranked.groupBy("quote_id").agg(F.max("rank").alias("last"))
    others = every.join(ranked, ["quote_id", "doc_id", "chunk_index"], "left_anti").join(last, "quote_id", "left").withColumn(
        "rank", F.coalesce("last", F.lit(0)) + F.col("chunk_index") + 1)
    return ranked.unionByName(others.select(*ranked.columns))


#: Quotations of one paper that are tried in one task.
TOGETHER = 256


def with_texts(quotes: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Quotations with the text of their paper, which moves to them once.

    Papers with more than TOGETHER quotations are dealt over several tasks, each
    with a copy of the text; the list of such papers is that many times shorter
    than the quotations.
    """
    crowded = F.broadcast(quotes.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("_parts")).where("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1))
    asked = quotes.join(crowded, "doc_id", "left").withColumn("_part", F.pmod(F.xxhash64("quote_id", "quote"), parts).cast("int")).drop("_parts")
    texts = docs.select("doc_id", F.col(text).alias("text")).join(crowded, "doc_id", "left").select(
        "doc_id", "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return asked.join(spread(texts, "doc_id", "_part"), ["doc_id", "_part"]).drop("_part")


def chunk_matches(quotes: DataFrame, docs: DataFrame, text: str = "text", threshold: float = MIN_SIMILARITY) -> DataFrame:
    """All matches of each quotation in the chunks of its own paper, with offsets in the text.

    Texts are cut and searched in the row where they met the quotation, so no
    chunk is written or moved. A quotation with a verbatim match in a text needs
    no approximate one there.
    """
    rows = with_texts(quotes, docs, text).withColumn("_c", P.chunks_of(F.col("text")))
    tried = F.transform("_c", lambda c: F.struct(
        c["chunk_index"].alias("chunk_index"), c["start"].alias("start"), c["chunk"].alias("chunk"),
        verbatim_match(F.col("quote"), c["chunk"]).alias("v")))
    kept = let(tried, lambda t: let(F.filter(t, lambda x: x["v"].isNotNull()), lambda sure: F.when(F.size(sure) > 0, sure).otherwise(t)))
    # The outer form keeps the optimizer from testing for chunks first, which would search twice.
    pairs = rows.select("quote_id", "doc_id", "quote", F.explode_outer(kept).alias("p")).select("quote_id", "doc_id", "quote", "p.*")
    found = approximate_matches(pairs, threshold, F.col("v").isNull(), reached=True).where("v is not null or a is not null")
    start, end = F.coalesce("v.start", "a.start"), F.coalesce("v.end", "a.end")
    return found.select(
        "quote_id", "doc_id", "quote", "chunk_index", F.col("v").isNotNull().alias("verbatim"), F.coalesce("v.method", "a.method").alias("method"),
        F.when(F.col("v").isNotNull(), F.lit(1.0)).otherwise(F.col("a.similarity")).alias("similarity"),
        (F.col("start") + start).alias("m_start"), (F.col("start") + end).alias("m_end"),
        F.substring("chunk", start + 1, end - start).alias("matched"))


def locate_quotes(proposals: DataFrame, docs: DataFrame, text: str = "text",
                  threshold: float = MIN_SIMILARITY) -> DataFrame:
    """Best accepted match of each proposed quotation in its own paper.

    Of equally good matches the one in the chunk that is searched first counts;
    the order of chunks is worked out for quotations with such matches only.
    """
    long_enough = cut_lineage(proposals.where(F.length("quote") >= MIN_QUOTE_CHARS).select("quote_id", "doc_id", "quote"), "long-quotes")
    quotes = long_enough.select("quote_id", "doc_id").distinct().join(long_enough.select("quote_id", "quote").distinct(), "quote_id")
    found = cut_lineage(chunk_matches(quotes, docs, text, threshold), "chunk-matches")
    place = F.struct("doc_id", "chunk_index")
    level = found.groupBy("quote_id", "verbatim", "similarity").agg((F.min(place) != F.max(place)).alias("tied"))
    tied = level.groupBy("quote_id").agg(F.max_by("tied", F.struct("verbatim", "similarity")).alias("tied")).where("tied").select("quote_id")
    asked = cut_lineage(long_enough.join(tied, "quote_id", "left_semi"), "tied-quotes")
    if asked.isEmpty():
        found = found.withColumn("rank", F.lit(0))
    else:
        chunks = P.chunk_offsets(docs.join(asked.select("doc_id").distinct(), "doc_id", "left_semi"), text)
        found = found.join(candidate_chunks(asked, chunks), ["quote_id", "doc_id", "chunk_index"], "left")
    best = found.groupBy("quote_id").agg(F.max_by(F.struct(
        "doc_id", "quote", "method", "m_start", "m_end", "matched", "similarity"),
        F.struct("verbatim", "similarity", -F.coalesce("rank", F.lit(0)), -F.col("m_start"))).alias("b")).select("quote_id", "b.*")
    return best.where(accept_match("similarity", "quote", "matched", threshold)).withColumn(
        "similarity", F.round("similarity", 4))


def section_gate(mode: str, strict: bool, category: Column, section_map: Column, region: Column,
                 text_chars: Column, abstract_only: Column,
                 max_leading: int = MAX_LEADING_CHARS) -> Column:
    """Whether the place of a quotation makes it the study's own finding."""
    if mode == "require_evidence":
        bounded = (F.size(section_map) > 0) & ~F.exists(section_map, lambda s: s["category"] == "ABSTRACT") & (
            F.coalesce(F.get(section_map, F.lit(0))["start"], text_chars) <= max_leading)
        kept = category.isin("EVIDENCE", "ABSTRACT")
        if not strict:
            kept = kept | ((category == "UNKNOWN") & bounded)
        return abstract_only | kept
    if mode == "exclude_non_evidence":
        active = F.exists(section_map, lambda s: s["category"] == "REFS")
        kept = F.when(category == "REFS", F.lit(False)).when(
            category == "EXCLUDE", region > max_leading).otherwise(F.lit(True))
        return abstract_only | ~active | kept
    raise ValueError(f"unknown gate mode {mode!r}")


def verify_quotes(proposals: DataFrame, docs: DataFrame, text: str = "text",
                  mode: str = "require_evidence", strict: bool = False,
                  exclude_secondhand: bool = True) -> DataFrame:
    """Verified and rejected quotations with method, place and signs.

    docs: doc_id, the text column, and optionally `abstract_only`.
    """
    found = locate_quotes(proposals, docs, text)
    only = F.col("abstract_only") if "abstract_only" in docs.columns else F.lit(False)
    maps = docs.select("doc_id", F.length(text).alias("text_chars"), sections(text).alias("section_map"),
                       only.alias("abstract_only"))
    rows = proposals.where(F.length("quote") >= MIN_QUOTE_CHARS).withColumnRenamed("quote", "proposed").join(
        found.drop("doc_id", "quote"), "quote_id", "left").join(maps, "doc_id")
    rows = rows.withColumn("_s", section_at("section_map", "m_start")).withColumn(
        "category", F.when(F.col("abstract_only"), F.lit("ABSTRACT")).otherwise(F.col("_s.category")))
    region = F.coalesce(F.col("_s.end"), F.coalesce(F.get("section_map", F.lit(0))["start"], F.col("text_chars"))) - F.col("_s.start")
    located = F.col("method").isNotNull()
    rows = rows.withColumn("placed", section_gate(
        mode, strict, F.col("category"), F.col("section_map"), region, F.col("text_chars"), F.col("abstract_only")))
    signs = F.when(located & F.col("placed"), secondhand_markers("matched")) if exclude_secondhand else F.array().cast("array<string>")
    rows = rows.withColumn("markers", F.coalesce(signs, F.array().cast("array<string>")))
    verified = located & F.col("placed") & (F.size("markers") == 0)
    return rows.select(
        "quote_id", "doc_id", "pos", "importance", "context",
        F.when(located, F.col("matched")).otherwise(F.col("proposed")).alias("quote"),
        verified.alias("verified"),
        F.when(~located, F.lit("not_found")).when(~F.col("placed"), F.lit("rejected_non_evidence_section"))
        .when(F.size("markers") > 0, F.lit("rejected_secondhand_citation"))
        .otherwise(F.col("method")).alias("verification_method"),
        F.coalesce("similarity", F.lit(0.0)).alias("match_confidence"),
        F.col("m_start").alias("start"), F.col("m_end").alias("end"),
        F.when(located, F.col("category")).otherwise(F.lit("N/A")).alias("source_section"),
        F.when(located & ~F.col("abstract_only"), F.col("_s.heading")).otherwise(F.lit("")).alias("section_heading"),
        "markers")


def quote_outcomes(quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per study: proposed, verified and the reasons for drops."""
    method = F.col("verification_method")
    kept = F.col("verified") & ~missing("quote")
    return quotes.groupBy(key).agg(
        F.count(F.lit(1)).alias("proposed"), F.count_if(kept).alias("verified_primary"),
        F.count_if(~kept & (method == "rejected_non_evidence_section")).alias("dropped_non_evidence"),
        F.count_if(~kept & (method == "rejected_secondhand_citation")).alias("dropped_secondhand"),
        F.count_if(~kept & (method == "not_found")).alias("dropped_not_found"))


def min_verified_filter(studies: DataFrame, quotes: DataFrame, minimum: int = 1) -> DataFrame:
    """Mark each study kept or dropped by its number of verified quotations."""
    n = quotes.where(F.col("verified") & ~missing("quote")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_verified"))
    return studies.join(n, "doc_id", "left").withColumn("n_verified", F.coalesce("n_verified", F.lit(0).cast("bigint"))).withColumn(
        "kept", F.col("n_verified") >= minimum).withColumn(
        "drop_reason", F.when(~F.col("kept"), F.concat(
            F.lit("only "), "n_verified", F.lit(f" verified quotes (threshold: {minimum})"))))


def importance_cap(quotes: DataFrame, key: str, n: int) -> DataFrame:
    """At most n quotations per study, the important first; unknown counts as medium."""
    rank = F.when(F.lower("importance") == "high", 0).when(F.lower("importance") == "low", 2).otherwise(1)
    return first_n_per_key(quotes, [key], n, rank, F.col("pos"), F.col("quote_id"))


def distinct_quotes(quotes: DataFrame, key: str) -> DataFrame:
    """First proposal of each wording within a study."""
    keyed = quotes.withColumn("quote_key", quote_key("quote")).where(~missing("quote"))
    return first_per_key(keyed, [key, "quote_key"], "quote_id")


def fuzzy_topk(pairs: DataFrame, threshold: float = 0.9, top: int = 5) -> DataFrame:
    """Best windows of the quotation's own length in each paired text."""
    @F.pandas_udf("array<struct<start:int,end:int,ratio:double>>")
    def search(quotes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "ratio": r} for s, e, r in fuzzy.best_windows(q, t, threshold, top)]
                          if q and t else [] for q, t in zip(quotes, texts)])

    # As above: a filter on the size of the outcome would search once more before the shuffle.
    search = search.asNondeterministic()
    return spread(pairs, "quote_id", "doc_id").withColumn("_w", search("quote", "text")).select(
        "quote_id", "doc_id", F.posexplode("_w").alias("rank", "w")).select(
            "quote_id", "doc_id", "rank", "w.start", "w.end", F.round("w.ratio", 6).alias("ratio"))


def similarity_of(pairs: DataFrame, left: str, right: str, name: str = "similarity") -> DataFrame:
    """Containment or matcher ratio of two texts; the native containment test
    keeps sure pairs out of the Python step."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fuzzy.similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    contained = F.contains(normalize_text(right), normalize_text(left)) & (normalize_text(left) != "")
    flagged = pairs.withColumn("_in", F.coalesce(contained, F.lit(False)))
    sure = flagged.where("_in").withColumn(name, F.lit(1.0))
    rest = spread(flagged.where("not _in"), F.xxhash64(left, right)).withColumn(name, ratio(left, right))
    return sure.unionByName(rest).drop("_in")
