"""Reading order, curation rules, budgets and stop rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import Bound
from ..functions.keys import echo_title_key, title_key
from ..functions.text import blank, missing, strip
from .prefix import first_per_key, number_rows, pack_batches, running_totals, trailing_rows  # noqa: F401

# Weights of study types; types not listed weigh 3.
STUDY_WEIGHTS = {
    "systematic_review": 10, "meta_analysis": 10,
    "rct": 8, "randomized_controlled_trial": 8, "cohort_study": 6,
    "case_control": 5, "case_control_study": 5,
    "cross_sectional": 4, "cross_sectional_study": 4,
    "review": 3, "narrative_review": 3, "scoping_review": 3,
    "animal_study": 2, "in_vitro": 2, "pilot_study": 2,
    "thesis": 1, "other": 1, "case_report": 2, "expert_opinion": 1}
DEFAULT_WEIGHT = 3

# Thresholds of the selection rules.
MIN_FILTER_STUDIES = 5
RESCUE_PAPERS = 5
TOP_UP_TARGET = 8
TITLE_MATCH = 0.75

# Descriptions and types of claims that another check decides.
TOKEN_TYPES = ["cited_but_not_quoted", "missing_token", "no_token", "token_missing", "unexpanded_token"]
REFERENCE_TYPES = ["missing_section", "references_missing", "reference_format", "incomplete_reference"]
CORROBORATING_TYPES = ["fabricated_quote", "misattributed_quote", "missing_citation", "unknown_citation",
                       "scaffolding_leak"]
TOKEN_CLAIMS = [
    r"no\s+quote\s+token",
    r"no\s+\w*\s*token\s+(from|for)\b",
    r"token\s+from\s+(this|that)\s+study\s+was\s+(not\s+)?inserted",
    r"(not|never)\s+(quoted|tokeni[sz]ed)\b",
    r"cited[^.]{0,90}\bbut\b[^.]{0,90}(no\b|not\b|without\b)[^.]{0,40}token",
    r"\bwithout\s+(using\s+)?the\s+token",
    r"paraphrase[^.]{0,70}(instead of|without)[^.]{0,25}token",
    r"token[^.]{0,30}(missing|not\s+used|not\s+inserted|not\s+present|absent)",
    r"\[\[[sq]\d+\]\][^.]{0,90}(missing|not\s+used|not\s+inserted|not\s+expanded|"
    r"not\s+replaced|\braw\b|placeholder|metadata)",
    r"raw\s+display\s+metadata",
    r"placeholder[s]?\s+(for|not)",
    r"not\s+expanded",
    r"every\s+(cited\s+)?study\s+must\s+be\s+(quoted|tokeni[sz]ed)",
    r"no\s+corresponding\s+(quote\s+)?token"]
HAND_TYPED_CLAIMS = [
    r"hand-?typed", r"expands\s+to", r"\bcite\s+as\b", r"\(\s*\d+\s*words?",
    r"verified\s+quotes", r"quotation\s+marks[^.]{0,40}instead"]
REFERENCE_CLAIMS = [
    r"\breferences?\b[^.]{0,90}(missing|incomplete|empty|absent|not\s+present|"
    r"lacks?|omit|blank|abruptly|no\s+(citations|entries))",
    r"(missing|incomplete|empty|absent|no)\b[^.]{0,40}\breferences?\b\s*(section|list)?",
    r"\breference(s)?\s+(list|section|entry|entries)\b[^.]{0,90}(journal|volume|"
    r"issue|page|doi|title|hanging\s+indent|format|apa|order|alphabe)",
    r"(omit|omits|lacks?|missing|without|absent)\b[^.]{0,40}(journal\s+name|"
    r"volume(/| or |\s+and\s+|, )?\s*(pages?|page\s+numbers?)?|page\s+numbers?|source\s+title)",
    r"must\s+include\s+the\s+(source\s+title|journal)",
    r"hanging\s+indent",
    r"full\s+citation\s+for\b",
    r"\breferences?\b[^.]{0,90}(apa\s*7|apa\s+7th|properly\s+format|not\s+"
    r"(properly\s+)?format|requires?\s+.*format)"]


def any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def readable_papers(papers: DataFrame, read_ids: DataFrame, mode: str) -> DataFrame:
    """Unread papers with the reason they are read or skipped."""
    unread = papers.join(read_ids.select("paper_id"), "paper_id", "left_anti")
    full, abstract = F.col("full_text_available"), ~missing("abstract")
    read = full | abstract if mode == "tangential" else full
    return unread.withColumn("action", F.when(read, F.lit("read")).when(abstract, F.lit("skip abstract only"))).where(
        "action is not null")


def unseen_only(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def study_weight(study_type: Column | str) -> Column:
    weights = F.create_map(*[x for k, v in STUDY_WEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))])
    name = F.lower(strip(F.coalesce(study_type, F.lit(""))))
    return F.coalesce(F.try_element_at(weights, name), F.lit(float(DEFAULT_WEIGHT)))


def strength(score: str = "reliability_score", study_type: str = "study_type") -> Column:
    """Reliability, 0 when it is no number, and the weight of the study type."""
    return F.coalesce(F.expr(f"try_cast({score} as double)"), F.lit(0.0)) + study_weight(study_type)


def apply_drop_list(studies: DataFrame, drops: DataFrame, protected: DataFrame, group: str) -> DataFrame:
    """Drop listed studies but curated ones. Small groups are not filtered, and a
    list that would drop a whole group is ignored."""
    flagged = studies.join(drops.select("doc_id", F.lit(True).alias("_listed")).distinct(), "doc_id", "left").join(
        protected.select("doc_id", F.lit(True).alias("_protected")).distinct(), "doc_id", "left")
    flagged = flagged.withColumn("_drop", F.coalesce("_listed", F.lit(False)) & ~F.coalesce("_protected", F.lit(False)))
    sizes = flagged.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("_drop")).alias("_kept"))
    out = flagged.join(sizes, group)
    keep = ~F.col("_drop") | (F.col("_n") <= MIN_FILTER_STUDIES) | (F.col("_kept") == 0)
    return out.withColumn("kept", keep).drop("_listed", "_protected", "_drop", "_n", "_kept")


def default_include(studies: DataFrame, decisions: DataFrame) -> DataFrame:
    """A study without a decision is included."""
    return studies.join(decisions.select("doc_id", "include"), "doc_id", "left").withColumn(
        "include", F.coalesce("include", F.lit(True)))


def prior_decisions(studies: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decision on each study in the last pass before."""
    last = decisions.groupBy("doc_id").agg(F.max_by("include", "pass").alias("prior"))
    return studies.join(last, "doc_id", "left").withColumn(
        "prior", F.when(F.col("prior"), F.lit("INCLUDE")).when(~F.col("prior"), F.lit("EXCLUDE")))


def rescue_topk(studies: DataFrame, group: str, n: int = RESCUE_PAPERS) -> DataFrame:
    """Strongest studies of the groups whose studies were all excluded."""
    none = studies.groupBy(group).agg(F.max("include").alias("any")).where("not any")
    lost = studies.join(none.select(group), group, "left_semi")
    order = Window.partitionBy(group).orderBy(strength().desc(), F.coalesce("paper_year", F.lit(0)).desc(), "doc_id")
    return lost.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_up(studies: DataFrame, group: str, target: int = TOP_UP_TARGET) -> DataFrame:
    """Curated studies, refilled to the target from the unused ones: those with
    full text first, then the strongest, then the latest."""
    n = studies.where("include").groupBy(group).agg(F.count(F.lit(1)).alias("_have"))
    order = Window.partitionBy(group).orderBy(
        F.col("has_full_text").desc(), strength().desc(), F.coalesce("paper_year", F.lit(0)).desc(), "doc_id")
    extra = (studies.where("not include").withColumn("_rank", F.row_number().over(order))
             .where(F.col("_rank") <= target).join(n, group, "left")
             .where(F.col("_rank") <= target - F.coalesce("_have", F.lit(0))))
    return studies.where("include").withColumn("origin", F.lit("curated")).unionByName(
        extra.drop("_rank", "_have").withColumn("origin", F.lit("topped up")))


def suppress_claims(issues: DataFrame, keys: list[str], references_rebuilt: bool = True) -> DataFrame:
    """Model-raised issues with the reason for dropping those another check owns.

    Rows of a corroborating type are the deterministic findings; claims about
    hand-typed quotations stand only beside one of them.
    """
    kind, text = F.lower(F.coalesce("type", F.lit(""))), F.coalesce("description", F.lit(""))
    found = issues.where(F.col("type").isin(CORROBORATING_TYPES)).select(*keys, F.lit(True).alias("_found")).distinct()
    claims = issues.where(~F.coalesce(F.col("type").isin(CORROBORATING_TYPES), F.lit(False))).join(found, keys, "left")
    reference = kind.isin(REFERENCE_TYPES) | text.rlike(any_of(REFERENCE_CLAIMS))
    return claims.withColumn("dropped_as", F.when(
        kind.isin(TOKEN_TYPES) | text.rlike(any_of(TOKEN_CLAIMS)), F.lit("token domain"))
        .when(F.lit(references_rebuilt) & reference, F.lit("reference domain"))
        .when(text.rlike(any_of(HAND_TYPED_CLAIMS)) & F.col("_found").isNull(), F.lit("uncorroborated"))).drop("_found")


def evidence_floor(runs: DataFrame, quotes: DataFrame, min_studies: int = 3, max_retries: int = 2,
                   max_minutes: float = 35, floor: bool = True) -> DataFrame:
    """Search again, abort or proceed, per review.

    runs: review_id, quality, round, max_rounds, retries, minutes.
    """
    n = quotes.where(F.col("verified") & ~missing("quote")).groupBy("review_id").agg(
        F.count_distinct("study_index").alias("n_verified"))
    r = runs.join(n, "review_id", "left").withColumn("n_verified", F.coalesce("n_verified", F.lit(0).cast("bigint")))
    thin, weak = F.col("n_verified") < min_studies, F.lower("quality") == "weak"
    budget = (F.col("round") < F.col("max_rounds")) & (F.col("retries") < max_retries) & (F.col("minutes") < max_minutes)
    return r.withColumn("outcome", F.when((thin | weak) & budget, F.lit("research"))
                        .when(thin & F.lit(floor), F.lit("abort")).otherwise(F.lit("proceed")))


def mode_entry_gates(inventory: DataFrame, abstract_only: DataFrame, healthy: int = 8, min_rounds: int = 3,
                     unread: int = 10, unused: int = 10, min_abstracts: int = 3) -> DataFrame:
    """Whether indirect evidence is refused, forced or left open, and why.

    Both inputs hold one row.
    """
    one = inventory.withColumn("n_abstract_only", abstract_only.select("n_abstract_only").scalar())
    c = F.col
    forced = ((c("full_text") == 0) & (c("pool") == 0) & (c("curated") == 0)
              & (c("standard_rounds") >= min_rounds) & (c("n_abstract_only") >= min_abstracts))
    return one.select(
        F.when(forced, F.lit("force")).when(c("curated") >= healthy, F.lit("refuse"))
        .when(c("standard_rounds") < min_rounds, F.lit("refuse")).when(c("unread_full_text") >= unread, F.lit("refuse"))
        .when(c("pool_unused") >= unused, F.lit("refuse")).otherwise(F.lit("allow")).alias("action"),
        F.when(forced, F.lit("nothing readable")).when(c("curated") >= healthy, F.lit("sufficient"))
        .when(c("standard_rounds") < min_rounds, F.lit("too few rounds"))
        .when(c("unread_full_text") >= unread, F.lit("unread full texts"))
        .when(c("pool_unused") >= unused, F.lit("unused pool")).alias("reason"))


def plan_rows_valid(areas: DataFrame) -> DataFrame:
    """Areas with a name; priority 3 unless it is a whole number, kept in 1..5;
    the first of several queries."""
    whole = F.when(F.col("priority").rlike(r"^\s*[+-]?\d+\s*$"), F.expr("try_cast(trim(priority) as int)"))
    return areas.where(~missing("area")).select(
        "plan_id", "pos", "area", F.least(F.greatest(F.coalesce(whole, F.lit(3)), F.lit(1)), F.lit(5)).alias("priority"),
        F.coalesce(F.get("search_queries", F.lit(0)), F.lit("")).alias("search_query"))


def priority_order(areas: DataFrame) -> DataFrame:
    return areas.orderBy("plan_id", F.col("priority").desc(), "pos")


def next_issue(issues: DataFrame, keys: list[str]) -> DataFrame:
    """The first critical issue, else the first moderate, else the first other."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "moderate", 1).otherwise(2)
    return first_per_key(issues.withColumn("_rank", rank), keys, "_rank", "ord").drop("_rank")


def budgeted_history(entries: DataFrame, key: str, order: str, full_entries: int = 8,
                     max_chars: int = 40000) -> DataFrame:
    """The newest entries in full, older ones compact, the oldest left out
    beyond the budget; `omitted` counts those of the key. Columns: full_chars, compact_chars."""
    newest = entries.withColumn("_rev", -F.col(order))
    numbered = number_rows(newest, [key], "_rev", "_n")
    chars = F.when(F.col("_n") <= full_entries, F.col("full_chars")).otherwise(F.col("compact_chars"))
    run = running_totals(numbered, [key], "_rev", {"_used": chars.cast("bigint")})
    formed = run.withColumn("form", F.when(F.col("_n") <= full_entries, F.lit("full")).when(
        F.col("_used") <= max_chars, F.lit("compact")).otherwise(F.lit("omitted"))).drop("_rev", "_n", "_used")
    return _with_omitted(formed, key, F.col("form") == "omitted")


def _with_omitted(rows: DataFrame, key: str, out: Column) -> DataFrame:
    """Add the number of rows of the key that were left out."""
    return rows.join(rows.groupBy(key).agg(F.count_if(out).alias("omitted")), key)


def budgeted_list(rows: DataFrame, key: str, order: str, size: Column, max_chars: int = 20000) -> DataFrame:
    """Rows in order up to the first that would exceed the budget; `omitted` counts the others of the key."""
    run = running_totals(rows, [key], order, {"used": size.cast("bigint")})
    return _with_omitted(run.withColumn("kept", F.col("used") <= max_chars), key, ~F.col("kept"))


def streaks(rounds: DataFrame) -> DataFrame:
    """Add `hits`, the rounds so far that added something, and `stagnant`, the rounds since then that did not."""
    hit = running_totals(rounds, ["run_id"], "round", {"hits": F.when(F.col("added") > 0, 1).otherwise(0).cast("bigint")})
    return running_totals(hit, ["run_id", "hits"], "round",
                          {"stagnant": F.when(F.col("added") > 0, 0).otherwise(1).cast("bigint")})


def stagnation(rounds: DataFrame, limit: int = 3) -> DataFrame:
    """Consecutive rounds that added nothing, counted up to each round."""
    return streaks(rounds).withColumn("stop", F.col("stagnant") >= limit).drop("hits")


def round_stop_reason(rounds: DataFrame, round_cap: int = 8, max_engagements: int = 2, max_stagnant: int = 3,
                      absolute_cap: int = 40, minutes: float = 90) -> DataFrame:
    """The first stop rule that holds after each round.

    `round_cap` counts the tangential rounds, `absolute_cap` all of them.
    """
    run = running_totals(stagnation(rounds, max_stagnant), ["run_id"], "round", {
        "n_rounds": F.lit(1).cast("bigint"), "n_tangential": F.col("tangential").cast("bigint"), "n_engagements": F.col("engagements").cast("bigint"),
        "n_minutes": F.col("minutes").cast("decimal(18,2)")})
    return run.withColumn("reason", F.when(F.col("n_tangential") >= round_cap, F.lit("round cap"))
                          .when(F.col("n_engagements") > max_engagements, F.lit("engagement limit"))
                          .when(F.col("stagnant") >= max_stagnant, F.lit("stagnation"))
                          .when(F.col("n_rounds") >= absolute_cap, F.lit("absolute cap"))
                          .when(F.col("n_minutes") >= minutes, F.lit("time budget")))


def title_ratio(pairs: DataFrame, left: str, right: str, threshold: float = TITLE_MATCH) -> DataFrame:
    """Similarity of two title keys; 0 for pairs that cannot reach the threshold."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher
        out = []
        for x, y in zip(a, b):
            if not x or not y:
                out.append(0.0)
            elif x == y:
                out.append(1.0)
            elif 2 * min(len(x), len(y)) < threshold * (len(x) + len(y)) or Bound(x).ratio(y) < threshold:
                out.append(0.0)
            else:
                out.append(SequenceMatcher(None, x, y).ratio())
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("ratio", ratio(left, right))


def resolve_selections(selections: DataFrame, candidates: DataFrame) -> DataFrame:
    """Match numbered selections to the candidates of their query by number and
    echoed title; a wrong number is corrected when the title names another one.

    The fallback only meets candidates of the same query, a list the search
    step limits per source.
    """
    s = selections.withColumn("_i", F.when(strip("paper_index").rlike(r"^\d+$"),
                                           F.expr("try_cast(trim(paper_index) as bigint)")))
    s = s.withColumn("_echo", echo_title_key("title")).withColumn("_blank", blank("title"))
    c = candidates.select("query_id", F.col("paper_index").alias("_i"), F.col("seq").alias("by_index"),
                          echo_title_key("title").alias("_t"))
    joined = title_ratio(s.join(c, ["query_id", "_i"], "left"), "_echo", "_t")
    sure = (F.col("_blank") & F.col("by_index").isNotNull()) | (~F.col("_blank") & (F.col("ratio") >= TITLE_MATCH))
    joined = joined.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    open_ones = joined.where(~F.col("_sure") & ~F.col("_blank")).select("query_id", "sel", "_echo")
    near = title_ratio(open_ones.join(c.withColumnRenamed("_i", "_j"), "query_id"), "_echo", "_t").where(
        F.col("ratio") >= TITLE_MATCH)
    best = near.groupBy("query_id", "sel").agg(
        F.max_by("by_index", F.struct("ratio", -F.col("_j"))).alias("by_title"))
    out = joined.join(best, ["query_id", "sel"], "left").withColumn(
        "seq", F.when(F.col("_sure"), F.col("by_index")).otherwise(F.col("by_title"))).withColumn(
        "status", F.when(F.col("_sure") & F.col("_blank"), F.lit("unverified")).when(F.col("_sure"), F.lit("verified"))
        .when(F.col("by_title").isNotNull(), F.lit("corrected")).otherwise(F.lit("dropped")))
    first = out.where("seq is not null").groupBy("query_id", "seq").agg(F.min("sel").alias("_first"))
    return out.join(first, ["query_id", "seq"], "left").withColumn(
        "status", F.when(F.col("sel") > F.col("_first"), F.lit("duplicate")).otherwise(F.col("status"))).select(
            "query_id", "sel", "seq", "status")


def best_title_match(wanted: DataFrame, results: DataFrame, least: float = 0.6) -> DataFrame:
    """The result whose title shares most tokens with the wanted one.

    wanted: want_id, group, title. results: group, pos, result_id, title. A
    title without tokens takes the first result.
    """
    def toks(c: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), 1))

    w = wanted.select("want_id", "group", toks("title").alias("t")).withColumn("n", F.size("t"))
    r = results.select("group", "pos", "result_id", toks("title").alias("t"))
    shared = w.select("want_id", "group", "n", F.explode("t").alias("token")).join(
        r.select("group", "pos", "result_id", F.explode("t").alias("token")), ["group", "token"]).groupBy(
            "want_id", "n", "pos", "result_id").agg(F.count(F.lit(1)).alias("hits"))
    scored = shared.withColumn("share", F.col("hits") / F.col("n")).where(F.col("share") >= least)
    best = scored.groupBy("want_id").agg(
        F.max_by(F.struct("result_id", "share"), F.struct("share", -F.col("pos"))).alias("b")).select(
            "want_id", "b.result_id", "b.share")
    first = r.groupBy("group").agg(F.min_by("result_id", "pos").alias("result_id"))
    empty = w.where("n = 0").join(first, "group").select("want_id", "result_id", F.lit(0.0).alias("share"))
    return best.unionByName(empty)


def merge_grades(studies: DataFrame, grades: DataFrame) -> DataFrame:
    """Write assessment fields back by study number; other numbers are ignored."""
    return studies.join(grades, ["review_id", "study_index"], "left")


def pair_weakness_query(assessments: DataFrame, cap: int = 6) -> DataFrame:
    """Pair the n-th weakness with the n-th query; the query stands in for a
    missing weakness."""
    q = assessments.select("review_id", F.slice("weaknesses", 1, cap).alias("w"),
                           F.posexplode(F.slice("queries", 1, cap)).alias("pos", "query"))
    return q.select("review_id", "pos", "query", F.coalesce(F.get("w", F.col("pos")), F.col("query")).alias("weakness"))


def query_key(c: str) -> Column:
    return title_key(c)
