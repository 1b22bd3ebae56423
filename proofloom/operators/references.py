"""Cited references: selection, resolution and backward citation chasing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import candidate_key, doi_key
from ..functions.text import missing, strip
from ..session import cut_lineage
from .prefix import first_per_key, first_rows
from .selection import best_title_match

# Bounds of the citation chase.
MAX_DEPTH, MAX_PER_STUDY, MAX_TOTAL, MIN_VERIFIED = 1, 5, 20, 1


def map_reference_selection(selections: DataFrame, entries: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Put selected references back onto the entries they number.

    selections: doc_id, pos, index (text), title, doi. The entry fills an absent
    DOI or title; a number without an entry stands only with a DOI; each work is
    kept once per paper. An entry stands for its title whole, or by its first
    `title_chars`.
    """
    number = F.when(F.col("index").rlike(r"^\d+$"), F.expr("try_cast(index as int)"))
    e = entries.select("doc_id", F.col("entry_no").alias("_i"), F.col("raw").alias("_raw"), F.col("doi").alias("_doi"))
    joined = selections.withColumn("_i", number).join(e, ["doc_id", "_i"], "left")
    own, raw = doi_key("doi", "harvest"), F.coalesce("_raw", F.lit(""))
    joined = joined.withColumn("doi", F.when(own != "", own).otherwise(F.coalesce("_doi", F.lit("")))).withColumn(
        "title", F.when(strip(F.coalesce("title", F.lit(""))) != "", strip("title")).otherwise(
            raw if title_chars is None else F.substring(raw, 1, title_chars)))
    kept = joined.where((F.col("_raw").isNotNull() | (F.col("doi") != "")) & ((F.col("doi") != "") | (F.col("title") != "")))
    keyed = kept.select("doc_id", "pos", "title", "doi", F.coalesce("_raw", F.lit("")).alias("raw"),
                        candidate_key("doi", "title").alias("work_key"))
    return first_per_key(keyed, ["doc_id", "work_key"], "pos")


def reference_targets(candidates: DataFrame, catalog: DataFrame, hits: DataFrame) -> DataFrame:
    """The record a cited work stands for, with the route it was found by.

    candidates: cand_id, group, title, doi. catalog: result_id, doi, has_text.
    hits: group, pos, result_id, title (the title search of each group).
    """
    c = candidates.withColumn("_dk", doi_key("doi", "harvest")).withColumn("_t", strip(F.coalesce("title", F.lit(""))))
    by_doi = catalog.withColumn("_dk", doi_key("doi", "harvest")).where("_dk <> ''").groupBy("_dk").agg(
        F.min("result_id").alias("_by_doi"))
    titled = c.where("_dk = '' and _t <> ''").select(F.col("cand_id").alias("want_id"), "group", F.col("_t").alias("title"))
    by_title = best_title_match(titled, hits).select(F.col("want_id").alias("cand_id"), F.col("result_id").alias("_by_title"))
    found = c.join(by_doi, "_dk", "left").join(by_title, "cand_id", "left").withColumn(
        "result_id", F.coalesce("_by_doi", "_by_title"))
    text = catalog.select("result_id", "has_text")
    out = found.join(text, "result_id", "left")
    route = F.when(F.col("_dk") != "", F.lit("doi_lookup")).when(F.col("_t") != "", F.lit("title_search"))
    status = (F.when(route.isNull(), F.lit("no_doi_or_title"))
              .when((route == "title_search") & F.col("result_id").isNull(), F.lit("title_search:no_confident_match"))
              .when(F.coalesce("has_text", F.lit(False)), F.concat(route, F.lit(":full_text_ok")))
              .otherwise(F.concat(route, F.lit(":no_full_text"))))
    return out.select("cand_id", "result_id", status.alias("status"))


def citation_snowball(seeds: DataFrame, edges: DataFrame, papers: DataFrame, max_depth: int = MAX_DEPTH,
                      per_study: int = MAX_PER_STUDY, budget: int | None = MAX_TOTAL,
                      min_verified: int = MIN_VERIFIED) -> DataFrame:
    """Works reached over references, generation by generation.

    seeds: paper, ord (unique). edges: paper, entry_no, cited (key of the cited
    work). papers: paper, n_verified, has_text. A work is tried once; one with
    enough verified quotations is kept and expanded next. `budget` bounds the
    number of tries over all generations in frontier order, and a paper reads no
    more entries than tries are left when its turn comes; None lifts the bound.
    Each generation is one job whose result is written before the next.
    """
    # The place of a work is the path of entry numbers from its seed. Only works with a text have references to read.
    readable = papers.where("has_text").select("paper")
    frontier = seeds.join(readable, "paper", "left_semi").select("paper", F.array(F.col("ord").cast("bigint")).alias("ord"))
    seen = seeds.select("paper").distinct()
    generations, left = [], budget
    for depth in range(1, max_depth + 1):
        if left is not None and left <= 0:
            break
        place = F.row_number().over(Window.partitionBy("paper").orderBy("entry_no"))
        capped = edges.withColumn("place", place).where(F.col("place") <= per_study)
        out = frontier.join(capped, "paper").select(F.col("cited").alias("paper"), "ord", "entry_no", "place")
        unseen = out.join(seen, "paper", "left_anti")
        fresh = first_per_key(unseen, ["paper"], "ord", "entry_no")
        if left is not None:
            unseen = cut_lineage(unseen, f"unseen-{depth}")
            fresh = _within_budget(unseen, cut_lineage(first_per_key(unseen, ["paper"], "ord", "entry_no"), f"fresh-{depth}"),
                                   per_study, left)
        tried = fresh.join(papers, "paper", "left").select(
            "paper", F.lit(depth).alias("depth"), "ord", "entry_no",
            F.coalesce("has_text", F.lit(False)).alias("acquired"),
            F.coalesce("n_verified", F.lit(0).cast("bigint")).alias("n_verified"))
        tried = tried.withColumn("kept", F.col("acquired") & (F.col("n_verified") >= min_verified))
        tried = cut_lineage(tried, f"generation-{depth}")
        generations.append(tried)
        n = tried.count()
        if n == 0:
            break
        left = None if left is None else left - n
        seen = seen.unionByName(tried.select("paper"))
        # A work inherits the place of the first entry that led to it.
        frontier = tried.where("kept").select("paper", F.concat("ord", F.array(F.col("entry_no").cast("bigint"))).alias("ord"))
    every = generations[0]
    for g in generations[1:]:
        every = every.unionByName(g)
    return every


def _within_budget(unseen: DataFrame, fresh: DataFrame, per_study: int, left: int) -> DataFrame:
    """The first `left` works of a generation in frontier order.

    unseen: paper, ord, entry_no, place (the entry's number among those its paper
    may read). fresh: the first row of each work. Papers read `per_study` entries
    while as many tries are left, so their works are the first ones in order. The
    papers after them read fewer: each step finds the next paper with a work to
    try among its first entries. A step spends at least one try, and fewer than
    `per_study` are left, so there are few steps, each an aggregate over all rows.
    """
    free = left - per_study + 1
    last, head = None, fresh.limit(0)
    if free > 0:
        if fresh.count() < free:
            return fresh
        last = first_rows(fresh, free, "ord", "entry_no").agg(F.max("ord").alias("ord")).first()["ord"]
        head = fresh.where(F.col("ord") <= _path(last))
        left -= head.count()
        unseen = cut_lineage(unseen.where(F.col("ord") > _path(last)).join(head, "paper", "left_anti"), "tail")
    taken = []  # fewer than `per_study` rows, or than the budget if that is less
    while left > 0:
        rest = unseen.where((F.col("place") <= left) & ~F.col("paper").isin([r["paper"] for r in taken]))
        if last is not None:
            rest = rest.where(F.col("ord") > _path(last))
        last = rest.agg(F.min("ord").alias("ord")).first()["ord"]
        if last is None:
            break
        tried = first_per_key(rest.where(F.col("ord") == _path(last)), ["paper"], "entry_no").collect()
        taken += tried
        left -= len(tried)
    if not taken:
        return head
    return head.unionByName(unseen.where(reduce(or_, [
        (F.col("ord") == _path(r["ord"])) & (F.col("entry_no") == r["entry_no"]) for r in taken])))


def _path(ord: list[int]) -> Column:
    return F.array(*[F.lit(n).cast("bigint") for n in ord])


def harvest_rollup(events: DataFrame, seeds: int | Column, budget: int) -> DataFrame:
    """Frontier, candidates, kept and budget left of each generation.

    There is one row per generation, so the window below is tiny.
    """
    from pyspark.sql import Window
    per = events.groupBy("depth").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("kept").alias("kept"))
    w = Window.partitionBy(F.lit(0)).orderBy("depth")
    start = F.lit(seeds) if isinstance(seeds, int) else seeds
    return per.withColumn("frontier", F.coalesce(F.lag("kept").over(w), start.cast("bigint"))).withColumn(
        "budget_left", F.lit(budget) - F.sum("candidates").over(w))


def harvest_trace(events: DataFrame, rollup: DataFrame) -> DataFrame:
    """The chase as ordered report lines: generations, then candidates."""
    head = rollup.select(F.lit(0).alias("part"), F.col("depth").cast("bigint").alias("ord"), F.lit("").alias("paper"), F.concat(
        F.lit("depth "), "depth", F.lit(": frontier="), "frontier", F.lit(" candidates="), "candidates", F.lit(" kept="), "kept",
        F.lit(" budget_left="), "budget_left").alias("line"))
    state = F.when(F.col("kept"), F.lit("KEPT")).when(~F.col("acquired"), F.lit("DROPPED (not acquired)")).otherwise(
        F.concat(F.lit("DROPPED ("), "n_verified", F.lit(" primary quotes)")))
    rows = events.select(F.lit(1).alias("part"), F.col("depth").cast("bigint").alias("ord"), "paper", F.concat(
        F.lit("[depth "), "depth", F.lit("] "), state, F.lit(": "), "paper").alias("line"))
    return head.unionByName(rows)


def known_keys(studies: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keys of all works that need not be chased again."""
    return studies.select(candidate_key("paper_doi", "paper_title").alias("work_key")).unionByName(
        catalog.select(candidate_key("doi", "title").alias("work_key"))).where(~missing("work_key")).distinct()
