"""Linking, deduplicating and summarising bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import doi_key, paper_id, title_key, title_usable
from ..functions.text import missing, preview, strip
from ..session import cut_lineage
from .prefix import first_n_per_key, first_per_key, running_totals


def derive_paper_id(papers: DataFrame) -> DataFrame:
    return papers.withColumn("paper_id", paper_id("doi", "title"))


def catalog_entry(papers: DataFrame) -> DataFrame:
    """Preview of a record: three authors, 300 characters of abstract."""
    return papers.select(
        "paper_id", "title", F.slice("authors", 1, 3).alias("authors"), "year", "venue",
        "citation_count", "doi", F.col("full_text_available").alias("has_full_text"),
        preview("abstract", 300).alias("abstract_preview"), "source_api")


def _take_fields(chosen: DataFrame, keys: list[str], own: str, roles: dict[str, str],
                 rows: DataFrame, row_id: str, rest: list[str]) -> DataFrame:
    """Fetch the row `own` points at, and each field of `roles` from the row its
    column points at.

    Only identifiers were aggregated so far. A role that points at the own row
    needs nothing more; the others are few and are looked up in one join.
    """
    base = chosen.join(rows.select(F.col(row_id).alias(own), *rest, *roles), own)
    elsewhere = chosen.select(*keys, F.explode(F.filter(
        F.array(*[F.struct(F.lit(f).alias("role"), F.when(F.col(c) != F.col(own), F.col(c)).alias("id")) for f, c in roles.items()]),
        lambda x: x["id"].isNotNull())).alias("x")).select(*keys, "x.role", F.col("x.id").alias(row_id))
    found = elsewhere.join(rows.select(row_id, *roles), row_id).groupBy(*keys).agg(
        *[F.max(F.when(F.col("role") == f, F.col(f))).alias(f"_{f}") for f in roles])
    out = base.join(found, keys, "left")
    for f, c in roles.items():
        out = out.withColumn(f, F.when(F.col(c) != F.col(own), F.col(f"_{f}")).otherwise(F.col(f)))
    return out.drop(*[f"_{f}" for f in roles])


def link_search_hits(hits: DataFrame) -> DataFrame:
    """Union of the hits of one query: the first record of a DOI (else of an
    identity) stands; later records of that DOI only fill an absent open-access
    link or abstract. `ord` numbers the hits of all queries."""
    fill = ~missing("doi")
    slim = hits.select("query_id", "ord", paper_id("doi", "title").alias("link_key"), fill.alias("fill"),
                       (~missing("open_access_pdf_url")).alias("has_pdf"), (~missing("abstract")).alias("has_abstract"))
    chosen = slim.groupBy("query_id", "link_key").agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_hits"),
        F.min(F.when(F.col("fill") & F.col("has_pdf"), F.col("ord"))).alias("pdf_ord"),
        F.min(F.when(F.col("fill") & F.col("has_abstract"), F.col("ord"))).alias("abstract_ord"))
    rest = [c for c in hits.columns if c not in ("query_id", "ord", "open_access_pdf_url", "abstract")]
    return _take_fields(chosen, ["query_id", "link_key"], "ord",
                        {"open_access_pdf_url": "pdf_ord", "abstract": "abstract_ord"}, hits, "ord", rest).drop(
                            "pdf_ord", "abstract_ord")


# The longest abstract and, among those, the earliest record are one decimal
# maximum, which hash aggregation can hold. It has room for any length (an int)
# before any record number (a long).
_LAST_SEQ = (1 << 63) - 1
_ROOM = "1" + "0" * 20


def _longest_first(text: str, seq: str) -> Column:
    return (F.length(text).cast("decimal(11,0)") * F.lit(_ROOM).cast("decimal(21,0)")
            + (F.lit(_LAST_SEQ).cast("decimal(20,0)") - F.col(seq).cast("decimal(20,0)")))


def _seq_of_longest(packed: str) -> Column:
    return (F.lit(_LAST_SEQ).cast("decimal(20,0)") - F.col(packed) % F.lit(_ROOM).cast("decimal(21,0)")).cast("bigint")


def resolve_catalog(papers: DataFrame) -> DataFrame:
    """One record per work, with the metadata of its copies merged in.

    Records are grouped by DOI (by identity when they have none), then the
    earliest record of each group is grouped by title when the title is long
    enough. The earliest record survives. Copies add the longest abstract, the
    highest citation count and the first open-access link, external id and full
    text. One exception keeps arrival-order semantics: a record without a DOI
    that repeats the identity of the survivor adds nothing.

    Both groupings fold plain numbers (which record supplies which field), so
    they hash-aggregate before the shuffle, a work with very many copies costs
    one row per task, and texts move only once, at the end. If the records have
    a map `external_ids`, a work gets the first value of each kind of identifier.
    """
    seq = F.col("seq")
    dkey = doi_key("doi")
    k1 = F.when(dkey != "", F.concat(F.lit("d"), dkey)).otherwise(F.concat(F.lit("p"), paper_id("doi", "title")))

    def supplier(ok) -> Column:
        return F.when(ok, seq)

    slim = papers.select(
        "seq", k1.alias("k1"),
        # The title key as two hashes: grouping by them is grouping by the key.
        F.when(title_usable("title"), F.xxhash64(title_key("title"))).alias("t1"),
        F.when(title_usable("title"), F.xxhash64(F.lit("second"), title_key("title"))).alias("t2"),
        F.when(~missing("abstract"), _longest_first("abstract", "seq")).alias("abstract"),
        F.when(F.col("citation_count") > 0, F.col("citation_count")).alias("cites"),
        supplier(~missing("open_access_pdf_url")).alias("pdf"), supplier(F.col("full_text_available")).alias("full"),
        supplier(~missing("pmcid")).alias("pmc"), supplier(~missing("arxiv_id")).alias("arx"))
    least, most = ["pdf", "full", "pmc", "arx"], ["abstract", "cites"]

    def fold(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
        return rows.groupBy(*by).agg(*more, *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])

    level1 = fold(slim, ["k1"], F.min("seq").alias("rep"), F.count(F.lit(1)).alias("n_records"),
                  F.min_by("t1", "seq").alias("t1"), F.min_by("t2", "seq").alias("t2"),
                  *[F.min_by(c, "seq").alias(f"first_{c}") for c in least + most])
    level1 = level1.withColumn("g1", F.coalesce("t1", F.xxhash64(F.lit("own"), "k1"))).withColumn(
        "g2", F.coalesce("t2", F.xxhash64(F.lit("own second"), "k1"))).drop("t1", "t2")
    # Both uses below read this table of numbers; the records are read once.
    level1 = cut_lineage(level1, "catalog-groups")
    survivors = level1.groupBy("g1", "g2").agg(F.min("rep").alias("survivor"))
    member = level1.join(survivors, ["g1", "g2"])
    # A group without a DOI whose earliest record survives keeps that record only.
    alone = F.startswith(F.col("k1"), F.lit("p")) & (F.col("rep") == F.col("survivor"))
    for c in least + most:
        member = member.withColumn(c, F.when(alone, F.col(f"first_{c}")).otherwise(F.col(c)))
    merged = fold(member, ["survivor"], F.sum("n_records").alias("n_records"))
    chosen = merged.withColumn("abstract_seq", _seq_of_longest("abstract")).drop("abstract")

    rest = ["title", "authors", "year", "venue", "doi", "source_api", "citation_count"]
    roles = {"abstract": "abstract_seq", "open_access_pdf_url": "pdf", "pmcid": "pmc", "arxiv_id": "arx",
             "full_text_content": "full", "acquisition_method": "full"}
    out = _take_fields(chosen, ["survivor"], "survivor", roles, papers, "seq", rest)
    ids = []
    if "external_ids" in papers.columns:
        records = papers.select("seq", k1.alias("k1"), "external_ids")
        out = out.join(_merged_ids(records, member.select("k1", "rep", "survivor", alone.alias("alone"))), "survivor", "left")
        ids = [F.coalesce("ids", F.create_map().cast("map<string,string>")).alias("external_ids")]
    return out.select(
        F.col("survivor").alias("seq"), paper_id("doi", "title").alias("paper_id"), "title", "authors", "year", "venue",
        "doi", "source_api", "abstract", F.coalesce("cites", "citation_count").alias("citation_count"),
        "open_access_pdf_url", "pmcid", "arxiv_id", F.col("full").isNotNull().alias("full_text_available"),
        "full_text_content", "acquisition_method", "n_records", *ids)


def _merged_ids(records: DataFrame, member: DataFrame) -> DataFrame:
    """(survivor, ids): the earliest value of each kind of identifier among the records of a work.

    Which record supplies a kind is folded as numbers, first within a group and
    then within a work; values are fetched at the end, one for each kind.
    """
    entries = records.select("seq", "k1", F.explode("external_ids").alias("kind", "value")).where(~missing("value"))
    firsts = entries.groupBy("k1", "kind").agg(F.min("seq").alias("seq"))
    # A group that adds nothing has its own earliest record only.
    live = firsts.join(member, "k1").where(~F.col("alone") | (F.col("seq") == F.col("rep")))
    chosen = live.groupBy("survivor", "kind").agg(F.min("seq").alias("seq"))
    found = chosen.join(entries.select("seq", "kind", "value"), ["seq", "kind"])
    return found.groupBy("survivor").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "value")))).alias("ids"))


def external_ids(papers: DataFrame) -> DataFrame:
    """Known identifiers of a record as a map without empty entries."""
    return papers.withColumn("external_ids", F.map_filter(
        F.create_map(F.lit("DOI"), F.col("doi"), F.lit("PubMedCentral"), F.col("pmcid"),
                     F.lit("ArXiv"), F.col("arxiv_id")), lambda k, v: ~missing(v)))


def api_stats(calls: DataFrame) -> DataFrame:
    """Queries, results, errors and rates of each source."""
    failed = F.col("error").isNotNull()
    return calls.groupBy("api").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.sum(F.when(failed, 0).otherwise(F.col("n_results"))).alias("total_results"),
        F.count_if(failed).alias("total_errors"),
        F.max_by("error", F.when(failed, F.col("call_id"))).alias("last_error")).withColumn(
            "success_rate", (F.col("total_queries") - F.col("total_errors")) / F.col("total_queries")).withColumn(
            "avg_results", F.when(F.col("total_queries") > F.col("total_errors"),
                                  F.col("total_results") / (F.col("total_queries") - F.col("total_errors")))
            .otherwise(F.lit(0.0)))


def running_response_time(calls: DataFrame) -> DataFrame:
    """Mean response time of each source up to and including each call."""
    run = running_totals(calls, ["api"], "call_id",
                         {"_n": F.lit(1).cast("bigint"), "_sum": F.col("response_time").cast("decimal(18,6)")})
    return run.withColumn("avg_response_time", F.col("_sum").cast("double") / F.col("_n")).drop("_n", "_sum")


def catalog_summary(papers: DataFrame) -> DataFrame:
    """Totals and counts per source. The abstract-only figure is a plain
    difference and may be negative; `text_availability` counts it exactly."""
    per_source = papers.groupBy("source_api").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("full_text_available").alias("ft"),
        F.count_if(~missing("abstract")).alias("ab"))
    return per_source.agg(
        F.sum("n").alias("total_papers"), F.sum("ft").alias("with_full_text"),
        (F.sum("ab") - F.sum("ft")).alias("with_abstract_only"),
        F.array_join(F.array_sort(F.collect_list(
            F.concat_ws("=", "source_api", "n"))), ",").alias("by_source"))


def availability(full_text="full_text_available", abstract="abstract"):
    return (F.when(F.col(full_text), F.lit("full text"))
            .when(~missing(abstract), F.lit("abstract only")).otherwise(F.lit("metadata only")))


def text_availability(papers: DataFrame) -> DataFrame:
    return papers.groupBy(availability().alias("status")).agg(F.count(F.lit(1)).alias("n"))


def evidence_inventory(papers: DataFrame, read_ids: DataFrame, pool: DataFrame,
                       curated: DataFrame, decisions: DataFrame, rounds: DataFrame) -> DataFrame:
    """Evidence that is held but not used, as one row."""
    def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return rows.join(ids.select("paper_id").distinct().withColumn("_seen", F.lit(True)), "paper_id", "left")

    full, new = F.col("full_text_available"), F.col("_seen").isNull()
    records = marked(papers, read_ids).agg(
        F.count("*").alias("catalog"), F.count_if(full).alias("full_text"), F.count_if(full & new).alias("unread_full_text"))
    pooled = marked(pool, curated).agg(F.count("*").alias("pool"), F.count_if(new).alias("pool_unused"))
    totals = records
    for part in (pooled, curated.agg(F.count("*").alias("curated")),
                 decisions.agg(F.count_if(~F.col("include")).alias("curation_excluded")),
                 rounds.agg(F.coalesce(F.max("round"), F.lit(0)).alias("standard_rounds"))):
        totals = totals.unionByName(part, allowMissingColumns=True)
    return totals.agg(*[F.max(c).alias(c) for c in totals.columns])


def backfill_venue(studies: DataFrame, catalog: DataFrame) -> DataFrame:
    """Fill an absent venue from the catalog: by paper id, else by DOI. The DOI
    is only tried when the id is not in the catalog."""
    by_id = catalog.groupBy("paper_id").agg(F.max_by("venue", "seq").alias("_venue_id"),
                                            F.lit(True).alias("_known"))
    by_doi = (catalog.withColumn("_dk", doi_key("doi", "venue")).where("_dk <> ''")
              .groupBy("_dk").agg(F.min_by("venue", "seq").alias("_venue_doi")))
    dk = doi_key("paper_doi", "venue")
    s = studies.withColumn("_dk", F.when(dk != "", dk))
    joined = s.join(by_id, "paper_id", "left").join(by_doi, "_dk", "left")
    found = F.when(F.col("_known"), F.col("_venue_id")).otherwise(F.col("_venue_doi"))
    return joined.withColumn("paper_venue", F.when(
        strip(F.coalesce("paper_venue", F.lit(""))) != "", F.col("paper_venue")).otherwise(
            F.coalesce(F.nullif(strip(found), F.lit("")), F.col("paper_venue")))).drop(
                "_dk", "_venue_id", "_known", "_venue_doi")


def append_pool(pool: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Append-only union: the first entry of each paper, blank ids left out."""
    both = pool.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_per_key(both.where(~missing("paper_id")), ["paper_id"], "_new", order).drop("_new")


def merge_preserved(preserved: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """All preserved rows and the first new row of each paper not among them."""
    fresh = new.join(preserved.select("paper_id").distinct(), "paper_id", "left_anti")
    return preserved.unionByName(first_per_key(fresh, ["paper_id"], order).select(*preserved.columns))


def suppress_repeat_queries(queries: DataFrame) -> DataFrame:
    """Mark a query that ran before under the same key."""
    keyed = queries.withColumn("query_key", title_key("query"))
    first = keyed.where("query_key <> ''").groupBy("run_id", "query_key").agg(F.min("round").alias("_first"))
    return keyed.join(first, ["run_id", "query_key"], "left").withColumn(
        "outcome", F.when(F.col("round") > F.col("_first"), F.lit("skipped_duplicate_query"))
        .otherwise(F.lit("searched"))).drop("_first")


def limit_hits(hits: DataFrame, per_api: int = 20) -> DataFrame:
    """First hits of each source within a query."""
    return first_n_per_key(hits, ["query_id", "source_api"], per_api, F.col("ord"))


# Places where a full text of a known identifier is kept.
PMC_PDF = "https://www.ncbi.nlm.nih.gov/pmc/articles/{}/pdf/"
ARXIV_PDF = "https://arxiv.org/pdf/{}.pdf"
RENDER_PDF = "https://europepmc.org/backend/ptpmcrender.fcgi?accid={}&blobtype=pdf"


def fill(template: str, value):
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value, F.lit(tail))


def url_builders(papers: DataFrame) -> DataFrame:
    ids = F.col("external_ids")
    pmc = F.coalesce(F.nullif(ids["PubMedCentral"], F.lit("")), ids["PMCID"])
    return papers.select(
        "seq", fill(PMC_PDF, pmc).alias("pmc_url"), fill(ARXIV_PDF, ids["ArXiv"]).alias("arxiv_url"),
        fill(RENDER_PDF, pmc).alias("render_url"))


def route_candidates(papers: DataFrame, locations: DataFrame) -> DataFrame:
    """Places to fetch each paper from, in the order they are tried.

    `locations` holds, per DOI key, the best open-access link, the alternates
    in order, an index link and the links of a title search.
    """
    p = papers.where(~F.col("full_text_available")).withColumn("_dk", doi_key("doi"))
    known = p.join(locations.withColumnRenamed("doi_key", "_dk"), "_dk", "left")

    def entry(rank: int, url, method):
        return F.struct(F.lit(rank).alias("priority"), url.alias("url"), method.alias("method"))

    alternates = F.transform(
        F.filter(F.coalesce("alternates", F.array().cast(locations.schema["alternates"].dataType)),
                 lambda a: ~missing(a["url"]) & (a["url"] != F.col("best_url"))),
        lambda a, i: F.struct((F.lit(3) + i * 0).cast("int").alias("priority"), a["url"].alias("url"),
                              F.concat(F.lit("unpaywall_"), F.coalesce(a["host_type"], F.lit("?"))).alias("method")))
    steps = F.concat(
        F.array(entry(1, F.col("open_access_pdf_url"), F.lit("direct_oa")),
                entry(2, F.col("best_url"), F.lit("unpaywall"))),
        F.when(~missing("best_url"), alternates).otherwise(F.slice(alternates, 1, 0)),
        F.array(entry(4, fill(PMC_PDF, F.col("pmcid")), F.lit("pmc")),
                entry(5, fill(ARXIV_PDF, F.col("arxiv_id")), F.lit("arxiv")),
                entry(6, F.col("index_url"), F.lit("openalex_crossref")),
                entry(7, F.col("core_url"), F.lit("core_title"))))
    tried = F.filter(steps, lambda s: ~missing(s["url"]))
    return known.select("seq", F.posexplode(tried).alias("step", "c")).select(
        "seq", "step", F.col("c.url").alias("url"), F.col("c.method").alias("method"))


def acquisition_route(candidates: DataFrame, payloads: DataFrame) -> DataFrame:
    """The first candidate whose payload was accepted; html payloads mark the method."""
    outcome = candidates.join(payloads, "url", "left")
    ok = F.coalesce(F.col("accepted"), F.lit(False))
    method = F.when(F.col("kind") == "html", F.concat("method", F.lit("_html"))).otherwise(F.col("method"))
    return outcome.groupBy("seq").agg(
        F.min_by(method, F.when(ok, F.col("step"))).alias("acquisition_method"),
        F.min_by("url", F.when(ok, F.col("step"))).alias("url"),
        F.count(F.lit(1)).alias("n_candidates"))

