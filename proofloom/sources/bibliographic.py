"""Landed answers of bibliographic services, read with explicit schemas and
brought into one record form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import abstract_from_index, missing, strip, strip_tags
from ..operators.catalog import RENDER_PDF, fill

# The fields read from each service.
SCHEMAS = {
    "semantic_scholar": """title string, authors array<struct<name:string>>, year int, abstract string,
        externalIds map<string,string>, openAccessPdf struct<url:string>, venue string,
        journal struct<name:string>, citationCount int, publicationTypes array<string>""",
    "openalex": """id string, title string, doi string, publication_year int, cited_by_count int, type string,
        authorships array<struct<author:struct<display_name:string>>>, open_access struct<oa_url:string>,
        primary_location struct<is_oa:boolean,pdf_url:string,landing_page_url:string,source:struct<display_name:string>>,
        abstract_inverted_index map<string,array<int>>""",
    "core": """id string, title string, authors array<string>, doi string, downloadUrl string,
        journals array<struct<title:string>>, publisher string, fullText string, yearPublished int,
        abstract string, citationCount int""",
    "europe_pmc": """title string, authorList struct<author:array<struct<fullName:string>>>, doi string, pmid string,
        pmcid string, isOpenAccess string, journalTitle string, citedByCount int, abstractText string,
        pubYear string, pubType string""",
    "crossref": """title array<string>, author array<struct<given:string,family:string>>, DOI string,
        `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>,
        created struct<`date-parts`:array<array<int>>>, `container-title` array<string>, abstract string,
        `is-referenced-by-count` int, link array<struct<`content-type`:string,URL:string>>, type string""",
    "unpaywall": """doi string, is_oa boolean, best_oa_location struct<url:string,url_for_pdf:string>,
        oa_locations array<struct<url:string,url_for_pdf:string,host_type:string,version:string>>""",
}



def read_landed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Landed JSON files of one service, one answer per line."""
    return spark.read.schema(SCHEMAS[source]).json(path)


def parse_payloads(payloads: DataFrame, source: str, column: str = "payload") -> DataFrame:
    """Answers held as JSON text in a column; other columns are kept."""
    rest = [c for c in payloads.columns if c != column]
    return payloads.select(*rest, F.from_json(column, SCHEMAS[source]).alias("_j")).select(*rest, "_j.*")


def _text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def _names(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda a: ~missing(a))


def _ids(**ids: Column) -> Column:
    pairs = [x for k, v in ids.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: ~missing(v))


def _one(c: Column) -> Column:
    return F.when(missing(c), F.array().cast("array<string>")).otherwise(F.array(c))


def _bare_doi(c: str, *prefixes: str) -> Column:
    d = F.col(c)
    for p in prefixes:
        d = F.replace(d, F.lit(p), F.lit(""))
    return F.nullif(d, F.lit(""))


def _record(df: DataFrame, keep: list[str], source: str, **f: Column) -> DataFrame:
    f = {"full_text_available": F.lit(False), "full_text_content": F.lit(None).cast("string"),
         "acquisition_method": F.lit(None).cast("string"), **f}
    order = ["title", "authors", "year", "abstract", "doi", "venue", "citation_count", "publication_types",
             "open_access_pdf_url", "external_ids", "full_text_available", "full_text_content", "acquisition_method"]
    return df.select(*keep, *[f[c].alias(c) for c in order], F.lit(source).alias("source_api"))


def scan_semantic_scholar(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return _record(
        df, list(keep), "semantic_scholar", title=F.coalesce("title", F.lit("Unknown")), authors=_names(F.col("authors.name")),
        year=F.col("year"), abstract=F.col("abstract"), doi=F.col("externalIds")["DOI"],
        venue=F.coalesce(_text("venue"), F.col("journal.name"), F.lit("")), citation_count=F.col("citationCount"),
        publication_types=F.coalesce("publicationTypes", F.array().cast("array<string>")),
        open_access_pdf_url=F.col("openAccessPdf.url"),
        external_ids=F.coalesce("externalIds", F.create_map().cast("map<string,string>")))


def scan_openalex(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    doi = _bare_doi("doi", "https://doi.org/")
    place = F.when(F.col("primary_location.is_oa"),
                   F.coalesce(_text("primary_location.pdf_url"), F.col("primary_location.landing_page_url")))
    return _record(
        df, list(keep), "openalex", title=F.coalesce(_text("title"), F.lit("Unknown")),
        authors=_names(F.col("authorships.author.display_name")), year=F.col("publication_year"),
        abstract=abstract_from_index("abstract_inverted_index"), doi=doi,
        venue=F.coalesce("primary_location.source.display_name", F.lit("")), citation_count=F.col("cited_by_count"),
        publication_types=_one(F.col("type")), open_access_pdf_url=F.coalesce(_text("open_access.oa_url"), place),
        external_ids=_ids(DOI=doi, OpenAlex=F.col("id")))


def scan_core(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Authors come as objects or plain strings; some answers carry the text."""
    doi = _bare_doi("doi", "https://doi.org/", "http://doi.org/")
    names = F.transform("authors", lambda a: F.when(
        F.startswith(a, F.lit("{")), F.get_json_object(a, "$.name")).otherwise(a))
    inline = ~missing("fullText")
    return _record(
        df, list(keep), "core", title=F.coalesce(_text("title"), F.lit("Unknown")), authors=_names(names),
        year=F.col("yearPublished"), abstract=F.col("abstract"), doi=doi,
        venue=F.coalesce(_text(F.get("journals", F.lit(0))["title"]), F.col("publisher"), F.lit("")),
        citation_count=F.col("citationCount"), publication_types=F.array().cast("array<string>"),
        open_access_pdf_url=F.col("downloadUrl"), external_ids=_ids(DOI=doi, CORE=F.col("id")),
        full_text_available=inline, full_text_content=F.when(inline, F.col("fullText")),
        acquisition_method=F.when(inline, F.lit("core_inline")))


def scan_europe_pmc(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    link = F.when((F.col("isOpenAccess") == "Y") & ~missing("pmcid"), fill(RENDER_PDF, F.col("pmcid")))
    return _record(
        df, list(keep), "europe_pmc", title=F.coalesce(_text("title"), F.lit("Unknown")),
        authors=_names(F.col("authorList.author.fullName")), year=F.expr("try_cast(pubYear as int)"),
        abstract=F.col("abstractText"), doi=F.col("doi"), venue=F.coalesce("journalTitle", F.lit("")),
        citation_count=F.col("citedByCount"), publication_types=_one(F.col("pubType")), open_access_pdf_url=link,
        external_ids=_ids(DOI=F.col("doi"), PubMed=F.col("pmid"), PubMedCentral=F.col("pmcid")))


def scan_crossref(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    names = F.transform("author", lambda a: strip(F.concat_ws(" ", a["given"], a["family"])))

    def year(field: str) -> Column:
        return F.get(F.get(F.col(f"`{field}`.`date-parts`"), F.lit(0)), F.lit(0))

    pdf = F.filter("link", lambda x: x["content-type"] == "application/pdf")
    return _record(
        df, list(keep), "crossref", title=F.coalesce(F.get("title", F.lit(0)), F.lit("Unknown")), authors=_names(names),
        year=F.coalesce(*[F.nullif(year(f), F.lit(0)) for f in ("published-print", "published-online", "created")]),
        abstract=_text(strip_tags("abstract")), doi=F.col("DOI"),
        venue=F.coalesce(F.get(F.col("`container-title`"), F.lit(0)), F.lit("")),
        citation_count=F.col("`is-referenced-by-count`"), publication_types=_one(F.col("type")),
        open_access_pdf_url=F.get(pdf, F.lit(0))["URL"], external_ids=_ids(DOI=F.col("DOI")))


def scan_unpaywall(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per alternate location with the best link of the answer."""
    best = F.coalesce(_text("best_oa_location.url_for_pdf"), F.col("best_oa_location.url"))
    return df.select(*keep, F.lower(strip("doi")).alias("doi_key"), F.coalesce("is_oa", F.lit(False)).alias("is_oa"),
                     best.alias("best_url"), F.posexplode_outer("oa_locations").alias("n", "l")).select(
        *keep, "doi_key", "is_oa", "best_url", "n", F.col("l.url").alias("url"), F.col("l.url_for_pdf").alias("pdf_url"),
        F.col("l.host_type").alias("host_type"), F.col("l.version").alias("version"))


SCANS = {"semantic_scholar": scan_semantic_scholar, "openalex": scan_openalex, "core": scan_core,
         "europe_pmc": scan_europe_pmc, "crossref": scan_crossref, "unpaywall": scan_unpaywall}
