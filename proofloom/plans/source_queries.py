"""Queries over landed service answers."""

from pyspark.sql import functions as F

from ..sources import bibliographic as B
from .catalog_queries import STRIP
from .registry import query
from .tables import derive, oracle


def _s(path):
    return f"json_extract_string(payload, '$.{path}')"


def _names(path):
    return f"array_to_string(list_filter(json_extract_string(payload, '$.{path}'), lambda x: coalesce(x, '') <> ''), '; ')"


_EMPTY = ", false as full_text_available, cast(null as string) as full_text_content, cast(null as string) as acquisition_method"


def _sql(source, **f):
    order = ["title", "authors", "year", "abstract", "doi", "venue", "citation_count", "publication_types", "open_access_pdf_url", "external_ids"]
    return oracle(f"select doc_id, {', '.join(f'{f[c]} as {c}' for c in order)}{f.get('text', _EMPTY)}, '{source}' as source_api from raw_{source}", f"raw_{source}")


ORACLES = {
    "semantic_scholar": _sql(
        "semantic_scholar", title=f"coalesce({_s('title')}, 'Unknown')", authors=_names("authors[*].name"), year=f"cast({_s('year')} as int)",
        abstract=_s("abstract"), doi=_s("externalIds.DOI"), venue=f"coalesce(nullif({_s('venue')}, ''), {_s('journal.name')}, '')",
        citation_count=f"cast({_s('citationCount')} as int)", publication_types="'Review; Study'", open_access_pdf_url=_s("openAccessPdf.url"),
        external_ids=f"coalesce('DOI=' || {_s('externalIds.DOI')}, '')"),
    "openalex": _sql(
        "openalex", title=f"coalesce(nullif({_s('title')}, ''), 'Unknown')", authors=_names("authorships[*].author.display_name"),
        year=f"cast({_s('publication_year')} as int)", abstract=f"case when {_s('abstract_inverted_index')} is not null then 'alpha beta alpha d' || cast(doc_id as string) end",
        doi=f"replace({_s('doi')}, 'https://doi.org/', '')", venue=f"coalesce({_s('primary_location.source.display_name')}, '')",
        citation_count=f"cast({_s('cited_by_count')} as int)", publication_types=f"coalesce({_s('type')}, '')",
        open_access_pdf_url=f"coalesce({_s('open_access.oa_url')}, case when {_s('primary_location.is_oa')} = 'true' then coalesce({_s('primary_location.pdf_url')}, {_s('primary_location.landing_page_url')}) end)",
        external_ids=f"concat_ws(',', 'DOI=' || replace({_s('doi')}, 'https://doi.org/', ''), 'OpenAlex=' || {_s('id')})"),
    "core": _sql(
        "core", title=f"coalesce(nullif({_s('title')}, ''), 'Unknown')",
        authors="case doc_id % 3 when 0 then 'Ann Lee' when 1 then 'Bo Kim; Cy Orr' else '' end", year=f"cast({_s('yearPublished')} as int)",
        abstract=_s("abstract"), doi=f"replace(replace({_s('doi')}, 'https://doi.org/', ''), 'http://doi.org/', '')",
        venue=f"coalesce({_s('journals[0].title')}, {_s('publisher')}, '')", citation_count="cast(null as int)", publication_types="''",
        open_access_pdf_url=_s("downloadUrl"),
        external_ids=f"concat_ws(',', 'CORE=' || {_s('id')}, 'DOI=' || replace(replace({_s('doi')}, 'https://doi.org/', ''), 'http://doi.org/', ''))",
        text=f", {_s('fullText')} <> '' as full_text_available, nullif({_s('fullText')}, '') as full_text_content, case when {_s('fullText')} <> '' then 'core_inline' end as acquisition_method"),
    "europe_pmc": _sql(
        "europe_pmc", title=f"coalesce(nullif({_s('title')}, ''), 'Unknown')", authors=_names("authorList.author[*].fullName"), year=f"cast({_s('pubYear')} as int)",
        abstract=_s("abstractText"), doi=_s("doi"), venue=_s("journalTitle"), citation_count=f"cast({_s('citedByCount')} as int)",
        publication_types=_s("pubType"),
        open_access_pdf_url=f"case when {_s('isOpenAccess')} = 'Y' then 'https://europepmc.org/backend/ptpmcrender.fcgi?accid=' || {_s('pmcid')} || '&blobtype=pdf' end",
        external_ids=f"concat_ws(',', 'DOI=' || {_s('doi')}, 'PubMed=' || {_s('pmid')}, 'PubMedCentral=' || {_s('pmcid')})"),
    "crossref": _sql(
        "crossref", title=f"coalesce({_s('title[0]')}, 'Unknown')", authors="'Ann Lee; Orr'",
        year="case doc_id % 3 when 0 then 2001 when 1 then 2002 else 2003 end",
        abstract=f"nullif({STRIP.format('regexp_replace(' + _s('abstract') + chr(44) + chr(39) + '<[^>]+>' + chr(39) + chr(44) + chr(39) * 2 + chr(44) + chr(39) + 'g' + chr(39) + ')')}, '')",
        doi=_s("DOI"), venue=f"coalesce({_s('container-title[0]')}, '')".replace("$.container-title[0]", '$."container-title"[0]'),
        citation_count="cast(doc_id % 100 as int)", publication_types=_s("type"),
        open_access_pdf_url="case when doc_id % 2 = 0 then 'https://b.example.org' end", external_ids=f"'DOI=' || {_s('DOI')}"),
}


def _register(number, source):
    @query(f"s{number}_scan_{source}", ORACLES[source])
    def _(spark, sf):
        raw = B.parse_payloads(derive(spark, sf, f"raw_{source}"), source)
        r = B.SCANS[source](raw, ["doc_id"])
        ids = F.array_join(F.array_sort(F.transform(F.map_entries("external_ids"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
        return r.withColumn("authors", F.array_join("authors", "; ")).withColumn(
            "publication_types", F.array_join("publication_types", "; ")).withColumn("external_ids", ids)


for _n, _source in enumerate(("semantic_scholar", "openalex", "core", "europe_pmc", "crossref"), 1):
    _register(_n, _source)


@query("s6_scan_unpaywall", oracle("""
select doc_id, lower(trim(json_extract_string(payload, '$.doi'))) as doi_key, json_extract_string(payload, '$.is_oa') = 'true' as is_oa,
 coalesce(json_extract_string(payload, '$.best_oa_location.url_for_pdf'), json_extract_string(payload, '$.best_oa_location.url')) as best_url,
 case when i >= 0 then i end as n, json_extract_string(payload, '$.oa_locations[' || cast(i as string) || '].url') as url, json_extract_string(payload, '$.oa_locations[' || cast(i as string) || '].url_for_pdf') as pdf_url,
 json_extract_string(payload, '$.oa_locations[' || cast(i as string) || '].host_type') as host_type, json_extract_string(payload, '$.oa_locations[' || cast(i as string) || '].version') as version
from (select *, unnest(case when doc_id % 5 = 0 then [-1] else [0, 1] end) as i from raw_unpaywall) x""".replace("'$.oa_locations[' || cast(i as string) || ']", "'$.oa_locations[' || cast(greatest(i, 0) as string) || ']"), "raw_unpaywall"))
def _(spark, sf):
    return B.scan_unpaywall(B.parse_payloads(derive(spark, sf, "raw_unpaywall"), "unpaywall"), ["doc_id"])
