"""Input tables derived from the given tables.

The given tables hold no bibliographic fields, so the fields are derived by
plain SQL over the whole tables. The text is the same for Spark and for the
checking engine; only the array constructor and the way a base table is named
differ between the two.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

_AUTHORS = """case doc_id % 8
 when 0 then @arr('Jack Kingdon')
 when 1 then @arr('Salotti JM', 'Cornet JF')
 when 2 then @arr('Suzanne M. de la Monte', 'J. M. Salotti', 'Alam SS')
 when 3 then @arr('Smith, J. A.')
 when 4 then @arr('Maria van der Berg', 'Smith, J. A.')
 when 5 then @arr('Author' || cast(doc_id % 40 as string) || ' AB', 'Second Person')
 when 6 then @arr('Given Name' || cast(doc_id % 50 as string), 'Jones', 'Lee K', 'Ana Maria da Silva')
 else @arr() end"""

SQL = {
    "papers": f"""
select doc_id as seq, cast(doc_id % 5 as int) as api_rank,
 case doc_id % 5 when 0 then 'semantic_scholar' when 1 then 'openalex' when 2 then 'core'
   when 3 then 'europe_pmc' else 'crossref' end as source_api,
 split_part(text, chr(10), 1) as title,
 {_AUTHORS} as authors,
 case when doc_id % 13 = 0 then null else cast(1990 + doc_id % 35 as int) end as year,
 case when doc_id % 3 = 0 then null else split_part(text, chr(10), 2) end as abstract,
 case when doc_id % 4 = 3 then null
   when doc_id % 7 = 0 then ' ' || upper('10.5555/' || substring(md5(text), 1, 10))
   else '10.5555/' || substring(md5(text), 1, 10) end as doi,
 case when doc_id % 5 = 0 then '' else 'Journal ' || cast(doc_id % 11 as string) end as venue,
 case when doc_id % 6 = 5 then null else cast((doc_id * 37) % 500 as int) end as citation_count,
 case when doc_id % 3 = 1 then 'https://oa.example.org/' || cast(doc_id as string) || '.pdf'
   when doc_id % 3 = 2 then '' end as open_access_pdf_url,
 case when doc_id % 8 = 0 then 'PMC' || cast(100000 + doc_id as string) end as pmcid,
 case when doc_id % 9 = 0 then '2001.' || cast(10000 + doc_id as string) end as arxiv_id,
 doc_id % 2 = 0 as full_text_available,
 case when doc_id % 2 = 0 then text end as full_text_content,
 case when doc_id % 2 = 0 then 'landed' end as acquisition_method
from {{documents}}""",
    "keyed_papers": """
select *,
 case when doi is not null and doi <> '' then 'doi:' || lower(trim(doi))
   else 'hash:' || substring(md5(lower(trim(title))), 1, 12) end as paper_id
from @papers""",
    "search_hits": """
select cast(floor(seq / 50) as bigint) as query_id, cast(api_rank as bigint) * 1000000000 + seq as ord, *
from @keyed_papers""",
    "articles": """
select doc_id,
 'Front matter of item ' || cast(doc_id as string) || chr(10) ||
 case when doc_id % 3 = 0 then '' else 'Abstract' || chr(10) end ||
 substring(text, 1, cast(floor(length(text) * 0.1) as int)) || chr(10) ||
 '1. Introduction' || chr(10) || substring(text, cast(floor(length(text) * 0.1) as int) + 1, cast(floor(length(text) * 0.2) as int)) || chr(10) ||
 'Materials and Methods' || chr(10) || substring(text, cast(floor(length(text) * 0.3) as int) + 1, cast(floor(length(text) * 0.2) as int)) || chr(10) ||
 case when doc_id % 5 = 0 then 'Main Findings' else '## Results & Discussion' end || chr(10) ||
 substring(text, cast(floor(length(text) * 0.5) as int) + 1, length(text)) || chr(10) ||
 'REFERENCES:' || chr(10) ||
 '1. Smith J. First cited work on the topic. 10.5555/' || substring(md5(cast((doc_id * 7 + 1) % 1000 as string)), 1, 10) || chr(10) ||
 '2. Jones K. Second cited work on the topic. https://doi.org/10.5555/' || substring(md5(cast((doc_id * 3 + 2) % 1000 as string)), 1, 10) || '.' || chr(10) ||
 '[3] ' || split_part(text, chr(10), 1) || chr(10) ||
 '4) short' || chr(10) ||
 case when doc_id % 4 = 0 then 'Discussion' || chr(10) || 'Closing words of item ' || cast(doc_id as string) || '.' else '' end as article
from {documents}""",
    "proposals": """
select doc_id as quote_id, doc_id, cast(doc_id % 5 as int) as pos,
 case doc_id % 8
   when 0 then line
   when 1 then replace(line, ' ', '  ')
   when 2 then translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
   when 3 then replace(line, ' the ', ' teh ')
   when 4 then 'In 1999 ' || line
   when 5 then other
   when 6 then substring(line, 1, 15)
   else line || ' as well' end as quote,
 case doc_id % 4 when 0 then 'high' when 1 then 'LOW' when 2 then 'medium' else 'unknown' end as importance,
 'context ' || cast(doc_id % 9 as string) as context
from (select d.doc_id, case when split_part(d.text, chr(10), 3) <> '' then split_part(d.text, chr(10), 3)
        else split_part(d.text, chr(10), 1) end as line, b.text as other
      from {documents} d join {benchmark} b
        on b.item_id = d.doc_id % (select count(*) from {benchmark})) x""",
    "search_calls": """
select event_id as call_id, ts,
 case user_id % 5 when 0 then 'semantic_scholar' when 1 then 'openalex' when 2 then 'core'
   when 3 then 'europe_pmc' else 'crossref' end as api,
 cast(case when event_type = 'error' then 0 else event_id % 21 end as int) as n_results,
 case when event_type = 'error' then 'HTTP ' || cast(400 + event_id % 30 as string) end as error,
 value as response_time
from {events}""",
    "search_rounds": """
select user_id as run_id, cast(extract(day from ts) as bigint) as round,
 sum(case when event_type = 'purchase' then 1 else 0 end) as added,
 sum(case when event_type = 'view' then 1 else 0 end) as engagements,
 min(case when event_type = 'click' then 'Topic ' || cast(event_id % 12 as string)
   else 'topic: ' || cast(event_id % 7 as string) end) as query,
 cast(extract(day from ts) as bigint) % 3 > 0 as tangential, sum(value) as minutes
from {events} group by user_id, cast(extract(day from ts) as bigint)""",
    "candidates": """
select cast(floor(doc_id / 10) as bigint) as query_id, cast(doc_id % 10 + 1 as bigint) as paper_index,
 doc_id as seq, split_part(text, chr(10), 1) as title from {documents}""",
    "selections": """
select cast(floor(doc_id / 10) as bigint) as query_id, doc_id as sel,
 case when doc_id % 7 = 3 then 'none' else cast((case when doc_id % 7 = 1 then doc_id % 10 + 2 else doc_id % 10 + 1 end) as string) end as paper_index,
 case doc_id % 7
   when 2 then '' when 4 then '[2019] ' || split_part(text, chr(10), 1)
   when 5 then 'A title that no candidate of this query carries at all'
   else split_part(text, chr(10), 1) end as title,
 'reason ' || cast(doc_id % 3 as string) as reason
from {documents}""",
    "studies": f"""
select cast(floor(doc_id / 4) as bigint) as review_id, cast(doc_id % 4 + 1 as bigint) as study_index, doc_id,
 case when doc_id % 4 = 3 then 'hash:' || substring(md5(lower(trim(split_part(text, chr(10), 1)))), 1, 12)
   else 'doi:10.5555/' || substring(md5(text), 1, 10) end as paper_id,
 split_part(text, chr(10), 1) as paper_title,
 {_AUTHORS} as paper_authors,
 case when doc_id % 13 = 0 then null else cast(1990 + doc_id % 35 as int) end as paper_year,
 case when doc_id % 6 = 0 then null when doc_id % 6 = 1 then ' ' else 'Journal ' || cast(doc_id % 11 as string) end as paper_venue,
 case when doc_id % 4 = 3 then null else 'https://doi.org/10.5555/' || substring(md5(text), 1, 10) end as paper_doi,
 case doc_id % 7 when 0 then 'RCT' when 1 then 'review' when 2 then ' Cohort_Study ' when 3 then 'meta_analysis'
   when 4 then 'blog post' when 5 then null else 'case_report' end as study_type,
 case doc_id % 5 when 0 then '8' when 1 then 'high' when 2 then null when 3 then '6.5' else '3' end as reliability_score,
 case when doc_id % 3 = 0 then null else 'n=' || cast(doc_id % 300 as string) end as sample_size,
 case when doc_id % 5 = 4 then ' ' else split_part(text, chr(10), 1) end as study_summary,
 doc_id % 2 = 0 as has_full_text
from {{documents}}""",
    "study_quotes": """
select review_id, study_index, doc_id, pos, doc_id * 4 + pos as quote_ord, quote,
 case when quote = '' then false else (doc_id + pos) % 5 <> 0 end as verified,
 case when (doc_id + pos) % 5 <> 0 then 'exact'
   when doc_id % 3 = 0 then 'rejected_non_evidence_section'
   when doc_id % 3 = 1 then 'rejected_secondhand_citation' else 'not_found' end as verification_method,
 case doc_id % 3 when 0 then 'EVIDENCE' when 1 then 'ABSTRACT' else 'UNKNOWN' end as source_section,
 case when doc_id % 2 = 0 then 'why it matters' else '' end as context
from (
 select cast(floor(doc_id / 4) as bigint) as review_id, cast(doc_id % 4 + 1 as bigint) as study_index, doc_id, cast(1 as bigint) as pos, split_part(text, chr(10), 2) as quote from {documents}
 union all
 select cast(floor(doc_id / 4) as bigint), cast(doc_id % 4 + 1 as bigint), doc_id, cast(2 as bigint), split_part(text, chr(10), 3) from {documents}
 union all
 select cast(floor(doc_id / 4) as bigint), cast(doc_id % 4 + 1 as bigint), doc_id, cast(3 as bigint), split_part(text, chr(10), 4) from {documents}) q""",
    "plan_rows": """
select review_id, doc_id * 2 + k as plan_ord, cast((doc_id % 2) + 1 as bigint) as section_pos,
 case when doc_id % 2 = 0 then 'Effects' else ' ' end as heading,
 cast(floor((doc_id % 4) / 2) + 1 as bigint) as item_pos,
 case when doc_id % 11 = 0 then 99 else cast(doc_id % 4 + 1 as bigint) end as study_index,
 cast(k + 1 as bigint) as quote_pos, cast((doc_id % 4) * 2 + k + 1 - (doc_id % 3) as bigint) as quote_id
from (select cast(floor(doc_id / 4) as bigint) as review_id, doc_id, cast(0 as bigint) as k from {documents} where length(text) >= 200
 union all select cast(floor(doc_id / 4) as bigint), doc_id, cast(1 as bigint) from {documents} where length(text) >= 200) x""",
    "reviews": """
select review_id,
 'INTRODUCTION' || chr(10) || chr(10) || 'Opening words.The topic [[S1]] (Kingdon, 1990) matters. ' || coalesce(t1, '') || chr(10) || chr(10) ||
 'EVIDENCE' || chr(10) || chr(10) || '[[Q1]] (Kingdon, 1990) ' || case when review_id % 3 = 0 then '[[S2]] ' else '' end || 'and ‘[[Q2]]’ then [[Q4]]' ||
 case when review_id % 3 = 1 then ' [[S2]]' else '' end || ' [[Q1]] [[Q77]] [[S9]]. Smith (' || cast(1993 + (review_id * 4) % 35 as string) || ') agrees.' || chr(10) || chr(10) ||
 'One claim is "' || coalesce(q1, '') || '" (Kingdon, ' || cast(1990 + (review_id * 4) % 35 as string) || ') as told. ' ||
 'Another is "' || coalesce(q3, '') || '" (Salotti & Cornet, ' || cast(1991 + (review_id * 4) % 35 as string) || ') in full. ' ||
 'A third is "words that no source of this review has ever printed" (Salotti & Cornet, ' || cast(1991 + (review_id * 4) % 35 as string) || '). ' ||
 'A fourth is "words cited to a person who is not among the studies" (Nobody, 2003). ' || chr(10) || chr(10) ||
 case when review_id % 4 = 0 then 'CITE AS: (Kingdon, 1990) and (12 words) - text' || chr(10) || chr(10) else '' end ||
 'DISCUSSION' || chr(10) || chr(10) || 'Study 1 and Studies 2-3 differ, verified quote from full text. Studies 1 and 4 agree. Study 44 is unknown.' || chr(10) || chr(10) ||
 'A final remark is "a quotation that carries no citation of any kind at all", which closes the part.' ||
 ' The closing sentences of this discussion run on for a while so that no citation is near the end of them and nothing else can be taken for one. They add words and more words until the window that is searched for a citation has passed.' || chr(10) || chr(10) ||
 'REFERENCES' || chr(10) || chr(10) || 'Kingdon, J. (1990). Old entry.' as text
from (select cast(floor(doc_id / 4) as bigint) as review_id,
   max(case when doc_id % 4 = 0 then split_part(text, chr(10), 1) end) as t1,
   max(case when doc_id % 4 = 0 then replace(split_part(text, chr(10), 2), chr(34), ' ') end) as q1,
   max(case when doc_id % 4 = 2 then replace(split_part(text, chr(10), 2), chr(34), ' ') end) as q3
  from {documents} group by cast(floor(doc_id / 4) as bigint)) r""",
    "issues": """
select cast(floor(event_id / 12) as bigint) as review_id, event_id as ord, cast(event_id % 3 + 1 as bigint) as pass,
 case event_id % 11 when 0 then 'scaffolding_leak' when 1 then 'cited_but_not_quoted' when 2 then 'style'
   when 3 then 'Reference_Format' when 4 then 'missing_citation' when 5 then null else 'clarity' end as type,
 case event_type when 'error' then 'critical' when 'view' then 'moderate' when 'click' then 'minor' else 'note' end as severity,
 case event_id % 9
   when 0 then 'No quote token for this study was inserted'
   when 1 then 'The references section is missing entries'
   when 2 then 'A hand-typed quote appears in paragraph ' || cast(event_id % 4 as string)
   when 3 then 'The entry lacks the journal name'
   when 4 then 'Token [[Q3]] was not expanded'
   when 5 then 'The argument in section ' || cast(event_id % 5 as string) || ' is hard to follow'
   else 'Claim ' || cast(user_id % 6 as string) || ' needs support' end as description
from {events}""",
    "decisions": """
select cast(1 as bigint) as pass, doc_id, cast(floor(doc_id / 4) as bigint) as review_id, quality = 1 as include from {labels}
union all
select cast(2 as bigint), doc_id, cast(floor(doc_id / 4) as bigint), toxic = 0 and doc_id % 8 > 3 from {labels}""",
}



def _js(expr: str) -> str:
    """JSON string literal of a text expression."""
    return (f"(chr(34) || replace(replace(replace({expr}, chr(92), chr(92) || chr(92)), chr(34), "
            f"chr(92) || chr(34)), chr(9), ' ') || chr(34))")


def _payload(*fields: str) -> str:
    """JSON object from `name: expression` parts; expressions give JSON text."""
    parts = []
    for f in fields:
        name, expr = f.split(": ", 1)
        parts.append(f"chr(34) || '{name}' || chr(34) || ':' || {expr}")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_TITLE = _js("split_part(text, chr(10), 1)")
_SECOND = _js("split_part(text, chr(10), 2)")
_ID = "cast(doc_id as string)"
_DOI = "substring(md5(text), 1, 10)"


def _q(text: str) -> str:
    """Plain JSON text with double quotes, as an SQL literal."""
    return "replace('" + text.replace('"', "~") + "', '~', chr(34))"


SQL["raw_semantic_scholar"] = "select doc_id, " + _payload(
    f"title: case when doc_id % 17 = 0 then 'null' else {_TITLE} end",
    "authors: case doc_id % 4 when 0 then '[]' when 1 then " + _q('[{"name":"Jack Kingdon"},{"name":""}]')
    + " else " + _q('[{"name":"A One"},{"name":null},{"name":"B Two"}]') + " end",
    "year: case when doc_id % 6 = 0 then 'null' else cast(1990 + doc_id % 35 as string) end",
    f"abstract: case when doc_id % 3 = 0 then 'null' else {_SECOND} end",
    "externalIds: case when doc_id % 4 = 3 then 'null' else '{' || chr(34) || 'DOI' || chr(34) || ':' || " + _js("'10.5555/' || " + _DOI) + " || '}' end",
    "openAccessPdf: case when doc_id % 5 = 0 then 'null' else '{' || chr(34) || 'url' || chr(34) || ':' || " + _js(f"'https://oa.example.org/' || {_ID}") + " || '}' end",
    "venue: case when doc_id % 2 = 0 then chr(34) || chr(34) else " + _js("'Venue ' || cast(doc_id % 7 as string)") + " end",
    "journal: case when doc_id % 8 = 0 then 'null' else '{' || chr(34) || 'name' || chr(34) || ':' || " + _js("'Journal ' || cast(doc_id % 11 as string)") + " || '}' end",
    "citationCount: cast(doc_id % 100 as string)", "publicationTypes: " + _q('["Review","Study"]'),
) + " as payload from {documents}"

SQL["raw_openalex"] = "select doc_id, " + _payload(
    "id: " + _js("'https://openalex.example.org/W' || " + _ID), f"title: case when doc_id % 17 = 0 then chr(34) || chr(34) else {_TITLE} end",
    "doi: case when doc_id % 4 = 3 then 'null' else " + _js("'https://doi.org/10.5555/' || " + _DOI) + " end",
    "publication_year: cast(1990 + doc_id % 35 as string)", "cited_by_count: cast(doc_id % 100 as string)",
    "type: case when doc_id % 9 = 0 then 'null' else " + _q('"article"') + " end",
    "authorships: " + _q('[{"author":{"display_name":"Ann Lee"}},{"author":{"display_name":""}},{"author":{"display_name":"Bo Kim"}}]'),
    "open_access: case when doc_id % 3 = 0 then '{' || chr(34) || 'oa_url' || chr(34) || ':' || " + _js(f"'https://oa.example.org/' || {_ID}") + " || '}' else 'null' end",
    "primary_location: case when doc_id % 10 = 0 then 'null' else '{' || chr(34) || 'is_oa' || chr(34) || ':' || case when doc_id % 2 = 0 then 'true' else 'false' end || ',' || chr(34) || 'pdf_url' || chr(34) || ':' || case when doc_id % 4 = 0 then 'null' else "
    + _js(f"'https://pdf.example.org/' || {_ID}") + " end || ',' || chr(34) || 'landing_page_url' || chr(34) || ':' || " + _js(f"'https://page.example.org/' || {_ID}")
    + " || ',' || chr(34) || 'source' || chr(34) || ':' || case when doc_id % 7 = 0 then 'null' else '{' || chr(34) || 'display_name' || chr(34) || ':' || " + _js("'Source ' || cast(doc_id % 11 as string)") + " || '}' end || '}' end",
    "abstract_inverted_index: case when doc_id % 5 = 0 then 'null' else '{' || " + _q('"alpha":[0,2],"beta":[1],') + " || " + _js("'d' || " + _ID) + " || ':[3]}' end",
) + " as payload from {documents}"

SQL["raw_core"] = "select doc_id, " + _payload(
    f"id: {_ID}", f"title: {_TITLE}",
    "authors: case when doc_id % 3 = 0 then " + _q('[{"name":"Ann Lee"},{"name":""}]') + " when doc_id % 3 = 1 then " + _q('["Bo Kim","Cy Orr"]') + " else '[]' end",
    "doi: case when doc_id % 4 = 3 then 'null' when doc_id % 4 = 2 then " + _js("'http://doi.org/10.5555/' || " + _DOI) + " else " + _js("'https://doi.org/10.5555/' || " + _DOI) + " end",
    f"downloadUrl: case when doc_id % 6 = 0 then 'null' else {_js('https_core')} end",
    "journals: case when doc_id % 3 = 0 then '[]' else '[{' || chr(34) || 'title' || chr(34) || ':' || " + _js("'Journal ' || cast(doc_id % 11 as string)") + " || '}]' end",
    "publisher: case when doc_id % 9 = 0 then 'null' else " + _js("'Publisher ' || cast(doc_id % 5 as string)") + " end",
    f"fullText: case when doc_id % 2 = 0 then {_TITLE} else chr(34) || chr(34) end",
    "yearPublished: cast(1990 + doc_id % 35 as string)", f"abstract: {_SECOND}", "citationCount: 'null'",
).replace("https_core", f"'https://core.example.org/' || {_ID}") + " as payload from {documents}"

SQL["raw_europe_pmc"] = "select doc_id, " + _payload(
    f"title: {_TITLE}", "authorList: " + _q('{"author":[{"fullName":"Salotti JM"},{"fullName":""},{"fullName":"Cornet JF"}]}'),
    "doi: case when doc_id % 4 = 3 then 'null' else " + _js("'10.5555/' || " + _DOI) + " end",
    f"pmid: {_js(_ID)}", "pmcid: case when doc_id % 3 = 0 then 'null' else " + _js(f"'PMC' || {_ID}") + " end",
    "isOpenAccess: case when doc_id % 2 = 0 then " + _q('"Y"') + " else " + _q('"N"') + " end",
    "journalTitle: " + _js("'Journal ' || cast(doc_id % 11 as string)"), "citedByCount: cast(doc_id % 100 as string)",
    f"abstractText: {_SECOND}", "pubYear: case when doc_id % 6 = 0 then 'null' else " + _js("cast(1990 + doc_id % 35 as string)") + " end",
    "pubType: " + _q('"research-article"'),
) + " as payload from {documents}"

SQL["raw_crossref"] = "select doc_id, " + _payload(
    f"title: case when doc_id % 17 = 0 then '[]' else '[' || {_TITLE} || ']' end",
    "author: " + _q('[{"given":"Ann","family":"Lee"},{"family":"Orr"},{"given":"","family":""}]'),
    "DOI: " + _js("'10.5555/' || " + _DOI),
    "published-print: case when doc_id % 3 = 0 then " + _q('{"date-parts":[[2001,4]]}') + " else 'null' end",
    "published-online: case when doc_id % 3 <> 2 then " + _q('{"date-parts":[[2002]]}') + " else 'null' end",
    "created: " + _q('{"date-parts":[[2003,1,1]]}'),
    "container-title: case when doc_id % 4 = 0 then '[]' else '[' || " + _js("'Journal ' || cast(doc_id % 11 as string)") + " || ']' end",
    "abstract: case when doc_id % 5 = 0 then 'null' else " + _js("'<jats:p>' || split_part(text, chr(10), 2) || ' </jats:p>'") + " end",
    "is-referenced-by-count: cast(doc_id % 100 as string)",
    "link: case when doc_id % 2 = 0 then " + _q('[{"content-type":"text/html","URL":"https://a.example.org"},{"content-type":"application/pdf","URL":"https://b.example.org"}]') + " else '[]' end",
    "type: " + _q('"journal-article"'),
) + " as payload from {documents}"

SQL["raw_unpaywall"] = "select doc_id, " + _payload(
    "doi: " + _js("'10.5555/' || upper(" + _DOI + ")"), "is_oa: case when doc_id % 3 = 0 then 'true' else 'false' end",
    "best_oa_location: case doc_id % 4 when 0 then 'null' when 1 then " + _q('{"url":"https://u.example.org","url_for_pdf":null}') + " else " + _q('{"url":"https://u.example.org","url_for_pdf":"https://p.example.org"}') + " end",
    "oa_locations: case when doc_id % 5 = 0 then '[]' else " + _q('[{"url":"https://u.example.org","url_for_pdf":null,"host_type":"repository","version":"v1"},{"url":"https://w.example.org","url_for_pdf":"https://x.example.org","host_type":"publisher","version":null}]') + " end",
) + " as payload from {documents}"

_REF = re.compile(r"@([a-z_]+)\b(?!\()")


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for dep in _REF.findall(SQL[name]):
            visit(dep)
        seen.append(name)

    for n in names:
        visit(n)
    return seen


def _with(names: list[str], array: str, base) -> str:
    parts = []
    for name in _order(names):
        text = SQL[name].replace("@arr(", array)
        text = _REF.sub(lambda m: m.group(1), text)
        for table in BASE:
            if "{" + table + "}" in text:
                text = text.replace("{" + table + "}", base(table))
        parts.append(f"{name} as ({text})")
    return "with recursive " + ",\n".join(parts) if parts else ""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One with fewer splits than cores is spread by its key, so
    costly row steps use all cores; a large table keeps its splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, df.columns[0])
    return df


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    view = f"{name}_{zlib.crc32(sf_dir.encode()):08x}"
    read(spark, sf_dir, name).createOrReplaceTempView(view)
    return view


def derive(spark: SparkSession, sf_dir: str, name: str, **streams: str) -> DataFrame:
    """A derived table as a Spark plan over the given tables. A base table may
    be replaced by a named view, such as a stream."""
    head = _with([name], "array(", lambda t: streams.get(t) or _view(spark, sf_dir, t))
    return spark.sql(head.replace("with recursive", "with", 1) + f"\nselect * from {name}")


def oracle(body: str, *names: str) -> str:
    """Checking SQL: the derived tables it names in front of `body`.

    `body` is a query, or `cte as (...), ... select` text starting with a comma.
    """
    head = _with(list(names), "list_value(", lambda t: t)
    body = body.strip()
    if body.startswith(","):
        return head + body
    return f"{head}\n{body}"
