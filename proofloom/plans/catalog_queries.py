"""Queries over bibliographic records."""

from pyspark.sql import functions as F

from ..functions import authors as A
from ..functions import keys as K
from ..functions.text import numbers_subset
from ..operators import catalog as C
from ..session import cut_lineage
from .registry import query
from .tables import derive, oracle

AUTHORS = "array_to_string(authors, '; ')"
# White space at both ends, as the checking engine writes it.
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TKEY = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"


def text(c):
    return F.array_join(c, "; ")


@query("p1_derive_paper_id", oracle("select seq, paper_id from keyed_papers", "keyed_papers"))
def _(spark, sf):
    return C.derive_paper_id(derive(spark, sf, "papers")).select("seq", "paper_id")


@query("p2_catalog_entry", oracle(f"""
select paper_id, title, array_to_string(authors[1:3], '; ') as authors, year, venue, citation_count, doi,
 full_text_available as has_full_text,
 case when length(abstract) > 300 then substring(abstract, 1, 300) || '...' else abstract end as abstract_preview,
 source_api from keyed_papers""", "keyed_papers"))
def _(spark, sf):
    return C.catalog_entry(derive(spark, sf, "keyed_papers")).withColumn("authors", text("authors"))


@query("p3_title_key", oracle(f"""
select seq, {TKEY.format('title')} as title_key, length({TKEY.format('title')}) >= 25 as usable from papers""", "papers"))
def _(spark, sf):
    return derive(spark, sf, "papers").select(
        "seq", K.title_key("title").alias("title_key"), K.title_usable("title").alias("usable"))


@query("p4_doi_key", oracle(r"""
, shaped as (select doc_id, case doc_id % 6 when 0 then ' https://doi.org/' || paper_doi when 1 then 'DOI: ' || paper_doi || ').'
  when 2 then 'http://dx.doi.org/' || upper(paper_doi) when 3 then null else paper_doi || ' ' end as raw from
  (select doc_id, replace(paper_doi, 'https://doi.org/', '') as paper_doi from studies) s)
select doc_id, lower(trim(coalesce(raw, ''))) as catalog_key,
 lower(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(raw, '')), '^https?://(dx\.)?doi\.org/', '', 'i'), '^doi:\s*', '', 'i'), '[ ).,;>"''\]]+$', '')) as harvest_key,
 lower(trim(replace(coalesce(raw, ''), 'https://doi.org/', ''))) as venue_key
from shaped""", "studies"))
def _(spark, sf):
    s = derive(spark, sf, "studies").withColumn("d", F.replace("paper_doi", F.lit("https://doi.org/"), F.lit("")))
    kind = F.col("doc_id") % 6
    raw = (F.when(kind == 0, F.concat(F.lit(" https://doi.org/"), "d"))
           .when(kind == 1, F.concat(F.lit("DOI: "), "d", F.lit(").")))
           .when(kind == 2, F.concat(F.lit("http://dx.doi.org/"), F.upper("d")))
           .when(kind == 3, F.lit(None)).otherwise(F.concat("d", F.lit(" "))))
    s = s.withColumn("raw", raw)
    return s.select("doc_id", K.doi_key("raw", "catalog").alias("catalog_key"),
                    K.doi_key("raw", "harvest").alias("harvest_key"), K.doi_key("raw", "venue").alias("venue_key"))


@query("j1_link_search_hits", oracle("""
, ranked as (select *, row_number() over (partition by query_id, paper_id order by ord) as rn,
  count(*) over (partition by query_id, paper_id) as n_hits,
  first_value(case when open_access_pdf_url <> '' then open_access_pdf_url end ignore nulls) over (partition by query_id, paper_id order by ord rows between unbounded preceding and unbounded following) as pdf1,
  first_value(case when abstract <> '' then abstract end ignore nulls) over (partition by query_id, paper_id order by ord rows between unbounded preceding and unbounded following) as abs1
  from search_hits)
select query_id, paper_id as link_key, ord, title, n_hits,
 case when coalesce(open_access_pdf_url, '') <> '' then open_access_pdf_url when paper_id like 'doi:%' then coalesce(pdf1, open_access_pdf_url) else open_access_pdf_url end as open_access_pdf_url,
 case when coalesce(abstract, '') <> '' then abstract when paper_id like 'doi:%' then coalesce(abs1, abstract) else abstract end as abstract
from ranked where rn = 1""", "search_hits"))
def _(spark, sf):
    return C.link_search_hits(derive(spark, sf, "search_hits")).select(
        "query_id", "link_key", "ord", "title", "n_hits", "open_access_pdf_url", "abstract")


CATALOG = f"""
, k as (select *, paper_id as k1, row_number() over (partition by paper_id order by seq) as rn1 from keyed_papers),
reps as (select k1, seq as rep_seq, case when length({TKEY.format('title')}) >= 25 then 't' || {TKEY.format('title')} else 'k' || k1 end as k2 from k where rn1 = 1),
surv as (select k2, min(rep_seq) as survivor from reps group by k2),
member as (select k.*, r.rep_seq, s.survivor from k join reps r on k.k1 = r.k1 join surv s on r.k2 = s.k2),
live as (select * from member where seq = survivor or not (k1 like 'hash:%' and rep_seq = survivor)),
merged as (select survivor,
  max(struct_pack(n := length(abstract), s := -seq, v := abstract)) filter (where abstract <> '') as a,
  max(citation_count) filter (where citation_count > 0) as c,
  arg_min(open_access_pdf_url, seq) filter (where open_access_pdf_url <> '') as p,
  arg_min(pmcid, seq) filter (where pmcid <> '') as m, arg_min(arxiv_id, seq) filter (where arxiv_id <> '') as x,
  bool_or(full_text_available) as f,
  arg_min(full_text_content, seq) filter (where full_text_available) as t,
  arg_min(acquisition_method, seq) filter (where full_text_available) as am from live group by survivor),
sizes as (select survivor, count(*) as n from member group by survivor),
catalog as (select o.seq, o.paper_id, o.title, o.authors, o.year, o.venue, o.doi, o.source_api,
  coalesce(m.a.v, o.abstract) as abstract, coalesce(m.c, o.citation_count) as citation_count,
  coalesce(m.p, o.open_access_pdf_url) as open_access_pdf_url, coalesce(m.m, o.pmcid) as pmcid, coalesce(m.x, o.arxiv_id) as arxiv_id,
  m.f as full_text_available, m.t as full_text_content, m.am as acquisition_method, z.n as n_records
  from keyed_papers o join merged m on o.seq = m.survivor join sizes z on z.survivor = o.seq)
"""


def catalog_of(spark, sf):
    return C.resolve_catalog(derive(spark, sf, "papers"))


def catalog_table(spark, sf):
    """The catalog as a written table, for plans that read it several times."""
    return cut_lineage(catalog_of(spark, sf), "catalog")


@query("a1_resolve_catalog", oracle(CATALOG + f"""select seq, paper_id, title, {AUTHORS} as authors, year, venue, doi, source_api, abstract,
 citation_count, open_access_pdf_url, pmcid, arxiv_id, full_text_available, md5(full_text_content) as text_md5, acquisition_method, n_records from catalog""", "keyed_papers"))
def _(spark, sf):
    return catalog_of(spark, sf).withColumn("authors", text("authors")).withColumn(
        "text_md5", F.md5("full_text_content")).drop("full_text_content")


@query("a1_external_ids", oracle(CATALOG + """
, ids as (select survivor, seq, 'DOI' as kind, doi as value from live union all select survivor, seq, 'PubMedCentral', pmcid from live
 union all select survivor, seq, 'ArXiv', arxiv_id from live
 union all select survivor, seq, 'OpenAlex', 'W' || seq from live where source_api = 'openalex'
 union all select survivor, seq, 'CORE', 'c' || seq from live where source_api = 'core'),
firsts as (select survivor, kind, arg_min(value, seq) as value from ids where trim(coalesce(value, '')) <> '' group by survivor, kind),
joined as (select survivor, string_agg(kind || '=' || value, ',' order by kind) as ids, count(*) as n from firsts group by survivor)
select c.seq, c.paper_id, coalesce(j.ids, '') as ids, coalesce(j.n, 0) as n_ids from catalog c left join joined j on j.survivor = c.seq""", "keyed_papers"))
def _(spark, sf):
    """Five kinds of identifiers, merged over the records of a work."""
    papers = derive(spark, sf, "papers")
    of = lambda api, lead: F.when(F.col("source_api") == api, F.concat(F.lit(lead), F.col("seq").cast("string")))
    kinds = {"DOI": F.col("doi"), "PubMedCentral": F.col("pmcid"), "ArXiv": F.col("arxiv_id"),
             "OpenAlex": of("openalex", "W"), "CORE": of("core", "c")}
    ids = F.map_filter(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    found = C.resolve_catalog(papers.withColumn("external_ids", ids))
    lines = F.transform(F.map_entries("external_ids"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("seq", "paper_id", F.array_join(F.array_sort(lines), ",").alias("ids"),
                        F.size("external_ids").cast("long").alias("n_ids"))


@query("a2_api_stats", oracle("""
select api, count(*) as total_queries, cast(sum(case when error is null then n_results else 0 end) as bigint) as total_results,
 count(error) as total_errors, arg_max(error, call_id) filter (where error is not null) as last_error,
 (count(*) - count(error)) / count(*) as success_rate,
 case when count(*) > count(error) then sum(case when error is null then n_results else 0 end) / (count(*) - count(error)) else 0 end as avg_results
from search_calls group by api""", "search_calls"))
def _(spark, sf):
    return C.api_stats(derive(spark, sf, "search_calls"))


@query("w8_running_response_time", oracle("""
select call_id, api, cast(sum(cast(response_time as decimal(18,6))) over w as double) / count(*) over w as avg_response_time
from search_calls window w as (partition by api order by call_id rows between unbounded preceding and current row)""", "search_calls"))
def _(spark, sf):
    return C.running_response_time(derive(spark, sf, "search_calls")).select("call_id", "api", "avg_response_time")


@query("a3_catalog_summary", oracle(CATALOG + """
select cast(sum(n) as bigint) as total_papers, cast(sum(ft) as bigint) as with_full_text, cast(sum(ab) - sum(ft) as bigint) as with_abstract_only,
 string_agg(source_api || '=' || cast(n as string), ',' order by source_api || '=' || cast(n as string)) as by_source
from (select source_api, count(*) as n, count(*) filter (where full_text_available) as ft, count(*) filter (where abstract <> '') as ab from catalog group by source_api) g""", "keyed_papers"))
def _(spark, sf):
    return C.catalog_summary(catalog_of(spark, sf))


@query("a4_evidence_inventory", oracle(CATALOG + """
, read_ids as (select paper_id from studies where study_index <> 2),
pool as (select distinct paper_id from studies),
curated as (select distinct s.paper_id from studies s join decisions d on s.doc_id = d.doc_id where d.pass = 1 and d.include)
select (select count(*) from catalog) as catalog, (select count(*) from catalog where full_text_available) as full_text,
 (select count(*) from catalog where full_text_available and paper_id not in (select paper_id from read_ids)) as unread_full_text,
 (select count(*) from pool) as pool, (select count(*) from pool where paper_id not in (select paper_id from curated)) as pool_unused,
 (select count(*) from curated) as curated, (select count(*) from decisions where not include) as curation_excluded,
 (select max(round) from search_rounds) as standard_rounds""", "keyed_papers", "studies", "decisions", "search_rounds"))
def _(spark, sf):
    return inventory_of(spark, sf)


def inventory_of(spark, sf):
    studies, decisions = derive(spark, sf, "studies"), derive(spark, sf, "decisions")
    curated = studies.join(decisions.where("pass = 1 and include"), "doc_id", "left_semi").select("paper_id").distinct()
    return C.evidence_inventory(
        catalog_table(spark, sf), studies.where("study_index <> 2"), studies.select("paper_id").distinct(),
        curated, decisions, derive(spark, sf, "search_rounds"))


@query("a5_text_availability", oracle(CATALOG + """
select case when full_text_available then 'full text' when abstract <> '' then 'abstract only' else 'metadata only' end as status, count(*) as n
from catalog group by 1""", "keyed_papers"))
def _(spark, sf):
    return C.text_availability(catalog_of(spark, sf))


@query("j13_backfill_venue", oracle(r"""
, by_id as (select paper_id, arg_max(venue, seq) as v from keyed_papers group by paper_id),
by_doi as (select lower(trim(replace(doi, 'https://doi.org/', ''))) as dk, arg_min(venue, seq) as v from keyed_papers where doi <> '' group by 1)
select s.doc_id, case when trim(coalesce(s.paper_venue, '')) <> '' then s.paper_venue
  else coalesce(nullif(trim(case when i.paper_id is not null then i.v else d.v end), ''), s.paper_venue) end as paper_venue
from studies s left join by_id i on s.paper_id = i.paper_id
left join by_doi d on d.dk = lower(trim(replace(s.paper_doi, 'https://doi.org/', '')))""", "keyed_papers", "studies"))
def _(spark, sf):
    return C.backfill_venue(derive(spark, sf, "studies"), derive(spark, sf, "keyed_papers")).select("doc_id", "paper_venue")


@query("u1_append_pool", oracle("""
, both_sides as (select 0 as side, paper_id, doc_id, paper_title from studies where study_index <= 2
 union all select 1, case when doc_id % 10 = 0 then '' else paper_id end, doc_id, paper_title from studies where study_index >= 2)
select paper_id, doc_id, paper_title from (select *, row_number() over (partition by paper_id order by side, doc_id) as rn from both_sides where paper_id <> '') x where rn = 1""", "studies"))
def _(spark, sf):
    s = derive(spark, sf, "studies").select("paper_id", "doc_id", "paper_title", "study_index")
    new = s.where("study_index >= 2").withColumn(
        "paper_id", F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.col("paper_id")))
    return C.append_pool(s.where("study_index <= 2").drop("study_index"), new.drop("study_index"), "doc_id")


@query("u2_merge_preserved", oracle("""
, preserved as (select paper_id, doc_id from studies where study_index = 1),
fresh as (select paper_id, doc_id, row_number() over (partition by paper_id order by doc_id) as rn from studies where study_index > 1 and paper_id not in (select paper_id from preserved))
select paper_id, doc_id from preserved union all select paper_id, doc_id from fresh where rn = 1""", "studies"))
def _(spark, sf):
    s = derive(spark, sf, "studies").select("paper_id", "doc_id", "study_index")
    return C.merge_preserved(s.where("study_index = 1").drop("study_index"),
                             s.where("study_index > 1").drop("study_index"), "doc_id")


@query("u7_suppress_repeat_queries", oracle(f"""
, k as (select run_id, round, query, {TKEY.format('query')} as query_key from search_rounds)
select run_id, round, query_key, case when query_key <> '' and round > min(round) over (partition by run_id, query_key) then 'skipped_duplicate_query' else 'searched' end as outcome from k""", "search_rounds"))
def _(spark, sf):
    return C.suppress_repeat_queries(derive(spark, sf, "search_rounds")).select("run_id", "round", "query_key", "outcome")


@query("t10_limits", oracle("""
select query_id, source_api, seq from (select *, row_number() over (partition by query_id, source_api order by ord) as rn from search_hits) x where rn <= 3""", "search_hits"))
def _(spark, sf):
    return C.limit_hits(derive(spark, sf, "search_hits"), 3).select("query_id", "source_api", "seq")


@query("f34_url_builders", oracle("""
select seq, 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmcid || '/pdf/' as pmc_url, 'https://arxiv.org/pdf/' || arxiv_id || '.pdf' as arxiv_url,
 'https://europepmc.org/backend/ptpmcrender.fcgi?accid=' || pmcid || '&blobtype=pdf' as render_url from papers""", "papers"))
def _(spark, sf):
    return C.url_builders(C.external_ids(derive(spark, sf, "papers")))


_LOCATIONS = """
, loc as (select lower(trim(doi)) as doi_key,
  min(case when seq % 3 = 0 then 'https://best.example.org/' || cast(seq as string) end) as best_url,
  min('https://alt.example.org/' || cast(seq as string)) as alt_url,
  min(case when seq % 5 = 0 then 'https://index.example.org/' || cast(seq as string) end) as index_url,
  min(case when seq % 7 = 0 then 'https://core.example.org/' || cast(seq as string) end) as core_url
  from papers where doi is not null group by 1)"""


@query("j17_acquisition_route", oracle(_LOCATIONS + """
, known as (select p.*, l.best_url, l.alt_url, l.index_url, l.core_url from papers p left join loc l on lower(trim(p.doi)) = l.doi_key where not p.full_text_available),
cand as (select seq, 1 as prio, open_access_pdf_url as url, 'direct_oa' as method from known
 union all select seq, 2, best_url, 'unpaywall' from known
 union all select seq, 3, case when best_url <> '' and alt_url <> best_url then alt_url end, 'unpaywall_repository' from known
 union all select seq, 4, 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmcid || '/pdf/', 'pmc' from known
 union all select seq, 5, 'https://arxiv.org/pdf/' || arxiv_id || '.pdf', 'arxiv' from known
 union all select seq, 6, index_url, 'openalex_crossref' from known
 union all select seq, 7, core_url, 'core_title' from known),
tried as (select *, length(url) % 2 = 0 as accepted, case when length(url) % 3 = 0 then 'html' else 'pdf' end as kind from cand where url <> '')
select seq, arg_min(case when kind = 'html' then method || '_html' else method end, prio) filter (where accepted) as acquisition_method,
 arg_min(url, prio) filter (where accepted) as url, count(*) as n_candidates from tried group by seq""", "papers"))
def _(spark, sf):
    papers = derive(spark, sf, "papers")
    seq = F.col("seq").cast("string")

    def link(host, when=None):
        url = F.concat(F.lit(f"https://{host}.example.org/"), seq)
        return F.min(url if when is None else F.when(when, url))

    locations = papers.where("doi is not null").groupBy(K.doi_key("doi").alias("doi_key")).agg(
        link("best", F.col("seq") % 3 == 0).alias("best_url"), link("alt").alias("_alt"),
        link("index", F.col("seq") % 5 == 0).alias("index_url"),
        link("core", F.col("seq") % 7 == 0).alias("core_url")).withColumn(
            "alternates", F.array(F.struct(F.col("_alt").alias("url"), F.lit("repository").alias("host_type"))))
    cand = C.route_candidates(papers, locations.drop("_alt"))
    payloads = cand.select("url").distinct().withColumn("accepted", F.length("url") % 2 == 0).withColumn(
        "kind", F.when(F.length("url") % 3 == 0, F.lit("html")).otherwise(F.lit("pdf")))
    return C.acquisition_route(cand, payloads)


@query("f6_apa_in_text", oracle(r"""
, named as (select seq, year, list_transform(list_filter(authors, lambda a: a <> ''), lambda a:
  case when contains(a, ',') then trim(split_part(a, ',', 1))
   when regexp_matches(a, '^\S+$') then a
   when regexp_matches(a, '\s[A-Z]{1,3}$') then regexp_extract(a, '^(.*?)(\s+[A-Z]{1,3})+$', 1)
   else regexp_extract(a, '((?:(?:de|la|van|der|da)\s+)*\S+)$', 1) end) as n from papers)
select seq, '(' || case len(n) when 0 then 'Anonymous' when 1 then n[1] when 2 then n[1] || ' & ' || n[2] else n[1] || ' et al.' end
 || ', ' || coalesce(cast(year as string), 'n.d.') || ')' as citation from named""", "papers"))
def _(spark, sf):
    return derive(spark, sf, "papers").select("seq", A.apa_in_text("authors", "year").alias("citation"))


SPLIT_SQL = r"""
, one as (select seq, unnest(authors) as author from papers),
parts as (select seq, author, case when contains(author, ',') then trim(split_part(author, ',', 1))
   when regexp_matches(author, '^\S+$') then author
   when regexp_matches(author, '\s[A-Z]{1,3}$') then regexp_extract(author, '^(.*?)((\s+[A-Z]{1,3})+)$', 1)
   else regexp_extract(author, '((?:(?:de|la|van|der|da)\s+)*\S+)$', 1) end as surname from one),
names as (select seq, author, surname, case when contains(author, ',') then regexp_replace(upper(substring(author, strpos(author, ',') + 1)), '[^A-Z]', '', 'g')
   when regexp_matches(author, '^\S+$') then ''
   when regexp_matches(author, '\s[A-Z]{1,3}$') then regexp_replace(regexp_extract(author, '((\s+[A-Z]{1,3})+)$', 1), '[^A-Z]', '', 'g')
   else upper(array_to_string(list_transform(regexp_split_to_array(trim(substring(author, 1, length(author) - length(surname))), '\s+'), lambda t: substring(t, 1, 1)), '')) end as initials from parts)
"""


@query("f5_split_author", oracle(SPLIT_SQL + "select seq, author, surname, initials from names", "papers"))
def _(spark, sf):
    one = derive(spark, sf, "papers").select("seq", F.explode("authors").alias("author"))
    return one.withColumn("s", A.split_author("author")).select(
        "seq", "author", F.col("s.surname").alias("surname"), F.array_join("s.initials", "").alias("initials"))




@query("f7_apa_reference", oracle(SPLIT_SQL + r"""
, fmt as (select distinct author, case when contains(author, ',') then author when initials = '' then surname
   else surname || ', ' || trim(regexp_replace(initials, '(.)', '\1. ', 'g')) end as f from names),
pos as (select seq, unnest(authors) as author, unnest(range(1, len(authors) + 1)) as i, len(authors) as n from papers),
who as (select pos.seq, any_value(n) as n, string_agg(f, ', ' order by i) filter (where i < n) as heads, max(f) filter (where i = n) as last from pos join fmt on pos.author = fmt.author group by pos.seq),
blocks as (select p.*, case when w.n is null then 'Anonymous' when w.n = 1 then w.last else w.heads || ', & ' || w.last end as b from papers p left join who w on p.seq = w.seq)
select seq, case when b like '%.' then b else b || '.' end || ' (' || coalesce(cast(year as string), 'n.d.') || '). ' || case when title = '' then 'Untitled' else title end || '.'
 || case when venue <> '' then ' ' || venue || '.' else '' end || case when doi <> '' then ' https://doi.org/' || trim(doi) else '' end as reference from blocks""", "papers"))
def _(spark, sf):
    return derive(spark, sf, "papers").select(
        "seq", A.apa_reference("authors", "year", "title", "venue", "doi").alias("reference"))


@query("t7_reference_order", oracle(SPLIT_SQL + """
select p.seq, coalesce(lower(n.surname), 'zzzz') || '|' || coalesce(cast(p.year as string), '9999') as sort_key
from papers p left join (select distinct author, surname from names) n on n.author = p.authors[1]""", "papers"))
def _(spark, sf):
    return derive(spark, sf, "papers").select("seq", A.reference_sort_key("authors", "year").alias("sort_key")).orderBy("sort_key")


@query("f8_narrative_cite", oracle(r"""
select review_id, 'Kingdon (' || cast(1990 + (review_id * 4) % 35 as string) || ')' as narrative, '(Nobody)' as other from reviews""", "reviews"))
def _(spark, sf):
    cite = F.concat(F.lit("(Kingdon, "), (1990 + (F.col("review_id") * 4) % 35).cast("string"), F.lit(")"))
    return derive(spark, sf, "reviews").select(
        "review_id", A.narrative_cite(cite).alias("narrative"), A.narrative_cite(F.lit("(Nobody)")).alias("other"))


@query("u3_numbers_subset", oracle(r"""
, n as (select quote_id, regexp_extract_all(p.quote, '\d+(?:[.,]\d+)*') as q, regexp_extract_all(d.text, '\d+(?:[.,]\d+)*') as m from proposals p join documents d on p.doc_id = d.doc_id)
select quote_id, len(list_filter(q, lambda x: not list_contains(m, x))) = 0 as numbers_ok from n""", "proposals"))
def _(spark, sf):
    from .tables import read
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return derive(spark, sf, "proposals").join(docs, "doc_id").select(
        "quote_id", numbers_subset("quote", "text").alias("numbers_ok"))
