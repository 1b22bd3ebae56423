"""Queries over quote tokens, assembled reviews and their audit."""

from pyspark.sql import functions as F

from ..functions import authors as A
from ..functions.text import strip
from ..operators import audit as U
from ..operators import registry as R
from ..session import cut_lineage, spread
from .catalog_queries import SPLIT_SQL
from .registry import query
from .round_queries import written_twice
from .selection_queries import studies_of
from .tables import derive, oracle, read

SURNAME = r"""case when contains({0}, ',') then trim(split_part({0}, ',', 1)) when regexp_matches({0}, '^\S+$') then {0}
 when regexp_matches({0}, '\s[A-Z]{{1,3}}$') then regexp_extract({0}, '^(.*?)(\s+[A-Z]{{1,3}})+$', 1) else regexp_extract({0}, '((?:(?:de|la|van|der|da)\s+)*\S+)$', 1) end"""
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"

REG = rf"""
, named as (select *, list_transform(paper_authors, lambda a: {SURNAME.format('a')}) as names from studies),
cited as (select *, '(' || case len(names) when 0 then 'Anonymous' when 1 then names[1] when 2 then names[1] || ' & ' || names[2] else names[1] || ' et al.' end || ', ' || coalesce(cast(paper_year as string), 'n.d.') || ')' as citation from named),
good as (select *, row_number() over (partition by review_id order by quote_ord) as n from study_quotes where verified and quote <> ''),
reg as (select g.review_id, 'Q' || cast(n as string) as token, n, g.quote as text, c.citation, c.paper_id, c.study_index, false as is_summary from good g join cited c on g.review_id = c.review_id and g.study_index = c.study_index
 union all select review_id, 'S' || cast(study_index as string), study_index, trim(study_summary), citation, paper_id, study_index, true from cited where trim(study_summary) <> '')
"""
USED = REG + r"""
, hits as (select review_id, text, unnest(range(1, length(text))) as i from reviews),
spots as (select review_id, i - 1 as start, regexp_extract(substring(text, i, 20), '^\[\[([SQ]\d+)\]\]', 1) as token from hits where substring(text, i, 2) = '[['),
lookup as (select s.review_id, s.start, s.token, r.study_index, r.paper_id, r.is_summary, r.token is not null as valid from spots s left join reg r on s.review_id = r.review_id and s.token = r.token where s.token <> '')
"""
IN_REG = ("studies", "study_quotes")
IN_ALL = ("studies", "study_quotes", "reviews")


def quotes_of(spark, sf):
    return derive(spark, sf, "study_quotes")


def reviews_of(spark, sf):
    return derive(spark, sf, "reviews")


def registry_of(spark, sf):
    """The registry as a written table: every later step reads it."""
    return cut_lineage(R.assign_tokens(studies_of(spark, sf), quotes_of(spark, sf)), "registry")


def lookup_of(spark, sf):
    return cut_lineage(R.token_lookup(reviews_of(spark, sf), registry_of(spark, sf)), "tokens")


def texts_of(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


@query("w1_assign_tokens", oracle(REG + f"select review_id, token, md5(text) as text_md5, citation, paper_id, study_index, is_summary, {WORDS.format('text')} as word_count from reg", *IN_REG))
def _(spark, sf):
    return R.assign_tokens(studies_of(spark, sf), quotes_of(spark, sf)).select("review_id", "token", F.md5("text").alias("text_md5"), "citation", "paper_id",
                                         "study_index", "is_summary", "word_count")


@query("a10_study_quote_map", oracle(REG + """
select review_id, study_index, n, row_number() over (partition by review_id, study_index order by n) as place, citation from reg where not is_summary""", *IN_REG))
def _(spark, sf):
    return R.study_quote_map(registry_of(spark, sf))


PLAN = REG + r"""
, owned as (select review_id, study_index, n as quote_id, citation from reg where not is_summary),
used as (select p.*, o.citation, row_number() over (partition by p.review_id, p.quote_id order by section_pos, item_pos, quote_pos, plan_ord) as rn from plan_rows p join owned o on p.review_id = o.review_id and p.study_index = o.study_index and p.quote_id = o.quote_id),
placed as (select review_id, 0 as part, section_pos, item_pos, quote_pos, plan_ord, study_index, quote_id, citation, case when trim(coalesce(heading, '')) = '' then 'Evidence' else trim(heading) end as heading from used where rn = 1),
closing as (select o.review_id, 1 as part, 0 as section_pos, o.study_index as item_pos, o.quote_id as quote_pos, 0 as plan_ord, o.study_index, o.quote_id, o.citation,
  case when exists (select 1 from placed p where p.review_id = o.review_id) then 'Further Evidence' else 'Evidence' end as heading
  from owned o where not exists (select 1 from placed p where p.review_id = o.review_id and p.study_index = o.study_index)),
both_parts as (select * from placed union all select * from closing),
plan as (select *, (part, section_pos, item_pos) = min((part, section_pos, item_pos)) over (partition by review_id, study_index) as is_first from both_parts),
built as (select *, case when is_first then '[[S' || cast(study_index as string) || ']] ' || citation else regexp_replace(citation, '^\((.*),\s*(\d{4}[a-z]?)\)$', '\1 (\2)') || ' further reported:' end as opening from plan)
"""
IN_PLAN = ("studies", "study_quotes", "plan_rows")


def plan_of(spark, sf):
    return cut_lineage(R.build_plan_tables(derive(spark, sf, "plan_rows"), registry_of(spark, sf)), "plan")


@query("c4_build_plan_tables", oracle(PLAN + "select review_id, part, section_pos, item_pos, quote_pos, study_index, quote_id, heading, opening from built", *IN_PLAN))
def _(spark, sf):
    return plan_of(spark, sf).select("review_id", "part", "place.section_pos", "place.item_pos", "place.quote_pos",
                                     "study_index", "quote_id", "heading", "opening")


@query("w10_first_use_only", oracle(PLAN + "select review_id, quote_id, study_index from placed", *IN_PLAN))
def _(spark, sf):
    return plan_of(spark, sf).where("part = 0").select("review_id", "quote_id", "study_index")


@query("w11_introduce_or_backref", oracle(PLAN + "select distinct review_id, part, section_pos, item_pos, study_index, opening from built", *IN_PLAN))
def _(spark, sf):
    return plan_of(spark, sf).select("review_id", "part", "place.section_pos", "place.item_pos", "study_index", "opening").distinct()


@query("u4_leftover_evidence", oracle(PLAN + "select review_id, study_index, quote_id, heading from closing", *IN_PLAN))
def _(spark, sf):
    return plan_of(spark, sf).where("part = 1").select("review_id", "study_index", "quote_id", "heading")


@query("c4_evidence_lines", oracle(PLAN + """
select review_id, part, section_pos, cast(-1 as bigint) as item_pos, cast(-1 as bigint) as study_index, cast(-1 as bigint) as quote_pos, '### ' || arg_min(heading, (item_pos, quote_pos, plan_ord)) as line from built group by review_id, part, section_pos
union all select review_id, part, section_pos, item_pos, study_index, -1, min(opening) from built group by review_id, part, section_pos, item_pos, study_index
union all select review_id, part, section_pos, item_pos, study_index, quote_pos, '[[Q' || cast(quote_id as string) || ']] ' || citation from built""", *IN_PLAN))
def _(spark, sf):
    return R.evidence_lines(plan_of(spark, sf)).drop("plan_ord")


@query("c5_render_evidence", oracle(REG + f"""
, w as (select *, {WORDS.format('text')} as wc from reg)
select review_id, study_index, 0 as line_no, cast(0 as bigint) as n, 'STUDY ' || cast(study_index as string) || ': ' || paper_title as line from cited
union all select review_id, study_index, 1, 0, 'APA in-text: ' || citation from cited
union all select review_id, study_index, 2, 0, 'Year: ' || coalesce(cast(paper_year as string), '?') || ' | Venue: ' || coalesce(paper_venue, '?') || ' | DOI: ' || coalesce(paper_doi, 'N/A') from cited
union all select review_id, study_index, 3, 0, 'Type: ' || coalesce(study_type, '?') || ' | Sample: ' || coalesce(sample_size, '?') || ' | Reliability: ' || coalesce(reliability_score, '?') || '/10' from cited
union all select review_id, study_index, case when is_summary then 50 else 100 end, n, '  [[' || token || ']] (' || cast(wc as string) || ' words) "' || text || '"' from w
union all select review_id, study_index, 100, 0, '  no verified quotes' from cited c where not exists (select 1 from good g where g.review_id = c.review_id and g.study_index = c.study_index)""", *IN_REG))
def _(spark, sf):
    return R.render_evidence(studies_of(spark, sf), registry_of(spark, sf))


@query("c5_render_evidence_compact", oracle(REG + f"""
select review_id, study_index, 0 as line_no, cast(0 as bigint) as n, 'STUDY ' || cast(study_index as string) || ': ' || paper_title as line from cited
union all select review_id, study_index, 1, 0, '  Cite as: ' || citation || ' | Type: ' || coalesce(study_type, '?') || ' | Sample: ' || coalesce(sample_size, '?') || ' | Reliability: ' || coalesce(reliability_score, '?') || '/10' from cited
union all select review_id, study_index, 100, n, '  [[' || token || ']] (' || cast({WORDS.format('text')} as string) || ' words)' from reg where not is_summary
union all select review_id, study_index, 100, 0, '  no verified quotes' from cited c where not exists (select 1 from good g where g.review_id = c.review_id and g.study_index = c.study_index)""", *IN_REG))
def _(spark, sf):
    return R.render_evidence(studies_of(spark, sf), registry_of(spark, sf), compact=True)


@query("c6_assemble_review", """
select doc_id as review_id, 'INTRODUCTION' || chr(10) || chr(10) || trim(split_part(text, chr(10), 1)) || chr(10) || chr(10) || 'METHOD' || chr(10) || chr(10) || trim(split_part(text, chr(10), 2)) || chr(10) || chr(10)
 || 'EVIDENCE' || chr(10) || chr(10) || trim(split_part(text, chr(10), 3)) || chr(10) || chr(10) || 'DISCUSSION' || chr(10) || chr(10) || regexp_replace(array_to_string(string_split(text, chr(10))[4:], chr(10)), '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10)
 || 'LIMITATIONS' || chr(10) || chr(10) || '' || chr(10) || chr(10) || 'CONCLUSION' || chr(10) || chr(10) || 'End.' || chr(10) || chr(10) || 'REFERENCES' || chr(10) as text from documents""")
def _(spark, sf):
    def line(n):
        return F.split_part("text", F.lit("\n"), F.lit(n))
    lines = F.split("text", "\n")
    rest = F.array_join(F.slice(lines, F.lit(4), F.size(lines)), "\n")
    s = texts_of(spark, sf).select(
        F.col("doc_id").alias("review_id"), line(1).alias("introduction"), line(2).alias("method"), line(3).alias("evidence"),
        rest.alias("discussion"), F.lit(None).cast("string").alias("limitations"), F.lit("End.").alias("conclusion"))
    return R.assemble_review(s)


@query("c6_lock_evidence", oracle(r"""
select review_id, substring(text, 1, strpos(text, 'EVIDENCE' || chr(10)) + 7) || chr(10) || chr(10) || 'Locked evidence of ' || cast(review_id as string) || chr(10) || chr(10) || substring(text, strpos(text, 'DISCUSSION' || chr(10))) as text from reviews""", "reviews"))
def _(spark, sf):
    return R.lock_evidence(reviews_of(spark, sf), F.concat(F.lit("Locked evidence of "), "review_id"))


@query("j12_token_lookup", oracle(USED + "select review_id, cast(start as int) as start, token, study_index, valid from lookup", *IN_ALL))
def _(spark, sf):
    return lookup_of(spark, sf).select("review_id", "start", "token", "study_index", "valid")


@query("j12_strip_invalid_tokens", oracle(USED + r"""
, bad as (select review_id, string_agg(distinct token, '|') as bad, count(*) as n from lookup where not valid group by review_id)
select r.review_id, case when b.bad is null then r.text else regexp_replace(regexp_replace(regexp_replace(regexp_replace(r.text, '\[\[(' || b.bad || ')\]\]', '', 'g'), '[ \t]{2,}', ' ', 'g'), '[ \t]+([.,;:])', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') end as text, coalesce(b.n, 0) as n_removed
from reviews r left join bad b on r.review_id = b.review_id""", *IN_ALL))
def _(spark, sf):
    return R.strip_invalid_tokens(reviews_of(spark, sf), registry_of(spark, sf))


@query("f19_expand_tokens", oracle(REG + r"""
, t0 as (select review_id, regexp_replace(regexp_replace(text, '["“‘]\s*(\[\[Q\d+\]\])\s*["”’]', '\1', 'g'), '["“‘]\s*(\[\[S\d+\]\])\s*["”’]', '\1', 'g') as t from reviews),
cut as (select review_id, string_split_regex(t, '\[\[S\d+\]\]|\[\[Q\d+\]\](?:[ \t]*\([^()\n]*\d{4}[^()\n]*\))?') as p, regexp_extract_all(t, '\[\[S\d+\]\]|\[\[Q\d+\]\](?:[ \t]*\([^()\n]*\d{4}[^()\n]*\))?') as m from t0),
rws as (select review_id, unnest(p) as piece, unnest(list_append(m, '')) as mark, unnest(range(1, len(p) + 1)) as i from cut),
j as (select w.*, r.token, r.text, trim(regexp_replace(mark, '^\[\[[SQ]\d+\]\]', '')) as cite from rws w left join reg r on w.review_id = r.review_id and r.token = regexp_extract(mark, '\[\[([SQ]\d+)\]\]', 1)),
s as (select review_id, string_agg(piece || case when token is null then '' when token like 'S%' then text else chr(10) || chr(10) || '    “' || trim(text) || '”' || case when cite <> '' then ' ' || cite else '' end || chr(10) || chr(10) end, '' order by i) as b,
  count(*) filter (where token is not null) as expanded, count(*) filter (where mark <> '' and token is null) as unknown from j group by review_id)
select review_id, regexp_replace(regexp_replace(regexp_replace(b, '\n{3,}', chr(10) || chr(10), 'g'), '\n\n[ \t]*[.,;:]+[ \t]*', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) as text, expanded, unknown from s""", *IN_ALL))
def _(spark, sf):
    return R.expand_tokens(reviews_of(spark, sf), registry_of(spark, sf))


@query("a15_used_sources", oracle(USED + """
, u as (select review_id, count(distinct paper_id) as n from lookup where valid group by review_id)
select s.review_id, count(*) as n_studies, any_value(coalesce(u.n, 0)) as n_used, greatest(count(*) - any_value(coalesce(u.n, 0)), 0) as n_dropped from studies s left join u on s.review_id = u.review_id group by s.review_id""", *IN_ALL))
def _(spark, sf):
    return R.used_sources(lookup_of(spark, sf), studies_of(spark, sf))


BODY = USED + r"""
, body as (select review_id, case when regexp_matches(text, '(?im)^[ \t]*[#>*\s]*(7\.\s*)?REFERENCES\b') then substring(text, 1, strpos(text, regexp_extract(text, '(?im)^[ \t]*[#>*\s]*(7\.\s*)?REFERENCES\b.*$')) - 1) else text end as body from reviews),
flat as (select review_id, trim(regexp_replace(translate(body, '“”‘’', '""'''''), '\s+', ' ', 'g')) as nb from body),
incite as (select c.review_id, c.study_index, c.paper_id from cited c join flat f on c.review_id = f.review_id where contains(f.nb, c.citation)
  or (len(c.names) > 0 and c.names[1] <> '' and c.paper_year is not null and regexp_matches(f.nb, '(?i)' || regexp_replace(c.names[1], '([^\p{L}\p{N} ])', '\\\1', 'g') || '[^\n]{0,40}?\b' || cast(c.paper_year as string) || '\b')))
"""


@query("j14_cited_in_body", oracle(BODY + "select review_id, study_index from incite", *IN_ALL))
def _(spark, sf):
    return R.cited_in_body(studies_of(spark, sf), reviews_of(spark, sf)).select("review_id", "study_index")


REFSET = BODY + """
, inc as (select s.review_id, s.paper_id, min(s.study_index) as study_index from studies s where exists (select 1 from lookup l where l.valid and l.review_id = s.review_id and l.paper_id = s.paper_id)
  or exists (select 1 from incite i where i.review_id = s.review_id and i.study_index = s.study_index) group by s.review_id, s.paper_id)
"""


def reference_set_of(spark, sf):
    studies, reviews = studies_of(spark, sf), reviews_of(spark, sf)
    return R.reference_set(studies, lookup_of(spark, sf), R.cited_in_body(studies, reviews))


@query("u5_reference_set", oracle(REFSET + "select review_id, paper_id, study_index from inc", *IN_ALL))
def _(spark, sf):
    return reference_set_of(spark, sf).select("review_id", "paper_id", "study_index")


@query("c7_rebuild_references", oracle(REFSET + SPLIT_SQL.replace("papers", "(select doc_id as seq, paper_authors as authors from studies)", 1) + r"""
, fmt as (select distinct author, surname, case when contains(author, ',') then author when initials = '' then surname else surname || ', ' || trim(regexp_replace(initials, '(.)', '\1. ', 'g')) end as f from names),
pos as (select doc_id, unnest(paper_authors) as author, unnest(range(1, len(paper_authors) + 1)) as i, len(paper_authors) as n from studies),
who as (select doc_id, any_value(n) as n, string_agg(f, ', ' order by i) filter (where i < n) as heads, max(f) filter (where i = n) as last, max(surname) filter (where i = 1) as s1 from pos join fmt on pos.author = fmt.author group by doc_id),
by_id as (select paper_id, arg_max(venue, seq) as v from keyed_papers group by paper_id),
by_doi as (select lower(trim(replace(doi, 'https://doi.org/', ''))) as dk, arg_min(venue, seq) as v from keyed_papers where doi <> '' group by 1),
full_rows as (select s.*, case when trim(coalesce(s.paper_venue, '')) <> '' then s.paper_venue else coalesce(nullif(trim(case when b.paper_id is not null then b.v else d.v end), ''), s.paper_venue) end as venue2,
  case when w.n is null then 'Anonymous' when w.n = 1 then w.last else w.heads || ', & ' || w.last end as blk, coalesce(lower(w.s1), 'zzzz') || '|' || coalesce(cast(s.paper_year as string), '9999') as place
  from studies s join inc on s.review_id = inc.review_id and s.study_index = inc.study_index left join by_id b on s.paper_id = b.paper_id left join by_doi d on d.dk = lower(trim(replace(s.paper_doi, 'https://doi.org/', ''))) left join who w on w.doc_id = s.doc_id)
select review_id, 2 as part, place, case when blk like '%.' then blk else blk || '.' end || ' (' || coalesce(cast(paper_year as string), 'n.d.') || '). ' || case when paper_title = '' then 'Untitled' else paper_title end || '.'
 || case when coalesce(venue2, '') <> '' then ' ' || venue2 || '.' else '' end || case when paper_doi <> '' then ' ' || paper_doi else '' end as line from full_rows
union all select distinct review_id, 1, '', 'REFERENCES' from inc
union all select b.review_id, 0, '', case when b.review_id in (select review_id from inc) then regexp_replace(b.body, '\s+$', '') else r.text end from body b join reviews r on b.review_id = r.review_id""", *IN_ALL, "keyed_papers"))
def _(spark, sf):
    return R.rebuild_references(reviews_of(spark, sf), reference_set_of(spark, sf), derive(spark, sf, "keyed_papers"))


@query("c8_no_evidence_report")
def _(spark, sf):
    from .catalog_queries import catalog_table
    return R.no_evidence_report(catalog_table(spark, sf), studies_of(spark, sf), quotes_of(spark, sf), "What holds?")


@query("f20_sanitize_text", oracle(r"""
, a as (select review_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i),\s*verified quote from (full text|abstract)\s*\)', ')', 'g'), '(?i)\s*\(verified quote from (full text|abstract)\)', '', 'g'), '(?i)\s*,?\s*verified quote from (full text|abstract)', '', 'g') as t from reviews),
b as (select review_id, regexp_replace(t, '\[\[[SQ][n?]\]\]', '', 'g') as t from a),
cut as (select review_id, string_split_regex(t, '\[\[[SQ]\d+\]\]') as p, list_append(regexp_extract_all(t, '\[\[[SQ]\d+\]\]'), '') as m from b),
rws as (select review_id, unnest(p) as piece, unnest(m) as mark, unnest(range(1, len(p) + 1)) as i from cut),
dd as (select *, row_number() over (partition by review_id, mark order by i) as k from rws),
c as (select review_id, regexp_replace(regexp_replace(string_agg(piece || case when k = 1 then mark else '' end, '' order by i), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from dd group by review_id),
d as (select review_id, t, regexp_replace(t, '(\s)["“”‘’]+[ \t]*\([^()]*\b(18|19|20)\d{2}\b[^()]*\)', '\1', 'g') as u from c),
e as (select review_id, case when t = u then t else regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '[ \t]{2,}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') end as t from d)
select review_id, regexp_replace(t, '([a-z]{3,})\.([A-Z])', '\1. \2', 'g') as text from e""", "reviews"))
def _(spark, sf):
    return reviews_of(spark, sf).select("review_id", R.sanitize_text("text").alias("text"))


@query("f21_strip_transcription")
def _(spark, sf):
    return R.strip_transcription(reviews_of(spark, sf), registry_of(spark, sf))


@query("f22_scaffold_leaks", oracle(r"""
, hits as (select review_id, text, unnest(range(1, length(text) + 1)) as i from reviews),
labels as (select unnest(['summary line', 'citation line', 'quote line', 'context line', 'quotes header']) as label, unnest(['^expands to\s*:', '^CITE AS\s*:', '^\(\s*\d+\s+words?\s*\)\s*[—-]', '^\(context\s*:', '^VERIFIED QUOTES?\s*[—-]']) as p),
near as (select review_id, i, substring(text, i, 60) as w from hits where lower(substring(text, i, 1)) in ('e', 'c', '(', 'v')),
m as (select review_id, label, i - 1 as start, regexp_extract(w, '(?i)' || p) as f from near, labels where regexp_matches(w, '(?i)' || p))
select review_id, label, cast(start as int) as start, cast(start + length(f) as int) as "end" from m""", "reviews"))
def _(spark, sf):
    return U.scaffold_leaks(reviews_of(spark, sf))


@query("f23_dereference_studies", oracle(REG + r"""
, c as (select review_id, max(case when study_index = 1 then citation end) as c1, max(case when study_index = 2 then citation end) as c2, max(case when study_index = 3 then citation end) as c3, max(case when study_index = 4 then citation end) as c4 from cited group by review_id)
select r.review_id, replace(replace(replace(r.text, 'Study 1 and', c1 || ' and'), 'Studies 2-3', c2 || ' and ' || c3), 'Studies 1 and 4', c1 || ' and ' || c4) as text from reviews r join c on r.review_id = c.review_id""", *IN_ALL))
def _(spark, sf):
    return R.dereference_studies(reviews_of(spark, sf), studies_of(spark, sf))


@query("f24_context_window")
def _(spark, sf):
    reviews = spread(reviews_of(spark, sf), "review_id")
    leaks = U.scaffold_leaks(reviews).join(reviews, "review_id")
    return leaks.withColumn("w", R.context_window("text", F.col("start"), F.col("end"), 12)).select(
        "review_id", "label", "start", "end", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"),
        F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("context"))


@query("c9_fix_intros")
def _(spark, sf):
    look = lookup_of(spark, sf)
    return R.fix_intros(reviews_of(spark, sf), look, U.intro_order_guard(look))


# ---- audit ----------------------------------------------------------------

GUARD = USED + r"""
, si as (select review_id, cast(substring(token, 2) as bigint) as study_index, min(start) as intro from lookup where token like 'S%' group by 1, 2),
qi as (select review_id, study_index, min(start) as quoted from lookup where valid and not is_summary group by 1, 2),
guard as (select q.review_id, q.study_index, case when s.intro is null then 'missing_study_intro' when s.intro > q.quoted then 'study_intro_after_quote' end as type from qi q left join si s on q.review_id = s.review_id and q.study_index = s.study_index)
"""


@query("w9_intro_order_guard", oracle(GUARD + "select review_id, study_index, type from guard where type is not null", *IN_ALL))
def _(spark, sf):
    return U.intro_order_guard(lookup_of(spark, sf)).select("review_id", "study_index", "type")


@query("w13_cap_issue_type", oracle(BODY + """
, idle as (select i.review_id, i.study_index, row_number() over (partition by i.review_id order by i.study_index) as rn from incite i where not exists (select 1 from lookup l where l.valid and l.review_id = i.review_id and l.paper_id = i.paper_id))
select review_id, study_index, 'cited_but_not_quoted' as type from idle where rn <= 8""", *IN_ALL))
def _(spark, sf):
    return U.cap_issue_type(U.cited_not_quoted(reviews_of(spark, sf), studies_of(spark, sf), lookup_of(spark, sf)))


SPANS = r"""
, flat as (select review_id, trim(regexp_replace(translate(text, '“”‘’', '""'''''), '\s+', ' ', 'g')) as t from reviews),
cut as (select review_id, t, string_split_regex(t, '"[^"]{20,}"') as p, regexp_extract_all(t, '"[^"]{20,}"') as m from flat),
rws as (select review_id, t, unnest(m) as m, unnest(range(1, len(m) + 1)) as i, p, m as ms from cut),
ends as (select review_id, i, m, t, list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) as e from rws),
spans as (select review_id, i, trim(substring(m, 2, length(m) - 2)) as quote, regexp_extract(substring(t, cast(e as int) + 1, 200), '\([^()]+?\d{4}[^()]*\)') as citation_text from ends
 where not regexp_matches(m, '\([^()]*\b(1[7-9]\d{2}|20\d{2}|21\d{2})\b[^()]*\)'))
"""


@query("f15_extract_quoted_spans", oracle(SPANS + "select review_id, quote, citation_text, 'inline' as kind from spans", "reviews"))
def _(spark, sf):
    return U.quoted_spans(reviews_of(spark, sf)).select("review_id", "quote", "citation_text", "kind")


@query("f15_block_quotes", r"""
with p as (select doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat from documents)
select doc_id as review_id, regexp_replace(flat, '\.+$', '') as quote from (
 select doc_id, trim(regexp_replace(regexp_replace(translate(text, '“”‘’', '""'''''), '\n\s*\n', ' ', 'g'), '\s+', ' ', 'g')) as flat, text from documents) x
where len(list_filter(regexp_split_to_array(flat, '\s+'), lambda w: w <> '')) + 2 >= 40 and length(regexp_replace(flat, '\.+$', '')) >= 40""")
def _(spark, sf):
    """Each document as one indented paragraph that ends in a citation."""
    docs = texts_of(spark, sf).select(F.col("doc_id").alias("review_id"), F.concat(
        F.lit("    "), strip(F.regexp_replace("text", r"\n\s*\n", " ")), F.lit(" (Smith, 2001).")).alias("text"))
    return U.quoted_spans(docs).where("kind = 'block'").select("review_id", "quote")


@query("f9_parse_citation", oracle(SPANS + r"""
, c as (select review_id, i, quote, citation_text, regexp_replace(citation_text, '^[()]+|[()]+$', '', 'g') as inner_text from spans where citation_text <> ''),
y as (select *, nullif(regexp_extract(inner_text, '\b(1[7-9]\d{2}|20\d{2}|21\d{2})\b', 1), '') as year from c),
h as (select *, trim(case when year is null then inner_text else regexp_replace(substring(inner_text, 1, strpos(inner_text, year) - 1), '[, ]+$', '') end) as head from y)
select review_id, quote, year, array_to_string(list_filter(list_transform(case when contains(lower(head), ' et al') then [regexp_replace(head, '(?i)\s+et\s+al.*$', '')] when contains(head, '&') then string_split(head, '&') else string_split_regex(head, '(?i)\band\b') end, lambda x: trim(x)), lambda x: x <> ''), '|') as names from h""", "reviews"))
def _(spark, sf):
    q = U.quoted_spans(reviews_of(spark, sf)).where("citation_text <> ''").withColumn("p", A.parse_citation("citation_text"))
    return q.select("review_id", "quote", F.col("p.year").alias("year"), F.array_join("p.names", "|").alias("names"))


@query("j10_citation_to_study", oracle(SPANS + rf"""
, c as (select review_id, i, quote, regexp_replace(citation_text, '^[()]+|[()]+$', '', 'g') as t from spans where citation_text <> ''),
p as (select *, nullif(regexp_extract(t, '\b(1[7-9]\d{{2}}|20\d{{2}}|21\d{{2}})\b', 1), '') as year, trim(regexp_extract(t, '^([^,&]*)', 1)) as first_name from c),
s as (select *, lower({SURNAME.format('paper_authors[1]')}) as sn from studies where len(paper_authors) > 0)
select p.review_id, p.quote, s.study_index from p join s on p.review_id = s.review_id and s.sn = lower(p.first_name) and (p.year is null or s.paper_year is null or cast(s.paper_year as string) = p.year)""", "reviews", "studies"))
def _(spark, sf):
    q = U.quoted_spans(reviews_of(spark, sf)).where("citation_text <> ''")
    return U.citation_to_study(q, studies_of(spark, sf)).select("review_id", "quote", "study_index")


@query("j11_true_source")
def _(spark, sf):
    v = U.quote_sources(U.quoted_spans(reviews_of(spark, sf)), cut_lineage(studies_of(spark, sf), "studies"), texts_of(spark, sf))
    return v.select("review_id", "quote", "citation_text", "verdict", "true_study")


@query("j11_verbatim_sources", oracle(SPANS + """
select distinct s.review_id, s.quote, st.study_index from spans s join studies st using (review_id) join documents d on d.doc_id = st.doc_id
where contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(s.quote, '\\s+', ' ', 'g'))))""", "reviews", "studies"))
def _(spark, sf):
    """Studies that hold each hand-typed quotation."""
    spans = cut_lineage(U.quoted_spans(reviews_of(spark, sf)).where("kind = 'inline'"), "typed-quotes")
    found = U.verbatim_sources(spans, studies_of(spark, sf), texts_of(spark, sf))
    return found.join(spans, ["review_id", "n"]).select("review_id", "quote", "study_index").distinct()


@query("c3_token_issues", oracle(GUARD + r"""
select review_id, case when token like 'Q%' then 'invalid_quote_placeholder' else 'invalid_summary_placeholder' end as type, token as detail from (select distinct review_id, token from lookup where not valid) x
union all select review_id, type, 'study ' || study_index as detail from guard where type is not null""", *IN_ALL))
def _(spark, sf):
    """The issues of the audit that placeholders show."""
    found = U.token_issues(reviews_of(spark, sf), lookup_of(spark, sf)).where("type <> 'scaffolding_leak'")
    return found.select("review_id", "type", "detail")


@query("c3_citation_issues", oracle(BODY + """
select i.review_id, 'cited_but_not_quoted' as type, 'study ' || i.study_index as detail, 'moderate' as severity from incite i
where not exists (select 1 from lookup l where l.valid and l.review_id = i.review_id and l.paper_id = i.paper_id)""", *IN_ALL))
def _(spark, sf):
    """All studies that are cited but not quoted, without a limit."""
    return U.with_severity(U.citation_issues(reviews_of(spark, sf), studies_of(spark, sf), lookup_of(spark, sf))).select(
        "review_id", "type", "detail", "severity")


@query("c3_attribution_audit")
def _(spark, sf):
    reviews, studies = cut_lineage(reviews_of(spark, sf), "reviews"), cut_lineage(studies_of(spark, sf), "studies")
    registry = cut_lineage(R.assign_tokens(studies, quotes_of(spark, sf)), "registry")
    return U.attribution_audit(reviews, registry, studies, texts_of(spark, sf))


@query("a9_issue_severity", oracle("""
select review_id, pass, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'moderate') as moderate, count(*) filter (where severity = 'minor') as minor,
 count(*) filter (where severity in ('critical', 'moderate')) = 0 as clean from issues group by review_id, pass""", "issues"))
def _(spark, sf):
    return U.issue_severity(derive(spark, sf, "issues"), ["review_id", "pass"])


@query("w12_pass_diff", oracle("""
, seen as (select distinct review_id, pass, description from issues), passes as (select distinct review_id, pass from issues),
follow as (select b.review_id, b.pass from passes a join passes b on a.review_id = b.review_id and b.pass = a.pass + 1)
select s.review_id, s.pass + 1 as pass, s.description, 'resolved' as change from seen s join follow f on f.review_id = s.review_id and f.pass = s.pass + 1 where not exists (select 1 from seen t where t.review_id = s.review_id and t.pass = s.pass + 1 and t.description = s.description)
union all select s.review_id, s.pass, s.description, 'new' from seen s join follow f on f.review_id = s.review_id and f.pass = s.pass where not exists (select 1 from seen t where t.review_id = s.review_id and t.pass = s.pass - 1 and t.description = s.description)""", "issues"))
def _(spark, sf):
    return U.pass_diff(derive(spark, sf, "issues"))


@query("s11_sink_review", oracle(rf"""
, q as (select review_id, count(*) filter (where verified and quote <> '') as quotes from study_quotes group by review_id),
i as (select review_id, count(*) as n from issues where pass = 3 group by review_id),
s as (select review_id, count(*) as n, count(*) filter (where has_full_text) as f from studies group by review_id)
select r.review_id, 'LITERATURE REVIEW' || chr(10) || repeat('=', 60) || chr(10) || 'Question: What holds?' || chr(10) || 'Studies (post-curation): ' || cast(s.n as string) || chr(10) || 'Full texts: ' || cast(s.f as string) || chr(10)
 || 'Unresolved issues: ' || cast(coalesce(i.n, 0) as string) || chr(10) || repeat('=', 60) || chr(10) || chr(10) || r.text as value from reviews r join s on r.review_id = s.review_id left join i on i.review_id = r.review_id""", "studies", "reviews", "study_quotes", "issues"))
def _(spark, sf):
    roll = R.run_rollup(studies_of(spark, sf), reviews_of(spark, sf), quotes_of(spark, sf), derive(spark, sf, "issues").where("pass = 3"))
    return written_twice(spark, R.sink_review(reviews_of(spark, sf), roll, "What holds?"), "reviews")


def run_data(spark, sf):
    """All that a run leaves behind; the issues of the last pass are those of the final verification."""
    issues, rounds = derive(spark, sf, "issues"), derive(spark, sf, "search_rounds")
    totals = rounds.groupBy("run_id").agg(F.count("*").alias("rounds"), F.sum(F.col("added").cast("long")).alias("papers_added"))
    return R.sink_run_data(
        derive(spark, sf, "keyed_papers"), analyses=studies_of(spark, sf), self_review_issues=issues.where("pass < 3"),
        final_verification_issues=issues.where("pass = 3"), search_history=rounds, curation_history=derive(spark, sf, "decisions"),
        methodology_weaknesses=issues.where("severity = 'critical'").select("review_id", "description").distinct(), run_totals=totals)


@query("s10_sink_run_data")
def _(spark, sf):
    return written_twice(spark, run_data(spark, sf), "run-data", "entity")


@query("s10_written_entities", oracle("""
select 'catalog' as entity, cast(1 as bigint) as n union all select 'analyses', count(*) from studies
union all select 'self_review_issues', count(*) from issues where pass < 3 union all select 'final_verification_issues', count(*) from issues where pass = 3
union all select 'search_history', count(*) from search_rounds union all select 'curation_history', count(*) from decisions
union all select 'methodology_weaknesses', count(*) from (select distinct review_id, description from issues where severity = 'critical')
union all select 'run_totals', count(distinct run_id) from search_rounds""", "studies", "issues", "search_rounds", "decisions"))
def _(spark, sf):
    """Rows of each entity in the written folder, after the write was repeated."""
    return written_twice(spark, run_data(spark, sf), "run-data", "entity").groupBy("entity").agg(F.count("*").alias("n"))

