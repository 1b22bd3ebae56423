"""Queries over texts: reading, chunking, sections, ranking, quotations."""

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import headings as H
from ..functions import text as X
from ..operators import passages as P
from ..operators import quotes as Q
from ..session import spread
from .registry import query
from .tables import derive, oracle, read

# Recursive chunk boundaries, as the checking engine computes them.
CHUNKS = r"""
, cuts as (select doc_id, 0 as idx, 0 as s, text, length(text) as n,
  case when length(text) <= 4000 then length(text) else 3900 + case when regexp_matches(substring(text, 3901, 100), '[.!?\n]') then length(regexp_extract(substring(text, 3901, 100), '(?s)^.*[.!?\n]')) else 100 end end as e
  from {src} where length(text) > 0
 union all
 select doc_id, idx + 1, e - 500, text, n,
  case when e - 500 + 4000 >= n then n else e + 3400 + case when regexp_matches(substring(text, e + 3401, 100), '[.!?\n]') then length(regexp_extract(substring(text, e + 3401, 100), '(?s)^.*[.!?\n]')) else 100 end end
 from cuts where e < n),
chunks as (select doc_id, cast(idx as int) as chunk_index, cast(s as int) as start, cast(e as int) as "end", substring(text, s + 1, e - s) as chunk, s / n as position_ratio from cuts)
"""
TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 2)"
SQL_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def docs_of(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text", "source")


def proposals_of(spark, sf):
    return derive(spark, sf, "proposals")


@query("s7_scan_documents", r"""
select doc_id, source as name, length(text) as char_count, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as word_count, md5(text) as file_hash from documents""")
def _(spark, sf):
    return P.scan_documents(docs_of(spark, sf))


@query("f32_text_hash", "select doc_id, md5(text) as h from documents")
def _(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5("text").alias("h"))


@query("s8_html_to_text", r"""
select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages""")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.html_to_text_simple("html").alias("text"))


@query("s8_html_visible_text")
def _(spark, sf):
    return P.html_to_text(read(spark, sf, "pages"), ("script", "style", "nav", "header", "footer"))


@query("s9_classify_payload", r"""
, p as (select page_id, case page_id % 4 when 0 then '%PDF-1.4 ' || html when 1 then substring(html, 1, 90) when 2 then html else regexp_replace(html, '<[^>]+>', ' ', 'g') end as body from pages),
t as (select page_id, body, trim(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text,
 case when octet_length(encode(body)) < 100 then 'too_small' when body like '\%PDF-%' escape '\' then 'pdf'
  when contains(lower(substring(body, 1, 1000)), '<html') or contains(lower(substring(body, 1, 1000)), '<!doctype') then 'html' else 'unknown' end as kind from p)
select page_id, kind, (kind = 'pdf' and length(text) > 200) or (kind = 'html' and length(text) > 500) as accepted from t""".replace(", p as", "with p as", 1))
def _(spark, sf):
    kind = F.col("page_id") % 4
    body = (F.when(kind == 0, F.concat(F.lit("%PDF-1.4 "), "html")).when(kind == 1, F.substring("html", 1, 90))
            .when(kind == 2, F.col("html")).otherwise(F.regexp_replace("html", "<[^>]+>", " ")))
    p = read(spark, sf, "pages").select("page_id", body.alias("body"))
    p = p.select("page_id", F.encode("body", "UTF-8").alias("content"), F.lit("").alias("content_type"),
                 X.html_to_text_simple("body").alias("text"))
    return P.classify_payload(p).select("page_id", "kind", "accepted")


@query("f26_chunk_offsets", oracle(CHUNKS.replace("{src}", "documents").replace(", cuts", "with recursive cuts", 1) +
       'select doc_id, chunk_index, start, "end", md5(chunk) as chunk_md5, position_ratio from chunks'))
def _(spark, sf):
    return P.chunk_offsets(docs_of(spark, sf)).select(
        "doc_id", "chunk_index", "start", "end", F.md5("chunk").alias("chunk_md5"), "position_ratio")


def _last_fifth(start: str) -> str:
    window = f"substring(text, {start} + 2401, 600)"
    return rf"""({start} + 2400 + case
 when regexp_matches({window}, '\n\n') then case when length(regexp_extract({window}, '(?s)^.*\n\n')) > 2 then length(regexp_extract({window}, '(?s)^.*\n\n')) - 1 else 600 end
 when regexp_matches({window}, '[.?!] |\.\n') then length(regexp_extract({window}, '(?s)^.*([.?!] |\.\n)')) else 600 end)"""


@query("f25_chunk_sequential", f"""
with recursive cuts as (
 select doc_id, 0 as s, text, length(text) as n, case when length(text) <= 3000 then length(text) else {_last_fifth('0')} end as e
 from documents where length(text) > 0
 union all
 select doc_id, b as s, text, n, case when b + 3000 >= n then n else {_last_fifth('b')} end as e
 from (select *, greatest(e - 300, s + 1) as b from cuts where e < n) x),
pieces as (select doc_id, s, e, case when n <= 3000 then text else {SQL_STRIP.format('substring(text, s + 1, e - s)')} end as chunk from cuts)
select doc_id, cast(row_number() over (partition by doc_id order by s) - 1 as int) as chunk_index, cast(s as int) as start, cast(e as int) as "end", chunk
from pieces where chunk <> ''""")
def _(spark, sf):
    return P.chunk_sequential(docs_of(spark, sf), size=3000, overlap=300)


@query("a12_document_listing", CHUNKS.replace("{src}", "documents").replace(", cuts", "with recursive cuts", 1) + r"""
select d.doc_id, d.source as name, length(d.text) as char_count, len(list_filter(regexp_split_to_array(d.text, '\s+'), lambda w: w <> '')) as word_count,
 md5(d.text) as file_hash, coalesce(c.n, 0) as chunk_count
from documents d left join (select doc_id, count(*) as n from chunks group by doc_id) c on d.doc_id = c.doc_id""")
def _(spark, sf):
    d = docs_of(spark, sf)
    return P.document_listing(d, P.chunk_offsets(d))


@query("j7_span_in_chunk", CHUNKS.replace("{src}", "documents").replace(", cuts", "with recursive cuts", 1) + r"""
, spans as (select doc_id, cast(length(text) * 0.45 as int) as start, cast(length(text) * 0.45 as int) + 40 as "end" from documents)
select s.doc_id, c.chunk_index, s.start, s."end", substring(c.chunk, s.start - c.start + 1, 40) as span_text
from spans s join chunks c on s.doc_id = c.doc_id and c.start <= s.start and s."end" <= c."end" """)
def _(spark, sf):
    d = docs_of(spark, sf)
    at = F.round(F.length("text") * F.lit("0.45").cast("decimal(3,2)")).cast("int")
    spans = d.select("doc_id", at.alias("start"), (at + 40).alias("end"))
    return P.span_in_chunk(spans, P.chunk_offsets(d))


@query("p6_source_text_choice", oracle("""
, modes as (select 'main' as mode union all select 'tangential'),
c as (select seq, mode, case when full_text_available and length(full_text_content) >= 5000 then 'FULL TEXT'
  when full_text_available and length(full_text_content) > 0 and mode = 'tangential' then 'SHORT FULL TEXT'
  when mode = 'tangential' and length(abstract) >= 150 then 'ABSTRACT ONLY (tangential mode)' end as text_type, full_text_content, abstract from papers, modes)
select seq, mode, text_type, md5(case when text_type like '%FULL TEXT' then full_text_content when text_type is not null then abstract end) as text_md5,
 case when text_type is not null then 'extract' when mode = 'main' then 'drop' else 'keep_unquoted' end as action from c""", "papers"))
def _(spark, sf):
    p = derive(spark, sf, "papers")
    both = [P.source_text_choice(p, m).withColumn("mode", F.lit(m)) for m in ("main", "tangential")]
    return both[0].unionByName(both[1]).select("seq", "mode", "text_type", F.md5("text").alias("text_md5"), "action")


@query("p7_quick_read_text", oracle("""
select seq, case when abstract <> '' then abstract when full_text_available and full_text_content <> '' then full_text_content end as read_text from papers""", "papers"))
def _(spark, sf):
    return P.quick_read_text(derive(spark, sf, "papers")).select("seq", "read_text")


@query("f1_normalize_text", r"""
select doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as folded, md5(trim(regexp_replace(translate(text, '“”‘’', '""'''''), '\s+', ' ', 'g'))) as straight from documents""")
def _(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(X.normalize_text("text")).alias("folded"),
                                     F.md5(X.unify_quotes("text")).alias("straight"))


@query("f2_tokenize", "select doc_id, len({0}) as n, md5(array_to_string({0}, ' ')) as tokens from documents".format(TOKENS.format("text")))
def _(spark, sf):
    return docs_of(spark, sf).select("doc_id", X.tokenize("text").alias("t")).select(
        "doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("f3_abstract_from_index", r"""
select doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') as abstract from documents
where len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 0""")
def _(spark, sf):
    # The inverted index of a text is built from its words, then read back.
    # The texts move once, by document; both groupings keep to that.
    w = spread(docs_of(spark, sf), "doc_id").select("doc_id", F.posexplode_outer(X.words("text")).alias("p", "w")).where("w is not null")
    index = w.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", X.abstract_from_index("index").alias("abstract"))


@query("f4_strip_jats", r"""
select page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') as plain from pages""")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.strip_tags("html").alias("plain"))


@query("f30_text_budget", """
select doc_id, case when length(text) <= 1000 then text else substring(text, 1, 600) || '[cut]' || right(text, 400) end as fitted from documents""")
def _(spark, sf):
    return docs_of(spark, sf).select("doc_id", X.text_budget("text", 1000, "[cut]").alias("fitted"))


@query("f33_key_phrases", oracle(r"""
, w as (select quote_id, list_filter(regexp_split_to_array(quote, '\s+'), lambda x: x <> '') as w from proposals)
select quote_id, case when len(w) >= 12 then array_to_string(w[1:5], ' ') || '|' || array_to_string(w[-5:], ' ') || '|' || array_to_string(w[(len(w) // 2) - 1:(len(w) // 2) + 3], ' ')
 when len(w) >= 6 then array_to_string(w[1:5], ' ') || '|' || array_to_string(w[-5:], ' ') else '' end as phrases from w""", "proposals"))
def _(spark, sf):
    return proposals_of(spark, sf).select("quote_id", F.array_join(X.key_phrases("quote"), "|").alias("phrases"))


# ---- sections -------------------------------------------------------------

def _in(words):
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def _any(words):
    return f"(core in {_in(words)} or len(list_filter(toks, lambda t: t in {_in(words)})) > 0)"


_KNOWN = sorted({*H.EVIDENCE_NOUNS, *H.METHODS_NOUNS, *H.EXCLUDE_NOUNS, *H.QUALIFIERS, *H.STOP_WORDS})
HEADINGS = rf"""
, ls as (select doc_id, string_split(article, chr(10)) as lines, article from articles),
line0 as (select doc_id, unnest(lines) as raw, unnest(range(1, len(lines) + 1)) as i, lines from ls),
line1 as (select doc_id, i, {SQL_STRIP.format('raw')} as line from line0),
line2 as (select *, regexp_replace({SQL_STRIP.format('line')}, '^[*_`]+|[*_`]+$', '', 'g') as c0 from line1
  where length(line) between 1 and 90 and len(regexp_split_to_array(line, '\s+')) <= 10
   and not regexp_matches(line, '(?i)^(figure|fig|table|tab|scheme|equation|eq|algorithm|chart|plate|box|exhibit|appendix\s+figure|appendix\s+table)\s*\.?\s*\d')),
line3 as (select *, regexp_replace(regexp_replace(regexp_replace({SQL_STRIP.format('c0')}, '^#{{1,6}}\s*', ''), '^\|\s*', ''), '(?i)^(section|chapter|part)\b[\s:.\-]*', '') as c1 from line2),
line4 as (select *, regexp_replace(regexp_replace(regexp_replace(c1, '(?i)^(\d+(\.\d+)*[.):]?|[ivxlcdm]+[.):]?|[a-z][.):])(\s+|$)', ''), '(?i)^(\d+(\.\d+)*[.):]?|[ivxlcdm]+[.):]?|[a-z][.):])(\s+|$)', ''), '^\|\s*', '') as c2 from line3),
line5 as (select *, regexp_replace(regexp_replace(regexp_replace(lower({SQL_STRIP.format("regexp_replace(" + SQL_STRIP.format('c2') + ", '^[:.#*\\-]+|[:.#*\\-]+$', '', 'g')")}), '\s+', ' ', 'g'), '\s+sections?$', ''), '^(the|our)\s+', '') as core from line4),
line6 as (select *, list_filter(list_transform(string_split_regex(core, '(?i)\s*&\s*|\s*/\s*|\s*,\s*|\s*;\s*|\s+and\s+|\s*\+\s*'), lambda t: trim(t)), lambda t: t <> '') as toks,
  regexp_extract_all(core, '[a-z]+') as ws,
  regexp_matches(line, '^[^\p{{L}}]*\p{{Lu}}') or regexp_matches(line, '^#{{1,6}}') or regexp_matches(line, '(?i)^(section|chapter|part)\b') or regexp_matches(line, '(?i)^(\d+(\.\d+)*|[ivxlcdm]+|[a-z])[.):]?(\s|$)') or line like '%:' as shaped from line5 where core <> ''),
line7 as (select *, case when len(ws) = 0 or len(list_filter(ws, lambda w: w not in {_in(_KNOWN)})) > 0 then null
   when len(list_filter(ws, lambda w: w in {_in(H.EXCLUDE_NOUNS)})) > 0 then 'EXCLUDE'
   when len(list_filter(ws, lambda w: w in {_in(H.EVIDENCE_NOUNS)})) > 0 then 'EVIDENCE'
   when len(list_filter(ws, lambda w: w in {_in(H.METHODS_NOUNS)})) > 0 then 'METHODS' end as nouns,
  case when len(toks) = 0 then null when core like 'appendix%' or toks[1] in ('appendix', 'appendices') then 'REFS'
   when {_any(H.TERMINAL)} then 'REFS' when {_any(H.EXCLUDE)} then 'EXCLUDE' when {_any(H.METHODS)} then 'METHODS'
   when core in {_in(H.ABSTRACT)} then 'ABSTRACT'
   when len(list_filter(toks, lambda t: t not in {_in(H.EVIDENCE_PRIMARY + H.EVIDENCE_SECONDARY)})) = 0 and len(list_filter(toks, lambda t: t in {_in(H.EVIDENCE_PRIMARY)})) > 0 then 'EVIDENCE' end as phrase from line6),
heads as (select doc_id, i, line as heading, coalesce(phrase, nouns) as category from line7
  where (shaped or core in {_in(H.STRONG)} or coalesce(nouns, '') = 'EVIDENCE') and coalesce(phrase, nouns) is not null),
placed as (select h.doc_id, h.heading, h.category, case when i = 1 then 0 else length(array_to_string(l.lines[1:i - 1], chr(10))) + 1 end as start, length(l.article) as n from heads h join ls l on h.doc_id = l.doc_id),
regions as (select *, cast(row_number() over (partition by doc_id order by start) - 1 as int) as k, lead(start, 1, n) over (partition by doc_id order by start) as stop from placed)
"""


def articles_of(spark, sf):
    return derive(spark, sf, "articles").withColumnRenamed("article", "text")


@query("f10_classify_heading", oracle(HEADINGS + "select doc_id, cast(i - 1 as int) as line_no, heading, category from heads", "articles"))
def _(spark, sf):
    lines = articles_of(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return lines.select("doc_id", "line_no", X.strip("raw").alias("heading"), H.classify_heading("raw").alias("category")).where(
        "category is not null")


@query("w2_section_regions", oracle(HEADINGS + """select doc_id, k as n, cast(start as int) as start, cast(stop as int) as "end", category, heading, cast(stop - start as int) as region_chars from regions""", "articles"))
def _(spark, sf):
    return P.section_regions(P.with_sections(articles_of(spark, sf)))


@query("a6_section_profile", oracle(HEADINGS + """
select a.doc_id, count(*) filter (where category = 'EVIDENCE') as n_evidence, count(*) filter (where category = 'ABSTRACT') as n_abstract,
 count(*) filter (where category = 'METHODS') as n_methods, count(*) filter (where category = 'EXCLUDE') as n_exclude, count(*) filter (where category = 'REFS') as n_refs,
 coalesce(min(start), any_value(length(a.article))) as leading_chars, coalesce(bool_or(category in ('EVIDENCE', 'ABSTRACT')), false) as has_evidence
from articles a left join regions r on a.doc_id = r.doc_id group by a.doc_id""", "articles"))
def _(spark, sf):
    return P.section_profile(P.with_sections(articles_of(spark, sf)))


@query("j6_position_to_section", oracle(HEADINGS + """
, pos as (select doc_id, cast(floor(length(article) * f / 10) as int) as position from articles, (select unnest([0, 1, 3, 5, 7, 9]) as f) fr)
select p.doc_id, p.position, coalesce(arg_max(r.category, r.start), 'UNKNOWN') as category, coalesce(arg_max(r.heading, r.start), '') as heading
from pos p left join regions r on p.doc_id = r.doc_id and r.start <= p.position group by p.doc_id, p.position""", "articles"))
def _(spark, sf):
    d = P.with_sections(articles_of(spark, sf))
    pos = d.select("doc_id", F.explode(F.array_distinct(F.transform(
        F.array(*[F.lit(x) for x in (0, 1, 3, 5, 7, 9)]),
        lambda f: F.floor(F.length("text") * f / 10).cast("int")))).alias("position"))
    return P.position_to_section(pos, d)


REFBLOCK = HEADINGS + r"""
, ref as (select doc_id, min(start) as start from regions where category = 'REFS' and regexp_matches(lower(heading), 'reference|bibliograph|works cited|literature cited') group by doc_id),
stops as (select ref.doc_id, ref.start, min(r.start) as stop from ref left join regions r on r.doc_id = ref.doc_id and r.start > ref.start and r.category <> 'REFS' group by ref.doc_id, ref.start),
blocks as (select a.doc_id, coalesce((select """ + SQL_STRIP.format("substring(a.article, s.start + 1 + strpos(substring(a.article, s.start + 1), chr(10)), coalesce(s.stop, length(a.article)) - s.start - strpos(substring(a.article, s.start + 1), chr(10)))") + r""" from stops s where s.doc_id = a.doc_id), '') as block from articles a)
"""


@query("f14_references_block", oracle(REFBLOCK + "select doc_id, block from blocks", "articles"))
def _(spark, sf):
    return P.with_sections(articles_of(spark, sf)).select("doc_id", H.references_block("text", "section_map").alias("block"))


ENTRIES = REFBLOCK + r"""
, pieces as (select doc_id, unnest(p) as piece, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split_regex(block, '(?m)^\s*(\[\d+\]|\(\d+\)|\d+[\.\)])\s+') as p from blocks) x),
flat as (select doc_id, i, trim(regexp_replace(piece, '\s+', ' ', 'g')) as raw from pieces),
entries as (select doc_id, cast(row_number() over (partition by doc_id order by i) as int) as entry_no, raw, coalesce(lower(regexp_replace(nullif(regexp_extract(raw, '(?i)10\.\d{4,9}/[^\s,;\]\)>"'']+'), ''), '[ ).,;>"''\]]+$', '')), '') as doi from flat where length(raw) >= 15)
"""


def entries_of(spark, sf):
    """Reference entries of the derived articles, numbered from 1."""
    d = P.with_sections(articles_of(spark, sf))
    return d.select("doc_id", F.posexplode_outer(C.split_references(H.references_block("text", "section_map"))).alias("i", "e")).where("e is not null").select(
        "doc_id", (F.col("i") + 1).alias("entry_no"), "e.raw", "e.doi")


@query("f13_split_references", oracle(ENTRIES + "select doc_id, entry_no, raw, doi from entries", "articles"))
def _(spark, sf):
    return entries_of(spark, sf)


@query("f12_extract_dois", oracle(r"""
, found as (select doc_id, unnest(regexp_extract_all(article, '(?i)10\.\d{4,9}/[^\s,;\]\)>"'']+')) as d, unnest(range(1, 1 + len(regexp_extract_all(article, '(?i)10\.\d{4,9}/[^\s,;\]\)>"'']+')))) as i from articles),
clean as (select doc_id, i, lower(regexp_replace(d, '[ ).,;>"''\]]+$', '')) as d from found),
firsts as (select doc_id, d, min(i) as i from clean group by doc_id, d)
select doc_id, string_agg(d, ' ' order by i) as dois from firsts group by doc_id""", "articles"))
def _(spark, sf):
    return articles_of(spark, sf).select("doc_id", F.array_join(C.extract_dois("text"), " ").alias("dois"))


_MARKED = "('As reported by Smith et al. (2019), ' || quote)"


def _mark_sql(label, pattern):
    p = pattern.replace("'", "''")
    return f"case when regexp_matches(s, '{p}') then '{label}:' || trim(regexp_extract(s, '{p}')) end"


@query("f11_secondhand_markers", oracle(f"""
, s as (select quote_id, case quote_id % 4 when 0 then quote when 1 then 'As reported by Smith et al. (2019), ' || quote
   when 2 then quote || ' (Jones & Lee, 2018; Park, 2020) [3-5]' else 'According to Brown (2020) ' || quote end as s from proposals)
select quote_id, concat_ws('|', {', '.join(_mark_sql(n, p) for n, p in C.SECONDHAND)}) as markers from s""", "proposals"))
def _(spark, sf):
    return marked_proposals(spark, sf).select("quote_id", F.array_join(C.secondhand_markers("s"), "|").alias("markers"))


def marked_proposals(spark, sf):
    kind = F.col("quote_id") % 4
    return proposals_of(spark, sf).withColumn("s", (
        F.when(kind == 0, F.col("quote")).when(kind == 1, F.concat(F.lit("As reported by Smith et al. (2019), "), "quote"))
        .when(kind == 2, F.concat("quote", F.lit(" (Jones & Lee, 2018; Park, 2020) [3-5]")))
        .otherwise(F.concat(F.lit("According to Brown (2020) "), "quote"))))


@query("p9_primary_only", oracle(f"""
, s as (select quote_id, case quote_id % 4 when 0 then quote when 1 then 'As reported by Smith et al. (2019), ' || quote
   when 2 then quote || ' (Jones & Lee, 2018; Park, 2020) [3-5]' else 'According to Brown (2020) ' || quote end as s from proposals)
select quote_id from s where concat_ws('|', {', '.join(_mark_sql(n, p) for n, p in C.SECONDHAND)}) = ''""", "proposals"))
def _(spark, sf):
    return marked_proposals(spark, sf).where(F.size(C.secondhand_markers("s")) == 0).select("quote_id")


# ---- ranking --------------------------------------------------------------

STATS = CHUNKS.replace("{src}", "documents") + f"""
, ctok as (select doc_id, chunk_index, {TOKENS.format('chunk')} as t from chunks),
tot as (select doc_id, count(*) as n_chunks, avg(len(t)) as avgdl from ctok group by doc_id),
tf as (select doc_id, chunk_index, dl, token, count(*) as tf from (select doc_id, chunk_index, len(t) as dl, unnest(t) as token from ctok) x group by all),
df0 as (select doc_id, token, count(*) as df from tf group by doc_id, token),
df1 as (select d.*, t.n_chunks, t.avgdl, ln((t.n_chunks - df + 0.5) / (df + 0.5)) as raw_idf from df0 d join tot t on d.doc_id = t.doc_id),
df2 as (select *, case when raw_idf < 0 then 0.25 * avg(raw_idf) over (partition by doc_id) else raw_idf end as idf from df1)
"""


@query("a11_term_statistics", STATS.replace(", cuts", "with recursive cuts", 1) + """
select tf.doc_id, tf.chunk_index, tf.dl, tf.token, tf.tf, d.df, d.n_chunks, round(d.avgdl, 6) as avgdl, round(d.idf, 6) as idf
from tf join df2 d on tf.doc_id = d.doc_id and tf.token = d.token""")
def _(spark, sf):
    return P.term_statistics(P.chunk_offsets(docs_of(spark, sf))).withColumn(
        "avgdl", F.round("avgdl", 6)).withColumn("idf", F.round("idf", 6))


def _terms(quote_col="quote"):
    return X.tokenize(P.first_words(quote_col, Q.SEARCH_WORDS))


RANKED = STATS + rf"""
, ask as (select quote_id as query_id, doc_id, unnest({TOKENS.format("array_to_string(list_filter(regexp_split_to_array(quote, '\\s+'), lambda w: w <> '')[1:10], ' ')")}) as token from proposals),
qt as (select query_id, doc_id, token, count(*) as qtf from ask group by all),
scored as (select q.query_id, q.doc_id, f.chunk_index, sum(qtf * idf * f.tf * 2.5 / (f.tf + 1.5 * (0.25 + 0.75 * f.dl / d.avgdl))) as score
  from qt q join tf f on q.doc_id = f.doc_id and q.token = f.token join df2 d on d.doc_id = f.doc_id and d.token = f.token group by all),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_index) as rank from scored)
"""


@query("t1_bm25_topk", oracle(RANKED + "select query_id, doc_id, chunk_index, cast(rank as int) as rank, round(score, 6) as score from ranked where rank <= 10 and score >= 0.05", "proposals"))
def _(spark, sf):
    ask = proposals_of(spark, sf).select(F.col("quote_id").alias("query_id"), "doc_id", _terms().alias("terms"))
    return P.rank_passages(ask, P.chunk_offsets(docs_of(spark, sf)), 10).withColumn("score", F.round("score", 6))


@query("t1_bm25_corpus", CHUNKS.replace("{src}", "documents").replace(", cuts", "with recursive cuts", 1) + rf"""
, ctok as (select doc_id, chunk_index, {TOKENS.format('chunk')} as t from chunks),
tot as (select count(*) as n_chunks, avg(len(t)) as avgdl from ctok),
tf as (select doc_id, chunk_index, dl, token, count(*) as tf from (select doc_id, chunk_index, len(t) as dl, unnest(t) as token from ctok) x group by all),
df1 as (select token, count(*) as df, any_value(n_chunks) as n_chunks, any_value(avgdl) as avgdl, ln((any_value(n_chunks) - count(*) + 0.5) / (count(*) + 0.5)) as raw_idf from tf, tot group by token),
df2 as (select *, case when raw_idf < 0 then 0.25 * avg(raw_idf) over () else raw_idf end as idf from df1),
ask as (select item_id as query_id, unnest({TOKENS.format("array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:10], ' ')")}) as token from benchmark),
qt as (select query_id, token, count(*) as qtf from ask group by all),
scored as (select q.query_id, f.doc_id, f.chunk_index, sum(qtf * idf * f.tf * 2.5 / (f.tf + 1.5 * (0.25 + 0.75 * f.dl / d.avgdl))) as score
  from qt q join tf f on q.token = f.token join df2 d on d.token = f.token group by all),
ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id, chunk_index) as rank from scored)
select query_id, doc_id, chunk_index, cast(rank as int) as rank, round(score, 6) as score from ranked where rank <= 50 and score >= 0.05""")
def _(spark, sf):
    ask = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), _terms("text").alias("terms"))
    return P.rank_corpus(ask, P.chunk_offsets(docs_of(spark, sf))).withColumn("score", F.round("score", 6))


@query("t2_keyword_topk", oracle(CHUNKS.replace("{src}", "documents") + rf"""
, q as (select quote_id as query_id, doc_id, list_distinct({TOKENS.format("array_to_string(list_filter(regexp_split_to_array(quote, '\\s+'), lambda w: w <> '')[1:10], ' ')")}) as q from proposals),
hit as (select query_id, q.doc_id, chunk_index, len(list_intersect(q.q, {TOKENS.format('chunk')})) / len(q.q) as score from q join chunks c on q.doc_id = c.doc_id where len(q.q) > 0),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_index) as rank from hit where score > 0)
select query_id, doc_id, chunk_index, cast(rank as int) as rank, score from r where rank <= 3""", "proposals"))
def _(spark, sf):
    ask = proposals_of(spark, sf).select(F.col("quote_id").alias("query_id"), "doc_id", _terms().alias("terms"))
    return P.keyword_topk(ask, P.chunk_offsets(docs_of(spark, sf)), 3)


# ---- quotations -----------------------------------------------------------

def benchmark_quotes(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


@query("j9_exact_quote_scan", """
with hit as (select b.item_id as quote_id, d.doc_id, b.text as q, d.text as t from benchmark b join documents d on contains(d.text, b.text)),
spots as (select quote_id, doc_id, q, t, unnest(range(1, length(t) - length(q) + 2)) as i from hit)
select quote_id, doc_id, cast(i - 1 as int) as start, cast(i - 1 + length(q) as int) as "end" from spots where substring(t, i, length(q)) = q""")
def _(spark, sf):
    return Q.exact_quote_scan(benchmark_quotes(spark, sf), docs_of(spark, sf))


@query("c1_locate_in_corpus", r"""
with q as (select item_id as quote_id, case item_id % 3 when 0 then text when 1 then replace(text, ' ', '  ') else translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') end as quote from benchmark),
n as (select quote_id, quote, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) as nq from q),
d as (select doc_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as nt from documents),
hit as (select n.quote_id, n.quote, d.doc_id, d.text, '(?i)' || regexp_replace(regexp_replace(n.nq, '([^\p{L}\p{N} ])', '\\\1', 'g'), ' ', '\\s+', 'g') as pat from n join d on contains(d.nt, n.nq)),
m as (select quote_id, doc_id, case when contains(text, quote) then 'exact' else 'normalized' end as method, text, case when contains(text, quote) then quote else regexp_extract(text, pat) end as found from hit)
select quote_id, doc_id, method, cast(strpos(text, found) - 1 as int) as start, cast(strpos(text, found) - 1 + length(found) as int) as "end" from m""")
def _(spark, sf):
    q = benchmark_quotes(spark, sf)
    k = F.col("quote_id") % 3
    q = q.withColumn("quote", F.when(k == 0, F.col("quote")).when(k == 1, F.replace("quote", F.lit(" "), F.lit("  ")))
                     .otherwise(F.translate("quote", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    return Q.locate_in_corpus(q, docs_of(spark, sf))


def _own_pairs(spark, sf):
    p = proposals_of(spark, sf).where(F.length("quote") >= Q.MIN_QUOTE_CHARS)
    return p.select("quote_id", "doc_id", "quote").join(P.chunk_offsets(docs_of(spark, sf)).drop("position_ratio"), "doc_id")


@query("f17_match_cascade")
def _(spark, sf):
    return Q.match_cascade(_own_pairs(spark, sf)).select(
        "quote_id", "doc_id", "chunk_index", "method", "m_start", "m_end", F.round("confidence", 6).alias("confidence"))


@query("f17_verbatim_match", oracle(CHUNKS.replace("{src}", "documents") + r"""
, pair as (select p.quote_id, p.doc_id, c.chunk_index, p.quote, c.chunk, lower(trim(regexp_replace(p.quote, '\s+', ' ', 'g'))) as nq from proposals p join chunks c on p.doc_id = c.doc_id where length(p.quote) >= 20),
m as (select *, '(?i)' || regexp_replace(regexp_replace(nq, '([^\p{L}\p{N} ])', '\\\1', 'g'), ' ', '\\s+', 'g') as pat from pair),
f as (select quote_id, doc_id, chunk_index, chunk, case when contains(chunk, quote) then 'exact' else 'normalized' end as method, case when contains(chunk, quote) then quote else regexp_extract(chunk, pat) end as found
  from m where contains(chunk, quote) or contains(lower(trim(regexp_replace(chunk, '\s+', ' ', 'g'))), nq))
select quote_id, doc_id, chunk_index, method, cast(strpos(chunk, found) - 1 as int) as m_start, cast(strpos(chunk, found) - 1 + length(found) as int) as m_end from f""", "proposals"))
def _(spark, sf):
    m = _own_pairs(spark, sf).withColumn("v", Q.verbatim_match(F.col("quote"), F.col("chunk"))).where("v is not null")
    return m.select("quote_id", "doc_id", "chunk_index", "v.method", F.col("v.start").alias("m_start"), F.col("v.end").alias("m_end"))


@query("f18_expand_sentence")
def _(spark, sf):
    pairs = _own_pairs(spark, sf).where(Q.verbatim_match(F.col("quote"), F.col("chunk")).isNull())
    a = Q.approximate_matches(spread(pairs, "quote_id", "chunk_index"), Q.MIN_SIMILARITY).where("a is not null")
    return a.select("quote_id", "doc_id", "chunk_index", "a.method", F.substring(
        "chunk", F.col("a.start") + 1, F.col("a.end") - F.col("a.start")).alias("sentence"))


@query("f16_similarity")
def _(spark, sf):
    own = proposals_of(spark, sf).select("quote_id", "doc_id", "quote").join(
        read(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line")), "doc_id")
    return Q.similarity_of(own, "quote", "first_line").select("quote_id", F.round("similarity", 6).alias("similarity"))


@query("t3_fuzzy_topk")
def _(spark, sf):
    pairs = proposals_of(spark, sf).select("quote_id", "doc_id", "quote").join(
        docs_of(spark, sf).select("doc_id", "text"), "doc_id").where(~F.contains("text", "quote"))
    return Q.fuzzy_topk(pairs, 0.9)


@query("j8_locate_quotes")
def _(spark, sf):
    return Q.locate_quotes(proposals_of(spark, sf), docs_of(spark, sf))


@query("p10_accept_match", oracle(r"""
, m as (select p.quote_id, p.quote, d.text, case when contains(d.text, p.quote) then 1.0 else 0.96 end as sim from proposals p join documents d on p.doc_id = d.doc_id)
select quote_id, sim >= 0.95 and (sim >= 1 or len(list_filter(regexp_extract_all(lower(quote), '\d+(?:[.,]\d+)*'), lambda x: not list_contains(regexp_extract_all(lower(text), '\d+(?:[.,]\d+)*'), x))) = 0) as accepted from m""", "proposals"))
def _(spark, sf):
    m = proposals_of(spark, sf).join(docs_of(spark, sf), "doc_id").withColumn(
        "sim", F.when(F.contains("text", "quote"), F.lit(1.0)).otherwise(F.lit(0.96)))
    return m.select("quote_id", Q.accept_match("sim", "quote", "text").alias("accepted"))


_AT = "(select unnest([0, 1, 3, 5, 7, 9]) as f) fr"


@query("p8_section_gate", oracle(HEADINGS + f"""
, prof as (select a.doc_id, length(a.article) as n, count(r.doc_id) as heads, coalesce(bool_or(category = 'ABSTRACT'), false) as has_abs, coalesce(bool_or(category = 'REFS'), false) as has_refs, coalesce(min(start), length(any_value(a.article))) as lead from articles a left join regions r on a.doc_id = r.doc_id group by a.doc_id, a.article),
pos as (select doc_id, cast(floor(length(article) * f / 10) as int) as position from articles, {_AT}),
cat as (select p.doc_id, p.position, coalesce(arg_max(r.category, r.start), 'UNKNOWN') as category, arg_max(r.stop - r.start, r.start) as region from pos p left join regions r on p.doc_id = r.doc_id and r.start <= p.position group by p.doc_id, p.position)
select c.doc_id, c.position, c.category, category in ('EVIDENCE', 'ABSTRACT') or (category = 'UNKNOWN' and heads > 0 and not has_abs and lead <= 8000) as require_evidence,
 category in ('EVIDENCE', 'ABSTRACT') as require_strict, not has_refs or case category when 'REFS' then false when 'EXCLUDE' then region > 8000 else true end as exclude_non_evidence
from cat c join prof p on c.doc_id = p.doc_id""", "articles"))
def _(spark, sf):
    d = P.with_sections(articles_of(spark, sf))
    pos = d.withColumn("position", F.explode(F.array_distinct(F.transform(
        F.array(*[F.lit(x) for x in (0, 1, 3, 5, 7, 9)]), lambda f: F.floor(F.length("text") * f / 10).cast("int")))))
    s = pos.withColumn("s", H.section_at("section_map", "position"))
    region = F.col("s.end") - F.col("s.start")

    def gate(mode, strict=False):
        return Q.section_gate(mode, strict, F.col("s.category"), F.col("section_map"), region, F.length("text"), F.lit(False))

    return s.select("doc_id", "position", "s.category", gate("require_evidence").alias("require_evidence"),
                    gate("require_evidence", True).alias("require_strict"),
                    gate("exclude_non_evidence").alias("exclude_non_evidence"))


def verified_of(spark, sf):
    return Q.verify_quotes(proposals_of(spark, sf), articles_of(spark, sf))


@query("c1_verify_quotes")
def _(spark, sf):
    return verified_of(spark, sf).withColumn("markers", F.array_join("markers", "|"))


@query("a7_quote_outcomes", oracle("""
select doc_id, count(*) as proposed, count(*) filter (where verified and quote <> '') as verified_primary,
 count(*) filter (where not (verified and quote <> '') and verification_method = 'rejected_non_evidence_section') as dropped_non_evidence,
 count(*) filter (where not (verified and quote <> '') and verification_method = 'rejected_secondhand_citation') as dropped_secondhand,
 count(*) filter (where not (verified and quote <> '') and verification_method = 'not_found') as dropped_not_found
from study_quotes group by doc_id""", "study_quotes"))
def _(spark, sf):
    return Q.quote_outcomes(derive(spark, sf, "study_quotes"))


@query("p11_min_verified_filter", oracle("""
, n as (select doc_id, count(*) as n from study_quotes where verified and quote <> '' group by doc_id)
select s.doc_id, coalesce(n.n, 0) as n_verified, coalesce(n.n, 0) >= 2 as kept, case when coalesce(n.n, 0) < 2 then 'only ' || cast(coalesce(n.n, 0) as string) || ' verified quotes (threshold: 2)' end as drop_reason
from studies s left join n on s.doc_id = n.doc_id""", "studies", "study_quotes"))
def _(spark, sf):
    return Q.min_verified_filter(derive(spark, sf, "studies").select("doc_id"), derive(spark, sf, "study_quotes"), 2)


@query("t6_importance_cap", oracle("""
, r as (select quote_id, cast(floor(quote_id / 10) as bigint) as study, row_number() over (partition by cast(floor(quote_id / 10) as bigint) order by case lower(importance) when 'high' then 0 when 'low' then 2 else 1 end, pos, quote_id) as rn from proposals)
select quote_id, study from r where rn <= 4""", "proposals"))
def _(spark, sf):
    p = proposals_of(spark, sf).withColumn("study", F.floor(F.col("quote_id") / 10))
    return Q.importance_cap(p, "study", 4).select("quote_id", "study")


@query("a13_distinct_ordered", oracle(r"""
, k as (select quote_id, cast(floor(quote_id / 20) as bigint) as study, trim(regexp_replace(lower(quote), '[^\p{L}\p{N}_]+', ' ', 'g')) as quote_key from proposals where quote <> '')
select study, quote_key, min(quote_id) as quote_id from k group by study, quote_key""", "proposals"))
def _(spark, sf):
    p = proposals_of(spark, sf).withColumn("study", F.floor(F.col("quote_id") / 20))
    return Q.distinct_quotes(p, "study").select("study", "quote_key", "quote_id")
