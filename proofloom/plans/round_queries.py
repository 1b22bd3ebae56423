"""Queries over references, answers and streams."""

from pyspark.sql import functions as F

from ..functions.sql import register_functions
from ..operators import answers as N
from ..operators import references as X
from ..session import cut_lineage, work_dir
from ..sources.sinks import read_batches, write_once
from ..streaming import rounds as S
from .catalog_queries import CATALOG, TKEY
from .passage_queries import ENTRIES, entries_of
from .registry import query
from .selection_queries import studies_of
from .tables import derive, oracle, read



def written_twice(spark, rows, name, *by):
    """Rows that were written as one batch, and once more, which changes nothing, and read back."""
    rows = cut_lineage(rows, name)
    folder = work_dir(spark, name)
    for _ in range(2):
        write_once(rows, folder, 0, *by)
    return read_batches(spark, folder, rows.schema)


PICKS = """
, picks as (select doc_id, pos, case pos when 0 then '1' when 1 then '2' when 2 then '99' when 3 then 'x' else '1' end as idx,
  case pos when 2 then 'No such entry' else '' end as title, case pos when 1 then 'DOI: 10.5555/ABC.' when 3 then 'https://doi.org/10.5555/x' || cast(doc_id % 50 as string) else '' end as doi
 from (select doc_id, unnest([0, 1, 2, 3, 4]) as pos from articles) a)
, m as (select p.doc_id, p.pos, case when p.doi <> '' then lower(regexp_replace(regexp_replace(regexp_replace(p.doi, '^https://doi.org/', ''), '(?i)^doi:\\s*', ''), '[ ).,;]+$', '')) else coalesce(e.doi, '') end as doi,
  case when p.title <> '' then p.title else coalesce(e.raw, '') end as title, e.raw as raw
 from picks p left join entries e on e.doc_id = p.doc_id and cast(e.entry_no as string) = p.idx)
, k as (select *, case when doi <> '' then 'doi:' || doi else 'title:' || substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 1, 120) end as work_key from m where (raw is not null or doi <> '') and (doi <> '' or title <> ''))
, r as (select *, row_number() over (partition by doc_id, work_key order by pos) as rn from k)
select doc_id, pos, title, doi, coalesce(raw, '') as raw, work_key from r where rn = 1""".replace("\\\\", "\\")


@query("j3_map_reference_selection", oracle(ENTRIES + PICKS, "articles"))
def _(spark, sf):
    docs = derive(spark, sf, "articles").select("doc_id")
    pos = F.col("pos")
    picks = docs.withColumn("pos", F.explode(F.array(*[F.lit(i) for i in range(5)]))).select(
        "doc_id", "pos",
        F.when(pos == 1, F.lit("2")).when(pos == 2, F.lit("99")).when(pos == 3, F.lit("x")).otherwise(F.lit("1")).alias("index"),
        F.when(pos == 2, F.lit("No such entry")).otherwise(F.lit("")).alias("title"),
        F.when(pos == 1, F.lit("DOI: 10.5555/ABC.")).when(pos == 3, F.concat(F.lit("https://doi.org/10.5555/x"), F.col("doc_id") % 50))
        .otherwise(F.lit("")).alias("doi"))
    return X.map_reference_selection(picks, entries_of(spark, sf))


TARGETS = r"""
, cand as (select doc_id as cand_id, cast(floor(doc_id / 10) as bigint) as g, case when doc_id % 5 = 4 then '' else paper_title end as title,
  case when doc_id % 2 = 0 then coalesce(paper_doi, '') else '' end as doi from studies),
cat as (select lower(trim(doi)) as dk, min(seq) as result_id from papers where doi <> '' group by 1),
toks as (select cand_id, g, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}')) as t from cand where doi = '' and trim(title) <> ''),
hits as (select query_id as g, paper_index as pos, seq, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}')) as t from candidates),
sc as (select cand_id, seq, pos, len(list_intersect(a.t, h.t)) / len(a.t) as share from toks a join hits h on a.g = h.g where len(a.t) > 0),
bt as (select cand_id, seq from (select *, row_number() over (partition by cand_id order by share desc, pos) as rn from sc where share >= 0.6) z where rn = 1
 union all select a.cand_id, arg_min(h.seq, h.pos) from toks a join hits h on a.g = h.g where len(a.t) = 0 group by a.cand_id),
f as (select c.*, coalesce(cat.result_id, bt.seq) as result_id from cand c left join cat on c.doi <> '' and cat.dk = lower(replace(c.doi, 'https://doi.org/', '')) left join bt on bt.cand_id = c.cand_id)
select f.cand_id, f.result_id, case when f.doi = '' and trim(f.title) = '' then 'no_doi_or_title' when f.doi = '' and f.result_id is null then 'title_search:no_confident_match'
 else case when f.doi <> '' then 'doi_lookup' else 'title_search' end || case when coalesce(p.full_text_available, false) then ':full_text_ok' else ':no_full_text' end end as status
from f left join papers p on p.seq = f.result_id"""


@query("j19_reference_targets", oracle(TARGETS, "studies", "papers", "candidates"))
def _(spark, sf):
    s = studies_of(spark, sf)
    cand = s.select(F.col("doc_id").alias("cand_id"), F.floor(F.col("doc_id") / 10).alias("group"),
                    F.when(F.col("doc_id") % 5 == 4, F.lit("")).otherwise(F.col("paper_title")).alias("title"),
                    F.when(F.col("doc_id") % 2 == 0, F.coalesce("paper_doi", F.lit(""))).otherwise(F.lit("")).alias("doi"))
    cat = derive(spark, sf, "papers").select(F.col("seq").alias("result_id"), "doi", F.col("full_text_available").alias("has_text"))
    hits = derive(spark, sf, "candidates").select(F.col("query_id").alias("group"), F.col("paper_index").alias("pos"),
                                                  F.col("seq").alias("result_id"), "title")
    return X.reference_targets(cand, cat, hits)


GRAPH = """
, n as (select count(*) as n from documents),
edges as (select doc_id as paper, cast(1 as bigint) as entry_no, (doc_id * 7 + 1) % n as cited from documents, n union all select doc_id, 2, (doc_id * 3 + 2) % n from documents, n union all select doc_id, 3, doc_id from documents),
nodes as (select d.doc_id as paper, d.doc_id % 2 = 0 as has_text, (select count(*) from study_quotes q where q.doc_id = d.doc_id and q.verified and q.quote <> '') as n_verified from documents d),
seeds as (select doc_id as paper from labels where toxic = 1),
walk as (select s.paper, 0 as depth, o.has_text as kept from seeds s join nodes o on o.paper = s.paper
 union select e.cited, w.depth + 1, o.has_text and o.n_verified >= 1 from walk w join edges e on e.paper = w.paper join nodes o on o.paper = e.cited where w.kept and w.depth < 3),
firsts as (select paper, min(depth) as depth from walk group by paper)
"""


def snowball_of(spark, sf, budget=None, edges=None):
    docs = read(spark, sf, "documents").select("doc_id")
    d = docs.withColumn("n", docs.agg(F.count(F.lit(1))).scalar())
    edges = edges if edges is not None else d.select(F.col("doc_id").alias("paper"), F.explode(F.array(
        F.struct(F.lit(1).cast("bigint").alias("entry_no"), ((F.col("doc_id") * 7 + 1) % F.col("n")).alias("cited")),
        F.struct(F.lit(2).cast("bigint").alias("entry_no"), ((F.col("doc_id") * 3 + 2) % F.col("n")).alias("cited")),
        F.struct(F.lit(3).cast("bigint").alias("entry_no"), F.col("doc_id").alias("cited")))).alias("e")).select("paper", "e.*")
    quotes = derive(spark, sf, "study_quotes").where("verified and quote <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_verified"))
    papers = docs.join(quotes, "doc_id", "left").select(
        F.col("doc_id").alias("paper"), F.coalesce("n_verified", F.lit(0).cast("bigint")).alias("n_verified"), (F.col("doc_id") % 2 == 0).alias("has_text"))
    seeds = read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("paper"), F.col("doc_id").alias("ord"))
    return X.citation_snowball(seeds, edges, papers, max_depth=3, budget=budget)


@query("c2_citation_snowball", oracle(GRAPH.replace("with recursive", "") + """
select f.paper, f.depth, o.has_text as acquired, o.n_verified, o.has_text and o.n_verified >= 1 as kept from firsts f join nodes o on o.paper = f.paper where f.depth > 0""", "study_quotes"))
def _(spark, sf):
    return snowball_of(spark, sf).drop("ord", "entry_no")


#: The chase paper by paper: a queue of papers, the works met, and the tries of 20 that are spent.
BUDGETED = GRAPH.replace("with recursive", "") + """
, lists as (select e.paper, list({'p': e.cited, 'k': o.has_text and o.n_verified >= 1} order by e.entry_no) as es from edges e join nodes o on o.paper = e.cited group by e.paper),
turns as (select 1 as depth, list(s.paper order by s.paper) filter (where o.has_text) as queue, cast([] as bigint[]) as later, list(s.paper) as met, cast([] as struct(p bigint, d int)[]) as tried from seeds s join nodes o on o.paper = s.paper
 union all
 select case when len(queue) > 0 then depth else depth + 1 end, case when len(queue) > 0 then queue[2:] else later end,
  case when len(queue) > 0 then list_concat(later, list_transform(list_filter(news, lambda x: x.k), lambda x: x.p)) else cast([] as bigint[]) end,
  list_concat(met, list_transform(news, lambda x: x.p)), list_concat(tried, list_transform(news, lambda x: {'p': x.p, 'd': depth}))
 from (select t.*, list_filter(cut, lambda x, i: not list_contains(met, x.p) and list_position(list_transform(cut, lambda y: y.p), x.p) = i) as news
  from (select t.*, case when len(t.queue) > 0 then l.es[1:least(5, 20 - len(t.tried))] else l.es[1:0] end as cut from turns t left join lists l on l.paper = t.queue[1]
   where len(t.tried) < 20 and t.depth <= 3 and (len(t.queue) > 0 or len(t.later) > 0)) t)),
ended as (select tried from turns order by len(tried) desc limit 1),
spent as (select unnest(tried, recursive := true) from ended)
select s.p as paper, s.d as depth, o.has_text as acquired, o.n_verified, o.has_text and o.n_verified >= 1 as kept from spent s join nodes o on o.paper = s.p"""


@query("c2_citation_snowball_budget", oracle(BUDGETED, "study_quotes"))
def _(spark, sf):
    return snowball_of(spark, sf, 20).drop("ord", "entry_no")


def parsed_edges(spark, sf):
    """Edges read from the texts: reference sections, entries, selected works, records."""
    entries = entries_of(spark, sf)
    picks = entries.select("doc_id", F.col("entry_no").alias("pos"), F.col("entry_no").cast("string").alias("index"),
                           F.lit("").alias("title"), F.lit("").alias("doi"))
    works = X.map_reference_selection(picks, entries)
    wanted = works.select(F.concat_ws(":", "doc_id", "pos").alias("cand_id"), F.col("doc_id").alias("group"), "title", "doi", "pos")
    docs = read(spark, sf, "documents")
    records = docs.select(F.col("doc_id").alias("result_id"), F.concat(
        F.lit("10.5555/"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 10)).alias("doi"), (F.col("doc_id") % 2 == 0).alias("has_text"))
    hits = docs.select(F.col("doc_id").alias("group"), F.lit(1).cast("bigint").alias("pos"), F.col("doc_id").alias("result_id"),
                       F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    found = X.reference_targets(wanted.drop("pos"), records, hits).where("result_id is not null")
    return wanted.join(found, "cand_id").select(F.col("group").alias("paper"), F.col("pos").cast("bigint").alias("entry_no"),
                                                F.col("result_id").alias("cited"))


PARSED = ENTRIES + """
, records as (select doc_id as paper, '10.5555/' || substring(md5(cast(doc_id as string)), 1, 10) as doi from documents),
edges as (select e.doc_id as paper, r.paper as cited from entries e join records r on r.doi = e.doi),
""" + GRAPH[GRAPH.index("nodes as"):]


@query("c2_chase_from_texts", oracle(PARSED + """
select f.paper, f.depth, o.has_text as acquired, o.n_verified, o.has_text and o.n_verified >= 1 as kept from firsts f join nodes o on o.paper = f.paper where f.depth > 0""", "articles", "study_quotes"))
def _(spark, sf):
    # Every generation reads the edges, so the texts are parsed once.
    return snowball_of(spark, sf, edges=cut_lineage(parsed_edges(spark, sf), "parsed-edges")).drop("ord", "entry_no")


@query("a8_harvest_rollup", oracle(GRAPH + """
, ev as (select f.paper, f.depth, o.has_text and o.n_verified >= 1 as kept from firsts f join nodes o on o.paper = f.paper where f.depth > 0),
p as (select depth, count(*) as candidates, count(*) filter (where kept) as kept from ev group by depth)
select depth, candidates, kept, coalesce(lag(kept) over (order by depth), (select count(*) from seeds)) as frontier, cast(100000 - sum(candidates) over (order by depth) as bigint) as budget_left from p""", "study_quotes"))
def _(spark, sf):
    return rollup_of(spark, sf)[1]


def rollup_of(spark, sf):
    ev = snowball_of(spark, sf)
    n = read(spark, sf, "labels").where("toxic = 1").count()
    return ev, X.harvest_rollup(ev, n, 100000)


@query("s12_sink_harvest_trace", oracle(GRAPH + """
, ev as (select f.paper, f.depth, o.has_text as acquired, o.n_verified, o.has_text and o.n_verified >= 1 as kept from firsts f join nodes o on o.paper = f.paper where f.depth > 0),
p as (select depth, count(*) as candidates, count(*) filter (where kept) as kept from ev group by depth),
r as (select depth, candidates, kept, coalesce(lag(kept) over (order by depth), (select count(*) from seeds)) as frontier, cast(100000 - sum(candidates) over (order by depth) as bigint) as budget_left from p)
select 0 as part, cast(depth as bigint) as ord, '' as paper, 'depth ' || cast(depth as string) || ': frontier=' || cast(frontier as string) || ' candidates=' || cast(candidates as string) || ' kept=' || cast(kept as string) || ' budget_left=' || cast(budget_left as string) as line from r
union all select 1, depth, cast(paper as string), '[depth ' || cast(depth as string) || '] ' || case when kept then 'KEPT' when not acquired then 'DROPPED (not acquired)' else 'DROPPED (' || cast(n_verified as string) || ' primary quotes)' end || ': ' || cast(paper as string) from ev""", "study_quotes"))
def _(spark, sf):
    ev, roll = rollup_of(spark, sf)
    return written_twice(spark, X.harvest_trace(ev.withColumn("paper", F.col("paper").cast("string")), roll), "trace", "part")


# ---- answers --------------------------------------------------------------

_SIZES = ", ".join(str(s) for s in N.window_sizes(65536))


@query("f27_token_budget", f"""
with t as (select doc_id, length(text) as chars, 1000 + doc_id % 3000 as output_tokens from documents),
i as (select *, case when chars <= 0 then 0 else cast(floor(chars / 3.0) as bigint) + 1 end as input_tokens from t),
n as (select *, cast(floor(input_tokens * 1.25) as bigint) + output_tokens + 2048 as needed from i),
b as (select *, coalesce((select min(s) from (select unnest([{_SIZES}]) as s) z where s >= needed), 65536) as bucket from n)
select doc_id, input_tokens, needed, cast(least(greatest(least(bucket, 16384), 1024, least(needed, 65536)), 65536) as bigint) as chosen, needed > 16384 as exceeded from b""")
def _(spark, sf):
    p = read(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"), (1000 + F.col("doc_id") % 3000).alias("output_tokens"))
    return N.token_budget(p, 65536, 16384).select("doc_id", "input_tokens", "needed", "chosen", "exceeded")


def answers_of(spark, sf):
    """Answers in the ways models break JSON, one per document."""
    title = F.replace(F.replace(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("\\"), F.lit("")), F.lit('"'), F.lit(""))
    good = F.concat(F.lit('{"quote": "'), title, F.lit('", "score": '), F.col("doc_id") % 10, F.lit(', "tags": ["a", "b"]}'))
    kind = F.col("doc_id") % 9
    raw = (F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```")))
           .when(kind == 2, F.replace(good, F.lit('"b"]}'), F.lit('"b",],}')))
           .when(kind == 3, F.replace(good, F.lit(', "b"]}'), F.lit(', "b')))
           .when(kind == 4, F.concat(F.lit('{"quote": "he said "yes" to '), title, F.lit('", "score": 1}')))
           .when(kind == 5, F.replace(good, F.lit('"score": '), F.lit('"score": about ')))
           .when(kind == 6, F.replace(good, F.lit('"b"]}'), F.lit('"b"}')))
           .when(kind == 7, F.concat(F.lit("<think>maybe {not this}</think>"), good)).otherwise(title))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), raw.alias("raw"))


@query("f28_repair_json")
def _(spark, sf):
    return N.repair_json(answers_of(spark, sf)).select("answer_id", "stage", "value")


@query("s14_dead_letter_json", oracle(r"""
, t as (select doc_id as answer_id, doc_id % 18 = 17 as braced, replace(replace(split_part(text, chr(10), 1), chr(92), ''), chr(34), '') as title from documents where doc_id % 9 = 8),
a as (select answer_id, braced, case when braced then '{' || title || '}' else title end as raw from t where not braced or title <> '')
select answer_id, raw, case when braced then 'Expecting property name enclosed in double quotes' else 'no object in the answer' end as reason,
 case when braced then 1 + len(raw[2:]) - len(ltrim(raw[2:])) end as position,
 case when braced then substring(raw, 1, 1 + len(raw[2:]) - len(ltrim(raw[2:])) + 400) else trim(raw) end as "window" from a""".replace(", t as", "with t as", 1)))
def _(spark, sf):
    # Of the answers without an object, every other one has braces around its words.
    braced = (F.col("answer_id") % 18 == 17) & (F.col("raw") != "")
    answers = answers_of(spark, sf).withColumn("raw", F.when(braced, F.concat(F.lit("{"), "raw", F.lit("}"))).otherwise(F.col("raw")))
    return N.dead_letter_json(answers)


def turns_of(spark, sf):
    return read(spark, sf, "conversations")


@query("x1_batch_answer")
def _(spark, sf):
    import pandas as pd

    def longest_word(batch):
        return pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "num_ctx": batch["num_ctx"], "answer": [
            max(t.split() or [""], key=len) for t in batch["text"]]})

    p = turns_of(spark, sf).where("role = 'user'").select("conv_id", "turn", "text", F.lit("planning").alias("task"))
    return N.batch_answer(p, longest_word, "conv_id bigint, turn bigint, num_ctx int, answer string")


@query("x1_lookup_answers", """
select u.conv_id, u.turn, a.text as answer from conversations u left join conversations a on a.role = 'assistant' and a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user'""")
def _(spark, sf):
    t = turns_of(spark, sf)
    known = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return N.lookup_answers(t.where("role = 'user'").select("conv_id", "turn"), known, ["conv_id", "turn"])


@query("s13_sink_qa_transcript", """
select u.conv_id, u.turn, 'Q: ' || u.text || chr(10) || chr(10) || 'A: ' || a.text as value from conversations u join conversations a on a.role = 'assistant' and a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and u.text <> ''""")
def _(spark, sf):
    turns, folder = turns_of(spark, sf), work_dir(spark, "transcript")
    for _ in range(2):  # the second call finds the batch and changes nothing
        N.append_transcript(turns, folder, 0)
    return read_batches(spark, folder, N.transcript_rows(turns).schema)


@query("c11_map_reduce_text")
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 40).alias("grp"), "text")
    return N.map_reduce_text(d, "grp", "doc_id", "text").select("grp", "fragment", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query("x2_register_functions")
def _(spark, sf):
    register_functions(spark)
    read(spark, sf, "documents").createOrReplaceTempView("x2_documents")
    return spark.sql("""
        select d.doc_id, c.chunk_index, c.start, c.`end`, md5(normalize_text(c.chunk)) as folded, title_key(d.source) as source_key
        from x2_documents d, lateral chunk_text(d.text, 4000, 500) c""")


# ---- streams --------------------------------------------------------------

def stream_of(spark, sf, base, name):
    """A derived table over a stream of its base table."""
    view = f"stream_{base}"
    S.read_table_stream(spark, sf, base).createOrReplaceTempView(view)
    return derive(spark, sf, name, **{base: view})


@query("r1_stream_catalog", oracle(CATALOG + """select seq, paper_id, abstract, citation_count, open_access_pdf_url, full_text_available, n_records from catalog""", "keyed_papers"))
def _(spark, sf):
    c = landed_in_parts(spark, derive(spark, sf, "papers"), F.col("seq") % 3, S.stream_catalog)
    return c.select("seq", "paper_id", "abstract", "citation_count", "open_access_pdf_url", "full_text_available", "n_records")


@query("r2_stream_read_once", oracle("select distinct paper_id from keyed_papers", "keyed_papers"))
def _(spark, sf):
    return landed_in_parts(spark, derive(spark, sf, "papers").select("seq", "doi", "title"), F.col("seq") % 3,
                           lambda s, folder: S.run_to_table(S.read_once(s).select("paper_id"), "read-once", folder=folder))


def landed_in_parts(spark, table, part, step):
    """Land a table in three parts, rows in any order, and run a stream after each, as restarts from its checkpoint."""
    table = cut_lineage(table.withColumn("_part", part), "to-land")
    landing, folder = work_dir(spark, "landing"), work_dir(spark, "stream")
    kept = table.drop("_part")
    for k in range(3):
        table.where(F.col("_part") == k).select(kept.columns).repartition(4).write.mode("append").parquet(landing)
        out = step(spark.readStream.schema(kept.schema).parquet(landing), folder)
    return out


def rounds_in_parts(spark, sf, step):
    """The rounds of every run in three parts, earlier ones first."""
    rounds = derive(spark, sf, "search_rounds")
    last = rounds.agg(F.max("round")).first()[0] or 0
    return landed_in_parts(spark, rounds, F.floor(3 * F.col("round") / (last + 1)), step)


@query("r3_stream_query_dedupe", oracle(f"""
select distinct run_id, {TKEY.format('query')} as query_key from search_rounds where {TKEY.format('query')} <> ''""", "search_rounds"))
def _(spark, sf):
    return rounds_in_parts(spark, sf, lambda s, folder: S.run_to_table(
        S.query_dedupe(s).select("run_id", "query_key"), "queries", folder=folder))


@query("r4_stream_stagnation", oracle("""
, i as (select *, sum(case when added > 0 then 1 else 0 end) over (partition by run_id order by round rows unbounded preceding) as island from search_rounds)
select run_id, round, cast(sum(case when added > 0 then 0 else 1 end) over (partition by run_id, island order by round rows unbounded preceding) as bigint) as stagnant,
 sum(case when added > 0 then 0 else 1 end) over (partition by run_id, island order by round rows unbounded preceding) >= 3 as stop from i""", "search_rounds"))
def _(spark, sf):
    return rounds_in_parts(spark, sf, lambda s, folder: S.stagnation_table(s, folder=folder))


@query("r5_stream_api_stats", oracle("""
select date_trunc('day', ts) as window_start, api, count(*) as total_queries, cast(sum(case when error is null then n_results else 0 end) as bigint) as total_results, count(error) as total_errors
from search_calls group by 1, 2""", "search_calls"))
def _(spark, sf):
    s = S.api_stats_stream(stream_of(spark, sf, "events", "search_calls"))
    return S.latest_update(S.run_to_table(s, "api-stats", "update"), ["window_start", "api"])
