"""Queries over selection rules, budgets and rounds."""

from pyspark.sql import functions as F

from ..functions.text import missing
from ..operators import catalog as C
from ..operators import selection as S
from ..operators.prefix import first_n_per_key
from .catalog_queries import CATALOG, TKEY, catalog_of, catalog_table, inventory_of
from .registry import query
from .tables import derive, oracle, read

_W = "case lower(trim(coalesce(study_type, ''))) " + " ".join(
    f"when '{k}' then {v}" for k, v in S.STUDY_WEIGHTS.items()) + " else 3 end"
STRENGTH = f"(coalesce(try_cast(reliability_score as double), 0) + {_W})"


def studies_of(spark, sf):
    return derive(spark, sf, "studies")


@query("p5_readable_papers", oracle(CATALOG + """
, modes as (select 'main' as mode union all select 'tangential'),
u as (select c.seq, mode, full_text_available as f, coalesce(abstract, '') <> '' as a from catalog c, modes where paper_id not in (select paper_id from studies where study_index = 1))
select seq, mode, case when f or (mode = 'tangential' and a) then 'read' else 'skip abstract only' end as action from u where f or a""", "keyed_papers", "studies"))
def _(spark, sf):
    p, read_ids = catalog_table(spark, sf), studies_of(spark, sf).where("study_index = 1")
    both = [S.readable_papers(p, read_ids, m).withColumn("mode", F.lit(m)) for m in ("main", "tangential")]
    return both[0].unionByName(both[1]).select("seq", "mode", "action")


@query("j5_unseen_only", oracle("""
select doc_id from studies where paper_id not in (select paper_id from studies where study_index = 2)""", "studies"))
def _(spark, sf):
    s = studies_of(spark, sf)
    return S.unseen_only(s, s.where("study_index = 2"), ["paper_id"]).select("doc_id")


@query("f29_study_weight", oracle(f"select doc_id, cast({_W} as double) as weight, {STRENGTH} as strength from studies", "studies"))
def _(spark, sf):
    return studies_of(spark, sf).select("doc_id", S.study_weight("study_type").alias("weight"), S.strength().alias("strength"))


def _grouped(spark, sf, size):
    return studies_of(spark, sf).withColumn("grp", F.floor(F.col("doc_id") / size))


@query("p12_apply_drop_list", oracle("""
, s as (select doc_id, cast(floor(doc_id / 16) as bigint) as grp,
  doc_id in (select doc_id from decisions where pass = 2 and not include) and doc_id not in (select doc_id from decisions where pass = 1 and include and doc_id % 2 = 0) as dropped from studies)
select doc_id, not dropped or count(*) over (partition by grp) <= 5 or count(*) filter (where not dropped) over (partition by grp) = 0 as kept from s""", "studies", "decisions"))
def _(spark, sf):
    d = derive(spark, sf, "decisions")
    return S.apply_drop_list(_grouped(spark, sf, 16), d.where("pass = 2 and not include"),
                             d.where("pass = 1 and include and doc_id % 2 = 0"), "grp").select("doc_id", "kept")


@query("p13_default_include", oracle("""
select s.doc_id, coalesce(d.include, true) as include from studies s left join (select * from decisions where pass = 2) d on s.doc_id = d.doc_id""", "studies", "decisions"))
def _(spark, sf):
    return S.default_include(studies_of(spark, sf), derive(spark, sf, "decisions").where("pass = 2")).select("doc_id", "include")


@query("j15_prior_decisions", oracle("""
, l as (select doc_id, arg_max(include, pass) as p from decisions group by doc_id)
select s.doc_id, case when p then 'INCLUDE' when not p then 'EXCLUDE' end as prior from studies s left join l on s.doc_id = l.doc_id""", "studies", "decisions"))
def _(spark, sf):
    return S.prior_decisions(studies_of(spark, sf), derive(spark, sf, "decisions")).select("doc_id", "prior")


@query("t4_rescue_topk", oracle(f"""
, s as (select s.*, cast(floor(s.doc_id / 16) as bigint) as grp, coalesce(d.include, false) and s.doc_id % 32 < 16 as include from studies s left join (select * from decisions where pass = 1) d on s.doc_id = d.doc_id),
r as (select *, row_number() over (partition by grp order by {STRENGTH} desc, coalesce(paper_year, 0) desc, doc_id) as rank from s where grp in (select grp from s group by grp having not bool_or(include)))
select doc_id, grp, cast(rank as int) as rank from r where rank <= 5""", "studies", "decisions"))
def _(spark, sf):
    d = derive(spark, sf, "decisions").where("pass = 1").select("doc_id", "include")
    s = _grouped(spark, sf, 16).join(d, "doc_id", "left").withColumn(
        "include", F.coalesce("include", F.lit(False)) & (F.col("doc_id") % 32 < 16))
    return S.rescue_topk(s, "grp").select("doc_id", "grp", "rank")


@query("t5_top_up", oracle(f"""
, s as (select s.*, cast(floor(s.doc_id / 16) as bigint) as grp, coalesce(d.include, false) and s.doc_id % 3 = 0 as include from studies s left join (select * from decisions where pass = 1) d on s.doc_id = d.doc_id),
n as (select grp, count(*) filter (where include) as have from s group by grp),
r as (select s.*, row_number() over (partition by grp order by has_full_text desc, {STRENGTH} desc, coalesce(paper_year, 0) desc, doc_id) as rank from s where not include)
select doc_id, grp, 'curated' as origin from s where include union all select r.doc_id, r.grp, 'topped up' from r join n on r.grp = n.grp where rank <= 8 - have""", "studies", "decisions"))
def _(spark, sf):
    d = derive(spark, sf, "decisions").where("pass = 1").select("doc_id", "include")
    s = _grouped(spark, sf, 16).join(d, "doc_id", "left").withColumn(
        "include", F.coalesce("include", F.lit(False)) & (F.col("doc_id") % 3 == 0))
    return S.top_up(s, "grp").select("doc_id", "grp", "origin")


def _rx(patterns):
    return "'" + S.any_of(patterns).replace("'", "''") + "'"


def _list(items):
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


CLAIMS = f"""
, found as (select distinct review_id, pass from issues where type in {_list(S.CORROBORATING_TYPES)}),
claims as (select i.ord, i.review_id, i.pass, case
  when lower(coalesce(type, '')) in {_list(S.TOKEN_TYPES)} or regexp_matches(description, {_rx(S.TOKEN_CLAIMS)}) then 'token domain'
  when lower(coalesce(type, '')) in {_list(S.REFERENCE_TYPES)} or regexp_matches(description, {_rx(S.REFERENCE_CLAIMS)}) then 'reference domain'
  when regexp_matches(description, {_rx(S.HAND_TYPED_CLAIMS)}) and f.review_id is null then 'uncorroborated' end as dropped_as
 from issues i left join found f on i.review_id = f.review_id and i.pass = f.pass where coalesce(type not in {_list(S.CORROBORATING_TYPES)}, true))
"""


@query("p14_suppress_claims", oracle(CLAIMS + "select ord, dropped_as from claims", "issues"))
def _(spark, sf):
    return S.suppress_claims(derive(spark, sf, "issues"), ["review_id", "pass"]).select("ord", "dropped_as")


@query("u6_all_issues", oracle(CLAIMS + f"""
select i.review_id, i.pass, i.ord, i.severity, case when i.type in {_list(S.CORROBORATING_TYPES)} then 'deterministic' else 'model' end as origin
from issues i where i.type in {_list(S.CORROBORATING_TYPES)} or i.ord in (select ord from claims where dropped_as is null)""", "issues"))
def _(spark, sf):
    issues = derive(spark, sf, "issues")
    sure = issues.where(F.col("type").isin(S.CORROBORATING_TYPES)).withColumn("origin", F.lit("deterministic"))
    rest = S.suppress_claims(issues, ["review_id", "pass"]).where("dropped_as is null").drop("dropped_as").withColumn(
        "origin", F.lit("model"))
    return sure.unionByName(rest).select("review_id", "pass", "ord", "severity", "origin")


_RUNS = """
, runs as (select review_id, case review_id % 3 when 0 then 'Weak' when 1 then 'moderate' else 'strong' end as quality,
  cast(review_id % 20 as int) as round, 15 as max_rounds, cast(review_id % 4 as int) as retries, cast(review_id % 50 as double) as minutes from reviews)"""


@query("p15_evidence_floor", oracle(_RUNS + """
, n as (select review_id, count(distinct study_index) as n from study_quotes where verified and quote <> '' group by review_id)
select r.review_id, coalesce(n, 0) as n_verified, case when (coalesce(n, 0) < 3 or lower(quality) = 'weak') and round < max_rounds and retries < 2 and minutes < 35 then 'research'
 when coalesce(n, 0) < 3 then 'abort' else 'proceed' end as outcome from runs r left join n on r.review_id = n.review_id""", "reviews", "study_quotes"))
def _(spark, sf):
    i = F.col("review_id")
    runs = derive(spark, sf, "reviews").select(
        "review_id", F.when(i % 3 == 0, F.lit("Weak")).when(i % 3 == 1, F.lit("moderate")).otherwise(F.lit("strong")).alias("quality"),
        (i % 20).cast("int").alias("round"), F.lit(15).alias("max_rounds"), (i % 4).cast("int").alias("retries"),
        (i % 50).cast("double").alias("minutes"))
    return S.evidence_floor(runs, derive(spark, sf, "study_quotes")).select("review_id", "n_verified", "outcome")


@query("p16_mode_entry_gates", oracle(CATALOG + """
, curated as (select distinct s.paper_id from studies s join decisions d on s.doc_id = d.doc_id where d.pass = 1 and d.include),
i as (select (select count(*) from catalog where full_text_available) as ft, (select count(distinct paper_id) from studies) as pool, (select count(*) from curated) as curated,
 (select max(round) from search_rounds) as rounds, (select count(*) from catalog where full_text_available and paper_id not in (select paper_id from studies where study_index <> 2)) as unread,
 (select count(distinct paper_id) from studies where paper_id not in (select paper_id from curated)) as unused,
 (select count(*) from catalog where not full_text_available and abstract <> '') as ab)
select case when ft = 0 and pool = 0 and curated = 0 and rounds >= 3 and ab >= 3 then 'force' when curated >= 8 or rounds < 3 or unread >= 10 or unused >= 10 then 'refuse' else 'allow' end as action,
 case when ft = 0 and pool = 0 and curated = 0 and rounds >= 3 and ab >= 3 then 'nothing readable' when curated >= 8 then 'sufficient' when rounds < 3 then 'too few rounds' when unread >= 10 then 'unread full texts' when unused >= 10 then 'unused pool' end as reason from i""",
 "keyed_papers", "studies", "decisions", "search_rounds"))
def _(spark, sf):
    n = catalog_of(spark, sf).agg(F.count_if(~F.col("full_text_available") & ~missing("abstract")).alias("n_abstract_only"))
    return S.mode_entry_gates(inventory_of(spark, sf), n)


_AREAS = """
, areas as (select cast(floor(doc_id / 6) as bigint) as plan_id, doc_id % 6 as pos, case when doc_id % 9 = 0 then '' else text end as area,
  case doc_id % 5 when 0 then '7' when 1 then 'x' when 2 then null when 3 then '-1' else ' 4 ' end as priority, 'q' || cast(doc_id as string) as q1, doc_id % 4 = 0 as no_query from documents)
, valid as (select plan_id, pos, area, case when regexp_matches(coalesce(priority, ''), '^\\s*[+-]?\\d+\\s*$') then least(greatest(cast(trim(priority) as int), 1), 5) else 3 end as priority, case when no_query then '' else q1 end as search_query from areas where area <> '')"""


def areas_of(spark, sf):
    k = F.col("doc_id") % 5
    return read(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 6).alias("plan_id"), (F.col("doc_id") % 6).alias("pos"),
        F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("text")).alias("area"),
        F.when(k == 0, F.lit("7")).when(k == 1, F.lit("x")).when(k == 2, F.lit(None)).when(k == 3, F.lit("-1")).otherwise(F.lit(" 4 ")).alias("priority"),
        F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(
            F.concat(F.lit("q"), F.col("doc_id")), F.lit("second"))).alias("search_queries"))


@query("p17_plan_rows_valid", _AREAS.replace(",", "with", 1).replace("\\\\", "\\") + " select * from valid")
def _(spark, sf):
    return S.plan_rows_valid(areas_of(spark, sf))


@query("t8_priority_order", _AREAS.replace(",", "with", 1).replace("\\\\", "\\") + """
 select plan_id, area, cast(row_number() over (partition by plan_id order by priority desc, pos) as int) as place from valid""")
def _(spark, sf):
    from pyspark.sql import Window
    a = S.priority_order(S.plan_rows_valid(areas_of(spark, sf)))
    # A plan has few areas, so its window is small.
    return a.withColumn("place", F.row_number().over(
        Window.partitionBy("plan_id").orderBy(F.col("priority").desc(), "pos"))).select("plan_id", "area", "place")


@query("t9_next_issue", oracle("""
select review_id, pass, ord, severity from (select *, row_number() over (partition by review_id, pass order by case severity when 'critical' then 0 when 'moderate' then 1 else 2 end, ord) as rn from issues) x where rn = 1""", "issues"))
def _(spark, sf):
    return S.next_issue(derive(spark, sf, "issues"), ["review_id", "pass"]).select("review_id", "pass", "ord", "severity")


@query("w3_budgeted_history", oracle("""
, e as (select run_id, round, 200 + 40 * added as full_chars, 60 + length(query) as compact_chars, row_number() over (partition by run_id order by round desc) as n from search_rounds where query is not null),
u as (select *, sum(case when n <= 3 then full_chars else compact_chars end) over (partition by run_id order by round desc rows unbounded preceding) as used from e)
select run_id, round, case when n <= 3 then 'full' when used <= 1000 then 'compact' else 'omitted' end as form,
 count(*) filter (where n > 3 and used > 1000) over (partition by run_id) as omitted from u""", "search_rounds"))
def _(spark, sf):
    e = derive(spark, sf, "search_rounds").where("query is not null").withColumn(
        "full_chars", 200 + 40 * F.col("added")).withColumn("compact_chars", 60 + F.length("query"))
    return S.budgeted_history(e, "run_id", "round", 3, 1000).select("run_id", "round", "form", "omitted")


@query("w4_budgeted_list", oracle("""
, u as (select doc_id, cast(floor(doc_id / 25) as bigint) as grp, sum(length(paper_title) + 80) over (partition by cast(floor(doc_id / 25) as bigint) order by doc_id rows unbounded preceding) as used from studies)
select doc_id, grp, cast(used as bigint) as used, used <= 2000 as kept, count(*) filter (where used > 2000) over (partition by grp) as omitted from u""", "studies"))
def _(spark, sf):
    return S.budgeted_list(_grouped(spark, sf, 25), "grp", "doc_id", F.length("paper_title") + 80, 2000).select(
        "doc_id", "grp", "used", "kept", "omitted")


@query("w5_pack_batches", oracle("""
, s as (select doc_id, cast(floor(doc_id / 40) as bigint) as grp, length(text) as n, row_number() over (partition by cast(floor(doc_id / 40) as bigint) order by doc_id) as i from documents),
pack as (select doc_id, grp, i, n, n as used, 0 as batch from s where i = 1
 union all select s.doc_id, s.grp, s.i, s.n, case when p.used + s.n > 9000 then s.n else p.used + s.n end, case when p.used + s.n > 9000 then p.batch + 1 else p.batch end from pack p join s on s.grp = p.grp and s.i = p.i + 1)
select doc_id, grp, cast(batch as bigint) as batch from pack""").replace(", s as", "with recursive s as", 1))
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 40).alias("grp"), F.length("text").alias("n"))
    return S.pack_batches(d, "grp", "doc_id", "n", 9000).select("doc_id", "grp", "batch")


@query("w6_stagnation_streak", oracle("""
, i as (select *, sum(case when added > 0 then 1 else 0 end) over (partition by run_id order by round rows unbounded preceding) as island from search_rounds)
select run_id, round, cast(sum(case when added > 0 then 0 else 1 end) over (partition by run_id, island order by round rows unbounded preceding) as bigint) as stagnant,
 sum(case when added > 0 then 0 else 1 end) over (partition by run_id, island order by round rows unbounded preceding) >= 3 as stop from i""", "search_rounds"))
def _(spark, sf):
    return S.stagnation(derive(spark, sf, "search_rounds")).select("run_id", "round", "stagnant", "stop")


_ROUNDS = """
, i as (select *, sum(case when added > 0 then 1 else 0 end) over (partition by run_id order by round rows unbounded preceding) as island from search_rounds),
c as (select *, sum(case when added > 0 then 0 else 1 end) over (partition by run_id, island order by round rows unbounded preceding) as stagnant, count(*) over w as nr, count(*) filter (where tangential) over w as nt, sum(engagements) over w as ne, sum(cast(minutes as decimal(18,2))) over w as nm
 from i window w as (partition by run_id order by round rows unbounded preceding))
"""


@query("w14_round_stop_reason", oracle(_ROUNDS + """
select run_id, round, case when nt >= 8 then 'round cap' when ne > 2 then 'engagement limit' when stagnant >= 3 then 'stagnation' when nr >= 40 then 'absolute cap' when nm >= 90 then 'time budget' end as reason from c""", "search_rounds"))
def _(spark, sf):
    return S.round_stop_reason(derive(spark, sf, "search_rounds")).select("run_id", "round", "reason")


@query("w14_round_caps", oracle(_ROUNDS + """
select run_id, round, case when nt >= 6 then 'round cap' when ne > 40 then 'engagement limit' when stagnant >= 5 then 'stagnation' when nr >= 7 then 'absolute cap' when nm >= 200 then 'time budget' end as reason from c""", "search_rounds"))
def _(spark, sf):
    return S.round_stop_reason(derive(spark, sf, "search_rounds"), 6, 40, 5, 7, 200).select("run_id", "round", "reason")


@query("w7_last_n_context", """
select conv_id, turn, array_to_string(coalesce(list(role || ':' || text) over (partition by conv_id order by turn rows between 4 preceding and 1 preceding), []), '|') as context from conversations""")
def _(spark, sf):
    c = S.trailing_rows(read(spark, sf, "conversations"), ["conv_id"], "turn", 4,
                        F.concat_ws(":", "role", "text"), "ctx")
    return c.select("conv_id", "turn", F.array_join("ctx", "|").alias("context"))


@query("j2_resolve_selections")
def _(spark, sf):
    return S.resolve_selections(derive(spark, sf, "selections"), derive(spark, sf, "candidates"))


@query("j2_exact_selections", oracle(f"""
, k as (select *, case when regexp_matches(paper_index, '^\\d+$') then cast(paper_index as bigint) end as i, {TKEY.format("regexp_replace(title, '^\\s*\\[?\\s*(19|20)\\d{2}\\s*\\]?\\s*', '')").replace('{{2}}', '{2}')} as e from selections)
select k.query_id, k.sel, c.seq from k join candidates c on k.query_id = c.query_id and k.i = c.paper_index
where trim(k.title) = '' or k.e = trim(regexp_replace(lower(c.title), '[^a-z0-9]+', ' ', 'g'))""", "selections", "candidates"))
def _(spark, sf):
    """The part of the resolution that needs no similarity: number and equal title."""
    from ..functions.keys import echo_title_key, title_key
    from ..functions.text import blank
    s = derive(spark, sf, "selections").withColumn("paper_index", F.when(
        F.col("paper_index").rlike(r"^\d+$"), F.expr("try_cast(paper_index as bigint)")))
    c = derive(spark, sf, "candidates").withColumnRenamed("title", "listed")
    return s.join(c, ["query_id", "paper_index"]).where(
        blank("title") | (echo_title_key("title") == title_key("listed"))).select("query_id", "sel", "seq")


@query("j4_best_title_match", oracle(r"""
, w as (select sel as want_id, query_id as g, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}')) as t from selections),
r as (select query_id as g, paper_index as pos, seq as result_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}')) as t from candidates),
s as (select want_id, pos, result_id, len(list_intersect(w.t, r.t)) / len(w.t) as share from w join r on w.g = r.g where len(w.t) > 0),
b as (select *, row_number() over (partition by want_id order by share desc, pos) as rn from s where share >= 0.6)
select want_id, result_id, share from b where rn = 1
union all select w.want_id, arg_min(r.result_id, r.pos), 0 from w join r on w.g = r.g where len(w.t) = 0 group by w.want_id""", "selections", "candidates"))
def _(spark, sf):
    w = derive(spark, sf, "selections").select(F.col("sel").alias("want_id"), F.col("query_id").alias("group"), "title")
    r = derive(spark, sf, "candidates").select(F.col("query_id").alias("group"), F.col("paper_index").alias("pos"),
                                               F.col("seq").alias("result_id"), "title")
    return S.best_title_match(w, r)


@query("j16_merge_grades", oracle("""
, grades as (select review_id, study_index + case when doc_id % 10 = 9 then 50 else 0 end as study_index, 'w' || cast(doc_id % 3 as string) as evidence_weight, cast(doc_id % 10 as string) as final_reliability from studies where doc_id % 3 <> 0)
select s.doc_id, g.evidence_weight, g.final_reliability from studies s left join grades g on s.review_id = g.review_id and s.study_index = g.study_index""", "studies"))
def _(spark, sf):
    s = studies_of(spark, sf)
    grades = s.where("doc_id % 3 <> 0").select(
        "review_id", (F.col("study_index") + F.when(F.col("doc_id") % 10 == 9, 50).otherwise(0)).alias("study_index"),
        F.concat(F.lit("w"), F.col("doc_id") % 3).alias("evidence_weight"), (F.col("doc_id") % 10).cast("string").alias("final_reliability"))
    return S.merge_grades(s, grades).select("doc_id", "evidence_weight", "final_reliability")


@query("j18_pair_weakness_query", oracle("""
, a as (select review_id, doc_id, study_index - 1 as pos, 'q ' || paper_title as query, case when study_index <= 2 then 'w ' || cast(doc_id as string) end as weakness from studies)
select review_id, cast(pos as int) as pos, query, coalesce(weakness, query) as weakness from a where pos < 3""", "studies"))
def _(spark, sf):
    s = studies_of(spark, sf)
    # Both lists are capped before they are gathered.
    s = first_n_per_key(s, ["review_id"], 6, F.col("study_index"))
    a = s.groupBy("review_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("study_index", F.concat(F.lit("q "), "paper_title").alias("v")))), lambda x: x["v"]).alias("queries"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("study_index") <= 2, F.struct("study_index", F.concat(F.lit("w "), F.col("doc_id")).alias("v"))))), lambda x: x["v"]).alias("weaknesses"))
    return S.pair_weakness_query(a, 3)


@query("a14_run_rollup", oracle("""
, q as (select review_id, count(*) filter (where verified and quote <> '') as quotes from study_quotes group by review_id),
i as (select review_id, count(*) as issues from issues where pass = 3 group by review_id)
select s.review_id, count(*) as studies, count(*) filter (where has_full_text) as full_texts, any_value(coalesce(q.quotes, 0)) as quotes, any_value(coalesce(i.issues, 0)) as unresolved,
 any_value(len(list_filter(regexp_split_to_array(r.text, '\\s+'), lambda w: w <> ''))) as words
from studies s join reviews r on s.review_id = r.review_id left join q on q.review_id = s.review_id left join i on i.review_id = s.review_id group by s.review_id""".replace("\\\\", "\\"), "studies", "reviews", "study_quotes", "issues"))
def _(spark, sf):
    from ..operators.registry import run_rollup
    return run_rollup(studies_of(spark, sf), derive(spark, sf, "reviews"), derive(spark, sf, "study_quotes"),
                      derive(spark, sf, "issues").where("pass = 3"))


@query("c10_gap_fill_merge", oracle("""
, linked as (select *, row_number() over (partition by query_id, paper_id order by ord) as rn from search_hits),
seen as (select paper_id, doc_id from studies where study_index <= 2),
fresh as (select paper_id, min(seq) as doc_id from linked where rn = 1 and paper_id not in (select paper_id from seen) group by paper_id)
select paper_id, doc_id, 'preserved' as origin from seen union all select paper_id, doc_id, 'new' from fresh""", "search_hits", "studies"))
def _(spark, sf):
    """Hits of the gap searches, linked, without what was seen, merged with the preserved studies."""
    seen = studies_of(spark, sf).where("study_index <= 2").select("paper_id", "doc_id").withColumn("origin", F.lit("preserved"))
    linked = C.link_search_hits(derive(spark, sf, "search_hits"))
    new = S.unseen_only(linked, seen, ["paper_id"]).select("paper_id", F.col("seq").alias("doc_id"), F.lit("new").alias("origin"))
    return C.merge_preserved(seen, new, "doc_id")
