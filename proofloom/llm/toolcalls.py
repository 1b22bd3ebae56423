"""Tool calls linked with their results.

Calls and results of a conversation meet by identifier in a hash join. A call
may name earlier calls whose results it needs; its level is the longest chain
of such calls below it, found in rounds: each round settles the calls whose
needed calls are all settled. Calls in a circle are never settled and have no
level. Arguments are checked against the schema of the tool, and a call with
its result is written as canonical JSON: keys sorted, no blanks, one form for
each number.

Of calls, or results, of one identifier in a conversation the one of the
smallest turn counts (then the smallest text); the others are dropped, the
number of them is given. Results without call have their own rows. Rows
without conversation or identifier are dropped. A needed call that does not
exist is an error and no dependency. Null arguments are malformed.
The rounds are as many as the longest chain; each is written to the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

KEY = ["conv_id", "call_id"]
#: JSON types and the variant types they stand for.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE", "boolean": "BOOLEAN",
         "array": "ARRAY.*", "object": "OBJECT.*"}

#: {tool: {parameter: (type, required, allowed values or None)}}
Schemas = dict[str, dict[str, tuple[str, bool, list[str] | None]]]


def _first(rows: DataFrame, *values: str) -> DataFrame:
    """One row for each identifier; `n` counts the rows it had."""
    known = rows.where("conv_id is not null and call_id is not null")
    return known.groupBy(*KEY).agg(F.min(F.struct("turn", *values)).alias("f"), F.count("*").alias("n")).select(*KEY, "f.*", "n")


def argument_errors(arguments: Column, tool: Column, schemas: Schemas) -> Column:
    """array<string>, sorted: what is wrong with the arguments of a call."""
    parsed = F.try_parse_json(arguments)
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    out = F.when(~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.array(F.lit("malformed")))
    for name, parameters in schemas.items():
        errors = [F.transform(F.array_except(keys, F.array(*map(F.lit, parameters))), lambda k: F.concat(F.lit("unexpected "), k))]
        for parameter, (kind, required, allowed) in parameters.items():
            value = F.try_variant_get(parsed, f"$.{parameter}", "variant")
            there = F.array_contains(keys, parameter)
            wrong = ~F.coalesce(F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$"), F.lit(False))
            found = F.when(~there, F.lit(f"missing {parameter}") if required else F.lit(None)).when(
                wrong, F.lit(f"type {parameter}"))
            if allowed:
                text = F.try_variant_get(parsed, f"$.{parameter}", "string")
                found = found.when(~text.isin(allowed), F.lit(f"value {parameter}"))
            errors.append(F.array(found))
        out = out.when(tool == name, F.array_sort(F.filter(F.concat(*errors), lambda e: e.isNotNull())))
    return out.otherwise(F.array(F.lit("unknown tool")))


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that stand in no circle. needs(conv_id, call_id, needed)."""
    open_ = cut_lineage(calls.join(needs.groupBy(*KEY).agg(F.count("*").alias("waits")), KEY, "left").select(
        *KEY, F.coalesce("waits", F.lit(0)).alias("waits")), "waits")
    needs = cut_lineage(needs, "needs")
    level = 0
    settled = open_.where("waits = 0").select(*KEY, F.lit(0).alias("level"))
    front, waiting = settled, open_.where("waits > 0")
    while not waiting.isEmpty():
        done = front.select("conv_id", F.col("call_id").alias("needed"))
        less = needs.join(done, ["conv_id", "needed"]).groupBy(*KEY).agg(F.count("*").alias("got"))
        level += 1
        waiting = cut_lineage(waiting.join(less, KEY, "left").select(
            *KEY, (F.col("waits") - F.coalesce("got", F.lit(0))).alias("waits")), f"waits-{level}")
        front = waiting.where("waits = 0").select(*KEY, F.lit(level).alias("level"))
        if front.isEmpty():
            break
        settled = settled.union(front)
        waiting = waiting.where("waits > 0")
    return settled


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and each result without call, in the order of conversations, levels and turns.

    calls(conv_id, turn, call_id, name, arguments, after array<string>),
    results(conv_id, turn, call_id, content). Returns conv_id, call_id, turn,
    name, level, status, n_calls, n_results, errors, canonical.
    """
    # The same calls are read by several steps.
    one = cut_lineage(_first(calls, "name", "arguments", "after"), "calls")
    wanted = one.select(*KEY, F.explode(F.array_distinct(F.filter("after", lambda a: a.isNotNull()))).alias("needed"))
    there = one.select("conv_id", F.col("call_id").alias("needed"), F.lit(True).alias("there"))
    wanted = cut_lineage(wanted.join(there, ["conv_id", "needed"], "left"), "wanted")
    level = levels(one, wanted.where("there").drop("there"))
    lost = wanted.where("there is null").groupBy(*KEY).agg(F.lit(True).alias("lost"))
    answers = _first(results, "content").select(*KEY, F.col("turn").alias("result_turn"), "content", F.col("n").alias("n_results"))
    both = (one.withColumnRenamed("n", "n_calls").join(level, KEY, "left").join(lost, KEY, "left")
            .join(answers.hint("shuffle_hash"), KEY, "full"))
    is_call = F.col("n_calls").isNotNull()
    errors = F.concat(argument_errors(F.col("arguments"), F.col("name"), schemas),
                      F.when(F.coalesce("lost", F.lit(False)), F.array(F.lit("unknown reference"))).otherwise(F.array()))
    status = F.when(~is_call, "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("answered")
    canonical = F.to_json(F.struct(
        F.array_sort(F.array_distinct("after")).alias("after"), F.try_parse_json("arguments").alias("arguments"),
        F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("content").alias("result")))
    out = both.select(
        *KEY, F.coalesce("turn", "result_turn").alias("turn"), "name", F.col("level").cast("int").alias("level"), status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(is_call, F.array_join(errors, ",")).alias("errors"), canonical.alias("canonical"))
    return out.orderBy("conv_id", F.col("level").asc_nulls_last(), "turn", "call_id")


#: The tools of the derived calls.
TOOLS: Schemas = {
    "search": {"query": ("string", True, None), "limit": ("integer", False, None)},
    "summarise": {"query": ("string", True, None), "style": ("string", True, ["short", "long"])},
    "translate": {"query": ("string", True, None), "limit": ("number", True, None)},
}


def _call_columns(text: str, quoted: str, array: str, none: str, group: str) -> list[str]:
    """Calls derived from user turns: some without a parameter, with a wrong type or value, cut off, or of an unknown tool."""
    one = f"'c' || cast(conv_id as {text}) || '-' || cast(turn - 2 as {text})"
    two = f"'c' || cast(conv_id as {text}) || '-' || cast(turn - 6 as {text})"
    return [
        "conv_id", "cast(turn as bigint) as turn", f"'c' || cast(conv_id as {text}) || '-' || cast(turn as {text}) as call_id",
        """case length(text) % 7 when 0 then 'lookup' when 1 then 'summarise' when 2 then 'summarise' when 3 then 'translate'
 else 'search' end as name""",
        f"""case when length(text) % 11 = 0 then '{{"query": ' || {quoted}
 when length(text) % 7 in (1, 2) then
  '{{"style": "' || case when turn % 3 = 0 then 'brief' else 'short' end || '", "query": ' || {quoted} || '}}'
 when length(text) % 13 = 0 then '{{"limit": "' || cast(turn as {text}) || '", "extra": true}}'
 else '{{ "query": ' || {quoted} || ', "limit": ' || cast(turn as {text}) || ' }}' end as arguments""",
        f"case {group} when 0 then cast({none} as {array}) when 3 then [{one}, {two}] else [{one}] end as after"]


def derived_calls(conversations: DataFrame) -> DataFrame:
    """Each user turn as a call; in groups of four user turns a call needs the one before, the last also the first."""
    quoted = "substring(to_json(struct(text as q)), 6, length(to_json(struct(text as q))) - 6)"
    columns = _call_columns("string", quoted, "array<string>", "array()", "turn div 2 % 4")
    columns[-1] = columns[-1].replace("[", "array(").replace("]", ")")
    return conversations.where("role = 'user' and text is not null").selectExpr(*columns)


def derived_results(conversations: DataFrame) -> DataFrame:
    """Each assistant turn as the result of the turn before it."""
    return conversations.where("role = 'assistant'").select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("text").alias("content"))


ORACLE = "with recursive calls as (select " + ",\n ".join(_call_columns("varchar", "to_json(text)", "varchar[]", "[]", "turn // 2 % 4")) + """
 from conversations where role = 'user' and text is not null),
results as (
 select conv_id, cast(turn as bigint) as turn, 'c' || cast(conv_id as varchar) || '-' || cast(turn - 1 as varchar) as call_id, text as content
 from conversations where role = 'assistant'),
call as (
 select conv_id, call_id, turn, name, arguments, after,
  count(*) over (partition by conv_id, call_id) as n_calls,
  row_number() over (partition by conv_id, call_id order by turn, name, arguments) as r
 from calls qualify r = 1),
result as (
 select conv_id, call_id, turn, content, count(*) over (partition by conv_id, call_id) as n_results,
  row_number() over (partition by conv_id, call_id order by turn, content nulls first) as r
 from results qualify r = 1),
need as (select distinct conv_id, call_id, unnest(after) as needed from call),
edge as (select n.conv_id, n.call_id, n.needed from need n join call c on n.conv_id = c.conv_id and n.needed = c.call_id),
chain(conv_id, call_id, level) as (
 select conv_id, call_id, 0 from call where (conv_id, call_id) not in (select conv_id, call_id from edge)
 union all
 select e.conv_id, e.call_id, p.level + 1 from chain p join edge e on e.conv_id = p.conv_id and e.needed = p.call_id),
level as (select conv_id, call_id, max(level) as level from chain group by conv_id, call_id),
lost as (
 select distinct n.conv_id, n.call_id from need n left join call c on n.conv_id = c.conv_id and n.needed = c.call_id where c.call_id is null),
parsed as (
 select *, case when json_valid(arguments) then cast(arguments as json) end as j,
  case name when 'search' then ['query', 'limit'] when 'summarise' then ['query', 'style'] when 'translate' then ['query', 'limit'] end as allowed
 from call),
checked as (
 select *, case when j is null then ['malformed'] when allowed is null then ['unknown tool'] else list_sort(list_concat(
  list_transform(list_filter(json_keys(j), lambda k: not list_contains(allowed, k)), lambda k: 'unexpected ' || k),
  case when json_type(j, '$.query') is null then ['missing query'] when json_type(j, '$.query') <> 'VARCHAR' then ['type query'] else [] end,
  case when name = 'summarise' then (case when json_type(j, '$.style') is null then ['missing style']
     when json_type(j, '$.style') <> 'VARCHAR' then ['type style'] when (j ->> '$.style') not in ('short', 'long') then ['value style'] else [] end)
   when json_type(j, '$.limit') is null then (case when name = 'translate' then ['missing limit'] else [] end)
   when json_type(j, '$.limit') not in ('BIGINT', 'UBIGINT') then ['type limit'] else [] end)) end as wrong
 from parsed),
canonical as (
 select *, '{' || array_to_string(list_transform(list_sort(json_keys(j)),
   lambda k: cast(to_json(k) as varchar) || ':' || cast(json_extract(j, '$."' || k || '"') as varchar)), ',') || '}' as args
 from checked)
select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, coalesce(c.turn, r.turn) as turn, c.name, l.level,
 case when c.call_id is null then 'orphan' when r.call_id is null then 'unanswered' else 'answered' end as status,
 coalesce(n_calls, 0) as n_calls, coalesce(n_results, 0) as n_results,
 case when c.call_id is not null then array_to_string(list_concat(wrong, case when o.call_id is null then [] else ['unknown reference'] end), ',') end as errors,
 '{' || case when c.call_id is null then '' else '"after":' || cast(to_json(list_sort(list_distinct(after))) as varchar) || ',' end
  || case when j is null then '' else '"arguments":' || args || ',' end
  || '"id":' || cast(to_json(coalesce(c.call_id, r.call_id)) as varchar)
  || case when c.name is null then '' else ',"name":' || cast(to_json(c.name) as varchar) end
  || case when content is null then '' else ',"result":' || cast(to_json(content) as varchar) end || '}' as canonical
from canonical c left join level l on l.conv_id = c.conv_id and l.call_id = c.call_id
left join lost o on o.conv_id = c.conv_id and o.call_id = c.call_id
full join result r on r.conv_id = c.conv_id and r.call_id = c.call_id
"""
