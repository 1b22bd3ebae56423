"""License notices by an exact set-similarity join.

A block matches a template if it holds at least `SHARE` of the template's
distinct words. Blocks for labels and scores are windows of words, `SPREAD`
times as long as the template, that reach over line ends; blocks of `matches`
are lines. Both joins are exact. Words of the templates are ordered by the
number of documents that hold them, rare ones first; then
  - prefix: a match holds one of the template's first n - needed + 1 words, so
    only these words are joined on;
  - length: a match has at least `needed` template words;
  - position: the words that follow the met one on either side must be enough;
and the pairs that are left are verified on whole sets. Words of a line that
stand in no template change neither side and are dropped first.

The SQL takes lines as blocks for labels too, so it does not see wrapped
notices, takes scattered words of a long line for one, and labels a line by its
best template only.

Beside the templates, fixed phrases are searched as words that stand one after
another, over line ends too. Null texts count as empty. Rows are searched one
by one, also rows of equal id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Share of a template's distinct words that a block must hold.
SHARE = 0.8
#: Length of a window in lengths of the template: as many foreign words may stand between as the template has words.
SPREAD = 2

#: Fixed values: (label, words of a notice).
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "released under cc0 1 0 universal public domain dedication"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved unauthorized copying of this file is strictly prohibited"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Fixed values: (label, phrase); each phrase ends with the word `license`.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. Two other letters whose lower case has ASCII letters are blotted out."""
    t = F.coalesce(text, F.lit(""))
    for odd in ("İ", "K"):
        t = F.replace(t, F.lit(odd), F.lit("�"))
    return F.lower(t)


def words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, BETWEEN), "")


def phrase_places(words: Column) -> Column:
    """array<struct<label, at>>: where the phrases start, counted in words."""
    def found(word: Column, i: Column) -> Column:
        out = F.when(word != "license", F.lit(None))
        for label, phrase in PHRASES:
            parts = phrase.split()
            fits = F.lit(True)
            for back, part in enumerate(reversed(parts[:-1]), 1):
                fits = fits & (F.get(words, i - back) == part)
            out = out.when(fits, F.struct(F.lit(label).alias("label"), (i - (len(parts) - 1)).cast("long").alias("at")))
        return out

    return F.filter(F.transform(words, found), lambda p: p.isNotNull())


def _list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE,
         templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places, matches, notices) of every row.

    places: array<struct<label, at>> of the phrases; matches:
    array<struct<label, template, line, share, common>> of the lines that match;
    notices: array<struct<label, template, at, end, share, common>> of the windows that match, see `_notices`.
    """
    spark = docs.sparkSession
    sets = [sorted(set(t.split())) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    low = docs.select(F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("t"))
    # One row for each word of the templates at most.
    held = dict(low.select(F.explode(F.array_intersect(words(F.col("t")), _list(vocabulary))).alias("w")).groupBy("w").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (held.get(w, 0), w)))}
    asked = _asked(spark, templates, sets, rank, share)
    prefixes = sorted({r["word"] for r in asked.select("word").collect()})

    with_words = low.withColumn("w", words(F.col("t")))
    lines = F.transform(F.split("t", "\n"), lambda line, i: F.struct(
        i.cast("long").alias("line"), F.array_intersect(words(line), _list(vocabulary)).alias("held")))
    candidates = F.when(F.arrays_overlap("w", _list(prefixes)), F.filter(
        lines, lambda b: F.arrays_overlap(b["held"], _list(prefixes))))
    places = F.when(F.contains("t", F.lit("license")), phrase_places(F.col("w")))
    rows = cut_lineage(with_words.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), places.alias("places"), candidates.alias("blocks"),
        _surroundings(prefixes, templates).alias("near"), F.monotonically_increasing_id().alias("row")), "license-blocks")

    order = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    block = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.line", F.array_sort(F.transform(
        "b.held", lambda w: F.struct(order[w].alias("rank"), w.alias("word")))).alias("own"))
    met = (block.select("*", F.posexplode("own").alias("j", "o")).withColumn("word", F.col("o.word"))
           .join(F.broadcast(asked), "word")  # as many rows as the templates have prefix words
           .where((F.size("own") >= F.col("needed"))
                  & (1 + F.least(F.col("n") - F.col("i") - 1, F.size("own") - F.col("j") - 1) >= F.col("needed"))))
    common = F.size(F.array_intersect(F.transform("own", lambda o: o["word"]), F.col("words")))
    matched = (met.withColumn("common", common).where(F.col("common") >= F.col("needed"))
               .select("row", "line", "template", "label", (F.col("common") / F.col("n")).alias("share"), "common").distinct()
               .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", "template", "line", "share", "common"))).alias("matches")))
    notices = _notices(rows, asked)
    return rows.join(matched, "row", "left").join(notices, "row", "left").select(
        "doc_id", "n_words", _or_empty("places", rows), _or_empty("matches", matched), _or_empty("notices", notices))


def _surroundings(prefixes: list[str], templates: list[tuple[str, str]]) -> Column:
    """array<struct<at, first, word, words>>: the prefix words of `w`, and all words that share a window with them."""
    reach = max((SPREAD * len(t.split()) for _, t in templates), default=1)
    def found(word: Column, i: Column) -> Column:
        first = F.greatest(i - (reach - 1), F.lit(0))
        return F.when(word.isin(prefixes), F.struct(
            i.alias("at"), first.alias("first"), word.alias("word"), F.slice("w", first + 1, i + reach - first).alias("words")))

    return F.when(F.arrays_overlap("w", _list(prefixes)), F.filter(F.transform("w", found), lambda x: x.isNotNull()))


def _notices(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(row, notices): the windows that match, from the first to the last word that they need.

    A window starts at a word of its template that it does not hold again. It
    counts unless it lies within another one that holds all its template words,
    and more of them or as many and a larger share: agpl in gpl, cc-by in cc-by-nc.
    """
    met = rows.select("row", F.explode("near").alias("b")).select("row", "b.*").join(
        F.broadcast(asked.withColumnRenamed("words", "own")), "word")
    first = F.greatest(F.col("at") - F.col("span") + 1, F.lit(0))
    met = met.withColumn("from", first).withColumn("region", F.slice(
        "words", F.col("from") - F.col("first") + 1, F.col("at") + F.col("span") - F.col("from")))
    # The rarest word that a match holds is a prefix word, and the others follow it in the template's order.
    met = met.where(F.size(F.array_intersect("region", F.slice("own", F.col("i") + 1, F.col("n")))) >= F.col("needed"))
    starts = F.filter(F.sequence(F.lit(0), F.col("at") - F.col("from")), lambda k: F.array_contains("own", F.get("region", k)))
    block = met.select("*", F.explode(starts).alias("k")).select(
        "row", "template", "label", "n", "needed", (F.col("from") + F.col("k")).cast("long").alias("at"),
        F.slice("region", F.col("k") + 1, F.col("span")).alias("block"), "own")
    held = block.withColumn("held", F.array_intersect("block", "own")).where(F.size("held") >= F.col("needed"))
    last = F.array_max(F.transform("held", lambda h: F.array_position("block", h)))
    held = held.withColumn("last", last.cast("int")).where(
        "last < 2 or not array_contains(slice(block, 2, last - 1), block[0])")
    held = held.select("row", "label", "template", "at", (F.col("at") + F.col("last") - 1).alias("end"),
                       (F.size("held") / F.col("n")).alias("share"), F.size("held").alias("common"), "held").dropDuplicates(
                           ["row", "template", "at"])
    reach = asked.agg(F.max("span")).first()[0] or 1
    # A window that another one lies in starts less than a length before it: the frame stays short in any text.
    frame = Window.partitionBy("row").orderBy("at").rangeBetween(-reach, 0)
    around = held.withColumn("around", F.collect_list(F.struct("end", "share", "common", "held")).over(frame))
    kept = around.where(~F.exists("around", _over))
    return kept.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("label", "template", "at", "end", "share", "common"))).alias("notices"))


def _over(o: Column) -> Column:
    """Whether a window that starts no later hides the one of the row."""
    return ((o["end"] >= F.col("end")) & (F.struct(o["common"], o["share"]) > F.struct("common", "share"))
            & (F.size(F.array_except("held", o["held"])) == 0))


def _or_empty(name: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)).alias(name)


def _asked(spark: SparkSession, templates, sets: list[list[str]], rank: dict[str, int], share: float) -> DataFrame:
    """(word, i, n, needed, span, template, label, words): the prefix words of the templates; span is the length of a window."""
    rows = []
    for no, ((label, text), own) in enumerate(zip(templates, sets, strict=True)):
        ordered = sorted(own, key=rank.__getitem__)
        needed = math.ceil(share * len(own) - 1e-9)
        rows += [(w, i, len(own), needed, SPREAD * len(text.split()), no, label, ordered) for i, w in enumerate(ordered[:len(own) - needed + 1])]
    return spark.createDataFrame(rows, "word string, i int, n int, needed int, span int, template int, label string, words array<string>")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score for each row of `scan`; the score is the best share of a notice, and 1 for a phrase."""
    at = F.transform("places", lambda p: p["at"])
    base = F.transform("places", lambda p: p["label"])
    labels = F.array_union(base, F.transform("notices", lambda m: m["label"]))
    best = F.coalesce(F.array_max(F.transform("notices", lambda m: m["share"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))


ORACLE = r"""
with templates(template, label, words) as (
 select t, l, list_distinct(string_split(w, ' ')) from (values
  (0, 'agpl', 'licensed under the gnu affero general public license'),
  (1, 'apache', 'licensed under the apache license version 2 0'),
  (2, 'apache', 'you may not use this file except in compliance with the license'),
  (3, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
  (4, 'cc-by', 'licensed under cc by 4 0'),
  (5, 'cc-by', 'licensed under a creative commons attribution 4 0 international license'),
  (6, 'cc-by-nc', 'licensed under cc by nc 4 0'),
  (7, 'cc-by-sa', 'licensed under cc by sa 4 0'),
  (8, 'cc0', 'released under cc0 1 0 universal public domain dedication'),
  (9, 'gpl', 'this work is licensed under the gnu general public license version 3'),
  (10, 'gpl', 'you can redistribute it and or modify it under the terms of the gnu general public license'),
  (11, 'isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted'),
  (12, 'lgpl', 'licensed under the gnu lesser general public license'),
  (13, 'mit', 'released under the mit license'),
  (14, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
  (15, 'mpl', 'subject to the terms of the mozilla public license v 2 0'),
  (16, 'proprietary', 'all rights reserved unauthorized copying of this file is strictly prohibited'),
  (17, 'unlicense', 'this is free and unencumbered software released into the public domain')) v(t, l, w)),
docs as (
 select row_number() over () as r, doc_id,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
cut as (select r, doc_id, t, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from docs),
word as (select r, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from cut where contains(t, 'license')),
followed as (
 select r, pos, word, lead(word) over (partition by r order by pos) as second, lead(word, 2) over (partition by r order by pos) as third from word),
place as (
 select r, pos, case when word = 'general' then 'gpl' else word end as label from followed
 where (word in ('mit', 'apache') and second = 'license') or (word = 'general' and second = 'public' and third = 'license')),
base as (
 select r, count(*) as n, min(pos) as first_at, max(pos) as last_at, list_sort(list_distinct(list(label))) as labels from place group by r),
line as (select r, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) as no from docs),
block as (select r, no, list_distinct(string_split_regex(l, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as held from line),
hit as (
 select r, label, len(list_intersect(held, words)) / len(words) as share,
  rank() over (partition by r, no order by len(list_intersect(held, words)) / len(words) desc, len(list_intersect(held, words)) desc) as best
 from block, templates where len(list_intersect(held, words)) >= ceil(0.8 * len(words) - 1e-9)),
own as (select r, list_distinct(list(label) filter (best = 1)) as labels, max(share) as share from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base,
 cast(first_at as bigint) as first_word, cast(last_at as bigint) as last_word,
 coalesce(array_to_string(base.labels, ','), '') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') as labels,
 cast(case when n > 0 then 1.0 else coalesce(share, 0) end as double) as score
from cut left join base using (r) left join own using (r)
"""
