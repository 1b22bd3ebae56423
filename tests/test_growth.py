"""Steps run once, texts move once, and the memory of a task does not grow with the input."""

import math
import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofloom.functions import fuzzy
from proofloom.functions import headings as H
from proofloom.functions import text as X
from proofloom.operators import answers as N
from proofloom.operators import audit as U
from proofloom.operators import passages as P
from proofloom.operators import quotes as Q
from proofloom.operators import registry as R
from proofloom.session import work_dir


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def pairs_of(spark):
    return spark.createDataFrame([(1, 7, 0, "the quick brown fox jumps", "And the quikc brown fox jumps. More.")],
                                 "quote_id long, doc_id long, chunk_index int, quote string, text string")


def test_window_search_runs_once(spark):
    found = Q.fuzzy_topk(pairs_of(spark), 0.8)
    assert plan(found).count("search(") == 1
    assert {r.quote_id for r in found.collect()} == {1}


def test_approximate_strategies_run_once(spark):
    pairs = Q.spread(pairs_of(spark).withColumnRenamed("text", "chunk"), "quote_id")
    assert plan(Q.approximate_matches(pairs).where("a is not null").select("quote_id", "a.method")).count("match(") == 1


def test_best_windows_measure_few_windows(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(200)]
    text = " ".join(rng.choices(words, k=400))
    quote = text[700:890].replace("a", "b", 2)
    every = sorted((-fuzzy.SequenceMatcher(None, quote, text[s:s + len(quote)]).ratio(), s) for s in range(len(text) - len(quote) + 1))
    want = [(s, s + len(quote), -r) for r, s in every if -r >= 0.8][:5]
    measured = []
    common = fuzzy.Bound.common
    monkeypatch.setattr(fuzzy.Bound, "common", lambda self, w: measured.append(1) or common(self, w))
    assert fuzzy.best_windows(quote, text, 0.8) == want
    assert len(measured) < 70


@pytest.mark.parametrize("texts", [10, 40])
def test_tasks_follow_the_tokens(spark, monkeypatch, texts):
    monkeypatch.setattr(P, "TASK_TOKENS", 50, raising=False)
    chunks = spark.range(texts).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.repeat(F.lit("word other "), 25).alias("chunk"))
    stats = P.term_statistics(chunks)
    assert stats.rdd.getNumPartitions() >= texts
    assert {(r.token, r.tf, r.dl) for r in stats.collect()} == {("word", 25, 50), ("other", 25, 50)}


def test_prose_lines_are_not_searched_for_headings(spark):
    lines = ["Results", "  Results  ", "\x0bMethods\f", "x" * 91, " " * 95 + "Discussion", "Results  ", "Results " + " " * 90 + " ",
             "A long line of prose that is not a heading " * 9, ""]
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    got = [(s.heading, s.category) for s in df.select(H.sections("text").alias("s")).first().s]
    assert [h for h, _ in got] == ["Results", "Results", "Methods", "Discussion", "Results ", "Results "]
    assert "btrim" in plan(df.select(H.classify_heading("text")))


def test_verbatim_sources_ask_no_python(spark):
    quotes = spark.createDataFrame([(1, 0, "Some  words stand HERE in full"), (1, 1, "nobody printed these words"), (1, 2, " ")],
                                   "review_id long, n int, quote string")
    studies = spark.createDataFrame([(1, 5, 7), (1, 6, 8), (2, 5, 7)], "review_id long, study_index long, doc_id long")
    texts = spark.createDataFrame([(7, "x some words\nstand here in full y"), (8, None)], "doc_id long, text string")
    found = U.verbatim_sources(quotes, studies, texts)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 5)]
    assert "holders(" not in plan(found)


def test_holders_read_a_text_once(spark, monkeypatch):
    written = []
    keep = U.cut_lineage
    monkeypatch.setattr(U, "cut_lineage", lambda df, name: written.append(plan(df).count("mark_of_text")) or keep(df, name))
    pairs = spark.createDataFrame([(1, 0, 7, "some words stand here in full"), (1, 1, 7, "words that nobody has printed")],
                                  "review_id long, n int, doc_id long, quote string")
    texts = spark.createDataFrame([(7, "x some words\nstand here in full y")], "doc_id long, text string").withColumn(
        "text", F.concat("text", F.lit(" mark_of_text")))
    assert [tuple(r) for r in U._holds(pairs, texts).collect()] == [(1, 0, 7)]
    assert sum(n > 0 for n in written) == 1


def test_context_window_is_found_once(spark):
    df = spark.createDataFrame([("One two three. Four [[Q1]] five six seven. Eight nine.", 20, 26)], "text string, start int, end int")
    w = df.select(R.context_window("text", F.col("start"), F.col("end"), 3).alias("w"))
    assert tuple(w.first().w) == (0, 54)
    assert plan(w).lower().count("split(") <= 3


def test_index_is_read_in_order(spark):
    df = spark.sql("select map('b', array(1, 3), 'a', array(0, 2)) as index")
    built = df.select(X.abstract_from_index("index").alias("t"))
    assert built.first().t == "a b a b"
    assert "lambdafunction(CASE" not in plan(built) and "sort_array" in plan(built)


def test_map_reduce_moves_texts_once(spark, monkeypatch):
    rng = random.Random(3)
    texts = {(k, o): "w" * rng.choice([0, 3, 10, 25, 60]) + f" {o}" * rng.randint(0, 2) for k in range(4) for o in range(12 * k + 1)}

    def merge(parts, budget):
        out, size = [], None
        for t in parts:
            if size is None or size + len(t) > budget:
                out, size = [*out, []], 0
            out[-1].append(t)
            size += len(t)
        return ["\n".join(x) for x in out]

    want = {}
    for k in range(4):
        parts = merge([texts[k, o] for o in range(12 * k + 1)], 40)
        for _ in range(3):
            if sum(map(len, parts)) + 2 * len(parts) > 90 and len(parts) > 1:
                parts = merge(parts, 90)
        want |= {(k, i): t for i, t in enumerate(parts)}
    written = []
    keep = N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df, name: written.append(dict(df.dtypes)) or keep(df, name))
    rows = spark.createDataFrame([(k, o, t) for (k, o), t in texts.items()], "k long, o long, t string")
    got = {(r.k, r.fragment): r.text for r in N.map_reduce_text(rows, "k", "o", "t", 40, 90).collect()}
    assert got == want
    assert written and not any("string" in types.values() for types in written)


def _copies(review, text, n, share, stretch):
    """Every meeting of equal runs in order of shift, as the rule says."""
    met = sorted((i - j, i, j) for i, a in enumerate(review) for j, b in enumerate(text) if a == b)
    groups = []
    for k, (shift, i, j) in enumerate(met):
        if not k or shift - met[k - 1][0] > math.ceil((1 - share) * n):
            groups.append([])
        groups[-1].append((i, j))
    spans = [(min(i for i, _ in g), max(i for i, _ in g) + 2, len({j + k for _, j in g for k in range(3)})) for g in groups]
    return sorted((a, b) for a, b, covered in spans if covered >= share * n and b - a + 1 <= stretch * n)


@pytest.mark.parametrize("at_once", [1, 7, 1_000_000])
def test_copies_by_blocks_follow_the_rule(monkeypatch, at_once):
    monkeypatch.setattr(R, "MEETINGS", at_once, raising=False)
    rng = random.Random(2)
    for _ in range(150):
        kinds = rng.choice([1, 3, 30])
        text = np.array(rng.choices(range(kinds), k=rng.randint(1, 25)))
        review = np.concatenate([np.array(rng.choices(range(kinds + 5), k=rng.randint(0, 20))), text[:rng.randint(1, 25)], text[rng.randint(0, 3):]])
        n = len(text) + 2
        assert sorted(R.text_copies([review], [text], n, 0.6, 1.6)) == _copies(review.tolist(), text.tolist(), n, 0.6, 1.6)


def test_repeated_runs_are_no_rows(spark):
    """Their meetings, whose number grows with the square of the repeats, were rows of a shuffle."""
    source = "ha " * 400 + "and an end"
    reviews = spark.createDataFrame([(1, f"Intro [[S1]] {source}. A connector stays.")], "review_id long, text string")
    reg = spark.createDataFrame([(1, "S1", source)] * 2, "review_id long, token string, text string")
    got = R.strip_transcription(reviews, reg)
    assert "posexplode" not in plan(got) and "Window" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, "Intro [[S1]]. A connector stays.")]


def test_texts_are_cut_in_slices_of_bytes(spark, monkeypatch):
    """A task held all texts of an Arrow batch, and their chunks, as Python objects."""
    monkeypatch.setattr(P, "CUT_BYTES", 10)
    texts = ["abc", None, "éé", "", "x" * 25, "yy", "z" * 9, None]
    cut = P._cutter(lambda b: ((s, s + 2, b[s:s + 2]) for s in range(0, len(b), 2))).func
    got = list(cut(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["end"])])))
    assert [len(a) for a in got] == [4, 1, 1, 2, 1]
    assert [[(c["chunk_index"], c["start"], c["end"], c["chunk"]) for c in row] for a in got for row in a.to_pylist()] == [
        [(k, 2 * k, 2 * k + 2, t[2 * k:2 * k + 2]) for k in range((len(t) + 1) // 2)] for t in [t or "" for t in texts] + ["end"]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted((r.doc_id, r.chunk) for r in P.chunk_offsets(docs).collect()) == [(i, t) for i, t in enumerate(texts) if t]


def test_expanded_matches_are_never_skipped():
    """The condition of one stretch holds for every expanded match that reaches the threshold."""
    pick = random.Random(7)
    words = "the yield of Dr. Smith's field rose by 3.5 percent in wet years e.g. here. Then? Rain! stopped \n\nResults\n and\nmore words".split(" ")
    reached = 0
    for _ in range(1500):
        passage = " ".join(pick.choices(words, k=pick.randrange(5, 120)))
        at = pick.randrange(len(passage))
        quote = list(passage[at:at + pick.randrange(20, 160)])
        for _ in range(pick.randrange(4)):
            quote[pick.randrange(len(quote))] = pick.choice("xy 7")
        quote = "".join(quote)
        match = fuzzy.approximate_match(quote, passage)
        if match and fuzzy.similarity(quote, passage[match[1]:match[2]]) >= 0.9:
            reached += 1
            assert fuzzy.sentence_may_reach(quote, passage, 0.9)
    assert reached > 50


def test_texts_are_not_written_for_verification(spark):
    """Neither chunks nor tokens go to the shared folder; crowded papers and equal matches are settled all the same."""
    line = F.concat_ws(" ", *[F.substring(F.sha2(F.concat("id", F.lit(f"-{i}")).cast("binary"), 256), 1, 30) for i in range(300)])
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("Results\n"), line, F.lit(". A line that is said two times here.\n" * 2)).alias("text"))
    asked = docs.select(F.col("doc_id").alias("quote_id"), "doc_id", F.lit(0).alias("pos"), F.lit("high").alias("importance"), F.lit("").alias("context"), F.when(
        F.col("doc_id") % 20 == 0, F.substring("text", 3700, 60)).when(F.col("doc_id") % 2 == 0, F.substring("text", 500, 60)).otherwise(F.lit("A line that is said two times here.")).alias("quote"))
    crowd = spark.range(1000, 1600).select(F.col("id").alias("quote_id"), F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("pos"), F.lit("low").alias("importance"),
                                           F.lit("").alias("context"), F.concat(F.lit("absent words of quotation "), "id").alias("quote"))
    work_dir(spark, "any")
    base = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))

    def written() -> int:
        return sum(f.stat().st_size for f in base.rglob("*.parquet"))

    before = written()
    rows = Q.verify_quotes(asked.unionByName(crowd), docs).collect()
    assert written() - before < docs.agg(F.sum(F.length("text"))).first()[0] / 4
    assert [r.verification_method for r in sorted(rows, key=lambda r: r.quote_id)] == ["exact"] * 200 + ["not_found"] * 600
