"""Large keys, padded lines, short quotations, text keys, unordered rounds, long lists: nothing is cut or lost."""

import random
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F

from proofloom.functions import fuzzy
from proofloom.functions import headings as H
from proofloom.functions.headings import section_at, sections
from proofloom.functions.spans import pattern_spans
from proofloom.functions.text import running
from proofloom.operators import answers as N
from proofloom.operators import audit as U
from proofloom.operators import passages as P
from proofloom.operators import quotes as Q
from proofloom.operators import references as X
from proofloom.operators import registry as R
from proofloom.operators import selection as S
from proofloom.operators.catalog import resolve_catalog
from proofloom.operators.prefix import pack_batches
from proofloom.plans.tables import derive
from proofloom.sources import sinks
from proofloom.streaming import rounds


def test_abstracts_survive_large_record_numbers(spark):
    papers = derive(spark, SF, "papers")
    small = {r.paper_id: (r.abstract, r.n_records) for r in resolve_catalog(papers).collect()}
    for shift in (200 << 33, (1 << 62), -(1 << 62)):
        moved = resolve_catalog(papers.withColumn("seq", F.col("seq") + shift)).collect()
        assert {r.paper_id: (r.abstract, r.n_records) for r in moved} == small


def test_padded_headings_count(spark):
    text = "Results" + " " * 400 + "\nbody\n" + " " * 500 + "References"
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(H.sections("text").alias("s")).first().s
    assert [(x.start, x.category) for x in got] == [(0, "EVIDENCE"), (413, "REFS")]


@pytest.mark.parametrize("quote, starts", [("ab", [3]), ("y", [6]), ("xx ", [0]), ("zz", [])])
def test_short_quotations_are_found(spark, quote, starts):
    quotes = spark.createDataFrame([(1, quote)], "quote_id long, quote string")
    docs = spark.createDataFrame([(7, "xx ab yz")], "doc_id long, text string")
    assert [r.start for r in Q.exact_quote_scan(quotes, docs).orderBy("start").collect()] == starts


def test_all_holders_meet_their_quotation(spark):
    """A quotation of common and rare runs is looked up by a rare one."""
    shared = "licensed under the terms of the common notice in all files of this work"
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(
        F.lit(shared + " then word"), F.col("id").cast("string"), F.lit(" stands here alone at last")).alias("text"))
    quotes = spark.createDataFrame([(1, "files of this work then word17 stands here alone at last"), (2, shared)], "quote_id long, quote string")
    pairs = Q.candidate_pairs(quotes, docs).collect()
    assert {r.doc_id for r in pairs if r.quote_id == 1} == {17}
    assert sum(r.quote_id == 2 for r in pairs) == 300


def test_text_keys_are_packed(spark):
    df = spark.createDataFrame([("a", i, 40) for i in range(5)] + [("b", 1, 10)], "k string, pos long, n long")
    got = pack_batches(df, "k", "pos", "n", 100)
    assert {(r.k, r.pos, r.batch) for r in got.collect()} == {
        ("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 1, 0)}


def test_unordered_rounds_of_one_batch(spark, tmp_path):
    order = list(range(3000))
    shuffled = [(1, (i * 1201) % 3000, int((i * 1201) % 3000 == 999)) for i in order]
    spark.createDataFrame(shuffled, "run_id long, round long, added long").repartition(8).write.parquet(str(tmp_path / "rounds.parquet"))
    stream = rounds.read_table_stream(spark, str(tmp_path / "rounds.parquet").rsplit("/", 1)[0], "rounds")
    got = rounds.stagnation_table(spark.readStream.schema("run_id long, round long, added long").parquet(str(tmp_path / "rounds.parquet")))
    assert stream.isStreaming and got.count() == 3000
    assert got.agg(F.max("stagnant")).first()[0] == 2000 and got.where("round = 999").first().stagnant == 0


def test_rounds_over_several_batches(spark, tmp_path):
    for part in range(4):
        spark.createDataFrame([(1, part * 10 + i, int(part == 1 and i == 5)) for i in (7, 2, 9, 0, 1, 3, 5, 4, 8, 6)],
                              "run_id long, round long, added long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema("run_id long, round long, added long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["round"]: r.stagnant for r in rounds.stagnation_table(stream).collect()}
    assert got == {**{i: i + 1 for i in range(15)}, **{i: i - 15 for i in range(15, 40)}}


def test_read_once_over_several_batches(spark, tmp_path):
    papers = derive(spark, SF, "papers").select("seq", "doi", "title")
    for part in range(3):
        papers.where(F.col("seq") % 3 <= part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(papers.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = rounds.run_to_table(rounds.read_once(stream), "once")
    from proofloom.operators.catalog import derive_paper_id
    assert got.count() == derive_paper_id(papers).select("paper_id").distinct().count() == got.select("paper_id").distinct().count()


def test_entry_numbers_over_one_hundred_keep_their_order(spark):
    edges = spark.createDataFrame([("s1", n, f"a{n}") for n in (1, 250)] + [("s2", 1, "b1")] + [(f"a{n}", 1, f"c{n}") for n in (1, 250)]
                                  + [("b1", 1, "d1")], "paper string, entry_no long, cited string")
    papers = spark.createDataFrame([(p, 1, True) for p in ("s1", "s2", "a1", "a250", "b1", "c1", "c250", "d1")], "paper string, n_verified long, has_text boolean")
    seeds = spark.createDataFrame([("s1", 1), ("s2", 2)], "paper string, ord long")
    got = X.citation_snowball(seeds, edges, papers, max_depth=2, per_study=1000, budget=5)
    assert {r.paper for r in got.collect()} == {"a1", "a250", "b1", "c1", "c250"}


def test_absolute_cap_is_reached(spark):
    rows = spark.createDataFrame([(1, i, 1, 0, False, 1.0) for i in range(1, 9)],
                                 "run_id long, round long, added long, engagements long, tangential boolean, minutes double")
    got = {r["round"]: r.reason for r in S.round_stop_reason(rows, round_cap=2, absolute_cap=6).collect()}
    assert got[5] is None and got[6] == got[8] == "absolute cap"


def test_long_abbreviations_and_gaps():
    assert not fuzzy._ends_sentence("x" * 60 + " et al. y", 66)
    assert N._escape_inner('{"a": "b' + '"' + " " * 200 + '}') == '{"a": "b"' + " " * 200 + "}"


def test_offsets_take_time_in_proportion(spark):
    text = spark.createDataFrame([("a b " * 8000,)], "t string")
    start = time.time()
    got = text.select(F.size(Q.occurrences(F.col("t"), F.lit("a"))), F.size(pattern_spans("t", "b"))).first()
    assert tuple(got) == (8000, 8000) and time.time() - start < 10
    assert text.select(running(F.sequence(F.lit(1), F.lit(1000))).alias("r")).first().r == [n * (n + 1) // 2 for n in range(1, 1001)]


def test_several_copies_are_cut_at_once(spark):
    source = "the trial enrolled many adults and followed them for two whole years with great care"
    changed = source.replace("many", "some")
    text = f"A [[S1]] {source}. Then {changed.upper()}, and more. The trial enrolled others."
    reviews = spark.createDataFrame([(1, text), (2, "no token")], "review_id long, text string")
    reg = spark.createDataFrame([(1, "S1", source), (1, "S2", "absent"), (2, "S1", source)], "review_id long, token string, text string")
    got = {r.review_id: r.text for r in R.strip_transcription(reviews, reg).collect()}
    assert got == {1: "A [[S1]]. Then, and more. The trial enrolled others.", 2: "no token"}


def test_reading_chunks_refuse_sizes_that_never_end(spark):
    docs = spark.createDataFrame([(1, "x" * 5000)], "doc_id long, text string")
    with pytest.raises(ValueError):
        P.chunk_sequential(docs, size=1000, overlap=1000)
    assert [(r.start, r.end) for r in P.chunk_sequential(docs, size=2000, overlap=200).orderBy("start").collect()] == [
        (0, 2000), (1800, 3800), (3600, 5000)]


def _changed(rng, quote: str, share: float) -> str:
    return "".join(rng.choice("abcdefgh ") if rng.random() < share else c for c in quote)


def test_no_holder_is_left_out():
    """All quotations against all texts: what the strategies accept was never ruled out beforehand."""
    rng = random.Random(7)
    letters = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 11))) for _ in range(60)]
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(10, 120))) for _ in range(200)]
    quotes = []
    for i in range(200):
        size, text = rng.randint(15, 160), texts[i]
        at = rng.randint(0, max(0, len(text) - size))
        quotes.append(_changed(rng, text[at:at + size], rng.choice([0, 0.03, 0.08, 0.12, 0.2])))
    accepted = ruled_out = 0
    for t in texts:
        possible = set(fuzzy.possible_holders(quotes, t, 0.6))
        ruled_out += len(quotes) - len(possible)
        for i, q in enumerate(quotes):
            if i in possible:
                continue
            found = fuzzy.approximate_match(q, t, expand=False)
            accepted += bool(found and found[3] >= 0.6) + (fuzzy.normalize(q) in fuzzy.normalize(t))
    assert accepted == 0 and ruled_out > 20_000


def test_a_source_with_a_wrong_letter_in_each_word_is_found(spark):
    words = "investigations demonstrated considerable improvements throughout participating institutions notwithstanding methodological limitations regarding measurements".split()
    quote = " ".join(w[:4] + "#" + w[5:] for w in words)
    studies = spark.createDataFrame([(1, 0, 10, "Own", ["Smith J"], 2001), (1, 1, 11, "Other", ["Jones K"], 2002), (1, 2, 12, "Third", ["Brown L"], 2003)],
                                    "review_id long, study_index long, doc_id long, paper_title string, paper_authors array<string>, paper_year int")
    texts = spark.createDataFrame([(10, "nothing of the kind stands here. " * 9), (11, "Here: " + " ".join(words) + ". And more."), (12, "unrelated words. " * 20)],
                                  "doc_id long, text string")
    asked = spark.createDataFrame([(1, 0, quote, "(Smith, 2001)", "inline"), (1, 1, "an invented sentence that nobody wrote", "(Smith, 2001)", "inline")],
                                  "review_id long, n int, quote string, citation_text string, kind string")
    got = {r.n: (r.verdict, r.true_study) for r in U.quote_sources(asked, studies, texts).collect()}
    assert got == {0: ("misattributed_quote", 1), 1: ("fabricated_quote", None)}


def test_sections_take_time_in_proportion(spark):
    def took(headings):
        text = "\n".join(f"{i}. Results of part {i}\nSome text that follows the heading of this part.\nMore of it." for i in range(headings))
        df = spark.createDataFrame([(text,)] * 8, "t string").repartition(8).cache()
        df.count()
        start = time.time()
        n = df.select(F.size(sections("t")).alias("n")).agg(F.sum("n")).first()[0]
        assert n == 8 * headings
        return time.time() - start

    took(100)
    assert took(1600) < 8 * took(400) + 2


def test_section_at_any_place(spark):
    text = "front\nIntroduction\nA text.\nMethods\nB text.\nResults\nC text.\n"
    rows = spark.createDataFrame([(text, i) for i in range(len(text) + 3)], "t string, i int").withColumn("m", sections("t"))
    for r in rows.select("i", "m", section_at("m", "i").alias("s")).collect():
        want = [h for h in r.m if h.start <= r.i]
        assert (r.s.start, r.s.category) == ((want[-1].start, want[-1].category) if want else (0, "UNKNOWN"))
    assert spark.range(1).select(section_at(F.lit(None).cast(rows.schema["m"].dataType), F.lit(3)).alias("s")).first().s.category == "UNKNOWN"


def test_a_repeated_write_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "sink")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sinks.read_batches(spark, folder, rows.schema).count() == 0
    assert sinks.write_once(rows, folder, 0, "k") and not sinks.write_once(rows.limit(1), folder, 0, "k")
    assert sinks.write_once(rows.where("k = 2"), folder, "next", "k")
    got = sorted(tuple(r) for r in sinks.read_batches(spark, folder, rows.schema).collect())
    assert got == [(1, "a"), (2, "b"), (2, "b")]


def test_rounds_go_on_after_a_restart(spark, tmp_path):
    """Most rows are of one run; each part is landed and counted by a stream of its own, which goes on from the last one's folder."""
    rounds_in = [(1 if i % 3 else i, i, int(i in (500, 1301))) for i in range(2000)]
    for part in range(4):
        own = rounds_in[part * 500:part * 500 + 500]
        random.Random(part).shuffle(own)
        spark.createDataFrame(own, "run_id long, round long, added long").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("run_id long, round long, added long").parquet(str(tmp_path / "in"))
        got = rounds.stagnation_table(stream, folder=str(tmp_path / "out"))
    want, idle = {}, {}
    for run, n, added in rounds_in:
        idle[run] = 0 if added else idle.get(run, 0) + 1
        want[run, n] = (idle[run], idle[run] >= 3)
    assert {(r.run_id, r["round"]): (r.stagnant, r.stop) for r in got.collect()} == want


def test_quotations_are_searched_in_all_chunks(spark):
    """The first words of a quotation are frequent in twelve chunks and stand once in the one that holds it."""
    start = "yield of the northern field under heavy rain was measured"
    quote = start + " once more after Zanzibar closed"
    frequent = (start + " again. ") * 55
    text = frequent * 13 + "Nothing else grew on those hills that year. " * 60 + quote + ". " + "Nothing else grew there. " * 400
    docs = spark.createDataFrame([(1, "Results\n" + text)], "doc_id long, text string")
    asked = spark.createDataFrame([(5, 1, quote, 0, "high", "")], "quote_id long, doc_id long, quote string, pos int, importance string, context string")
    chunks = P.chunk_offsets(docs)
    pairs = Q.candidate_chunks(asked, chunks).collect()
    assert sorted(r.chunk_index for r in pairs) == list(range(chunks.count()))
    assert len({r["rank"] for r in pairs}) == len(pairs)
    row = Q.verify_quotes(asked, docs).first()
    assert (row.verification_method, row.quote, row.verified) == ("exact", quote, True)


def test_very_long_quotations_are_tried(spark):
    """A quotation longer than any chunk is not found; one of many short words is."""
    letters = " ".join(random.Random(3).choices("abcdefgh", k=1300))
    docs = spark.createDataFrame([(1, "Results\n" + "Orre " * 6000), (2, "Results\n" + letters + ". " + "More words follow. " * 300)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 1, "Orre " * 5500, 0, "high", ""), (2, 2, letters.replace(" ", "  "), 0, "high", "")],
                                  "quote_id long, doc_id long, quote string, pos int, importance string, context string")
    rows = {r.quote_id: r for r in Q.verify_quotes(asked, docs).collect()}
    assert rows[1].verification_method == "not_found" and not rows[1].verified
    assert (rows[2].verification_method, rows[2].quote) == ("normalized", letters)
