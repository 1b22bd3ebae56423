"""Text rules, matching, audit and plan shapes."""

import json
import random
from difflib import SequenceMatcher

import pytest
from conftest import SF
from pyspark.sql import functions as F

from proofloom.functions import authors as A
from proofloom.functions import citations as C
from proofloom.functions import fuzzy
from proofloom.functions import headings as H
from proofloom.functions.text import numbers_subset
from proofloom.operators import answers as N
from proofloom.operators import audit as U
from proofloom.operators import passages as P
from proofloom.operators import quotes as Q
from proofloom.operators import registry as R
from proofloom.plans import QUERIES
from proofloom.plans.tables import derive, read
from proofloom.sources import bibliographic as B


def column(spark, values, fn, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize("line, category", [
    ("Results", "EVIDENCE"), ("results", "EVIDENCE"), ("Results Are Promising", None), ("Summary", "ABSTRACT"),
    ("Significance", "EXCLUDE"), ("Keywords", "REFS"), ("Figure 2 Results", None), ("design", None),
    ("2.1 Materials and Methods", "METHODS"), ("## Results & Discussion", "EVIDENCE"), ("REFERENCES:", "REFS"),
    ("Section 3.1 Main Findings", "EVIDENCE"), ("A. Background", "EXCLUDE"), ("", None)])
def test_headings(spark, line, category):
    assert column(spark, [line], H.classify_heading) == [category]


def test_sections_cover_their_text(spark):
    d = P.with_sections(derive(spark, SF, "articles").withColumnRenamed("article", "text"))
    rows = P.section_regions(d).join(d.select("doc_id", "text"), "doc_id").collect()
    assert rows
    for r in rows:
        assert r.text[r.start:].lstrip().startswith(r.heading)
        assert r.start < r.end <= len(r.text)


def test_author_forms(spark):
    got = column(spark, ["Salotti JM", "Suzanne M. de la Monte", "Smith, J. A.", "J. M. Salotti", "Plato"], A.last_first)
    assert got == ["Salotti, J. M.", "de la Monte, S. M.", "Smith, J. A.", "Salotti, J. M.", "Plato"]


def test_long_author_list_is_cut(spark):
    got = column(spark, [[f"Author{i} A" for i in range(1, 23)]], lambda c: A.apa_reference(
        c, F.lit(2001), F.lit("T"), F.lit(None).cast("string"), F.lit("http://x.org/1")), "array<string>")[0]
    assert ", ... Author22, A. (2001). T. http://x.org/1" in got and "Author20" not in got


def test_secondhand_signs(spark):
    own, other = column(spark, ["We found a rise of 30% in the second year.", "According to Brown (2020), a rise was seen [3-5]."],
                        C.secondhand_markers)
    assert own == []
    assert [m.split(":")[0] for m in other] == ["numeric_citation", "single_paren_citation", "attribution_phrase"]


def test_changed_number_is_refused(spark):
    df = spark.createDataFrame([("a rise of 30% was seen", "a rise of 80% was seen", 0.97),
                                ("a rise of 30% was seen", "a rise of 30% was seen.", 0.97)], "q string, m string, s double")
    assert [r[0] for r in df.select(Q.accept_match("s", "q", "m")).collect()] == [False, True]
    assert df.select(numbers_subset("q", "m")).first()[0] is False


def test_sentence_expansion():
    text = "Results\nDr. J. Smith found 3.5 units of growth in all plants. Others (Lee et al. 2001) did not.\n\nNext part"
    start = text.index("found")
    a, b = fuzzy.expand_sentence(text, start, start + 9)
    assert text[a:b] == "Dr. J. Smith found 3.5 units of growth in all plants."


def test_bounds_never_hide_a_match():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(60))
        at = rng.randint(0, len(text) - 60)
        quote = list(text[at:at + 50])
        for _ in range(rng.randint(0, 3)):
            quote[rng.randrange(50)] = rng.choice("abcxyz ")
        quote = "".join(quote)
        naive = []
        for s in range(len(text) - 49):
            r = SequenceMatcher(None, quote, text[s:s + 50]).ratio()
            if r >= 0.85:
                naive.append((s, s + 50, r))
        naive.sort(key=lambda h: -h[2])
        assert fuzzy.best_windows(quote, text, 0.85) == naive[:5]
        best, span = 0.0, None
        for size in (50, 45, 55):
            for s in range(0, len(text) - size + 1, size // 10):
                r = SequenceMatcher(None, quote, text[s:s + size]).ratio()
                if r > best:
                    best, span = r, (s, s + size)
        found = fuzzy._window_match(quote, text)
        assert found == (("fuzzy", *span, best) if best >= 0.8 else None)
        for s in range(0, len(text) - 50, 7):
            if fuzzy.similarity(quote, text[s:s + 50]) >= 0.95:
                assert fuzzy.may_reach(quote, text, 0.95)


def test_chunks_equal_their_offsets(spark):
    d = read(spark, SF, "documents").select("doc_id", "text")
    rows = P.chunk_offsets(d).join(d, "doc_id").orderBy("doc_id", "chunk_index").collect()
    ends = {}
    for r in rows:
        assert r.text[r.start:r.end] == r.chunk
        assert r.start == 0 if r.chunk_index == 0 else r.start == ends[r.doc_id] - 500
        ends[r.doc_id] = r.end
    assert all(ends[r.doc_id] == len(r.text) for r in rows)
    with pytest.raises(ValueError):
        P.chunk_offsets(d, size=500)


def test_scan_equals_brute_force(spark):
    docs = [(1, "aXaXa one two three four five six seven"), (2, "nothing here"), (3, "two words\nare  split, aXaXaXa end"),
            (4, "say one two three four five six seven eight one two three four five six seven"), (5, "x\\Ey.*z ok")]
    quotes = [(1, "aXa"), (2, "one two three four five six seven"), (3, "words\nare  split"), (4, "absent words of some length"),
              (5, "x\\Ey.*z"), (6, "three four")]
    got = Q.exact_quote_scan(spark.createDataFrame(quotes, "quote_id bigint, quote string"),
                             spark.createDataFrame(docs, "doc_id bigint, text string"))
    want = sorted((q, d, i, i + len(t)) for q, t in quotes for d, x in docs for i in range(len(x)) if x.startswith(t, i))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_hot_anchor_stays_whole(spark):
    """A third of all documents shares one passage; nothing is dropped."""
    shared = "this very passage is shared by a great many of the documents"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.concat(F.lit("start " + shared + " end "), "id")).otherwise(F.concat(F.lit("other text "), "id")).alias("text"))
    quotes = spark.createDataFrame([(1, shared)], "quote_id bigint, quote string")
    assert Q.exact_quote_scan(quotes, docs).count() == 1000


def test_verified_spans_are_source_text(spark):
    d = derive(spark, SF, "articles").withColumnRenamed("article", "text")
    rows = Q.verify_quotes(derive(spark, SF, "proposals"), d).join(d, "doc_id").collect()
    assert any(r.verified for r in rows)
    for r in rows:
        if r.verification_method != "not_found":
            assert r.text[r.start:r.end] == r.quote
        if r.verified:
            assert r.source_section in ("EVIDENCE", "ABSTRACT", "UNKNOWN") and not r.markers


def test_registry_numbers_are_dense(spark):
    reg = R.assign_tokens(derive(spark, SF, "studies"), derive(spark, SF, "study_quotes"))
    for r in reg.where("not is_summary").groupBy("review_id").agg(F.sort_array(F.collect_list("n")).alias("n")).collect():
        assert r.n == list(range(1, len(r.n) + 1))


def test_audit_names_the_true_source(spark):
    studies = spark.createDataFrame([
        (1, 1, 10, "p1", "One", ["Ann Lee"], 2001), (1, 2, 11, "p2", "Two", ["Bo Kim"], 2002)],
        "review_id bigint, study_index bigint, doc_id bigint, paper_id string, paper_title string, paper_authors array<string>, paper_year int")
    texts = spark.createDataFrame([
        (10, "Intro. The yield rose in every tested field over three seasons. End."),
        (11, "Intro. Water use fell by a third on the farms that took part. End.")], "doc_id bigint, text string")
    review = spark.createDataFrame([(1, (
        'A "The yield rose in every tested field over three seasons." (Lee, 2001) and then some more words that fill the line '
        'so that it is long. B "Water use fell by a third on the farms that took part." (Lee, 2001). C "Nobody ever wrote this '
        'sentence in any source at all." (Kim, 2002). D "Water use fell by a third on the farms that took part." (Roe, 1999).'))],
        "review_id bigint, text string")
    got = U.quote_sources(U.quoted_spans(review), studies, texts).orderBy("n").collect()
    assert [r.verdict for r in got] == ["attributed", "misattributed_quote", "fabricated_quote", "unknown_citation"]
    assert got[1].true_study == 2


def test_intro_is_put_in_front(spark):
    reviews = spark.createDataFrame([(1, "First words. The [[Q1]] shows. Then [[S1]] later.")], "review_id bigint, text string")
    look = spark.createDataFrame([(1, "Q1", 1, True, False)], "review_id bigint, token string, study_index bigint, valid boolean, is_summary boolean")
    flagged = spark.createDataFrame([(1, 1)], "review_id bigint, study_index bigint")
    assert R.fix_intros(reviews, look, flagged).first().text == "First words. [[S1]] The [[Q1]] shows. Then  later."


def test_transcribed_copy_is_removed(spark):
    source = "the trial enrolled many adults and followed them for two whole years with care"
    reviews = spark.createDataFrame([(1, f"Intro [[S1]] {source}. A connector stays.")], "review_id bigint, text string")
    reg = spark.createDataFrame([(1, "S1", source)], "review_id bigint, token string, text string")
    got = R.strip_transcription(reviews, reg).first().text
    assert got == "Intro [[S1]]. A connector stays."


def test_context_window_matches_plain_rule(spark):
    text = "One two three. Four five six seven eight nine ten. Eleven [[Q1]] twelve thirteen fourteen.\nFifteen sixteen"
    start = text.index("seven")
    df = spark.createDataFrame([(text, start, start + 5)], "text string, s int, e int")
    r = df.select(R.context_window("text", F.col("s"), F.col("e"), 2).alias("w")).first().w
    assert text[r.start:r.end] == " Four five six seven eight nine ten."


def test_json_recovery(spark):
    raw = ['{"a": 1}', '```json\n{"a": 1}\n```', '{"a": [1, 2,],}', '{"a": "x", "b": ["c", "d', '{"a": "he said "no" twice"}',
           '{"a": maybe later, "b": 2}', '{"a": [{"b": 1]}', '<think>{x}</think>{"a": 1}', 'no object']
    df = spark.createDataFrame(list(enumerate(raw)), "answer_id bigint, raw string")
    got = [json.loads(r.value) if r.value else None for r in N.repair_json(df).orderBy("answer_id").collect()]
    assert got == [{"a": 1}, {"a": 1}, {"a": [1, 2]}, {"a": "x", "b": ["c"]}, {"a": 'he said "no" twice'},
                   {"a": "maybe later", "b": 2}, {"a": [{"b": 1}]}, {"a": 1}, None]
    assert [r.answer_id for r in N.dead_letter_json(df).collect()] == [8]


def test_landed_files_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title":"T","authors":[{"name":"Ann Lee"},{"name":""}],"externalIds":null}\n'
                                     '{"authors":[],"year":2001,"journal":{"name":"J"},"venue":""}\n')
    rows = B.scan_semantic_scholar(B.read_landed(spark, str(tmp_path), "semantic_scholar")).orderBy("title").collect()
    assert [(r.title, r.authors, r.venue, r.doi) for r in rows] == [("T", ["Ann Lee"], "", None), ("Unknown", [], "J", None)]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("plain words")
    (tmp_path / "in" / "b.html").write_text("<html><script>x</script><p>shown</p></html>")
    (tmp_path / "in" / "c.exe").write_text("no")
    docs = {r.source: r.text for r in P.read_files(spark, str(tmp_path / "in")).collect()}
    assert docs["a.txt"] == "plain words" and "shown" in docs["b.html"] and "x</script>" not in docs["b.html"] and len(docs) == 2
    out = str(tmp_path / "log")
    turns = spark.createDataFrame([(1, 0, "user", "why"), (1, 1, "assistant", "so")], "conv_id bigint, turn bigint, role string, text string")
    N.append_transcript(turns, out)
    N.append_transcript(turns.withColumn("conv_id", F.lit(2).cast("bigint")), out)
    assert spark.read.parquet(out).count() == 2


@pytest.mark.parametrize("name", ["j6_position_to_section", "j7_span_in_chunk", "j9_exact_quote_scan", "c1_locate_in_corpus",
                                  "j8_locate_quotes", "t1_bm25_topk", "t1_bm25_corpus", "j10_citation_to_study", "a1_resolve_catalog",
                                  "j2_resolve_selections", "j4_best_title_match", "p16_mode_entry_gates"])
def test_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbering_uses_buckets(spark):
    plan = R.assign_tokens(derive(spark, SF, "studies"), derive(spark, SF, "study_quotes"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in w for w in windows)


def test_projection_reaches_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.md5("text"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
