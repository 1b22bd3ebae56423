"""Each operator against brute force or an exact round trip, and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import regex
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from proofloom.llm import (
    bilinear, components, curve, fractions, licenses, neardup, pieces, profiles, queries, ranking, shingles, templates, toolcalls,
)

LONG = "Onhe thing of the and was tion. " * 6000
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "the same words stand here twice over again"),
    (6, "the same words stand here twice over again"), (6, "the same words stand here twice over again"),
    (7, "THE same words stand here twice over again"), (8, "one two"), (9, "one two"), (10, "12 34 !!"), (None, "a row without id"),
    (11, "é漢😀 ▁ K İ mit license"), (12, "\x01\x02 5 kg of Tom Smith"),
]
CLASHES = ["score", "n", "key", "bands", "row", "rep", "part", "ghost", "hash", "place", "shard", "s", "own", "word", "lang", "source"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"x-{c}"))
    return df.withColumn("n_chars", F.length("text").cast("long")).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


# 1: pieces

def test_pieces_equal_the_library(spark, texts):
    sp = library()
    for r in queries.op1_pieces(spark, SF).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_pieces_of_random_text():
    sp = library()
    with open(queries.tokenizer_path(), "rb") as f:
        v = pieces.Vocabulary(f.read())
    draw = random.Random(1)
    for _ in range(3000):
        t = "".join(draw.choice("ab ▁\n\t.,é漢😀\x00\x7f  theer ñ1_²") for _ in range(draw.randint(0, 120)))
        got = np.frombuffer(v.encode([t])[0], np.int32).tolist()
        assert got == sp.encode(t)
        assert v.decode(got) == sp.decode(got)
        ids = [draw.choice([0, 1, 2, 3, 130, 200, 240, 250, 160, 29871, 259, 13, 500, 229]) for _ in range(draw.randint(0, 9))]
        assert v.decode(ids) == sp.decode(ids)
        segment = t.replace(" ", "▁")
        assert v._merge_short(list(segment)) == v._merge_long(segment)


def test_pieces_of_odd_rows(spark, odd, empty):
    path = queries.tokenizer_path()
    sp = library()
    for df in (odd, empty):
        rows = df.select("text", pieces.encode(spark, F.col("text"), path).alias("ids")).withColumn(
            "back", pieces.decode(spark, F.col("ids"), path)).collect()
        assert all(r.ids == sp.encode(r.text or "") and r.back == sp.decode(r.ids) for r in rows)


# 2: language model

def test_model_is_normalised_and_learns():
    draw = np.random.default_rng(0)
    symbols = np.cumsum(draw.integers(1, 3, 20000)) % 12
    frequency = np.bincount(symbols, minlength=12) / len(symbols)
    starts = np.arange(0, len(symbols), 100)
    before = bilinear.untrained(frequency, 8)
    after, seen = bilinear.train(before, frequency, iter([(symbols, starts)] * 3))
    assert seen == 3 * len(symbols)
    held = np.cumsum(draw.integers(1, 3, 2000)) % 12
    first = np.arange(0, 2000, 100)
    assert bilinear.Scorer(after)(held, first).sum() > bilinear.Scorer(before)(held, first).sum() + 300
    one = bilinear.Scorer(after)
    total = sum(10 ** one(np.array([3, 5, w]), np.array([0]))[2] for w in range(12))
    assert math.isclose(total, 1, abs_tol=1e-5)


def test_base_scores_equal_brute_force(spark, texts):
    rows = queries.op2_bilinear(spark, SF).collect()
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    words = {i: [w.encode() for w in _words(t)] + [b""] for i, t in texts.items()}
    c = collections.Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_words_off_the_list(spark, texts, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("out", F.col("doc_id") % 10 == 0)
    whole = {r.doc_id: r for r in bilinear.language_model_scores(docs, "out", F.col("doc_id") % 2).collect()}
    monkeypatch.setattr(bilinear, "LISTED", 300)
    for r in bilinear.language_model_scores(docs, "out", F.col("doc_id") % 2).collect():
        assert r.n_known == whole[r.doc_id].n_known
        assert math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-9)
        assert math.isclose(r.score, whole[r.doc_id].score, rel_tol=1e-2)


def test_scores_of_odd_rows(odd, empty):
    df = odd.withColumn("out", F.coalesce(F.col("doc_id") == 9, F.lit(False)))
    rows = bilinear.language_model_scores(df, "out", F.lit(0)).collect()
    assert len(rows) == len(ODD)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert bilinear.language_model_scores(empty.withColumn("out", F.lit(False)), "out", F.lit(0)).collect() == []


# 3: ranking

def test_ranking_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    rows = [r for r in queries.op3_ranking(spark, sf).collect() if r.held_out and r.doc_id in label]
    right = sum(r.predicted == label[r.doc_id] for r in rows)
    assert right >= 0.97 * len(rows) > 50
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_pairs_order_by_feature():
    x = np.zeros((40, ranking.N_FEATURES))
    x[:, 0] = np.arange(40)
    ranker = ranking.fit(x, (np.arange(40) >= 10).astype(int))
    scores = ranker.score(x)
    assert (np.diff(scores) > 0).all()
    assert ((scores >= ranking.CUT) == (np.arange(40) >= 10)).all()


def test_ranking_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, "x"), (8, 0, "x"), (10, 0, "y"), (10, 0, "y"), (None, 1, "z"), (5, None, "z"), (99, 1, "q")],
                                   "doc_id long, quality int, text string")
    for taught in (labels, labels.where("false")):
        ranker = ranking.train(odd, taught, "quality")
        rows = odd.select(ranking.score(ranker, F.col("text")).alias("p")).collect()
        assert len(rows) == len(ODD) and all(0 <= r.p <= 1 for r in rows)
        assert empty.select(ranking.score(ranker, F.col("text"))).collect() == []
    assert {r.p for r in rows} == {0.5}


# 4: tool calls

def test_levels_circles_and_lost_references(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "t", "{}", []), (1, 1, "b", "t", "{}", ["a", "a"]), (1, 2, "c", "t", "{}", ["b", "a", "zz"]),
         (1, 3, "d", "t", "{}", ["e"]), (1, 4, "e", "t", "{}", ["d"]), (1, 9, "a", "t", '{"x": 1}', ["c"]), (2, 0, "a", None, None, None),
         (None, 0, "a", "t", "{}", []), (3, 5, "s", "t", "{}", ["s"])],
        "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, 5, "a", "late"), (1, 1, "a", None), (1, 2, "x", "lost")],
                                    "conv_id long, turn long, call_id string, content string")
    rows = {(r.conv_id, r.call_id): r for r in toolcalls.link(calls, results, {"t": {}}).collect()}
    assert {k[1]: r.level for k, r in rows.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "x": None}
    assert rows[1, "c"].errors == "unknown reference" and rows[1, "x"].status == "orphan"
    assert (rows[1, "a"].n_calls, rows[1, "a"].n_results, rows[1, "a"].status) == (2, 2, "answered")
    assert rows[2, "a"].errors == "malformed" and rows[3, "s"].level is None
    assert toolcalls.link(calls.where("false"), results.where("false"), {"t": {}}).collect() == []


def test_arguments_and_canonical_json(spark):
    cases = [('{"b": 1, "a": "x"}', ""), ('{"b": 1.5, "a": "x"}', "type b"), ('{"a": 3}', "missing b,type a"), ("[1]", "malformed"),
             ('{"a": "x", "b": 2, "c": {"z": 1, "y": [1, 2]}}', "unexpected c"), ('{"a":', "malformed"), ('{"a": "q", "b": 1}', "value a")]
    schema = {"t": {"a": ("string", True, ["x"]), "b": ("integer", True, None)}}
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, arguments string")
    rows = df.select("i", toolcalls.argument_errors(F.col("arguments"), F.lit("t"), schema).alias("e"),
                     F.to_json(F.try_parse_json("arguments")).alias("j")).orderBy("i").collect()
    assert [",".join(r.e) for r in rows] == [e for _, e in cases]
    assert rows[4].j == '{"a":"x","b":2,"c":{"y":[1,2],"z":1}}'


# 5: shards

@pytest.mark.parametrize("dims,bits", [(1, 3), (2, 3), (3, 4), (4, 2)])
def test_curve_steps_to_neighbours(spark, dims, bits):
    cells = spark.range(2 ** (dims * bits)).select(
        *[F.expr(f"cast((id div {2 ** (bits * i)}) % {2 ** bits} as int)").alias(f"x{i}") for i in range(dims)])
    rows = cells.select("*", curve.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(rows)))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_shards_by_rows(spark, texts):
    rows = queries.op5_curve(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append((r.slot, r.curve, r.text_crc32, r.doc_id))
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    whole = []
    for _, own in sorted(by.items()):
        assert sorted(x[0] for x in own) == list(range(len(own)))
        whole += [x[1:] for x in sorted(own)]
    assert whole == sorted(whole)


def test_shards_by_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = curve.shards(docs, [curve.level_of_number(F.col("n_chars"))], 5, "bytes").collect()
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in rows)
    assert all(abs(n - sum(sums.values()) / 5) <= largest for n in sums.values())


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_odd_rows(odd, empty, law):
    levels = [curve.level_of_name(F.col("lang")), curve.level_of_number(F.col("n_chars"))]
    rows = curve.shards(odd, levels, 8, law).collect()
    assert len(rows) == len(ODD) and {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert all(0 <= r.shard < 8 and r.slot >= 0 for r in rows)
    assert curve.shards(empty, levels, 8, law).collect() == []


# 6: licenses

def test_licenses_equal_brute_force(spark):
    draw = random.Random(3)
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    docs = []
    for i in range(120):
        lines = []
        for _ in range(draw.randint(0, 4)):
            ws = list(draw.choice(licenses.TEMPLATES)[1].split())
            for _ in range(draw.randint(0, 4)):
                ws[draw.randrange(len(ws))] = draw.choice([*vocabulary, "other"])
            lines.append((draw.choice([" ", ", ", " - "])).join(draw.choice([w, w.upper()]) for w in ws))
        docs.append((i, "\n".join(lines)))
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    met = 0
    for r in rows:
        want = set()
        for no, line in enumerate(docs[r.doc_id][1].split("\n")):
            held = set(_license_words(line))
            for k, (label, t) in enumerate(licenses.TEMPLATES):
                own = set(t.split())
                if len(own & held) >= math.ceil(0.8 * len(own) - 1e-9):
                    want.add((label, k, no, len(own & held)))
        met += len(want)
        assert {(m.label, m.template, m.line, m.common) for m in r.matches} == want
        ws = _license_words(docs[r.doc_id][1])
        assert r.n_words == len(ws)
        assert sorted((p.at, p.label) for p in r.places) == sorted(
            (i, label) for label, p in licenses.PHRASES for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split())
    assert met > 50


def _license_words(text):
    out, word = [], ""
    for c in text:
        c = c.lower() if "A" <= c <= "Z" else c
        if c >= "\x80" or c.isdigit() or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def test_licenses_of_odd_rows(odd, empty):
    rows = licenses.report(licenses.scan(odd)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].labels, by[1].score) == (0, 0, None, "", 0)
    assert (by[11].n_words, by[11].base_labels, by[11].first_word) == (6, "mit", 4)
    assert licenses.report(licenses.scan(empty)).collect() == []


def test_licenses_of_wrapped_notices(spark):
    far = " and so on".join(f" {w} " + "word " * 12 for w in ("released", "under", "the", "license"))
    docs = [
        (1, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
        (2, "This file is subject to the terms of the Mozilla Public\n * License, v. 2.0"),
        (3, "you can redistribute it and/or modify\nit under the terms\nof the GNU\nGeneral Public License"),
        (4, far), (5, f"{'word ' * 50}\n{'text ' * 50} Released\n\nunder the MIT\nlicense {'word ' * 50}"),
        (6, "licensed under CC\nBY-NC 4.0"), (7, "all rights reserved")]
    rows = {r.doc_id: r for r in licenses.report(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert {k: r.labels for k, r in rows.items()} == {1: "bsd", 2: "mpl", 3: "gpl", 4: "", 5: "mit", 6: "cc-by-nc", 7: ""}
    assert {k: r.score for k, r in rows.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1, 7: 0}


def test_licenses_of_two_notices_in_a_line(spark):
    docs = [
        (1, "Redistribution and use in source and binary forms, with or without modification, are permitted. Docs licensed under CC BY 4.0"),
        (2, "licensed under CC BY-NC 4.0"), (3, "licensed under the GNU Affero General Public License"),
        (4, "code licensed under CC BY-NC 4.0, " + "word " * 20 + "docs licensed under CC BY 4.0"),
        (5, "This work is licensed under the GNU General Public License, version 3. All rights reserved. "
            "Unauthorized copying of this file is strictly prohibited")]
    rows = licenses.report(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "bsd,cc-by", 2: "cc-by-nc", 3: "agpl,gpl", 4: "cc-by,cc-by-nc", 5: "gpl,proprietary"}


def test_license_words_of_another_notice_do_not_hide_one(spark):
    inner = "redistribution and use in source licensed under cc by 4 0 and binary forms with or without modification are permitted"
    rows = licenses.report(licenses.scan(spark.createDataFrame([(1, inner)], "doc_id long, text string"))).collect()
    assert rows[0].labels == "bsd,cc-by"


def test_license_windows_equal_brute_force(spark):
    draw = random.Random(5)
    words = [*sorted({w for _, t in licenses.TEMPLATES for w in t.split()}), *["other"] * 30]
    docs = []
    for i in range(60):
        parts = [draw.choice(draw.choice(licenses.TEMPLATES)[1:]).split() for _ in range(draw.randint(0, 4))]
        docs.append((i, "".join(w + draw.choice(" \n") for p in parts for w in [
            *(draw.choice(words) for _ in range(draw.randint(0, 25))), *(w if draw.random() < 0.9 else draw.choice(words) for w in p)])))
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    met = 0
    for r in rows:
        ws, best = docs[r.doc_id][1].split(), {}
        for k, (_, t) in enumerate(licenses.TEMPLATES):
            own, span = set(t.split()), licenses.SPREAD * len(t.split())
            common = max((len(own & set(ws[i:i + span])) for i in range(len(ws))), default=0)
            if common >= math.ceil(0.8 * len(own) - 1e-9):
                best[k] = common / len(own)
        got = collections.defaultdict(list)
        for m in r.notices:
            got[m.template].append(m.share)
        assert set(got) <= set(best) and bool(got) == bool(best)
        assert max(best.values(), default=0) == max((max(x) for x in got.values()), default=0)
        met += len(best)
    assert met > 50


# 7: fingerprints

def _words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w.decode()) for w in (text or "").encode().split()]


def _shingles(text):
    w = _words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_equal_brute_force(spark, texts):
    rows = {r.doc_id: r for r in queries.op7_fractions(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for i, k in enumerate(order):
        t, following = texts[k], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        e = t[:len(t) - half] + following[:half]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b = _shingles(t), _shingles(e)
        errors.append(abs(r.near_edited - len(a & b) / min(len(a), len(b))))
        assert 0 <= r.near_next <= 1
    assert len(rows) == len(texts) and np.median(errors) < 0.1


def test_fingerprints_merge_and_estimate_containment():
    one, draw = shingles.Shingler(), random.Random(2)
    words = ["w%d" % draw.randrange(10**6) for _ in range(6000)]
    short, long = " ".join(words[1000:2000]), " ".join(words)
    a, b = (fractions.written(fractions.kept(one(t))) for t in (short, long))
    assert fractions.containment(a, b) > 0.99 and 0.1 < fractions.containment(b, a) < 0.25
    halves = [fractions.written(fractions.kept(one(" ".join(w)))) for w in (words[:3004], words[3000:])]
    assert fractions.merged(*halves) == b and fractions.merged(a, "") == a


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fractions.edit_report(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[5].fingerprint == by[6].fingerprint == by[7].fingerprint and by[1].fingerprint == ""
    assert by[2].near_next == 1 and by[1].n_chars == 0
    assert fractions.edit_report(empty).collect() == []


# 8: languages

def test_languages_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    rows = [r for r in queries.op8_profiles(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.98 * len(rows) > 100
    assert all(0 <= r.score <= 1 for r in rows)


def test_profile_distance_equals_brute_force(spark):
    docs = spark.createDataFrame([(1, "abc abd abc", "x"), (2, "xyz zyx xyz", "y"), (3, "abc", None), (4, None, "z")],
                                 "doc_id long, text string, lang string")
    known = profiles.learn(docs)
    assert known.names == ["x", "y"]
    assert known.predict("abd")[0] == "x" and known.predict("zyx")[0] == "y"

    def ranks(text):
        t = f" {text} "
        c = collections.Counter(t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))
        del c[" "]
        code = lambda g: sum(ord(ch) << 21 * (len(g) - 1 - i) for i, ch in enumerate(g))
        return {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], code(x[0]))))}

    own, theirs = ranks("abd ab"), ranks("abc abd abc")
    total = sum(abs(i - theirs[g]) if g in theirs else profiles.RANKS for g, i in own.items())
    assert math.isclose(known.predict("abd ab")[1], 1 - total / (profiles.RANKS * len(own)))


def test_languages_of_odd_rows(odd, empty):
    known = profiles.learn(odd.withColumn("lang", F.when(F.col("doc_id") < 8, "en").when(F.col("doc_id") > 8, "zz")))
    rows = {r.doc_id: r.p for r in odd.select("doc_id", profiles.predict(known, F.col("text")).alias("p")).collect()}
    assert all(tuple(rows[i]) == ("und", 0.0) for i in (1, 2, 3, 10))
    nothing = profiles.learn(empty)
    assert {r.p.lang for r in odd.select(profiles.predict(nothing, F.col("text")).alias("p")).collect()} == {"und"}
    assert empty.select(profiles.predict(known, F.col("text"))).collect() == []


# 9: decontamination

def _passage(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def test_templates_catch_changed_questions(spark):
    q = f"{_passage(9, 1)} in 1,250 steps and Mary Smith had 30 kg of {_passage(9, 2)} before Mary left 30 apart"
    items = spark.createDataFrame([(1, q), (2, _passage(30, 3)), (3, "a short one"), (4, None), (5, "1 2 3 4 5 6 7 8 9"), (6, q)],
                                  "item_id long, text string")
    other = q.replace("1,250", "77").replace("Mary", "Anna").replace("Smith", "Jones").replace("30", "45").replace("kg", "km")
    torn = q.replace("before Mary", "before Anna").replace("left 30", "left 31")
    docs = spark.createDataFrame(
        [(1, f"{_passage(50, 9)} {q}. {_passage(50, 8)}"), (2, f"{_passage(20, 7)}\n{other.upper()}"), (3, f"x {other} y"), (4, torn),
         (5, _passage(200, 6)), (6, None), (7, ""), (8, " ".join(_passage(30, 3).split()[:12])), (9, "well, a short one here"),
         (10, "9 8 7 6 5 4 3 2 1 0"), (None, q)], "doc_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in templates.contamination(docs, items).collect()}
    assert set(rows) == {(1, 1), (3, 1), (9, 3)}
    assert rows[1, 1].n_changed == 0 and rows[3, 1].n_changed > 2


def test_templates_catch_copies_without_telling_windows_and_parts(spark):
    long = _passage(300, 21)
    sums, names = "What is 48 * 17 + 23 - 5?", "In 1867, Canada, France, Spain and Italy met. Who led Canada?"
    items = spark.createDataFrame([(1, sums), (2, names), (3, long), (4, "12.5 %")], "item_id long, text string")
    words = long.split()
    docs = spark.createDataFrame(
        [(1, f"{_passage(40, 22)} {sums} {_passage(9, 23)}"), (2, f"{_passage(5, 24)}. {names.upper()}"), (3, names.lower()),
         (4, f"{_passage(30, 25)} {' '.join(words[100:150])} {_passage(30, 26)}"), (5, sums.replace("17", "18")),
         (6, names.replace("Spain", "Greece")), (7, f"{_passage(9, 27)} {' '.join(words[100:112])} {_passage(9, 28)}"),
         (8, f"{_passage(31, 29)} {' '.join(words[7:20]).upper()}"), (9, _passage(200, 30))], "doc_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in templates.contamination(docs, items).collect()}
    # Documents 5 and 6 hold the whole template of an item without telling windows, with other values.
    assert set(rows) == {(1, 1), (2, 2), (3, 2), (4, 3), (5, 1), (6, 2), (8, 3)}
    assert rows[1, 1].n_changed == 0 and rows[5, 1].n_changed == 1 and rows[4, 3].n_windows == 293 and 40 <= rows[4, 3].n_covered <= 50


def test_templates_keep_items_that_differ_in_slot_values(spark):
    q = "the farmer has 3 apples and buys 3 more at the market before the sun goes down"
    items = spark.createDataFrame([(1, q), (2, q.replace("buys 3", "buys 4")), (3, q), (4, q.replace("buys 3", "buys 4"))],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, q), (2, f"x {q.replace('buys 3', 'buys 4')} y"), (3, q.replace("3", "8"))],
                                 "doc_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in templates.contamination(docs, items).collect()}
    assert {(1, 1), (2, 2), (3, 1)} <= set(rows) and not {k for _, k in rows} & {3, 4}
    assert rows[2, 2].n_changed == 0 and rows[2, 2].n_covered == rows[2, 2].n_windows


def _brute_tokens(text):
    for pattern, to in templates.ITEM_STEPS:
        text = regex.sub(pattern, regex.sub(r"\$(\d)", r"\\g<\1>", to), text)
    return [t for t in regex.split(templates.SPLIT, text.lower()) if t]


def _bare(t):
    return t[1:] if t < "\x06" else t


def _brute_contamination(docs, items):
    """Documents and items that meet, by comparing each with each at every distance, without hashes."""
    kind = lambda t: min(t[0], "\x03") if t < "\x06" else t
    cut, first = {k: _brute_tokens(q) for k, q in items.items()}, {}
    for k in sorted(cut):
        first.setdefault(tuple(cut[k]), k)
    lower = {t for q in cut.values() for t in q if t >= "\x06"}
    found = set()
    for k in first.values():
        own = ["\x05" + t[1:] if t[0] == "\x04" and t[1:] in lower else t for t in cut[k]]
        w = min(len(own), templates.WIDTH)
        at = [i for i in range(len(own) - w + 1) if sum(t >= "\x05" for t in own[i:i + w]) >= min(w, templates.LITERALS)]
        whole = not at
        if whole:
            own = ["\x05" + t[1:] if t[0] == "\x04" else t for t in own]
            at = [i for i in range(len(own) - w + 1) if any(t >= "\x05" for t in own[i:i + w])]
            if len(own) < templates.WHOLE or sum(t >= "\x05" for t in own) < 2:
                at = []
        place = {}
        for i in at:
            place.setdefault(tuple(map(kind, own[i:i + w])), i)
        plain_own = [_bare(t) for t in own]
        size = min(len(own), templates.RUN)
        for d, text in docs.items():
            doc, held, covered = _brute_tokens(text), False, set()
            plain_doc = [_bare(t) for t in doc]
            for shift in range(-len(own), len(doc) + 1):
                here, values, torn = set(), {}, False
                for window, i in place.items():
                    j = i + shift
                    if j < 0 or j + w > len(doc) or tuple(map(kind, doc[j:j + w])) != window:
                        continue
                    pairs = list(zip(own[i:i + w], doc[j:j + w]))
                    if any(a[0] == "\x05" and a[1:] != b[1:] for a, b in pairs):
                        continue
                    here.add(window)
                    for a, b in pairs:
                        if a < "\x05":
                            torn |= values.setdefault(_bare(a), _bare(b)) != _bare(b)
                if torn:
                    here = {x for x in here if all(t >= "\x06" for t in x)}
                if not whole or len(here) == len(place):
                    covered |= here
                held |= not torn and any(plain_own[i:i + size] == plain_doc[i + shift:i + shift + size]
                                         for i in range(len(own) - size + 1) if i + shift >= 0)
            if held or place and len(covered) >= templates.SHARE * len(place):
                found.add((d, k))
    return found


_PEOPLE = ["Alice", "Robert", "Zoltan", "Mia", "Igor", "Noor"]
_SHAPES = [
    "{a} has {x} apples. {a} buys {y} more apples at the shop. How many apples does {a} have?",
    "What is {x} * {y} + {z} - {v}?", "If {a} and {b} run {x} km in {y} minutes, how fast does {a} run?",
    "A train leaves at {x} and {b} waits {y} minutes. When does the train that {a} takes arrive?",
    "{a} met {b}, {b} met {a}. Who paid {x} euros?", "how many of the {x} books that {a} lent to {b} were read in the {y} weeks",
]


def _asked(shape, draw):
    a, b = draw.sample(_PEOPLE, 2)
    x, y, z, v = draw.sample(range(2, 99), 4)
    return shape.format(a=a, b=b, x=x, y=y, z=z, v=v)


def test_templates_equal_brute_force(spark):
    draw = random.Random(31)
    items = {k: _asked(shape, draw) for k, shape in enumerate(_SHAPES)} | {20: _passage(40, 41), 21: f"Up. {_passage(6, 42)}. Why {_passage(9, 43)}?"}
    docs = {}
    for d in range(150):
        base = draw.choice([_asked(draw.choice(_SHAPES), draw), draw.choice(list(items.values()))])
        words = base.split()
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            words[draw.randrange(len(words))] = draw.choice(["Alice", "the", "7", "What", "apples", "It"])
        lo = draw.choice([0, 0, 0, 3])
        docs[d] = f"{_passage(5, d)}. {' '.join(words[lo:])} {draw.choice(['', 'The end', base])}"
    made = [spark.createDataFrame(list(x.items()), f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id) for r in templates.contamination(*made).collect()}
    assert got == _brute_contamination(docs, items) and 50 < len(got) < 150


def test_templates_find_changed_word_problems(spark):
    """Recall on 200 items with other names and numbers is at least 0.9, and clean texts stay clean."""
    draw = random.Random(32)
    items, docs = [], []
    for k in range(200):
        shape = draw.choice(_SHAPES) + " " + _passage(4, 1000 + k) + "."
        items.append((k, _asked(shape, draw)))
        docs.append((k, f"{_passage(20, 2000 + k)}. {_asked(shape, draw)} {_passage(20, 3000 + k)}"))
        docs.append((1000 + k, f"What is {_passage(6, 4000 + k)}? Alice has 3 {_passage(9, 5000 + k)}. Robert had 4. It is 5."))
    rows = templates.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len({r.doc_id for r in rows if r.doc_id == r.item_id}) >= 180
    assert not [r for r in rows if r.doc_id >= 1000]


def test_templates_catch_planted_passages(spark, texts):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = {(i, k) for i, t in texts.items() for k, q in items if q in t}
    got = {(r.doc_id, r.item_id) for r in queries.op9_templates(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 1


def test_templates_of_odd_rows(odd, empty):
    items = odd.select(F.col("doc_id").alias("item_id"), "text").where("item_id in (4, 5, 1, 2)")
    got = {(r.doc_id, r.item_id) for r in templates.contamination(odd, items).collect()}
    assert got == {(4, 4), (5, 5), (6, 5), (7, 5)}
    assert templates.contamination(empty, items).collect() == []
    assert templates.contamination(odd, items.where("false")).collect() == []


# 10: near-duplicates

def brute_components(rows):
    sets = {i: frozenset(_shingles(t)) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = collections.Counter()
    for own in holders.values():
        common.update((a, b) for n, a in enumerate(own) for b in own[n + 1:])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def _copies(n, groups, seed):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = _passage(120, seed * 1000 + g).split()
        for _ in range(n):
            w = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 4])):
                w[draw.randrange(len(w))] = "z%d" % draw.randrange(99)
            rows.append((len(rows), " ".join(w)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [neardup.CHUNK, 7])
def test_near_duplicates_equal_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup.links, "__defaults__", (neardup.PERCENT, chunk))
    rows = _copies(40, 6, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_of_the_table(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_neardup(spark, SF).collect()}
    assert got == brute_components(texts.items())


def test_sketch_estimates_similarity_and_fills():
    draw = np.random.default_rng(4)
    both = draw.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.unique(both[:800]), np.unique(both[100:])
    agree = np.mean([neardup.sketch(shingles.mix(a + np.uint64(s)), 200) == neardup.sketch(shingles.mix(b + np.uint64(s)), 200)
                     for s in range(20)])
    assert abs(agree - 700 / 900) < 0.03
    for n in (1, 2, 3, 50):
        assert neardup.sketch(a[:n]).max() < np.iinfo(np.uint64).max


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[6] == {(4, 5, False)} and by[7] == {(4, 5, False)}
    assert by[8] == {(1, 8, True)} and by[9] == {(1, 8, False)} and by[None] == {(1, None, True)}
    assert neardup.near_duplicates(empty).collect() == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 90)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 90, 90: 90}


# pipeline

def test_stages_keep_what_brute_force_keeps(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_text", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= left
        if name == "near_duplicates":
            assert set(kept) == {i for i, (_, _, k) in brute_components([(i, texts[i]) for i in left]).items() if k}
        if name == "decontamination":
            items = [q for (q,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
            clean = {i for i in left if not any(q in texts[i] for q in items)}
            assert set(kept) <= clean and len(clean) - len(kept) <= 1
        docs = out
    sp = library()
    for r in corpus_pipeline.encoded(spark, docs, SF).collect():
        assert r.ids == sp.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark):
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == ["doc_id", "n_tokens", "ids", "decoded"] and whole.count() > 100


def test_stages_on_odd_rows(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, empty, SF).collect() == []
    kept = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 8, 10, 11, 12, None]))
    assert corpus_pipeline.encoded(spark, odd, SF).count() == len(ODD)


def test_pipeline_lowers_the_rows_of_an_arrow_batch(spark):
    """In sessions of others, executor and worker each held batches of 10,000 whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, then in (("10000", "512"), ("0", "512"), ("100", "100")):
            spark.conf.set(key, given)
            corpus_pipeline.encoded(spark, corpus_pipeline.table(spark, SF, "documents"), SF)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)
