"""Quality rules, phrase mining and conversation repair against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_operators import CLASHES, ODD

from proofloom.llm import collocations, importance, queries, repair


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en"))
    for c in CLASHES:
        df = df if c == "lang" else df.withColumn(c, F.lit(f"x-{c}"))
    return df.withColumn("n_words", F.lit("x")).withColumn("trust", F.lit(7)).cache()


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()


# 11: quality rules

def surface_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def grams_by_hand(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    own = b" " + b" ".join(words) + b" " if words else b""
    for n in importance.LENGTHS:
        for i in range(len(own) - n + 1):
            yield n, (int.from_bytes(own[i:i + n], "big") * 0x9E3779B97F4A7C15 % 2**64) >> (64 - importance.BITS)


def test_importance_equals_brute_force(spark, docs):
    labels = dict((i, (q, t)) for i, q, t in duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall())
    good = {i for i, own in labels.items() if own == (1, 0) and zlib.crc32(str(i).encode()) % 5}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, text, _ in docs:
        n = collections.Counter(grams_by_hand(text))
        raw.update(n)
        if i in good:
            trusted.update(n)
    sums = [{n: sum(c for (m, _), c in own.items() if m == n) for n in importance.LENGTHS} for own in (trusted, raw)]
    size = 1 << importance.BITS

    def weight(gram):
        t, r = ((own[gram] + 0.5) / (total[gram[0]] + 0.5 * size) for own, total in zip((trusted, raw), sums, strict=True))
        return math.log(t) - math.log(r)

    weights = {g: weight(g) for g in raw}
    got = {r.doc_id: r for r in queries.op11_importance(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        r, want = got[i], surface_by_hand(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        own = list(grams_by_hand(text))
        score = sum(map(weights.__getitem__, own)) / len(own) if own else 0.0
        assert abs(r.score - score) < 2e-6
        if abs(score - importance.LEAST) > 2e-6:
            assert r.kept == (not r.base_failed and score >= importance.LEAST)


def test_importance_on_held_out_labels(spark):
    """Labelled texts that taught nothing: good ones stay, bad ones go."""
    sf = SF.replace("0.001", "0.01")
    found = {r.doc_id: r for r in queries.op11_importance(spark, sf).collect()}
    labels = [x for x in duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall() if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    good = [found[i] for i, q in labels if q == 1 and not found[i].base_failed]
    bad = [found[i] for i, q in labels if q == 0]
    assert len(good) > 30 and sum(r.kept for r in good) >= 0.99 * len(good)
    assert len(bad) > 5 and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_repeated_windows_of_random_words():
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join(rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 60)))
        assert importance.repeated(text.encode().split()) == surface_by_hand(text)[4]


def test_n_grams_of_pieces_equal_those_of_the_whole(monkeypatch):
    words = b"some words that are cut at any place of the text".split()
    whole = sorted(x for part in importance.buckets(words) for x in part.tolist())
    for piece in (1, 2, 3, 7, 46, 47, 48, 49, 50, 51):
        monkeypatch.setattr(importance, "PIECE", piece)
        assert sorted(x for part in importance.buckets(words) for x in part.tolist()) == whole


def test_importance_of_odd_rows(spark, odd):
    trusted = spark.createDataFrame([(4,), (4,), (None,)], "doc_id long")
    weights = importance.learn(odd, trusted)
    rows = importance.report(odd, weights).collect()
    assert len(rows) == len(ODD)
    texts = collections.Counter((i, surface_by_hand(t)) for i, t in ODD)
    assert collections.Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == texts
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].score == by_id[2].score == by_id[3].score == 0.0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[4].score > by_id[10].score
    assert not importance.learn(odd, trusted.where("false")).any()
    empty = odd.where("false")
    assert not importance.learn(empty, trusted).any() and importance.report(empty, weights).count() == 0


# 13: conversation repair

EMPTY = hashlib.sha256(b"").hexdigest()


def damaged_by_hand(turns):
    out = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        out[conv]  # all conversations are reported
        one = lambda v: " " if v is None else str(v)
        role, text = one(role), one(text)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
            for c, rows in out.items()}


def cheapest(rows):
    """(cost, audit) by trying all edits; rows: (initial, to be deleted, truncated)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        # Best without an insert first; three rounds of inserts reach every state from every other.
        for state in after:
            options = [(0, "")] if i == len(rows) and state in ("", "a") else []
            if i < len(rows):
                initial, gone, cut = rows[i]
                cost, edits = best[i + 1, state]
                options.append((cost + 3, "D" + edits))
                if not gone:
                    if initial == after[state] or (initial, state) == ("s", ""):
                        cost, edits = best[i + 1, initial]
                        options.append((cost + cut, "K" + edits))
                    cost, edits = best[i + 1, after[state]]
                    options.append((cost + cut + 2, "R" + edits))
            best[i, state] = min(options, default=(math.inf, ""))
        for _ in range(3):
            for state in after:
                cost, edits = best[i, after[state]]
                best[i, state] = min(best[i, state], (cost + 2, "I" + edits))
    return best[0, ""]


def repair_by_hand(rows):
    blanks = " \t\n\x0b\x0c\r"
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(blanks)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
    lines, state, i = [], "", 0
    names = {"u": "user", "a": "assistant"}
    for edit in audit:
        due = "a" if state == "u" else "u"
        if edit == "I":
            lines.append(names[due] + ":")
        elif edit == "R":
            lines.append(names[due] + ":" + rows[i][2])
        elif edit == "K":
            lines.append(rows[i][1] + ":" + rows[i][2])
            due = rows[i][1][0]
        state = state if edit == "D" else due
        i += edit != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def reported(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_equals_brute_force(spark):
    turns = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    got = reported(queries.op13_repair(spark, SF))
    assert got == {c: repair_by_hand(rows) for c, rows in damaged_by_hand(turns).items()}


def odd_turns(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "agent", "", None, "User"]
    texts = ["Yes.", "No", "", " \n", None, "What?", "é漢😀.", "so\x0b", "Ends. \t", "x" * 50_000 + "!"]
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice([".", "", "!"])
            out.append((None if c == 0 else c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]), rng.choice(roles[:rng.choice([2, 3, 10])]), text))
    return out + out[:3]


@pytest.mark.parametrize("rows", [1, 2, 3, 65_536])
def test_repair_in_chunks_of_any_size(spark, rows):
    turns = odd_turns(rows, 40, 30)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    for c in ("number", "uid", "kind", "found", "digest", "blank", "id"):
        df = df.withColumn(c, F.lit(f"x-{c}"))
    assert reported(repair.report(df, rows)) == {c: repair_by_hand(own) for c, own in damaged_by_hand(turns).items()}


def test_guesses_that_never_converge(spark):
    """Rows that all must go pass every vector on unchanged, so only the last chunk's costs are right at first."""
    turns = [(1, t, "system", " ") for t in range(60)] + [(1, 60 + t, "user", f"Say {t}.") for t in range(2)] + [
        (2, t, "user", f"Say {t}") for t in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert reported(repair.report(df, 1)) == {c: repair_by_hand(own) for c, own in damaged_by_hand(turns).items()}


def test_repaired_rows_and_their_grammar(spark):
    turns = [r for r in odd_turns(9, 60, 20) if r[0] is not None]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    own = repair.damaged(df)
    found = repair.audits(repair.faults(own)).cache()
    lines = collections.defaultdict(list)
    for r in repair.repaired(own, found).orderBy("conv_id", "position").collect():
        lines[r.conv_id].append((r.role, r.text))
    want = {c: repair_by_hand(rows) for c, rows in damaged_by_hand(turns).items()}
    for c, w in want.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines[c]))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines[c]).encode()).hexdigest() == w[-1]


def test_repair_of_empty_and_dropped_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(df).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], df.schema)
    assert reported(repair.report(df)) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}


# 12: phrases

def phrases_by_hand(rows, least, top, longest=4):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        own = counts["und" if lang is None else lang]
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for p, f in own.items() if len(p) == 1)
        often = {p: f for p, f in own.items() if f >= least and len(p) > 1}
        found = []
        for p, a in often.items():
            if any(100 * f >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in often.items() if len(q) > len(p)):
                continue
            score, _, left, rest = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, rest))
        for rank, (score, a, p, left, rest) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, rest, n, -score))
    return sorted(out)


def odd_texts(seed, rows):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "\x00", "漢", "a\x85b", " ", "new", "York", "city"]
    out = [(None, "en"), ("", None), (" \t ", "en"), ("..!", "en"), ("x" * 3000, "fr")] + [("New York city hall!", "de")] * 9
    for _ in range(rows):
        text = "".join(rng.choice(words[:rng.choice([4, 11])]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";"]) for _ in range(rng.randint(0, 60)))
        out.append((text, rng.choice(["en", "en", "fr", None])))
    return out


@pytest.mark.parametrize(("bits", "shards", "together", "least"), [(22, 4, 8_000_000, 9), (2, 4, 200, 9), (3, 3, 50, 4), (5, 1, 1000, 9), (1, 2, 1, 30)])
def test_phrases_equal_brute_force(spark, monkeypatch, bits, shards, together, least):
    monkeypatch.setattr(collocations, "BITS", bits)
    rows = odd_texts(bits, 120)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for c in ("words", "phrase", "total", "shard", "fresh"):
        df = df.withColumn(c, F.lit(f"x-{c}"))
    counted = collocations.frequent(df, least=least, shards=shards, together=together)
    got = sorted(tuple(r) for r in collocations.collocations(counted, 40).collect())
    assert got == phrases_by_hand(rows, least, 40)


def test_a_scan_hashes_no_words(monkeypatch):
    """Words were hashed again in every scan of their block; their hashes are written with them."""
    words, ids = collocations.numbered([b"a b a b\xffa b c"])
    hashes = collocations.word_hashes("en", words)
    monkeypatch.setattr(collocations, "word_hashes", None)
    reached = [np.zeros(1 << collocations.BITS, np.uint8) for _ in range(3)]
    reached[0][collocations.cell(hashes)] = 1
    got = {}
    for phrases, counts in collocations.count("en", pa.array(words, pa.binary()), hashes, ids, 1, reached, 4):
        got |= dict(zip(phrases.to_pylist(), counts.tolist(), strict=True))
    assert got == {b"en\n": 7, b"en\na": 3, b"en\nb": 3, b"en\nc": 1, b"en\na b": 3, b"en\nb a": 1, b"en\nb c": 1}


def test_a_phrase_that_becomes_frequent_in_the_last_scan_is_counted_whole(spark):
    """Shards are dealt by row: each holds a few of the occurrences, so the threshold is reached late."""
    rows = [("alpha beta gamma delta", "en")] * 30 + [("alpha beta", "en"), ("gamma", "en")]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    got = {(r.words, r.phrase): r.total for r in collocations.frequent(df).collect()}
    assert got[4, "alpha beta gamma delta"] == 30 and got[2, "alpha beta"] == 31 and got[1, "gamma"] == 31 and got[0, ""] == 123


def test_counts_of_a_bucket_are_merged_in_arrow():
    """Each scan's counts were rows that Spark shuffled and added up one by one; they are packed by bucket now."""
    old = pa.table({"phrase": [b"en\na", b"en\nb", b"en\nc"], "total": [28, 40, 5], "first": [1, 0, 0]}, schema=collocations._TOTALS)
    fresh = pa.table({"phrase": [b"en\na", b"en\nd", b"en\nb", b"en\n", b"en\na"], "fresh": [1, 3, 9, 7, 1]}, schema=collocations._FRESH)
    rows, newly = collocations.merged(old, fresh, 4, 4, 30)
    assert rows.to_pylist() == [{"phrase": p, "total": n, "first": f} for p, n, f in (
        (b"en\na", 30, 1), (b"en\nb", 40, 0), (b"en\nd", 3, 4), (b"en\n", 7, 4))] and newly.to_pylist() == [b"en\na"]
    assert collocations.unpack(pa.scalar(collocations.pack(rows), pa.binary())).equals(rows)


def test_phrases_of_odd_tables(spark, odd):
    assert collocations.collocations(collocations.frequent(odd.where("false")), 10).collect() == []
    counted = collocations.frequent(odd)
    got = [tuple(r) for r in collocations.collocations(counted, 2000).collect()]
    assert sorted(got) == phrases_by_hand([(t, "en") for _, t in ODD], 30, 2000)
