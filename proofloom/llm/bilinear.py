"""Scores of texts under a log-bilinear language model.

Tokens are the words of a text, A-Z in lower case, and one end. A token has a
symbol: its own if it is one of the `OWN` most frequent tokens, else that of
its ending, so that a text is a sequence of few symbols. The model predicts a
symbol from the two before it: context vectors of the two places are added,
and the product with the symbol's target vector, plus a bias, is its log
weight. It is trained with noise-contrastive estimation: each batch tells the
true symbols from `NOISE` symbols drawn by frequency. Scoring divides by the
exact sum over all symbols, from batched products over the distinct contexts,
and spreads an ending's probability over its words by their counts, with one
place for unknown words. So all probabilities of a place sum to one.

Counts, endings and training read all training documents. Each round every
task trains on its share, starting from the same parameters, and Spark averages
the results by tokens; the shares of the rounds are disjoint. What the driver
holds is bounded: `LISTED` words, `ENDINGS` endings, the parameters. Words off
the list get their counts by a join.

Null texts count as empty and have the end only. Rows are scored one by one,
also rows of equal id; rows without id are scored too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices

#: The end of a text; no word is empty.
END = b""
#: Tokens with a symbol of their own, endings with a symbol, and words whose counts all tasks know.
OWN, ENDINGS, LISTED = 256, 127, 150_000
#: Bytes of an ending.
ENDING = 2
#: Length of the vectors, noise symbols of a batch, tokens of a batch, step, rounds of averaging.
SIZE, NOISE, BATCH, STEP, ROUNDS = 24, 32, 1024, 0.1, 2
#: Tokens worked on together, and distinct words that a task counts before it passes them on.
TOGETHER, COUNTED = 300_000, 200_000


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space; only A-Z are lower-cased."""
    return (text or "").encode().lower().split()


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the tokens of all documents; the end is the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def passed_on():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                seen.update(words(t.as_py()))
                seen[END] += 1
                if len(seen) > COUNTED:
                    yield passed_on()
        if seen:
            yield passed_on()

    return docs.select(F.col(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Lexicon:
    """Symbols and counts of the listed words, and the totals of the training tokens."""

    index: dict[bytes, int]
    symbol: np.ndarray
    counts: np.ndarray
    endings: dict[bytes, int]
    own: int
    #: Log10 of the mass that the words of a symbol share; 0 for a token of its own.
    mass: np.ndarray
    frequency: np.ndarray
    tokens: int
    distinct: int

    @property
    def symbols(self) -> int:
        return len(self.mass)

    def base(self) -> float:
        return np.log10(self.tokens + 0.1 * (self.distinct + 1))

    def places(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each token its place on the list (-1: off the list) and its symbol."""
        at = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))
        symbols = self.symbol[at]
        off = np.flatnonzero(at < 0)
        other = self.symbols - 1
        symbols[off] = [self.endings.get(tokens[i][-ENDING:], other) for i in off.tolist()]
        return at, symbols


def lexicon(counts: DataFrame) -> Lexicon:
    """The most frequent tokens and endings; ties by bytes.

    The list holds the tokens above a count, at most LISTED, which a histogram of the counts gives;
    a sorted limit of this size would send as many rows from each task to the driver.
    """
    own = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(OWN).collect()]
    level = F.floor(F.log2("n") * 16)
    least, n_listed = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # about a thousand rows at most
        if n_listed + r["count"] > LISTED:
            break
        least, n_listed = r["level"], n_listed + r["count"]
    listed = list(own)
    if least is not None:
        first = {w for w, _ in own}
        rows = counts.where(level >= least).select("word", "n").toArrow()
        listed += sorted((w, n) for w, n in zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True) if w not in first)
    # The tokens of their own are few enough to stand in the plan.
    rest = counts.where(~F.col("word").isin([bytearray(w) for w, _ in own])) if own else counts
    ending = F.substring("word", -ENDING, ENDING)
    per_ending = rest.groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    most = [(bytes(r["e"]), r["n"], r["v"]) for r in per_ending.orderBy(F.desc("n"), "e").limit(ENDINGS).collect()]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_other = total["n"] - sum(n for _, n in own) - sum(n for _, n, _ in most)
    v_other = total["v"] - len(own) - sum(v for _, _, v in most)
    endings = {e: len(own) + i for i, (e, _, _) in enumerate(most)}
    other = len(own) + len(most)
    shared = [*((n, v) for _, n, v in most), (n_other, v_other)]
    symbol = [i if i < len(own) else endings.get(w[-ENDING:], other) for i, (w, _) in enumerate(listed)]
    frequency = np.array([*(n for _, n in own), *(n for n, _ in shared)], float) + 0.5
    return Lexicon({w: i for i, (w, _) in enumerate(listed)}, np.array([*symbol, other], np.int64),
                   np.array([*(n for _, n in listed), 0], float), endings, len(own),
                   np.array([0.0] * len(own) + [np.log10(n + 0.1 * (v + 1)) for n, v in shared]),
                   frequency / frequency.sum(), total["n"], total["v"])


@dataclass(frozen=True)
class Model:
    """Context vectors of the last and the last but one symbol, target vectors and biases."""

    last: np.ndarray
    before: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.last, self.before, self.target, self.bias)])

    def of(self, flat: np.ndarray) -> Model:
        parts, start = [], 0
        for x in (self.last, self.before, self.target, self.bias):
            parts.append(flat[start:start + x.size].reshape(x.shape).astype(np.float32))
            start += x.size
        return Model(*parts)


def untrained(frequency: np.ndarray, size: int = SIZE) -> Model:
    """Symbols by frequency, whatever the context. One more context vector stands for the start of a text."""
    draw, k = np.random.default_rng(11), len(frequency)
    context = draw.normal(0, 0.3, (2, k + 1, size)).astype(np.float32)
    return Model(context[0], context[1], np.zeros((k, size), np.float32), np.log(frequency).astype(np.float32))


def contexts(symbols: np.ndarray, starts: np.ndarray, start_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each place, and the one before that."""
    last = np.concatenate([[start_symbol], symbols[:-1]])
    last[starts] = start_symbol
    before = np.concatenate([[start_symbol], last[:-1]])
    before[starts] = start_symbol
    return last, before


def train(model: Model, frequency: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[Model, int]:
    """Noise-contrastive training on (symbols, starts of texts); returns the model and the number of tokens."""
    draw = np.random.default_rng(5)
    p = replace(model, last=model.last.copy(), before=model.before.copy(), target=model.target.copy(), bias=model.bias.copy())
    grown = [np.full(x.shape, 1e-6, np.float32) for x in (p.last, p.before, p.target, p.bias)]
    log_noise = np.log(NOISE * frequency).astype(np.float32)
    cumulative = np.cumsum(frequency)
    size, seen = p.target.shape[1], 0

    def summed(symbols: np.ndarray, slopes: np.ndarray, n: int) -> np.ndarray:
        flat = (symbols[:, None] * size + np.arange(size)).ravel()
        return np.bincount(flat, slopes.ravel(), n * size).reshape(n, size)

    def move(x: np.ndarray, past: np.ndarray, slope: np.ndarray) -> None:
        past += slope * slope
        x += STEP * slope / np.sqrt(past)

    for symbols, starts in parts:
        last, before = contexts(symbols, starts, len(frequency))
        order = draw.permutation(len(symbols))
        seen += len(order)
        for i in range(0, len(order), BATCH):
            at = order[i:i + BATCH]
            w, a, b = symbols[at], last[at], before[at]
            noise = np.searchsorted(cumulative, draw.random(NOISE)).clip(max=len(frequency) - 1)
            q = p.last[a] + p.before[b]
            t, tn = p.target[w], p.target[noise]
            # How far the model is from telling truth from noise.
            true = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, t) + p.bias[w] - log_noise[w]))
            false = -1 / (1 + np.exp(-(q @ tn.T + p.bias[noise] - log_noise[noise])))
            dq = (true[:, None] * t + false @ tn) / len(at)
            k = len(frequency)
            dt = summed(w, true[:, None] * q / len(at), k)
            db = np.bincount(w, true / len(at), k)
            np.add.at(dt, noise, false.T @ q / len(at))
            np.add.at(db, noise, false.sum(0) / len(at))
            for x, past, slope in zip((p.last, p.before, p.target, p.bias), grown,
                                      (summed(a, dq, k + 1), summed(b, dq, k + 1), dt, db), strict=True):
                move(x, past, slope.astype(np.float32))
    return p, seen


class Scorer:
    """Normalised log10 probabilities of symbols; the sums of contexts are remembered."""

    def __init__(self, model: Model):
        self.model = model
        k = len(model.bias)
        self.sums = np.full((k + 1) * (k + 1), np.nan)

    def __call__(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        m, k = self.model, len(self.model.bias)
        last, before = contexts(symbols, starts, k)
        code = last * (k + 1) + before
        new = np.unique(code[np.isnan(self.sums[code])])
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            weights = (m.last[part // (k + 1)] + m.before[part % (k + 1)]) @ m.target.T + m.bias
            most = weights.max(1, keepdims=True)
            self.sums[part] = most[:, 0] + np.log(np.exp(weights - most).sum(1, dtype=np.float64))
        out = np.empty(len(symbols))
        for i in range(0, len(symbols), 65536):
            s = slice(i, i + 65536)
            out[s] = np.einsum("ij,ij->i", m.last[last[s]] + m.before[before[s]], m.target[symbols[s]]) + m.bias[symbols[s]]
        return (out - self.sums[code]) / np.log(10)


def _parts(texts: Iterator[str | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Tokens of whole texts in a row, about TOGETHER at a time, and where the texts start."""
    tokens, starts = [], []
    for t in texts:
        starts.append(len(tokens))
        tokens.extend(words(t))
        tokens.append(END)
        if len(tokens) >= TOGETHER:
            yield tokens, np.array(starts)
            tokens, starts = [], []
    if tokens:
        yield tokens, np.array(starts)


def _plain(record) -> tuple:
    """The fields of a record; executors unpickle them without this package."""
    return tuple(getattr(record, f.name) for f in fields(record))


def fit(docs: DataFrame, known: Lexicon, lexicon_there: Broadcast, share: Column, text: str = "text", rounds: int = ROUNDS) -> Model:
    """The averaged model after `rounds` rounds; `share` deals the documents to rounds (0 to rounds - 1)."""
    model = untrained(known.frequency)
    for r in range(rounds):
        start = model

        def run(batches: Iterator[pa.RecordBatch], start: Model = start) -> Iterator[pa.RecordBatch]:
            k = Lexicon(*lexicon_there.value)
            texts = (t.as_py() for b in batches for t in b.column(0))
            trained, seen = train(start, k.frequency, ((k.places(tokens)[1], starts) for tokens, starts in _parts(texts)))
            if seen:
                flat = trained.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size), pa.int32()), pa.array(flat * seen),
                                                  pa.array(np.full(flat.size, float(seen)))], ["i", "x", "n"])

        rows = (docs.where(share == r).select(F.col(text)).mapInArrow(run, "i int, x double, n double")
                .groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).collect())
        if rows:
            flat = model.flat()
            flat[[row["i"] for row in rows]] = [row["x"] for row in rows]
            model = model.of(flat)
    return model


def scores(docs: DataFrame, counts: DataFrame, known: Lexicon, lexicon_there: Broadcast, model: Model,
           text: str = "text") -> DataFrame:
    """The rows of docs without the text, with n_tokens, n_known, train_tokens, base_score and score.

    Columns of docs that have one of these names give way.
    """
    model_there = docs.sparkSession.sparkContext.broadcast(_plain(model))

    @F.arrow_udf("struct<n_tokens bigint, listed bigint, base double, score double, rest array<struct<word binary, n int>>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        k, score = Lexicon(*lexicon_there.value), Scorer(Model(*model_there.value))
        log_count, base = np.log10(k.counts + 0.1), k.base()
        for batch in slices(batches):
            out = []
            for tokens, starts in _parts(t.as_py() for t in batch):
                at, symbols = k.places(tokens)
                listed = at >= 0
                # Words off the list get the logarithm of their count later.
                log_n = np.where(listed, log_count[at], 0)
                of_word = np.where(symbols < k.own, 0, log_n - k.mass[symbols])
                sums = [np.add.reduceat(x, starts) for x in (np.ones(len(at), np.int64), listed.astype(np.int64), log_n - base,
                                                            score(symbols, starts) + of_word)]
                rest: list[Counter[bytes]] = [Counter() for _ in starts]
                off = np.flatnonzero(~listed)
                for i, text_no in zip(off.tolist(), (np.searchsorted(starts, off, "right") - 1).tolist(), strict=True):
                    rest[text_no][tokens[i]] += 1
                ends = np.cumsum([0, *map(len, rest)])
                pairs = pa.StructArray.from_arrays(
                    [pa.array([w for c in rest for w in c], pa.binary()), pa.array([n for c in rest for n in c.values()], pa.int32())],
                    ["word", "n"])
                out.append(pa.StructArray.from_arrays(
                    [pa.array(x) for x in sums] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                    ["n_tokens", "listed", "base", "score", "rest"]))
            if out:
                yield pa.concat_arrays(out)
            else:
                yield pa.array([], pa.struct([("n_tokens", pa.int64()), ("listed", pa.int64()), ("base", pa.float64()), (
                    "score", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))]))

    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c != text and c not in made]
    first = cut_lineage(docs.select(F.struct(*kept).alias("own"), scored(F.col(text)).alias("s"),
                                    F.monotonically_increasing_id().alias("row")), "scored")
    rest = (first.select("row", F.explode("s.rest").alias("w")).select("row", "w.word", F.col("w.n").alias("times"))
            .join(counts, "word", "left"))
    c = F.coalesce("n", F.lit(0))
    added = rest.select("row", (F.col("times") * F.log10(c + 0.1)).alias("more"),
                        F.when(c > 0, F.col("times")).otherwise(0).cast("long").alias("known"))
    added = added.groupBy("row").agg(F.sum("more").alias("more"), F.sum("known").alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return first.join(added, "row", "left").select(
        "own.*", F.col("s.n_tokens").alias("n_tokens"), (F.col("s.listed") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("s.base") + more).alias("base_score"),
        (F.col("s.score") + more).alias("score"))


def language_model_scores(docs: DataFrame, held_out: str, share: Column, text: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, score all."""
    training = docs.where(~F.col(held_out))
    counts = cut_lineage(count_tokens(training, text), "counts")
    known = lexicon(counts)
    # One copy of the lexicon serves all steps, so that a worker holds it once.
    there = docs.sparkSession.sparkContext.broadcast(_plain(known))
    return scores(docs, counts, known, there, fit(training, known, there, share, text), text)
