"""Quality rules: surface rules and an n-gram likelihood ratio between trusted texts and the raw corpus.

A text is taken as the UTF-8 bytes of its words, joined by single blanks with
one blank at either end. Its n-grams of 2, 3 and 4 bytes are hashed, each
length into buckets of its own. Two multinomials over the buckets, one from the
trusted texts and one from all texts, give every bucket the logarithm of its
ratio. A text's score is the mean of these logarithms over its n-grams, so
length does not count. The verdict is a fixed threshold on that mean: every
text is judged alone, none is drawn by lot.

Counts are whole numbers summed by Spark, and logarithms are rounded to
millionths before texts are summed, so a score does not depend on how rows are
split. Tasks hold one counter for each bucket; long texts are counted in
pieces.

Surface rules: word_chars, n_symbols, n_dup_lines and n_repeat_words as in
`Surface`; a text of fewer than 20 words, or with more than 30 % of its words in
repeated windows of eight, has failed.

Null and empty texts, and texts without a word, have counts of 0, a score of 0
and have failed. Without a trusted text all scores are 0 and the surface rules
alone decide. Rows of equal id are judged each on its own text; all of them are
trusted if their id is. A row without id is never trusted. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: Bytes of the n-grams, and bits of the bucket number within a length.
LENGTHS, BITS = (2, 3, 4), 14
#: Added to every bucket's count.
SMOOTHING = 0.5
#: Texts whose n-grams have on average a smaller logarithm (natural) than this are rejected. Trusted texts stand about 0; a
#: share of languages that differs between trusted and raw texts moves them by a tenth or two.
LEAST = -0.3
#: Bytes that are counted together.
PIECE = 1 << 20

_MILLION = 1_000_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def buckets(words: list[bytes]) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, in pieces."""
    if not words:
        return
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    longest = max(LENGTHS)
    for start in range(0, len(text), PIECE):
        part = text[start:start + PIECE + longest - 1].astype(np.uint64)
        code = part
        for n in range(2, longest + 1):
            code = (code[:-1] << np.uint64(8)) | part[n - 1:]
            if n in LENGTHS:
                own = code[:PIECE]  # later ones belong to the next piece
                yield ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64) + (LENGTHS.index(n) << BITS)
            if len(code) < 2:
                break


def repeated(words: list[bytes], window: int = 8) -> int:
    """Words inside windows of eight words that stand twice or more in the text.

    Equal windows get equal numbers by doubling: words, then pairs, then fours, then eights.
    """
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    width = 1
    while width < window:
        pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        ids = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    found = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:-window][found] += 1
    np.add.at(edges, np.flatnonzero(found) + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def surface(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    raw = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero(((raw & 0xC0) != 0x80) & ~_BLANK[raw]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, int(np.count_nonzero(_SYMBOL[raw])), len(lines) - len(set(lines)), repeated(words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(LENGTHS) << BITS
    raw, trusted = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        for text, known in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
            own = text.as_py()
            if own is None:
                continue
            trust = known.as_py()
            for part in buckets(own.split()):
                n = np.bincount(part, minlength=size)
                raw += n
                if trust:
                    trusted += n
    met = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(trusted[met])], ["bucket", "n", "trusted"])


def learn(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Millionths of the log ratio of each bucket. trusted: the ids of trusted texts, in a column of the same name."""
    known = trusted.select(F.col(doc_id).alias("doc_id")).where("doc_id is not null").distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = rows.join(small(known.withColumn("trust", F.lit(True))), "doc_id", "left").select("text", F.coalesce("trust", F.lit(False)))
    found = (marked.mapInArrow(_count, "bucket long, n long, trusted long").groupBy("bucket")
             .agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted")).toArrow())
    shape = (len(LENGTHS), 1 << BITS)
    raw, good = np.zeros(shape), np.zeros(shape)
    at = found.column("bucket").to_numpy()
    raw.ravel()[at], good.ravel()[at] = found.column("n").to_numpy(), found.column("trusted").to_numpy()
    if not good.any():
        return np.zeros(raw.size, np.int64)
    share = [np.log((x + SMOOTHING) / (x.sum(1, keepdims=True) + SMOOTHING * x.shape[1])) for x in (good, raw)]
    return np.rint((share[0] - share[1]) * _MILLION).astype(np.int64).ravel()


def judge(weights: np.ndarray, text: Column, least: float = LEAST) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, above>: `above` tells whether the score reaches `least`."""
    bound = round(least * _MILLION)
    kind = "struct<n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, above boolean>"
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.arrow_udf(kind)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, scores, above = [], [], []
            for value in batch.cast(pa.binary()):
                own = value.as_py() or b""
                words = own.split()
                rows.append(surface(own, words))
                total = n = 0
                for part in buckets(words):
                    total += int(weights[part].sum())
                    n += len(part)
                scores.append(total / (n * _MILLION) if n else 0.0)
                above.append(total >= bound * n)
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))]
            yield pa.StructArray.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(above, pa.bool_())], [*names, "score", "above"])

    return judged(text)


def report(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), judge(weights, F.col(text)).alias("j"))
    failed = (F.col("j.n_words") < 20) | (100 * F.col("j.n_repeat_words") > 30 * F.col("j.n_words"))
    return rows.select("doc_id", *[f"j.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                       failed.alias("base_failed"), (~failed & F.col("j.above")).alias("kept"), F.col("j.score").alias("score"))
