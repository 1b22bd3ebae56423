"""Quality scores by pairwise ranking.

A document's strength is a weighted sum of features of its whole text. The
weights are the Bradley-Terry fit of preference pairs (a better document, a
worse one): the logistic loss of the feature differences, with a small penalty.
The strengths of the labelled documents give a threshold, the quantile that
cuts off the share of worse documents; the score is the logistic function of
the strength, shifted so that the threshold gets `CUT`.

Labels come from at most `max_labels` labelled rows, those of the smallest
hash of their id; everything else reads all rows. Null texts count as empty.
Rows without label, or labels without document, teach nothing. Without a pair
of a better and a worse document every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Score at the threshold; from here on a document counts as good.
CUT = 0.3
#: Labelled rows that the fit reads at most.
MAX_LABELS = 20_000
#: Pairs drawn for each labelled document.
PAIRS = 12

_CLASSES = [np.frombuffer(c, np.uint8) for c in (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b",.;:'\"-()", b"?", b"!",
    b"|", b"*&$%#", b"@^~=+<>{}[]\\/_`", b"\t\r")]
_SYMBOL_END = re.compile(r"[^\w\s,.;:'\")-](?=\s|$)")
N_FEATURES = len(_CLASSES) + 13


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a text; an empty one has zeros."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return out
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:len(_CLASSES)] = [counts[c].sum() / n for c in _CLASSES]
    upper, lower = out[0], out[1]
    distinct = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[len(_CLASSES):] = [
        counts[128:].sum() / n, upper / (upper + lower + 1e-9), np.log1p(len(words)), distinct / len(words),
        np.log1p(len(words) / distinct - 1), lengths.mean(), np.log(lengths.max()), len(_SYMBOL_END.findall(text)) / len(words),
        1 - len(set(lines)) / len(lines), np.log(n / len(lines)), len(zlib.compress(raw, 1)) / n,
        sum(map(raw.count, (b"http", b"www."))) / len(words), sum(x in raw for x in (b"&&", b"$$", b"!!", b"##", b"%%", b"**"))]
    return out


@dataclass(frozen=True)
class Ranker:
    """Weights of the standardised features, and the strength at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        strength = ((rows - self.mean) / self.scale).clip(-8, 8) @ self.weights
        shifted = strength - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-shifted.clip(-30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-3, steps: int = 25) -> Ranker:
    """Bradley-Terry weights by Newton steps on the mean logistic loss of pair differences."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    mean, scale = (rows.mean(0), rows.std(0) + 1e-6) if len(rows) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    weights = np.zeros(N_FEATURES)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, weights, float(np.log(CUT / (1 - CUT))))
    x = ((rows - mean) / scale).clip(-8, 8)
    draw = np.random.default_rng(7)
    better = np.concatenate([np.repeat(good, pairs), draw.choice(good, pairs * len(bad))])
    worse = np.concatenate([draw.choice(bad, pairs * len(good)), np.repeat(bad, pairs)])
    gap = x[better] - x[worse]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(gap @ weights).clip(-30, 30)))
        slope = gap.T @ (p - 1) / len(gap) + penalty * weights
        bend = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + penalty * np.eye(N_FEATURES)
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    strengths = x @ weights
    # The quantile stands in the middle of the gap between the two documents around it.
    order, cut = np.sort(strengths), len(bad)
    return Ranker(mean, scale, weights, float(order[cut - 1:cut + 1].mean()))


def _feature_arrays(batches: Iterator[pa.Array]) -> Iterator[np.ndarray]:
    for batch in slices(batches):
        yield np.array([features(t) for t in batch.to_pylist()]).reshape(-1, N_FEATURES)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for rows in _feature_arrays(batches):
        ends = pa.array(np.arange(0, rows.size + 1, N_FEATURES), pa.int32())
        yield pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))


def train(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text",
          max_labels: int = MAX_LABELS) -> Ranker:
    """Fit on documents joined with 0/1 labels, on a bounded number of labelled rows."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(
        "id is not null and label in (0, 1)").withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(2**30)) / 2**30)
    # About twice the rows that are wanted go on to be sorted, however many there are.
    near = rows.where(F.col("draw") * rows.count() < 2 * max_labels + 100)
    taught = near.orderBy("draw", "id", "label").limit(max_labels).drop("draw")
    # At most max_labels rows of two numbers: small enough to send everywhere.
    rows = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(taught), "id")
            .select("id", "label", _features("text").alias("f")).orderBy(F.xxhash64("id"), "id", "label").limit(max_labels)
            .collect())
    return fit(np.array([r.f for r in rows]).reshape(-1, N_FEATURES), np.array([r.label for r in rows], int))


def score(ranker: Ranker, text: Column) -> Column:
    """double: the score of a text, between 0 and 1."""
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in _feature_arrays(batches):
            yield pa.array(ranker.score(rows))

    return scored(text)


def predicted(score: Column) -> Column:
    """int: 1 for a score of `CUT` or more."""
    return (score >= CUT).cast("int")
