"""Languages by rank-order profiles.

A profile lists the most frequent letter n-grams (one to `LONGEST` letters, the
ends of words written as blanks) of a language by rank. A document's own list is
compared with each profile: every n-gram adds the distance between its two
ranks, or the length of the profile if the profile lacks it. The language of
the smallest sum wins; equal sums go to the name that comes first.

Profiles are learned from at most `max_rows` documents of each language, those
of the smallest hash of their id. Null texts and texts without a letter are
`und` with score 0; so is every text if nothing was learned. The score is one
minus the sum as a share of the largest possible sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small

#: n-grams of a profile, and of a document.
RANKS = 400
#: Letters of the longest n-gram; three code points of 21 bits fit into one number.
LONGEST = 3
#: Documents of one language that its profile is learned from at most.
MAX_ROWS = 1_000
UNKNOWN = "und"

_BETWEEN = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-case words of a text, with a blank before, between and after."""
    if not text or not any(map(str.isalpha, text)):
        return np.zeros(0, np.uint64)
    words = _BETWEEN.sub(" ", text.lower()).strip(" ")
    return np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.uint64)


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers, and their counts. The lone blank is none."""
    rows, code = [], np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        code = (code[:len(points) - n + 1] << np.uint64(21)) | points[n - 1:]
        rows.append(code)
    codes = np.concatenate(rows)
    return np.unique(codes[codes != 32], return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by number."""
    return codes[np.lexsort((codes, -counts))[:ranks]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of the n-grams of all languages; `ranks` where a language lacks one."""

    names: list[str]
    codes: np.ndarray
    table: np.ndarray
    ranks: int

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters(text)
        if not len(points) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(*grams(points), self.ranks)
        at = np.searchsorted(self.codes, own).clip(max=len(self.codes) - 1)
        theirs = np.where(self.codes[at] == own, self.table[:, at], self.ranks)
        steps = np.where(theirs < self.ranks, np.abs(theirs - np.arange(len(own))), self.ranks)
        sums = steps.sum(1)
        best = int(sums.argmin())
        return self.names[best], 1 - float(sums[best]) / (self.ranks * len(own))


@F.arrow_udf(T.ArrayType(T.StructType().add("code", "long").add("n", "long")))
def _grams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices(batches):
        found = [grams(p) if len(p := letters(t)) else (p, p) for t in batch.to_pylist()]
        ends = np.cumsum([0, *(len(c) for c, _ in found)])
        codes, counts = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"]))


def learn(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text",
          max_rows: int = MAX_ROWS, ranks: int = RANKS) -> Profiles:
    """Profiles of the languages of labelled documents; rows without language or text teach nothing."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    narrow = known.select("lang", "id", (F.pmod(F.xxhash64("id"), F.lit(2**30)) / 2**30).alias("draw"))
    # About twice the rows that are wanted of a language go on to be ranked, however many it has.
    sizes = small(narrow.groupBy("lang").agg(F.count("*").alias("n")))
    drawn = narrow.join(sizes, "lang").where(F.col("draw") * F.col("n") < 2 * max_rows + 100)
    first = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id")))
    taught = small(first.where(F.col("r") <= max_rows).select("lang", "id").distinct())
    counts = (known.join(taught, ["lang", "id"], "left_semi").select("lang", F.explode(_grams("text")).alias("g"))
              .groupBy("lang", "g.code").agg(F.sum("g.n").alias("n")))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counts.withColumn("rank", best - 1).where(F.col("rank") < ranks).select("lang", "code", "rank").collect()
    names = sorted({r["lang"] for r in rows})
    codes = np.array(sorted({r["code"] for r in rows}), np.uint64)
    places = np.full((len(names), len(codes)), ranks, np.int64)
    at = {c: i for i, c in enumerate(codes.tolist())}
    for r in rows:
        places[names.index(r["lang"]), at[r["code"]]] = r["rank"]
    return Profiles(names, codes, places, ranks)


def predict(profiles: Profiles, text: Column) -> Column:
    """struct<lang string, score double> of a text."""
    @F.arrow_udf("struct<lang string, score double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            found = [profiles.predict(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return predicted(text)
