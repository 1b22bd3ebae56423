"""Fingerprints that scale with the text: all shingle hashes below a fixed fraction.

A fingerprint holds the hashes of word shingles that fall below 1/`SCALE` of the
hash range, in order, `DIGITS` hexadecimal digits each. A set whose hashes are all
above keeps its smallest one. Fingerprints merge by union, and as each keeps
the same share of its set, the share of one that stands in another estimates
containment, however unequal the documents are. Likeness is the larger
containment of the two: common hashes over the hashes of the smaller one.
Two empty fingerprints are alike (1); an empty and another one are not (0).

Null texts count as empty. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shingles import Shingler

#: One of so many hashes is kept.
SCALE = 8
#: Hexadecimal digits of a kept hash.
DIGITS = 12


def kept(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of sorted hashes."""
    below = hashes[:np.searchsorted(hashes, np.uint64(2**64 // scale))]
    return below if len(below) else hashes[:1]


def written(sketch: np.ndarray) -> str:
    """Hashes as text, their lowest digits cut off."""
    return np.sort(sketch).astype(">u8").tobytes().hex() if DIGITS == 16 else "".join(
        f"{h:0{DIGITS}x}" for h in sorted({h >> (64 - 4 * DIGITS) for h in sketch.tolist()}))


def read(fingerprint: str) -> set[str]:
    return {fingerprint[i:i + DIGITS] for i in range(0, len(fingerprint), DIGITS)}


def merged(a: str, b: str, scale: int = SCALE) -> str:
    """The fingerprint of both shingle sets together."""
    both = sorted(read(a) | read(b))
    limit = f"{2**64 // scale >> (64 - 4 * DIGITS):0{DIGITS}x}"
    return "".join([h for h in both if h < limit] or both[:1])


def containment(a: str, b: str) -> float:
    """Estimated share of the first document's shingles that stand in the second."""
    own = read(a)
    return len(own & read(b)) / len(own) if own else float(not b)


def likeness(a: set[str], b: set[str]) -> float:
    if not a or not b:
        return float(not a and not b)
    return len(a & b) / min(len(a), len(b))


def edited(text: str, following: str) -> str:
    """The last half of a text, by code points, replaced by as many from the start of the following one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _ends_not_below(ends: list[int], value: Column) -> Column:
    """How many of the descending ends are not below a value, by bisection."""
    listed = F.lit(ends).cast("array<bigint>")
    steps = F.array(*[F.lit(2**k) for k in range(len(ends).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(listed, at + step - 1) >= value, at + step).otherwise(at))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, ghost, doc_id, text): the documents in ranges of descending ids, each with the first row of the next range.

    A ghost row ends each range, so that every document's successor stands in
    its own partition; that of the last range is the very first row. The ends
    of the ranges are quantiles of the ids, as many as there are shuffle
    partitions. Texts are shuffled once. Rows without id come last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ends = own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    ends = sorted(set(ends), reverse=True)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(ends))).otherwise(_ends_not_below(ends, F.col("doc_id"))) if ends else F.lit(0)
    placed = own.select(part.alias("part"), "doc_id", "text")
    heads = cut_lineage(placed.groupBy("part").agg(F.max("doc_id").alias("head")), "heads")
    last = F.lag("part").over(Window.orderBy("part"))  # one row for each range
    heads = heads.withColumn("to", F.coalesce(last, F.max("part").over(Window.partitionBy())))
    rows = placed.withColumn("ghost", F.lit(0)).unionByName(_heads(placed, heads))
    return rows.repartitionByRange(n, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "text")


def _heads(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """The first row of each range, for the end of the one before."""
    # One row for each shuffle partition at most.
    met = placed.join(F.broadcast(heads), (placed["part"] == heads["part"]) & placed["doc_id"].eqNullSafe(heads["head"]))
    return met.groupBy("to").agg(F.min("text").alias("text"), F.first("head").alias("doc_id")).select(
        F.col("to").alias("part"), "doc_id", "text", F.lit(1).alias("ghost"))


_COLUMNS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    schema = pa.schema(_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        waiting, rows = None, []  # waiting: (part, doc_id, text, fingerprint, its hashes)

        def report(at, following):
            changed = edited(at[2], following[2])
            other = written(kept(shingle(changed), scale))
            return (at[1], len(at[2]), hashlib.sha256(changed.encode()).hexdigest(), at[3], other,
                    likeness(at[4], read(other)), likeness(at[4], following[4]))

        for batch in batches:
            for part, ghost, own, t in zip(*(batch.column(c) for c in ("part", "ghost", "doc_id", "text")), strict=True):
                t = t.as_py()
                print_ = written(kept(shingle(t), scale))
                now = (part.as_py(), own.as_py(), t, print_, read(print_))
                if waiting and waiting[0] == now[0]:
                    rows.append(report(waiting, now))
                waiting = None if ghost.as_py() else now
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], schema=schema)

    return neighbours(docs, doc_id, text).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
