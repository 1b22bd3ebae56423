"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch. `bins` coordinates are filled in rounds. In each of the first `bins`
rounds every shingle is hashed to one bin and a value; a bin keeps its
smallest (round, value). In each of the next `bins` rounds all shingles go to
one fixed bin, so that no coordinate stays empty. It ends as soon as all bins
are full, after a few rounds for all but short texts. Two sketches agree in a
coordinate with a probability equal to the Jaccard similarity, with the same
concentration as independent coordinates.

Bands of `rows` coordinates make buckets. With 26 bands of 5 a pair of
similarity 0.85 shares no bucket in fewer than one of 10^6 cases.

Verification. Texts with equal shingle sets form a class; one document stands
for it. The members of a bucket meet under its smallest member, the centre, so
a document takes part once for a centre however many buckets they share. The
members of a centre are dealt into chunks, each two chunks meet in one task,
and there all pairs are compared on full sets. A task returns, for each
member that confirmed links connect, one link to the smallest, never all pairs.
No bucket and no partner is capped; a centre of m distinct texts costs m * m
comparisons in blocks.

Null texts and texts without a word are linked with nothing. Rows of equal id
count as copies if their sets are equal. A row without id gets no component
and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import slices, small
from .components import components
from .shingles import Shingler, mix

#: Coordinates of a band, and bands of a sketch.
ROWS, BANDS = 5, 26
#: Share of common shingles that links two documents, in percent.
PERCENT = 85
#: Members of a chunk; two chunks meet in a task.
CHUNK = 96

def sketch(hashes: np.ndarray, bins: int = ROWS * BANDS) -> np.ndarray:
    """Filled coordinates of a non-empty set of hashes."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    done, step = 0, max(1, 2048 // len(hashes))
    while done < 2 * bins:
        # Rounds past the one that fills the last bin change nothing: their values are larger.
        rounds = np.arange(done, min(done + step, 2 * bins), dtype=np.uint64)[:, None]
        y = mix(hashes[None, :] + (rounds + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        bin_of = np.where(rounds < bins, ((y >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32), rounds - np.uint64(bins))
        value = (rounds << np.uint64(32)) | (y & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, bin_of.astype(np.int64).ravel(), value.ravel())
        done += step
        if out.max() < np.iinfo(np.uint64).max:
            break
    return out


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One number for each band; it holds the number of the band."""
    cells = coordinates.reshape(-1, rows)
    out = np.arange(1, len(cells) + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, i])
    return out.view(np.int64)


@F.arrow_udf(T.StructType().add("n", "long").add("key", "binary").add("bands", T.ArrayType(T.LongType())))
def _sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    shingle = Shingler()
    for batch in slices(batches):
        sets = [shingle(t.as_py()) for t in batch]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        cells = [bands(sketch(s)) if len(s) else None for s in sets]
        yield pa.StructArray.from_arrays(
            [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64()))],
            ["n", "key", "bands"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    shingle = Shingler()
    for batch in slices(batches):
        yield pa.array([shingle(t.as_py()).view(np.int64) for t in batch], pa.list_(pa.int64()))


def linked(sets: list[np.ndarray], ids: np.ndarray, sides: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(id, smallest id) of the members that links between the sets connect; only pairs of unequal sides count, if there are two."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    common = np.zeros((m, m), np.int64)
    owner = np.repeat(np.arange(m), sizes)
    values, place, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(shared > 1) - 1
    held = shared[place] > 1
    owner, place = owner[held], column[place[held]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = 8192
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [start, start + width])
        cells = np.zeros((m, width), np.float32)
        cells[owner[a:b], place[a:b] - start] = 1
        common += np.rint(cells @ cells.T).astype(np.int64)
    near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if sides.min() != sides.max():
        near &= sides[:, None] != sides[None, :]
    label = np.arange(m)
    order = np.argsort(ids, kind="stable")  # smallest id first, so that a root is the smallest of its tree
    seen = np.zeros(m, bool)
    for root in order:
        if seen[root]:
            continue
        front = np.zeros(m, bool)
        front[root] = True
        tree = front.copy()
        while front.any():
            front = near[front].any(0) & ~tree
            tree |= front
        label[tree] = root
        seen |= tree
    return [(int(ids[i]), int(ids[label[i]])) for i in range(m) if label[i] != i]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(percent: int):
    """Links of the groups (centre, i, j) that stand together in sorted batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, sets, found = None, [], [], [], []

        def close():
            if len(sets) > 1:
                found.extend(linked(sets, np.array(ids), np.array(sides), percent))

        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("centre", "i", "j")), strict=True))
            own, side = batch.column("rep").to_pylist(), batch.column("chunk").to_pylist()
            lists = batch.column("hashes")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for n, group in enumerate(groups):
                if group != key:
                    close()
                    key, ids, sides, sets = group, [], [], []
                ids.append(own[n])
                sides.append(side[n])
                sets.append(flat[ends[n]:ends[n + 1]].copy())
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=_LINK)
                found = []
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=_LINK)

    return run


def links(reps: DataFrame, docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(a, b): confirmed links that connect what is linked. reps(rep, bands), docs(doc_id, text)."""
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("m")).where("m > 1").drop("m")
    members = cut_lineage(buckets.join(centres, "bucket").select("centre", "rep").distinct(), "members")
    sizes = members.groupBy("centre").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    dealt = (members.join(sizes, "centre")
             .withColumn("chunk", F.pmod(F.xxhash64("rep", "centre"), F.col("chunks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .select("centre", "rep", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
    asked = small(members.select("rep").distinct())
    sets = (docs.select(F.col("doc_id").alias("rep"), "text").join(asked, "rep", "left_semi")
            .select("rep", _sets("text").alias("hashes")))
    met = (dealt.join(sets, "rep").repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j"))
    return met.mapInArrow(_verify(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; `kept` marks the smallest id of each component."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    drawn = cut_lineage(own.select("doc_id", _sketches("text").alias("s")).select("doc_id", "s.*"), "sketches")
    named = drawn.where("n > 0 and doc_id is not null")
    classes = cut_lineage(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    found = components(links(classes, own, percent))
    of_class = classes.join(found, classes["rep"] == found["node"], "left").select(
        "key", F.coalesce("component", "rep").alias("component"))
    out = drawn.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(of_class, "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
