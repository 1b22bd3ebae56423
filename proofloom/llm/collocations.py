"""Phrases of two to four words whose parts seldom stand without each other, by dynamic itemset counting.

The corpus is dealt into shards that are scanned in turn, over and over. Words
are counted from the first scan. A longer phrase becomes active as soon as the
counts so far of both its subphrases (all words but the last, all but the
first) have reached the threshold, is counted from the next scan on, and is
complete after one full cycle. So phrases of all lengths are counted in the same
scans, mostly in fewer than one cycle for each length, and every count is that
of the whole corpus.

Texts are split once: blocks of some megabytes of a language and a shard are
written as their distinct words, the hashes of these and the numbers of all words. One scan is a
Spark job. Tasks count phrases as numbers and deal them into buckets by hash; Spark brings the
packed counts of a bucket together, where a task adds them up and merges them with those of earlier
scans. The number of buckets grows with the corpus, so a bucket stays small. What has reached the threshold comes to
the tasks as an array of hash cells for each length, of a fixed size, which holds
the last scan after which a phrase of the cell reached it. Phrases that share a
cell can only lengthen the time of counting: anything counted at all is counted
for one full cycle from its first scan, and what comes after is not added.
Complete phrases below the threshold are forgotten.

Null texts are empty, a null language counts as `und`, repeated rows count each,
extra columns are not read. An empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, work_dir
from .common import remove
from .shingles import mix

#: Shards of the corpus, words of the longest phrase, occurrences of a frequent one.
SHARDS, LONGEST, LEAST = 4, 4, 30
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
COVERED = 80
#: Cells of a length, as a power of two. More frequent phrases than cells cost time, not counts.
BITS = 22
#: Bytes of text that a task counts together.
TOGETHER = 8_000_000
#: Bytes of text for each bucket of phrases; phrases that a task deals out together, or packs into a row.
BUCKET, PACKED = 16_000_000, 400_000

_CUT = b"\xff"  # no byte of UTF-8
_FOLD = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", _CUT * 10 + b" ")
#: Stands between a language and a phrase; no word holds it.
_LEAD = b"\n"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    lead = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(lead + w) for w in words), np.uint64, len(words))


def longer_hash(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases that are continued by a word."""
    return mix(hashes * _ODD + word)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def parts(text: bytes, limit: int) -> Iterator[bytes]:
    """Lower-case text with marked cuts, in parts of about `limit` bytes that end at a cut."""
    folded = text.lower().translate(_FOLD)
    start = 0
    while len(folded) - start > limit:
        end = folded.find(_CUT, start + limit)
        if end < 0:
            break
        yield folded[start:end]
        start = end
    yield folded[start:]


def numbered(folded: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, the mark of a cut among them, and all words as numbers of these."""
    tokens = _CUT.join(folded).replace(_CUT, b" " + _CUT + b" ").split()
    number = dict(zip(dict.fromkeys(tokens), range(len(tokens)), strict=False))
    return list(number), np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))


def _blocks(shards: int, together: int):
    """(lang, shard, bytes, words, hashes, ids) blocks: texts of a language and a shard as numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[bytes]] = {}
        size = row = 0

        def flush():
            for (lang, shard), folded in held.items():
                words, ids = numbered(folded)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                         for x, kind in ((words, pa.binary()), (word_hashes(lang, words).view(np.int64), pa.int64()), (ids, pa.int32()))]
                sizes = pa.array([sum(map(len, folded))], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([shard], pa.int32()), sizes, *lists],
                                                 ["lang", "shard", "bytes", "words", "hashes", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                row += 1
                for part in parts(text.as_py() or b"", together):
                    held.setdefault((lang, row % shards), []).append(part)
                    size += len(part)
                    if size >= shards * together:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    return run


def count(lang: str, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, scan: int, reached: list[np.ndarray], shards: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of what is active in this scan; the language and a line end stand before a phrase.

    An empty phrase stands for the number of all words. `reached[n - 1][cell]`: 1 + the last scan after which a phrase of
    n words in that cell reached the threshold, else 0.
    """
    return ((phrases, counts) for phrases, counts, _ in _counted(lang, words, hashes, ids, scan, reached, shards))


def _counted(lang: str, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, scan: int, reached: list[np.ndarray], shards: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(phrases, counts, hashes) as in `count`."""
    lead = lang.encode() + _LEAD
    cut = pc.index(words, _CUT).as_py()
    opening = pc.binary_join_element_wise(pa.scalar(lead), words, pa.scalar(b""))
    if scan < shards:
        n = np.bincount(ids, minlength=len(words))
        if cut >= 0:
            n[cut] = 0
        met = np.flatnonzero(n)
        yield pa.array([lead], pa.binary()), np.array([n.sum()]), np.zeros(1, np.uint64)
        yield opening.take(pa.array(met)), n[met], hashes[met]
    if not any(r.any() for r in reached):
        return
    last = reached[0][cell(hashes)]
    if cut >= 0:
        last[cut] = 0
    grown, found = None, last[ids]  # of the phrase of n words that starts at each place
    for n in range(2, len(reached) + 2):
        # Both subphrases of n - 1 words reached the threshold, the later one less than a cycle ago.
        both = (found[:-1] > 0) & (found[1:] > 0)
        active = np.flatnonzero(both & (np.maximum(found[:-1], found[1:]) >= scan - shards + 1))
        if len(active):
            yield _distinct(ids, active, n, words, opening, hashes)
        if n > len(reached) or not both.any():
            return
        at = np.flatnonzero(both)
        hashed = longer_hash(hashes[ids[at]] if grown is None else grown[at], hashes[ids[at + n - 1]])
        grown = np.zeros(len(both), np.uint64)
        grown[at] = hashed
        found = np.zeros(len(both), np.uint8)
        found[at] = reached[n - 1][cell(hashed)]


def _distinct(ids: np.ndarray, at: np.ndarray, n: int, words: pa.Array, opening: pa.Array,
              hashes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct phrases of n words at some places, how often each stands there, and their hashes."""
    number = ids[at]
    for i in range(1, n):
        number = pa.array(number.astype(np.int64) * len(words) + ids[at + i]).dictionary_encode().indices.to_numpy()
    counts = np.bincount(number)
    places = np.empty(len(counts), np.int64)
    places[number] = at
    columns = [(words if i else opening).take(pa.array(ids[places + i])) for i in range(n)]
    hashed = hashes[ids[places]]
    for i in range(1, n):
        hashed = longer_hash(hashed, hashes[ids[places + i]])
    return pc.binary_join_element_wise(*columns, pa.scalar(b" ")), counts, hashed


#: Phrases with their counts in one scan; with their counts so far and the scan that met them first.
_FRESH = pa.schema([("phrase", pa.binary()), ("fresh", pa.int64())])
_TOTALS = pa.schema([("phrase", pa.binary()), ("total", pa.int64()), ("first", pa.int32())])


def pack(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack(packed: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def _packed_rows(bucket, old: bool, packed: list[bytes], cells: list[list[int]] | None = None) -> pa.RecordBatch:
    columns = [pa.array(bucket).cast(pa.int32()), pa.array([old] * len(packed)), pa.array(packed, pa.binary())]
    more = [] if cells is None else [pa.array(cells, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns + more, ["bucket", "old", "packed", "cells"][:3 + len(more)])


def _scanner(scan: int, sent, shards: int, buckets: int):
    """(bucket, old, packed): the counts of a scan, dealt into buckets by hash."""
    def dealt(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket = np.concatenate([h for _, _, h in held]) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays([p for p, _, _ in held]), pa.array(np.concatenate([c for _, c, _ in held]))],
                                          schema=_FRESH).take(pa.array(order))
        own, starts = np.unique(bucket[order], return_index=True)
        packed = [pack(rows.slice(a, b - a)) for a, b in pairwise([*starts.tolist(), len(order)])]
        return _packed_rows(own, False, packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, held, size = sent.value, [], 0
        for batch in batches:
            for lang, words, hashes, ids in zip(*batch.columns, strict=True):
                own = hashes.values.to_numpy().view(np.uint64), ids.values.to_numpy()
                for found in _counted(lang.as_py(), words.values, *own, scan, reached, shards):
                    held.append(found)
                    size += len(found[1])
                    if size >= PACKED:
                        yield dealt(held)
                        held, size = [], 0
        if size:
            yield dealt(held)

    return run


def merged(old: pa.Table, fresh: pa.Table, scan: int, shards: int, least: int) -> tuple[pa.RecordBatch, pa.Array]:
    """The counts so far after a scan, without complete phrases below the threshold; the phrases that reached it in this scan.

    A phrase stands once in `old`, any number of times in `fresh`.
    """
    every = pa.chunked_array([*old.column(0).chunks, *fresh.column(0).chunks], pa.binary()).combine_chunks().dictionary_encode()
    phrases, number = every.dictionary, every.indices.to_numpy()
    # Numbers are given in order, so those of `old` come first.
    before, first = np.zeros(len(phrases), np.int64), np.full(len(phrases), scan, np.int32)
    before[:len(old)], first[:len(old)] = old.column(1).to_numpy(), old.column(2).to_numpy()
    total = before.copy()
    np.add.at(total, number[len(old):], fresh.column(1).to_numpy())
    total = np.where(first + shards > scan, total, before)
    ends = pc.ends_with(phrases, _LEAD).to_numpy(zero_copy_only=False)
    kept = (first + shards - 1 > scan) | (total >= least) | ends
    newly = (before < least) & (total >= least) & ~ends
    rows = pa.RecordBatch.from_arrays([phrases, pa.array(total), pa.array(first)], schema=_TOTALS)
    return rows.filter(pa.array(kept)), phrases.filter(pa.array(newly))


def _merger(scan: int, shards: int, least: int, longest: int):
    """(bucket, old, packed, cells): the counts so far, and the cells of the phrases that reached the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[pa.RecordBatch], list[pa.RecordBatch]]] = {}
        for batch in batches:
            for bucket, old, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.setdefault(bucket, ([], []))[not old].append(unpack(packed))
        for bucket in list(held):
            old, fresh = held.pop(bucket)
            rows, newly = merged(pa.Table.from_batches(old, _TOTALS), pa.Table.from_batches(fresh, _FRESH), scan, shards, least)
            found = cells(newly, longest)
            for start in range(0, len(rows), PACKED):
                yield _packed_rows([bucket], True, [pack(rows.slice(start, PACKED))], [[] if start else found])

    return run


def cells(phrases: pa.Array, longest: int) -> list[int]:
    """Distinct cells of phrases that may grow: (words - 1) * 2 ** BITS + cell."""
    found = set()
    for own in phrases.to_pylist():
        lang, _, phrase = own.rpartition(_LEAD)
        words = phrase.split(b" ")
        if len(words) < longest:
            hashes = word_hashes(lang.decode(), words)
            grown = hashes[:1]
            for i in range(1, len(hashes)):
                grown = longer_hash(grown, hashes[i:i + 1])
            found.add(((len(words) - 1) << BITS) + int(cell(grown)[0]))
    return sorted(found)


def _frequent_rows(least: int):
    """(phrase, total) of the phrases that reached the threshold, and the numbers of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                rows = unpack(packed)
                rows = rows.filter(pc.or_(pc.greater_equal(rows.column(1), least), pc.ends_with(rows.column(0), _LEAD)))
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.string()), rows.column(1)], ["phrase", "total"])

    return run


def _distinct_in(*columns: str) -> dict[str, str]:
    """Options of a Parquet file whose columns have few equal values, so that no dictionary is tried."""
    return {f"parquet.enable.dictionary#{c}": "false" for c in columns}


_PACKED = "bucket int, old boolean, packed binary"


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, together: int = TOGETHER,
             text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, words, phrase, total) of all phrases up to `longest` words that stand `least` times; words 0: all words of the language."""
    spark = docs.sparkSession
    dealt = work_dir(spark, "shards")
    block = "lang string, shard int, bytes bigint, words array<binary>, hashes array<bigint>, ids array<int>"
    (docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
     .mapInArrow(_blocks(shards, together), block).write.partitionBy("shard").options(**_distinct_in("words.list.element", "hashes.list.element")).parquet(dealt))
    corpus = spark.read.schema(block).parquet(dealt)
    size = corpus.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, size // BUCKET + 1)
    reached = [np.zeros(1 << BITS, np.uint8) for _ in range(longest - 1)]
    state, scan, latest, schema = None, 0, -1, f"{_PACKED}, cells array<bigint>"
    while scan < shards or scan <= latest + shards:
        sent = spark.sparkContext.broadcast(reached)
        rows = corpus.where(F.col("shard") == scan % shards).select("lang", "words", "hashes", "ids").mapInArrow(
            _scanner(scan, sent, shards, buckets), _PACKED)
        if state:
            rows = rows.unionByName(spark.read.schema(schema).parquet(state).drop("cells"))
        path = work_dir(spark, "counts")
        (rows.repartitionById(buckets, "bucket").mapInArrow(_merger(scan, shards, least, longest), schema)
         .write.options(compression="none", **_distinct_in("packed")).parquet(path))
        if state:
            remove(spark, state)
        state = path
        sent.destroy()
        # At most one row for each cell.
        hit = spark.read.schema(schema).parquet(state).select(F.explode("cells").alias("cell")).distinct().toArrow()
        if len(hit):
            latest = scan
            found = hit.column("cell").to_numpy()
            for n in range(1, longest):
                reached[n - 1][found[found >> BITS == n - 1] & ((1 << BITS) - 1)] = scan + 1
        scan += 1
    remove(spark, dealt)
    counted = spark.read.schema(schema).parquet(state).select("packed").mapInArrow(_frequent_rows(least), "phrase string, total long")
    own = F.substring_index("phrase", _LEAD.decode(), -1)
    words = F.when(own == "", 0).otherwise(F.length(own) - F.length(F.translate(own, " ", "")) + 1)
    of = F.substring("phrase", F.lit(1), F.length("phrase") - F.length(own) - 1)
    counted = cut_lineage(counted.select(of.alias("lang"), words.alias("words"), own.alias("phrase"), "total"), "frequent")
    remove(spark, state)
    return counted


def _run(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(counted: DataFrame, top: int, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases. counted: as from `frequent`."""
    words = F.split("phrase", " ")
    phrases = counted.where("words > 0")
    candidates = phrases.where("words > 1").select("lang", "words", "phrase", F.col("total").alias("a"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _run(words, F.lit(1), F.col("k")).alias("head"),
                       _run(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    side = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("total").alias(count))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr("cast(2000000 as decimal(38, 0)) * a div (cast(l as decimal(20, 0)) + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Runs of two words and more inside longer candidates, with the most occurrences of one that holds them.
    spans = [(n, size, start) for n in range(3, LONGEST + 1) for size in range(2, n) for start in range(1, n - size + 2)]
    inner = F.filter(F.array(*[F.when(F.col("words") == n, _run(words, F.lit(start), F.lit(size))) for n, size, start in spans]),
                     lambda x: x.isNotNull())
    around = (candidates.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("outer")))
    left = lowest.join(around, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (100 * F.col("outer") < covered * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase").asc())
    first = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.where("words = 0").select("lang", F.col("total").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


#: DuckDB; all phrases are counted at once.
ORACLE = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces),
sized as (select lang, words, unnest(range(1, 5)) as size from worded),
places as (select lang, words, size, unnest(range(1, len(words) - size + 2)) as start from sized where len(words) >= size),
counted as (select lang, size, array_to_string(words[start:start + size - 1], ' ') as phrase, count(*) as f from places group by all),
totals as (select lang, sum(f)::bigint as n from counted where size = 1 group by lang),
often as (select * from counted where f >= 30),
candidates as (select lang, size, phrase, f as a, string_split(phrase, ' ') as words from often where size > 1),
cuts as (select lang, size, phrase, a, words, unnest(range(1, size)) as k from candidates),
scored as (
    select c.lang, c.phrase, c.a, c.k, h.f as l, t.f as r, (2000000::hugeint * c.a) // (h.f + t.f) as score
    from cuts c
    join often h on h.lang = c.lang and h.phrase = array_to_string(c.words[1:c.k], ' ')
    join often t on t.lang = c.lang and t.phrase = array_to_string(c.words[c.k + 1:c.size], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
runs as (
    select lang, a, words, size, unnest(range(2, size)) as m from candidates where size > 2),
around as (
    select lang, array_to_string(words[s:s + m - 1], ' ') as phrase, max(a) as outer_a
    from (select *, unnest(range(1, size - m + 2)) as s from runs) group by all),
kept as (
    select w.* from lowest w left join around o on o.lang = w.lang and o.phrase = w.phrase
    where o.outer_a is null or 100 * o.outer_a < 80 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::bigint as score
from ranked r join totals t on t.lang = r.lang where r.rank <= 2000
"""
