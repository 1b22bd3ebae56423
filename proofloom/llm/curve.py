"""Shards along a Hilbert curve.

The metadata of a row (numbers, names) is quantised to `BITS` bits for each
dimension; the cell's index on the Hilbert curve orders the rows, so that
neighbours on the curve are close in every dimension and a shard, a run of the
curve, covers a narrow range of each: readers can skip shards by their ranges.
Within a cell rows stand by the checksum of their text and by id, so that equal
texts of a cell stay together.

Runs are cut by one of two laws: `rows` (counts at most one apart) or `bytes`
(a row belongs to the shard in which the middle of its bytes falls).

Sizes: a number's level is its binary logarithm, a name's the checksum modulo
the number of levels, a missing value's is 0. Null texts have no bytes and the
checksum of an empty text. Rows of equal id keep an order by text checksum.

Only narrow rows move: they are dealt by ranges of the whole order, written in
order, and a row's place is its place in its partition plus the sizes of the
partitions before, of which there are a few hundred at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of each dimension, so 2^BITS levels.
BITS = 4


def level_of_number(value: Column, bits: int = BITS) -> Column:
    """The binary logarithm of 1 + a number of at least 0, at most the last level."""
    # The length of the binary form is exact where a floating logarithm may not be.
    digits = F.length(F.bin(F.greatest(value.cast("long"), F.lit(0)) + 1)) - 1
    return F.coalesce(F.least(digits, F.lit(2**bits - 1)), F.lit(0)).cast("int")


def level_of_name(value: Column, bits: int = BITS) -> Column:
    return F.coalesce(F.crc32(value.cast("string")) % 2**bits, F.lit(0)).cast("int")


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell.

    From the highest bit on, each dimension either turns the first one's lower
    bits or swaps them with its own; what remains is a Gray code of the index,
    read across the dimensions, highest bit first.
    """
    n = len(levels)

    def turned(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - 1
        first, own = x[0], F.get(x, i)
        swap = F.when(own.bitwiseAND(q) != 0, F.lit(0)).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        turn = F.when(own.bitwiseAND(q) != 0, low).otherwise(F.lit(0))
        return F.transform(x, lambda v, j: F.when(j == 0, first.bitwiseXOR(swap).bitwiseXOR(turn))
                           .when(j == i, v.bitwiseXOR(swap)).otherwise(v))

    steps = F.array(*[F.struct(F.lit(2**b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    x = F.aggregate(steps, F.array(*levels), turned)
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def read(state: Column, place: Column) -> Column:
        """Index so far and its last bit; a Gray code's bit tells whether the bit changes."""
        bit = F.call_function("shiftright", F.get(state["x"], place["i"]), place["b"]).bitwiseAND(1).bitwiseXOR(state["last"])
        return F.struct(state["x"].alias("x"), bit.alias("last"), (state["h"] * 2 + bit).alias("h"))

    start = F.struct(x.alias("x"), F.lit(0).alias("last"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(places, start, read, lambda s: s["h"])


def shards(docs: DataFrame, levels: list[Column], n_shards: int, law: str = "rows", doc_id: str = "doc_id", text: str = "text",
           bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, law, shard, slot): every row in a run of the curve."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                         F.crc32(t).alias("text_crc32"), hilbert_index(levels, bits).alias("curve"))
    order = ["curve", "text_crc32", "doc_id"]
    # Ranges of the whole order: no cell, and no group of equal texts, needs to fit into one task.
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = cut_lineage(dealt, "curve")
    rows = rows.withColumn("part", F.shiftrightunsigned("at", 33))
    parts = rows.groupBy("part").agg(F.count("*").alias("part_n"), F.sum("size").alias("part_bytes"))
    before, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # One row for each partition.
    parts = F.broadcast(parts.select(
        "part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("part_n").over(whole).alias("all_n"), F.sum("part_bytes").over(whole).alias("all_bytes")))
    placed = rows.join(parts, "part").withColumn("place", F.col("n_before") + F.col("at").bitwiseAND(2**33 - 1))
    if law == "rows":
        placed = placed.withColumn("shard", F.expr(f"cast(place * {n_shards:d} div all_n as int)"))
        placed = placed.withColumn("first", F.expr(f"(shard * all_n + {n_shards - 1:d}) div {n_shards:d}"))
    else:
        placed = _by_bytes(placed, n_shards)
    return placed.select("doc_id", "size", "text_crc32", "curve", F.lit(law).alias("law"), "shard",
                         (F.col("place") - F.col("first")).alias("slot"))


def _by_bytes(placed: DataFrame, n_shards: int) -> DataFrame:
    """Shards by the middle of a row's bytes: sums of blocks of rows first, then of the rows of a block."""
    rows = placed.withColumn("block", F.shiftrightunsigned("at", 10))
    blocks = rows.groupBy("part", "block").agg(F.sum("size").alias("block_bytes"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("block_bytes").over(in_part), F.lit(0)).alias("block_before"))
    in_block = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("to_end", F.sum("size").over(in_block)).join(blocks, "block")
    middle = "(2 * (bytes_before + block_before + to_end) - size)"
    rows = rows.withColumn("shard", F.expr(f"cast(least({n_shards - 1:d}, {middle} * {n_shards:d} div (2 * all_bytes)) as int)"))
    firsts = F.broadcast(rows.groupBy("shard").agg(F.min("place").alias("first")))  # one row for each shard
    return rows.join(firsts, "shard")
