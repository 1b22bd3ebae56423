"""Running totals and row numbers over groups of any size.

A plain window puts a whole group into one task. These helpers cut each group
into buckets of the order column, total the buckets, and add the total of the
earlier buckets to a window that only spans one bucket. The order column is a
unique integer, so a bucket never holds more than `bucket_rows` rows of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

BUCKET_ROWS = 1_000_000


def running_totals(df: DataFrame, keys: Sequence[str], order: str,
                   totals: Mapping[str, Column],
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add inclusive running sums of `totals` per `keys` in `order`."""
    keys = list(keys)
    cut = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket_rows)))
    for name, value in totals.items():
        cut = cut.withColumn(f"_v_{name}", value)
    sums = cut.groupBy(*keys, "_bucket").agg(
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in totals])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0).cast("int")).alias(f"_o_{name}")
        for name in totals])
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0)
    joined = cut.join(offsets, [*keys, "_bucket"])
    for name in totals:
        joined = joined.withColumn(
            name, F.col(f"_o_{name}") + F.sum(f"_v_{name}").over(within))
    drops = ["_bucket"]
    for name in totals:
        drops += [f"_v_{name}", f"_o_{name}"]
    return joined.drop(*drops)


def number_rows(df: DataFrame, keys: Sequence[str], order: str, name: str = "n",
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number the rows of each group 1..n in `order`."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, bucket_rows)


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Keep the first row of each key. Aggregates before the shuffle, so a key
    that holds most of the rows costs one row per map task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_n_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """Keep the first n rows of each key; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= n).drop("_rank"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a unique order, without sorting all rows in one place.

    Rows are dealt into ranges of the order and the ranges are counted; only the
    range that holds the n-th row is numbered.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = 0
    for r in sorted(dealt.groupBy("_range").count().collect()):  # one row for each shuffle partition
        if before + r["count"] > n:
            number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
            cut = dealt.where(F.col("_range") == r["_range"]).withColumn("_n", number).where(F.col("_n") <= n - before)
            return dealt.where(F.col("_range") < r["_range"]).unionByName(cut.drop("_n")).drop("_range")
        before += r["count"]
    return dealt.drop("_range")


def trailing_rows(df: DataFrame, keys: Sequence[str], order: str, back: int,
                  value: Column, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The `value` of the `back` rows before each row, oldest first.

    Rows are numbered, cut into buckets, and the last rows of a bucket are
    copied into the next one, so no window spans a whole group.
    """
    if bucket_rows <= back:
        raise ValueError("a bucket must hold more rows than the frame looks back")
    keys = list(keys)
    numbered = number_rows(df, keys, order, "_n", bucket_rows).withColumn("_value", value)
    own = F.floor((F.col("_n") - 1) / F.lit(bucket_rows))
    closing = (F.col("_n") - 1) % bucket_rows >= bucket_rows - back
    spread = numbered.withColumn("_own", own).withColumn(
        "_part", F.explode(F.when(closing, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(*keys, "_part").orderBy("_n").rowsBetween(-back, -1)
    return (spread.withColumn(name, F.collect_list("_value").over(frame))
            .where(F.col("_part") == F.col("_own")).drop("_n", "_value", "_own", "_part"))


def pack_batches(df: DataFrame, key: str, order: str, size: str, budget: int,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Greedy packing in order: a batch closes when the next row would exceed
    the budget. Adds `batch`, counted from 0.
    """
    return df.join(batch_labels(df, key, order, size, budget, bucket_rows), [key, order])


def batch_labels(df: DataFrame, key: str, order: str, size: str, budget: int,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The batch of each row, by key and order.

    What a bucket does depends only on the length carried into it, and only the
    place of its first closed batch matters. Each bucket reports that mapping
    (at most `budget` entries); the mappings are chained per key; then each
    bucket numbers its rows from its own carry.
    """
    import numpy as np
    import pandas as pd

    cut = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket_rows)))
    kind = df.schema[key].dataType.simpleString()
    # A group costs Python a fixed time, however few bytes it has.
    rows = spread(cut.select(F.col(key).alias("k"), F.col("_bucket").alias("b"),
                             F.col(order).alias("o"), F.col(size).cast("bigint").alias("n")), "k", "b")

    def next_starts(total):
        """Start of the batch after the one that starts at each row."""
        ends = np.searchsorted(total[1:], total[:-1] + budget, side="right")
        return np.maximum(ends, np.arange(len(total) - 1) + 1)

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        total = np.concatenate([[0], pdf["n"].to_numpy().cumsum()])
        m = len(pdf)
        nxt = next_starts(total)
        last, opened = np.arange(m), np.ones(m, dtype="int64")
        for i in range(m - 1, -1, -1):
            if nxt[i] < m:
                last[i], opened[i] = last[nxt[i]], opened[nxt[i]] + 1
        reach = np.unique(total[1:][total[:-1] <= budget], return_index=True)
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "b": [pdf["b"].iloc[0]], "size": [total[-1]],
                             "limit": [reach[0].tolist()], "carry": [(total[-1] - total[last[reach[1]]]).tolist()],
                             "opened": [opened[reach[1]].tolist()]})

    maps = rows.groupBy("k", "b").applyInPandas(
        describe, f"k {kind}, b bigint, size bigint, limit array<bigint>, carry array<bigint>, opened array<bigint>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        carry, batch, out = None, -1, []
        for r in pdf.itertuples():
            out.append((r.k, r.b, -1 if carry is None else carry, batch))
            # With nothing carried in, the first row opens a batch in any case.
            at = 0 if carry is None else int(np.searchsorted(r.limit, budget - carry, side="right"))
            if at == len(r.limit):
                carry += r.size
            else:
                carry, batch = r.carry[at], batch + r.opened[at]
        return pd.DataFrame(out, columns=["k", "b", "carry", "batch"])

    entry = spread(maps, "k").groupBy("k").applyInPandas(chain, f"k {kind}, b bigint, carry bigint, batch bigint")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        total = np.concatenate([[0], pdf["n"].to_numpy().cumsum()])
        m, carry, batch = len(pdf), pdf["carry"].iloc[0], pdf["batch"].iloc[0]
        nxt = next_starts(total)
        start = 0 if carry < 0 else int(np.searchsorted(total[1:], budget - carry, side="right"))
        label = np.full(m, batch, dtype="int64")
        while start < m:
            batch += 1
            label[start:nxt[start]] = batch
            start = nxt[start]
        return pd.DataFrame({"k": pdf["k"], "o": pdf["o"], "batch": label})

    labels = rows.join(entry, ["k", "b"]).groupBy("k", "b").applyInPandas(
        number, f"k {kind}, o bigint, batch bigint")
    return labels.select(F.col("k").alias(key), F.col("o").alias(order), "batch")
