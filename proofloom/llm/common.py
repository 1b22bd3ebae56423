"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.Array], rows: int = 1000) -> Iterator[pa.Array]:
    """Arrow batches cut smaller, so that a task holds few texts as Python objects."""
    for batch in batches:
        yield from (batch.slice(start, rows) for start in range(0, len(batch), rows))


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def held_out(doc_id: str, n: int) -> Column:
    return fold(doc_id, n) == 0


#: Rows of a few numbers that are sent to all executors at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast if a count shows that it is small; else it is joined by shuffling.

    The table is written to the shared folder first, so that it is worked out once.
    """
    df = cut_lineage(df, "small")
    return F.broadcast(df) if df.count() <= rows else df


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of an intermediate table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
