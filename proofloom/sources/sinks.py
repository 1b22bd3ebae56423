"""Partitioned writes that may be repeated.

A batch is written to a staging folder and then renamed to the folder of its
id, which is the mark that it is complete. A batch whose folder is there already
is not written again, so a repeated call, or a job that was started anew after
a loss, changes nothing. Readers see whole batches only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def batch_folder(folder: str, batch: str | int) -> str:
    return f"{folder}/batch={batch}"


def is_written(spark: SparkSession, folder: str, batch: str | int) -> bool:
    place, files = _files(spark, batch_folder(folder, batch))
    return files.exists(place)


def write_once(rows: DataFrame, folder: str, batch: str | int, *by: str) -> bool:
    """Write a batch, partitioned by columns; false if it was there before."""
    spark = rows.sparkSession
    target, files = _files(spark, batch_folder(folder, batch))
    if files.exists(target):
        return False
    staged = f"{folder}/_staging/{batch}-{uuid.uuid4().hex[:12]}"
    rows.write.partitionBy(*by).parquet(staged)
    # Of two writers one rename succeeds; the other one's rows are the same and are dropped.
    place, _ = _files(spark, staged)
    if files.exists(target) or not files.rename(place, target):
        files.delete(place, True)
        if not files.exists(target):
            raise OSError(f"{staged} could not become {target}")
        return False
    return True


def read_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of all complete batches in the columns of `schema`."""
    place, files = _files(spark, folder)
    names = [s.getPath().toString() for s in files.listStatus(place) if s.getPath().getName().startswith("batch=")] if files.exists(place) else []
    if not names:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(n).select(schema.names) for n in sorted(names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
