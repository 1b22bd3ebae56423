"""Incremental rounds as streams: records, reads, queries and source figures.

Deduplication keeps the keys it has seen, as the batch rules never forget. With
`watermark` it forgets keys older than the bound; a later copy then counts as
new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import title_key
from ..operators.catalog import derive_paper_id, resolve_catalog
from ..operators.selection import streaks
from ..session import work_dir


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A parquet table of a folder as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*")
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all available data into files and read them back. With the folder of an earlier run it goes on from there."""
    spark = stream.sparkSession
    folder = folder or work_dir(spark, name)
    out, state = f"{folder}/rows", f"{folder}/state"
    if mode == "append":
        q = (stream.writeStream.format("parquet").option("checkpointLocation", state)
             .trigger(availableNow=True).start(out))
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            # The batch id names the folder, so a repeated batch replaces itself.
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


def stream_catalog(papers: DataFrame, folder: str | None = None) -> DataFrame:
    """Catalog over a stream of records.

    Each batch is logged under its id; the catalog is the batch resolution over
    the log, so late copies merge exactly as in one run. With the folder of an
    earlier run it goes on from there.
    """
    spark = papers.sparkSession
    folder = folder or work_dir(spark, "catalog-stream")
    out, state = f"{folder}/log", f"{folder}/state"

    def log(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    papers.writeStream.foreachBatch(log).option("checkpointLocation", state).trigger(
        availableNow=True).start().awaitTermination()
    return resolve_catalog(spark.read.schema(papers.schema).option("recursiveFileLookup", "true").parquet(out))


def read_once(papers: DataFrame, event_time: str | None = None, watermark: str | None = None) -> DataFrame:
    """Each paper the first time it arrives."""
    keyed = derive_paper_id(papers)
    if watermark:
        return keyed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["paper_id"])
    return keyed.dropDuplicates(["paper_id"])


def query_dedupe(queries: DataFrame) -> DataFrame:
    """Each query of a run the first time its key arrives."""
    return queries.withColumn("query_key", title_key("query")).where("query_key <> ''").dropDuplicates(["run_id", "query_key"])


def stagnation_table(rounds: DataFrame, limit: int = 3, folder: str | None = None) -> DataFrame:
    """Rounds in a row that added nothing, over all batches of a stream, read back from files.

    The rounds of a batch come in any order and are counted in order by bucketed
    running totals, so one run may hold most of them. What a run's last streak
    was is a table of one row for each run, written under the number of the batch;
    the next batch adds it to the rounds before the first that added something.
    A repeated batch starts from the table before it and replaces itself. Called
    again with the same folder, it goes on from where it stopped.
    """
    spark = rounds.sparkSession
    folder = folder or work_dir(spark, "stagnation")
    kind = rounds.schema["run_id"].dataType.simpleString()
    carried = f"run_id {kind}, carried bigint"

    def place(table: str, batch: int) -> str:
        return f"{folder}/{table}/batch={batch}"

    def step(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        before = own.read.schema(carried).parquet(place("carried", batch_id - 1)) if batch_id else own.createDataFrame([], carried)
        found = streaks(batch.select("run_id", "round", "added")).join(before, "run_id", "left")
        first = F.when(F.col("hits") == 0, F.coalesce("carried", F.lit(0))).otherwise(F.lit(0))
        told = found.select("run_id", "round", (F.col("stagnant") + first).alias("stagnant"))
        told.withColumn("stop", F.col("stagnant") >= limit).write.mode("overwrite").parquet(place("rows", batch_id))
        rows = own.read.schema("run_id " + kind + ", round bigint, stagnant bigint").parquet(place("rows", batch_id))
        last = rows.groupBy("run_id").agg(F.max_by("stagnant", "round").alias("carried"))
        last.unionByName(before.join(last.select("run_id"), "run_id", "left_anti")).write.mode("overwrite").parquet(place("carried", batch_id))

    rounds.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(f"run_id {kind}, round bigint, stagnant bigint, stop boolean").option(
        "recursiveFileLookup", "true").parquet(f"{folder}/rows")


def api_stats_stream(calls: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls, results and errors of each source and time window."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp"))
    return (timed.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "api").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.sum(F.when(F.col("error").isNull(), F.col("n_results")).otherwise(0)).alias("total_results"),
        F.count("error").alias("total_errors"))
        .select(F.col("w.start").alias("window_start"), "api", "total_queries", "total_results", "total_errors"))


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last state of each key in a table of updates."""
    rest = [c for c in updates.columns if c not in (*keys, "_batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")
