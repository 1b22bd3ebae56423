"""A corpus pipeline of the operators in proofloom.llm.

Five stages, each over all rows that the one before kept. Columns of the
documents, also extra ones, pass through all stages but the last. Rows without
id have no copies and no contamination; rows without text leave at the language
stage at the latest. Of rows that repeat an id, that of the smallest checksum stays.
Stages that send texts through Python lower the session's rows of an Arrow batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import neardup, pieces, profiles, ranking, templates
from proofloom.llm.common import held_out, small, table
from proofloom.llm.queries import tokenizer_path
from proofloom.session import small_batches, work_dir

#: Language scores below this belong to texts that look like none of the learned languages.
LEAST_LANGUAGE = 0.2


def _where(docs: DataFrame, value: Column, keep) -> DataFrame:
    """Rows for which keep(value) holds; the value is worked out once, under a name that no column has."""
    name = "_" + max(docs.columns, key=len)
    return docs.withColumn(name, value).where(keep(F.col(name))).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by pairwise ranking."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out("doc_id", 5))
    ranker = ranking.train(docs, labels, "quality")
    return _where(docs, ranking.score(ranker, F.col("text")), lambda score: ranking.predicted(score) == 1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a text in one of the learned languages."""
    small_batches(spark)
    known = profiles.learn(docs.where(~held_out("doc_id", 5)))
    return _where(docs, profiles.predict(known, F.col("text")),
                  lambda p: (p["lang"] != profiles.UNKNOWN) & (p["score"] >= LEAST_LANGUAGE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    small_batches(spark)
    found = neardup.near_duplicates(docs)
    kept = docs.join(small(found.where("not kept").select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return kept
    # The row of the smallest checksum, whatever the order of rows.
    own = F.struct(*docs.columns)
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.to_json(own))
    one = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(own, order).alias("row"))
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(one.select("row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = templates.contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(small(found.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as ids of the piece vocabulary, and the text that these ids decode to."""
    small_batches(spark)
    both = docs.select("doc_id", pieces.round_trip(spark, F.col("text"), tokenizer_path()).alias("p"))
    return both.select("doc_id", F.size("p.ids").cast("long").alias("n_tokens"), "p.ids", "p.decoded")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pieces", encoded),
]

#: No SQL expresses the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written to the shared folder, where the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
