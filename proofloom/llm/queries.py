"""Queries of the operators, one each, over whole tables, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilinear, collocations, curve, fractions, importance, licenses, neardup, pieces, profiles, ranking, repair, templates, toolcalls
from .common import fold, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query()
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pieces.round_trip(spark, F.col("text"), tokenizer_path()).alias("p")).select("doc_id", "p.*")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op2_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 10).alias("held_out"), "text")
    # The remainders 1 to 9 are the training documents; odd ones train in the first round, even ones in the second.
    return bilinear.language_model_scores(docs, "held_out", (fold("doc_id", 10) + 1) % bilinear.ROUNDS)


@query()
def op3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    ranker = ranking.train(docs, labels.where(~held_out("doc_id", 5)), "quality")
    scored = docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), ranking.score(ranker, F.col("text")).alias("score"))
    return scored.withColumn("predicted", ranking.predicted(F.col("score")))


@query(toolcalls.ORACLE)
def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return toolcalls.link(toolcalls.derived_calls(turns), toolcalls.derived_results(turns), toolcalls.TOOLS)


@query()
def op5_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    levels = [curve.level_of_name(F.col("source")), curve.level_of_name(F.col("lang")), curve.level_of_number(size)]
    return curve.shards(docs, levels, 8).withColumn("grown_shard", F.lit(None).cast("int"))


@query(licenses.ORACLE)
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


@query()
def op7_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fractions.edit_report(table(spark, sf_dir, "documents"))


@query()
def op8_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = profiles.learn(docs.where(~held_out("doc_id", 5)))
    found = docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), profiles.predict(known, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query()
def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # A fifth of the labelled rows stays out of the trusted texts, for tests.
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").where(~held_out("doc_id", 5))
    return importance.report(docs, importance.learn(docs, trusted))


@query()
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


@query(collocations.ORACLE)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(collocations.frequent(table(spark, sf_dir, "documents")), 2000)
