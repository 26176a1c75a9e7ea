"""Queries of the text problems over whole tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelica.functions.keys import table
from allelica.llm import abuse, leaks, tokens


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids stand for."""
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents")))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items that leaked into them and the extent of each passage."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


#: Calibrated probability from which a document is to be excluded.
EXCLUDE = 0.5


@lru_cache(maxsize=4)
def _model(application: str, d: str) -> abuse.Model | None:
    spark = SparkSession.active()
    return abuse.train(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score for every document. One model per application and folder serves the three queries."""
    return abuse.score_documents(table(spark, d, "documents"), table(spark, d, "doc_labels"), ["doc_id", "source"], _model(spark.sparkContext.applicationId, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where(F.col("score") >= EXCLUDE).select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, excluded documents and their rate per source."""
    bad = F.coalesce(F.col("score") >= EXCLUDE, F.lit(False)).cast("int")
    s = p8_scores(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(bad).alias("n_excluded"), F.avg("score").alias("mean_score"))
    return s.withColumn("rate", F.col("n_excluded") / F.col("n_docs"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_decoded, p7_found, p7_leaks, p8_found, p8_scores, p8_rates)}
SQL: dict[str, str] = {"p6_decoded": "select doc_id, coalesce(text, '') as text from documents"}
