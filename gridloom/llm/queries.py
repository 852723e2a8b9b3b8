"""Queries of problems 7 to 9 over the corpus, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.mixing import draw, mix_weights
from gridloom.llm.subjects import assign, train
from gridloom.llm.tokens import count_tokens, encode_corpus
from gridloom.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text."""
    return encode_corpus(_table(spark, sf_dir, "documents"), ["doc_id"])


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of ids of every text."""
    return count_tokens(_table(spark, sf_dir, "documents"), ["doc_id"])


def p8_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's rows with capacities and weights."""
    return mix_weights(count_tokens(_table(spark, sf_dir, "documents"), ["source"]), _table(spark, sf_dir, "mix_plan"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the plan whose source cannot reach its share."""
    return p8_weights(spark, sf_dir).filter("not reachable").select("mix_name", "source")


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document drawn for a mix, and how often."""
    sized = cut(count_tokens(_table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    return draw(sized, mix_weights(sized, _table(spark, sf_dir, "mix_plan")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached next to the targets."""
    sized = cut(count_tokens(_table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    weights = cut(mix_weights(sized, _table(spark, sf_dir, "mix_plan")))
    reached = draw(sized, weights).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_documents"), F.max("copies").alias("most_repeats"))
    out = weights.join(reached, ["mix_name", "source"], "left").fillna(0, ["drawn_tokens", "drawn_documents", "most_repeats"])
    return out.select("mix_name", "source", "target_share", F.try_divide("drawn_tokens", "total_tokens").alias("reached_share"), "weight", "normalised_weight", "exponent", "drawn_tokens", "drawn_documents", "most_repeats", "reachable")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas each document is about."""
    documents = _table(spark, sf_dir, "documents")
    subjects = sorted(r[0] for r in _table(spark, sf_dir, "subject_areas").select("subject").dropna().distinct().collect())  # a fixed list of ten
    return assign(documents, train(documents, _table(spark, sf_dir, "doc_labels"), subjects))


QUERIES = {f.__name__: f for f in (p7_ids, p7_counts, p8_found, p8_weights, p8_draws, p8_shares, p9_found)}
