"""The registered queries of the text problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import entity_match, leaks, name_variants, packing, quality


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.payments_of_listed(table(spark, sf_dir, "txn_event"), table(spark, sf_dir, "opensanctions_target"), table(spark, sf_dir, "un_entity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).select("entity_id", "un_id").distinct()


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = entity_match.match_lists(table(spark, sf_dir, "opensanctions_target"), table(spark, sf_dir, "un_entity"))
    return pairs.where(F.col("confidence") >= entity_match.MatchParams().threshold).drop("dated")


def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = entity_match.match_lists(table(spark, sf_dir, "opensanctions_target"), table(spark, sf_dir, "un_entity"))
    return entity_match.reliability(pairs.withColumnRenamed("un_id", "b_record"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")).distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p3_found, p3_matches, p3_reliability, p6_packing, p7_found, p8_found, p8_statistics)}


def oracle_sql() -> dict[str, str]:
    return {}
