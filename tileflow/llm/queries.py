"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tileflow.llm import basket_itemsets, conversation_repair, cost_packing, embedding_duplicates, html_text, language_id, mixing, near_duplicates, packing, quality_classifier, quality_rules, secrets, sharding
from tileflow.llm.scratch import small_batches, tables


def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(tables(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates.near_duplicate_report(tables(spark, sf_dir, "documents"))


def op3_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packing_report(tables(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id.language_report(tables(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_text.page_report(tables(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.secret_report(tables(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(tables(spark, sf_dir, "documents"))


def op8_lattice_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return embedding_duplicates.embedding_report(tables(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(tables(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_classifier.quality_scores(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return conversation_repair.repair_report(tables(spark, sf_dir, "conversations"))


def op12_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return cost_packing.cost_packing_report(tables(spark, sf_dir, "documents"))


def op13_basket_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket_itemsets.itemset_report(tables(spark, sf_dir, "sale_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_histogram_sharding, op2_order_minhash, op3_residual_packing, op4_language_id, op5_html_extraction, op6_secret_scan, op7_quality_rules, op8_lattice_embeddings, op9_source_mixing, op10_quality_classifier, op11_conversation_repair, op12_cost_packing, op13_basket_itemsets)}


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules.ORACLE_SQL, "op9_source_mixing": mixing.ORACLE_SQL, "op11_conversation_repair": conversation_repair.ORACLE_SQL, "op13_basket_itemsets": basket_itemsets.ORACLE_SQL}
