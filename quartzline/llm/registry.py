"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.llm import chat_trees, html_text, matroska, mixing, packing, pii, quality_rules, rule_ensemble, similarity_join, spelling, token_alignment, url_filter, warc
from quartzline.session import table


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.text_media(table(spark, sf_dir, "documents"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op3_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 as the pipeline runs it: terms of whole documents, marked wherever they occur."""
    return pii.span_digests(table(spark, sf_dir, "documents"), whole=True)


def op4_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.joined_components(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_trees.chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op9_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_matroska": op1_matroska,
        "op2_length_buckets": op2_length_buckets,
        "op3_disclosure": op3_disclosure,
        "op3_whole_documents": op3_whole_documents,
        "op4_water_filling": op4_water_filling,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_main_text": op6_main_text,
        "op7_rule_ensemble": op7_rule_ensemble,
        "op8_reply_trees": op8_reply_trees,
        "op9_url_trees": op9_url_trees,
        "op10_robust_outliers": op10_robust_outliers,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_warc_index": op12_warc_index,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_disclosure": pii.OP3_SQL, "op4_water_filling": mixing.OP4_SQL, "op5_jaccard_join": similarity_join.OP5_SQL, "op8_reply_trees": chat_trees.OP8_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_warc_index": warc.OP12_SQL}
