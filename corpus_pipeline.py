"""The corpus pipeline: documents pass a quality classifier, near-duplicate removal, sanitisation, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.llm import mixing, packing, pii, rule_ensemble, similarity_join
from quartzline.llm.joins import near
from quartzline.session import counted, rows, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores under 0.5 go.

    Null text counts as empty and is scored like any other; repeated rows go or stay together; empty input gives empty output. Rows with a null
    key or label teach nothing; without labels every document scores 0.5 and stays. Columns stay as they are, whatever their names.
    """
    model = rule_ensemble.learn(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays, in one row.

    Components are of ids. Where rows share an id, those of the components concerned are joined again as nodes of their own: texts that aren't
    linked all stay, of equal and linked ones the row of the smallest id, then text hash, does. Rows without words or without an id are
    linked with nothing and all stay; empty input gives empty output. Other columns stay as they are.
    """
    found = written(similarity_join.joined_components(docs), "components")
    twice = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "component_id").count().where("count > 1")
    mixed = counted(twice.select("component_id").distinct(), "mixed")
    gone = found.where(F.col("component_id") != F.col("doc_id"))
    if not rows(mixed):
        return near(docs, counted(gone.select("doc_id").distinct(), "gone"), "doc_id", "left_anti")
    again = counted(near(found, mixed, "component_id", "left_semi").select("doc_id").distinct(), "again")
    gone = counted(gone.select("doc_id").unionByName(again).distinct(), "gone")
    nodes = written(near(docs, again, "doc_id", "left_semi").select(F.monotonically_increasing_id().alias("node"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "nodes")
    texts = nodes.select("node", "row.doc_id", "row.text")
    own = similarity_join.joined_components(texts, "node").join(texts, "node")
    first = own.groupBy("component_id").agg(F.min(F.struct("doc_id", F.xxhash64("text"), "node")).alias("m")).select("m.node")
    stay = nodes.join(first, "node").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return near(docs, gone, "doc_id", "left_anti").unionByName(stay)


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced in the texts.

    Null texts and texts without either stay as they are, as do all other columns; repeated rows are rewritten alike; empty input gives empty output.
    """
    return pii.sanitised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the capped mix takes it, with its columns as they are.

    Null sources are one source. Null and empty texts have no words and fill no target. Rows that repeat an id are taken alike. Empty input gives empty output.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's bucket, batch and slot: one row per input row, repeated rows included; null texts have length 0. Empty input gives empty output."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", sanitisation),
    ("mixing", mixture),
    ("packing", packed),
]

#: Trained models and iterative components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
