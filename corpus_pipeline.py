"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.common import materialise, table
from voxlake.llm.near_dedup import near_duplicates
from voxlake.llm.packing import pack_documents
from voxlake.llm.quality_rules import quality_cascade
from voxlake.llm.queries import judge_quality
from voxlake.llm.substring_dedup import substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade keeps.  Null and short texts are rejected."""
    return quality_cascade(docs).where("kept").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier keeps; it is fitted on the labelled rows of the
    raw documents, as those that the rules have rejected are its examples of low quality."""
    judged = judge_quality(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near duplicates.  Rows without an id stay;
    rows that repeat both id and text are one document."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    firsts = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return firsts.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a smaller id holds.

    A document of which nothing is left stays, with an empty text."""
    found = substring_dedup(docs)
    lost = F.col("n_removed") > 0
    text = F.when(lost, F.col("kept_text")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the near-duplicate classes and the tokenizer; the tests
#: check each stage against a plain version.
ORACLE_SQL = None
