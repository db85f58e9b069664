"""The training-data queries, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from voxlake.llm.ann import nearest_neighbours
from voxlake.llm.bpe import bpe_encode
from voxlake.llm.common import table
from voxlake.llm.conversations import QUERY_SQL as REPAIR_SQL
from voxlake.llm.conversations import damage, repair_summaries
from voxlake.llm.html_extract import extract_text
from voxlake.llm.near_dedup import near_duplicates
from voxlake.llm.packing import pack_documents
from voxlake.llm.pii import find_private, fit_from_table, labelled_table
from voxlake.llm.quality_classifier import fit_quality, grade, score_quality
from voxlake.llm.quality_rules import QUERY_SQL as RULES_SQL
from voxlake.llm.quality_rules import quality_cascade
from voxlake.llm.substring_dedup import substring_dedup
from voxlake.llm.url_filter import filter_urls, word_counts
from voxlake.llm.vector_codes import codes_sql, compress_vectors
from voxlake.llm.warc import archive_pages


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_bpe_chunk_reuse(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


def op10_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text")


def judge_quality(docs: DataFrame, fit_on: DataFrame, labels: DataFrame) -> DataFrame:
    """Score ``docs`` by a model fitted on the labelled rows of ``fit_on``; add ``kept``: the
    probability of the best grade reaches the model's cut, and low quality isn't likelier than not."""
    graded = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = fit_quality(fit_on, graded)
    return score_quality(docs, model).withColumn("kept", (F.col("tail_2") >= model.cut) & (F.col("tail_1") >= 0.5))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, docs, table(spark, sf_dir, "labels")).drop("text")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, word_counts(pages, longest=None))


def op4_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_text_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")


def op7_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", F.col("range").alias("index_range"), F.col("place").alias("index_place"))


def op11_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_private(docs, fit_from_table(labelled_table(spark)), digests=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summaries(damage(table(spark, sf_dir, "conversations")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {
    "op11_private_spans": op11_private_spans,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
    "op7_warc_index_merge": op7_warc_index_merge,
    "op8_text_to_tag": op8_text_to_tag,
    "op4_adaptive_scan": op4_adaptive_scan,
    "op1_url_filter": op1_url_filter,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op6_quality_rules": op6_quality_rules,
    "op10_prob_min_hash": op10_prob_min_hash,
    "op5_bpe_chunk_reuse": op5_bpe_chunk_reuse,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": RULES_SQL.format(source="documents"),
    "op12_conversation_repair": REPAIR_SQL,
    "op13_vector_codes": codes_sql(),
}
