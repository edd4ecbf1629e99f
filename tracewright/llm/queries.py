"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import kd_clusters, lexical_search, quality_rules, url_filter
from tracewright.llm import mixing as mixing_
from tracewright.llm.common import id_remainder, read_table
from tracewright.llm.exact_dedup import find_duplicates
from tracewright.llm.html_extract import extract_main_text
from tracewright.llm.language_id import identify_language
from tracewright.llm.packing import pack_documents
from tracewright.llm.quality_classifier import score_quality
from tracewright.llm.simhash import hex_of, near_duplicates
from tracewright.llm.suffix_dedup import find_repeats
from tracewright.llm.token_output import write_token_ids


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 4) == 2
    docs = read_table(spark, sf_dir, "documents")
    found = identify_language(docs, learn_from=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_duplicates(read_table(spark, sf_dir, "documents"), in_place=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 3) == 1
    found = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), learn_from=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_token_ids(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_.mix(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), url_filter.QUERY_RULES)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(read_table(spark, sf_dir, "documents"), keep="none", in_place=True)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.cluster(read_table(spark, sf_dir, "embeddings"))


OP5_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id is not distinct from max(doc_id) over g as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_html_extraction,
        op2_language_id,
        op3_quality_rules,
        op4_best_fit_packing,
        op5_exact_dedup,
        op6_simhash,
        op7_quality_classifier,
        op8_token_output,
        op9_mixing,
        op10_url_filter,
        op11_lexical_search,
        op12_suffix_dedup,
        op13_centroid_clustering,
    )
    return {op.__name__: op for op in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.oracle_sql(),
        "op5_exact_dedup": OP5_SQL,
        "op9_mixing": mixing_.ORACLE_SQL,
        "op10_url_filter": url_filter.ORACLE_SQL,
        "op11_lexical_search": lexical_search.oracle_sql(),
        "op13_centroid_clustering": kd_clusters.oracle_sql(),
    }
