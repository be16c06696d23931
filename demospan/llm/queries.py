"""The operators bound to the test tables, a query each, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversation_repair, conversation_trie, decontaminate, exact_dedup, html_text, license_scan, line_dedup, packing, piece_bpe, quality_crf, simhash_dedup, sql, token_counts, url_filter
from .common import cut, table

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
PACK_TOKENIZER = "word_bpe_49k.json"
PIECES = UNIGRAM_PIECES = "piece_bpe_32k.model"


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page shows a document, whose id is the last number of its path; it is bad if that is of low quality."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"([0-9]{1,18})[^0-9]*$", 1)
    shown = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.when(number != "", number).cast("bigint").alias("shown"))
    marks = labels.select(F.col("doc_id").alias("shown"), (1 - F.col("quality")).alias("bad"))
    return shown.where("shown IS NOT NULL").join(marks, "shown").select("page_id", "bad")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return url_filter.judged(pages, page_labels(pages, labels), RULES)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.quality(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return met.drop("text_key")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACK_TOKENIZER)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_groups(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), UNIGRAM_PIECES)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_bpe.round_trip(table(spark, sf_dir, "documents"), PIECES)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(conversation_trie.turns_of(table(spark, sf_dir, "conversations")))
    return conversation_trie.trie(*conversation_trie.with_shared_openings(turns))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repaired(conversations, conversation_repair.damaged(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_quality_classifier, op3_decontamination, op4_license_scan, op5_best_fit_packing,
        op6_line_dedup, op7_exact_dedup, op8_token_counts, op9_simhash_dedup, op10_html_extraction, op11_piece_round_trip, op12_conversation_trie,
        op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {
    "op1_url_filter": sql.url_filter(RULES),
    "op3_decontamination": sql.decontamination(),
    "op7_exact_dedup": sql.exact_dedup(),
    "op12_conversation_trie": sql.conversation_trie(),
    "op13_conversation_repair": sql.conversation_repair(),
}

__all__ = ["ORACLES", "QUERIES"]
