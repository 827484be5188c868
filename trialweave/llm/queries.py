"""Registered queries of the operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hard_negatives, lexical_search, ngram_join, pieces, pii, quality_classifier, quality_rules, secret_scan, substring_dedup, suffix_dedup, warc
from .exchange import read_table

VOCABULARY = "piece_bpe_32k.model"  # of the installed public vocabularies


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, _ = warc.write_archives(read_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_check(read_table(spark, sf_dir, "conversations")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_ngram_join,
        op3_secrets,
        op4_substring_dedup,
        op5_sentencepiece,
        op6_decontamination,
        op7_quality_rules,
        op8_quality_classifier,
        op9_warc,
        op10_chat,
        op11_hard_negatives,
        op12_suffix_dedup,
        op13_lexical_search,
    )
}

SQL = {"op9_warc": warc.ORACLE, "op10_chat": chat.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
