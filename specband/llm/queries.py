"""The registered queries of the text operators, with SQL counterparts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from specband.llm import alignment, decontaminate as winnow, embedding_join as vectors, html_text as pages, ngram_join as grams, pieces, pii, quality_classifier as classifier, quality_rules as rules, source_divergence as divergence, substring_dedup as passages, suffix_dedup as suffixes, token_counts as counting
from specband.llm import sql
from specband.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_ngram_jaccard_join", sql.NGRAM_JOIN)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.ngram_join(table(spark, sf_dir, "documents")).drop("class_id")


@query("op2_substring_dedup", sql.WORD_PASSAGES)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(passages.substring_dedup(table(spark, sf_dir, "documents")))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_benchmark_decontamination", sql.CONTAMINATION)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op5_quality_rules", sql.quality())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(table(spark, sf_dir, "documents")))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.html_text(table(spark, sf_dir, "pages"), keep=["url"])


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op9_suffix_array_dedup", sql.BYTE_STRINGS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.suffix_dedup(table(spark, sf_dir, "documents")))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op12_embedding_near_dedup", sql.VECTORS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_join(table(spark, sf_dir, "embeddings"))


@query("op13_source_divergence", sql.DIVERGENCE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.tokenizer_alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
