"""Cleaning a text corpus in five stages, each of which reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from specband.llm import decontaminate as winnow, ngram_join as grams, pieces, pii, quality_rules as rules
from specband.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rewritten(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that failed.

    Null and empty texts have no words and go; repeated rows are judged alike; texts are whole at any length; an empty table stays empty.
    """
    out = rules.quality_rules(docs, keep=COLUMNS).where("kept")
    return rewritten(out.select("in.*", "clean_text").withColumn("text", F.col("clean_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar rows the one with the smallest id stays; all other rows stay, also those that share an id with one that goes.

    Rows meet their group by one hash of all their columns and are told apart by two, so equal rows are one and different rows
    that share the first hash both stay; rows without words or without an id are in no group.
    """
    rows = docs.where("doc_id IS NOT NULL").select(*COLUMNS).withColumns({"row": F.xxhash64(*COLUMNS), "twin": F.xxhash64(F.lit(1), *COLUMNS)})
    members = grams.ngram_join(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id", (F.col("n_shingles") > 0).alias("grouped")).distinct()
    ids = rows.select("row", "doc_id").distinct()
    stay = members.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row", "grouped")).alias("m")).select("m.row", "m.grouped")
    kept = rows.join(stay, "row").groupBy("row", "twin", "grouped").agg(F.min(F.struct(*COLUMNS)).alias("d"), F.count("*").cast("int").alias("n"))
    kept = kept.withColumn("_", F.explode(F.sequence(F.lit(1), F.when(F.col("grouped"), 1).otherwise(F.col("n"))))).select("d.*")
    return kept.union(docs.where("doc_id IS NULL").select(*COLUMNS))


def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out; a document of nothing else goes.

    Null and empty texts have no hits and stay; repeated rows lose the same words; texts are whole at any length; an empty benchmark cuts nothing.
    """
    out = winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["b"] - s["a"])
    kept = out.where((n_hit == 0) | (n_hit < F.col("n_words")))
    return rewritten(kept.withColumn("text", winnow.without_hits(kept)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values and disclosing terms are replaced; every document stays.

    Null and empty texts stay as they are; repeated rows get equal texts and each counts in the corpus statistics; texts are whole at any length.
    """
    out = pii.sanitise(docs, keep=COLUMNS)
    return rewritten(out.select("in.*", "clean_text").withColumn("text", F.col("clean_text")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; null and empty texts have none, repeated rows get equal ids, texts are whole at any length."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("n_pieces", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_spans), ("PII", personal_data), ("SentencePiece", encoded),
]
ORACLE_SQL = None  # line rules, links and disclosing terms have no SQL of bearable cost; tests hold the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written as Parquet into the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
