"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

import importlib.resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import embedding_dedup, html_extract, importance, jaccard_join, line_dedup, lm_score, media, mixing, pieces, quality, token_counts, toxicity, vector_codes
from larkspur.session import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file: a parameter of the operators, installed on every worker."""
    return str(importlib.resources.files("public_tokenizers") / name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    rows = toxicity.score(docs, model).withColumnRenamed("k", "doc_id")
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("nearest").alias("evidence"), "cosine")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = pieces.vocabulary_for(spark, vocabulary("piece_bpe_32k.model"))
    docs = pieces.encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab)
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~lm_score.held_out())
    return rows.select("doc_id", lm_score.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines, gone, left = line_dedup.added(docs)
    return line_dedup.line_dedup(docs).select("doc_id", F.when(F.col("text").isNotNull(), F.size(lines)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.col(left).alias("text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("__key").alias("doc_id"), F.col("__words").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"), F.col("__position").alias("position"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.media(table(spark, sf_dir, "documents")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    rows = quality.score(docs, model).withColumnRenamed("k", "doc_id")
    return rows.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("nearest").alias("evidence"), "cosine")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("__key").alias("doc_id"), F.col("__features").alias("n_features"), F.col("__weight").alias("weight"), F.col("__score").alias("score"), F.col("__rank").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_embedding_dedup, op3_toxicity, op4_token_counts, op5_jaccard_join, op6_pieces, op7_lm_score, op8_line_dedup, op9_mixing, op10_media, op11_quality, op12_vector_codes, op13_importance)
}
ORACLE_SQL = {"op8_line_dedup": line_dedup.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_importance": importance.ORACLE}
