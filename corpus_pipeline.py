"""The training-data pipeline: stages over documents, each written and read again as the next one's input.

Every stage works on all rows that its predecessor kept and, but for the last, returns the columns of documents.
Null and empty texts pass all stages; documents with a null key are never near-duplicates of others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard_join, line_dedup, mixing, pieces, toxicity
from larkspur.llm.queries import vocabulary
from larkspur.session import sized_broadcast, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    rejected = written(toxicity.score(docs, model).filter("score >= 0.7").select("h1", "h2").distinct())
    rows = docs.select("*", *toxicity.identity("text", "doc_id"))
    return rows.join(sized_broadcast(rejected), ["h1", "h2"], "left_anti").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that earlier documents hold; n_chars follows."""
    _, _, left = line_dedup.added(docs)
    out = line_dedup.line_dedup(docs)
    return out.select(*[(F.col(left).alias(c) if c == "text" else F.length(left).cast("long").alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest key."""
    others = written(jaccard_join.classes(docs).filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(sized_broadcast(others), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it: the files of the written stage, and the rows in them, stand in that order."""
    return mixing.curriculum(docs)


def place_in_files(name: Column, row: Column) -> Column:
    """A row's place in the files of one written table: its partition, the file of that partition (a partition may be split into several) and the row, of fixed width, so that order of text is their order."""
    part, file = (F.lpad(F.regexp_extract(name, pattern, 1), 10, "0") for pattern in ("^part-([0-9]+)", "-c([0-9]+)[.]"))
    return F.concat(part, F.lit("-"), file, F.lit("/"), F.lpad(row.cast("string"), 19, "0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces, the number of these, whether decoding gives the text back, and training_order: sorting by it gives the order that the mix assigned.

    The stages between have the columns of documents only, so the order comes as that of files and rows; where docs isn't read from files, its own order counts.
    """
    vocab = pieces.vocabulary_for(spark, vocabulary("piece_bpe_32k.model"))
    try:
        name = F.col("_metadata.file_name")
        rows = docs.select("*", place_in_files(name, F.col("_metadata.row_index")).alias("training_order"))
    except AnalysisException:  # not read from files
        rows = docs.select("*", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0").alias("training_order"))
    return pieces.encode_checked(rows, vocab).select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip", "training_order")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("pieces", encode),
]

#: Toxicity, hash order and Viterbi paths aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
