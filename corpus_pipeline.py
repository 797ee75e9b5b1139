"""Corpus preparation: quality rules, line dedup, near-dedup, mixing to target weights, SentencePiece encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

A null text counts as an empty one, which the quality rules reject. Rows without an id are judged by their text alone and stay apart from
each other; repeated rows are judged each for itself, and near-dedup keeps all rows that have the kept id. Empty tables give empty ones.
Extra columns are carried, but by the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearspan.llm import line_dedup, near_dedup, piece_coding, quality_rules, source_mixing
from clearspan.llm.shared import stored

#: Largest shares of the mixing stage's outcome; clean documents have their own total as target, so these stay.
CEILINGS = {"poor": 0.02, "toxic": 0.10}


def keeping(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work's rows with the columns of docs, whatever their names: while it works, all but doc_id and text have names that no operator uses."""
    plain = [c if c in ("doc_id", "text") else f"__carried_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*plain)).select(*plain).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keeping(docs, lambda d: quality_rules.with_quality(d, labels).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more share go from all of them; n_chars follows the text."""
    cleaned = keeping(docs, lambda d: line_dedup.drop_frequent_lines(d, min_docs=10, min_chars=1))
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    gone = stored(found.where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates from 0 to 1 that scale domains down to CEILINGS; a document stays if its number of copies, by its rate and the hash of its id, is 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keeping(docs, lambda d: source_mixing.cap_sources(d, labels, CEILINGS).where("copies >= 1"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, score): the pieces of each document."""
    import public_tokenizers

    coded = piece_coding.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "score")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("source_mixing", mixing), ("piece_coding", encoding)]

#: Fitted models, components and pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each result stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
