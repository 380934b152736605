"""A training-data pipeline over `documents`: stages that are each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlattice.llm.mixing import mixed_documents
from driftlattice.llm.neardup import one_of_each
from driftlattice.llm.pieces import encode_documents
from driftlattice.llm.suffixdedup import without_repeats
from driftlattice.llm.textbuf import held_out, read_table, stored, temporary_tables
from driftlattice.llm.toxicity import without_toxic
from driftlattice.session import with_package


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, read_table(with_package(spark), sf_dir, "labels"), ~held_out(F.col("doc_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest doc_id."""
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller doc_id holds go."""
    return counted(without_repeats(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document may come twice or in part."""
    return counted(mixed_documents(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Near-duplicates, suffix arrays and piece lattices are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What stages wrote on the way is deleted once the next one's rows are written."""
    docs = read_table(spark, sf_dir, "documents")
    with temporary_tables(spark) as all_but_last:
        for _, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir))
            all_but_last()
    return docs
