"""Bag-of-words files: triples, vocabulary lists, LDA-C lines, packed rows from a database."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.operators import bow

TRIPLES = "doc_id long, word_id int, cnt long"
VOCAB = "word_id int, word string, df long, cf long"


def write_triples(triples: DataFrame, path: str) -> None:
    """CSV lines doc,word,count; many files, as many as the table has partitions."""
    triples.select("doc_id", "word_id", "cnt").write.mode("overwrite").csv(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIPLES).csv(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("word_id", "word", "df", "cf").write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB).parquet(path)


def write_ldac(triples: DataFrame, path: str, offset: int = 0) -> None:
    bow.ldac_lines(triples, offset).select("line").write.mode("overwrite").text(path)


def read_packed_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Triples from a database query giving doc_id, ids (1-based) and cnts as text."""
    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return bow.unpack(rows.select(F.col("doc_id").cast("long"), "ids", "cnts"))
