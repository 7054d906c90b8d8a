"""Table scans."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by key only if the scan has fewer splits than the cluster has cores.

    That happens with a table written as one small file. A large table already has many
    splits and is left as it is, so no large scan is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def parquet_docs(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs(doc_id, text) from a parquet table; only the two columns are read."""
    df = spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return spread(df, "doc_id")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """docs(doc_id, name, text) from a folder of UTF-8 files, one document per file."""
    from docsift.functions.ranking import hash_rank

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))
    return hash_rank(files, "name", 0, "doc_id").select("doc_id", "name", "text")
