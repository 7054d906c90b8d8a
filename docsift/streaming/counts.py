"""Incremental counts: only new documents are counted when a collection grows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.functions import text as T
from docsift.functions.stopwords import ENGLISH


def word_totals(docs: DataFrame, stopwords=ENGLISH) -> DataFrame:
    """Streaming (word, df, cf) over a stream of documents; state holds one row per word.

    A document's words are sorted inside its row; the first of each run of equal words counts the
    document, so `df` needs no distinct.
    """
    words = F.array_sort(T.content_tokens(F.col("text"), stopwords))
    marked = F.transform(
        "ws", lambda w, i: F.struct(w.alias("word"), ((i == 0) | (F.get("ws", i - 1) != w)).cast("long").alias("first"))
    )
    rows = docs.select(words.alias("ws")).select(F.explode(marked).alias("r"))
    return rows.groupBy("r.word").agg(F.sum("r.first").alias("df"), F.count(F.lit(1)).alias("cf"))


def run_available(spark: SparkSession, totals: DataFrame, path: str, key: str = "word") -> DataFrame:
    """Process everything available; returns the newest row of every key.

    Update mode: a batch writes only the keys it changed, under its batch id, so the work follows the new
    documents and not the vocabulary. A retried batch overwrites its own folder, so nothing is counted
    twice. The empty batch -1 gives a stream without files its schema.
    """
    spark.createDataFrame([], totals.schema).write.mode("ignore").parquet(f"{path}/result/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={batch_id}")

    query = (
        totals.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.parquet(f"{path}/result")
    newest = written.groupBy(key).agg(F.max_by(F.struct(*totals.columns), "batch").alias("r"))
    return newest.select("r.*")
