"""Stochastic online topic learning from a stream of document rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.operators import bow
from docsift.plans import online as O, topics as P
from docsift.sources import models


def learn_topics(spark: SparkSession, stream: DataFrame, vocab: DataFrame, start: P.TopicModel, n_total: int, path: str, delay=1.0, power=0.5):
    """One blended step per micro-batch. Input: doc_id, text. Returns the last model.

    The model is a table versioned by batch: batch b reads version b and writes version b + 1,
    so a retried micro-batch repeats the same step.
    """
    if not models.saved(spark, path):  # a restart goes on with the saved model
        models.save_topics(spark, start, path, 0.0)

    def step(batch: DataFrame, batch_id: int) -> None:
        model, lap = models.load_topics(spark, path, float(batch_id))
        if lap != float(batch_id):
            raise RuntimeError(f"version {batch_id} of the model is missing, found {lap}")
        rows = bow.bow_rows(bow.doc_term(bow.word_counts(batch), vocab))
        model, _ = O.sovb_topics_step(rows, vocab, model, n_total, O.step_size(batch_id + 1, delay, power))
        models.save_topics(spark, model, path, float(batch_id + 1))

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return models.load_topics(spark, path)[0]
