"""Forward filtering of hidden states while events arrive."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.operators import hmm as H

STATE = "key long, f array<double>, log_lik double"


def filter_events(spark: SparkSession, stream: DataFrame, hmm: H.Hmm, path: str, delay: str = "10 minutes", length: int = 4096) -> DataFrame:
    """Filters every available event (key, id, ts, obs); returns (key, id, f).

    The state is a table versioned by batch: batch b reads version b, writes version b + 1 and its
    own output folder, so a retry changes nothing. Inside a micro-batch a key's events are cut in
    chunks, so a busy key does not end up in one task. Events older than the newest one of earlier
    batches minus `delay` are dropped; within a batch events are put in time order.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows, state = batch, None
        if batch_id > 0:
            newest = spark.read.schema("newest timestamp").parquet(f"{path}/newest/version={batch_id}")
            rows = batch.where(F.col("ts") >= newest.select(F.col("newest") - F.expr(f"INTERVAL {delay}")).scalar())
            state = spark.read.schema(STATE).parquet(f"{path}/state/version={batch_id}")
        filters, after = H.filter_forward(H.chunks(rows, "key", ["ts"], length), hmm, state)
        filters.write.mode("overwrite").parquet(f"{path}/result/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{path}/state/version={batch_id + 1}")
        seen = rows.agg(F.max("ts").alias("newest"))
        if batch_id > 0:
            seen = seen.unionAll(newest).agg(F.max("newest").alias("newest"))
        seen.write.mode("overwrite").parquet(f"{path}/newest/version={batch_id + 1}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("key long, id long, f array<double>, batch int").parquet(f"{path}/result").drop("batch")
