"""Query of sharding: 40 shards, then 41."""
from __future__ import annotations

from pyspark.sql import functions as F

from docsift.llm.registry import query
from docsift.llm.shards import even_tree, shard


@query("op8_shards")
def op8_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs, even_tree(40), even_tree(41)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
