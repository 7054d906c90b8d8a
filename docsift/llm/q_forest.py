"""Query of the n-gram Jaccard join."""
from __future__ import annotations

from docsift.llm.forest import jaccard_join
from docsift.llm.registry import query


@query("op4_jaccard")
def op4_jaccard(spark, sf_dir):
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
