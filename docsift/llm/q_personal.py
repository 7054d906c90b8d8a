"""Query of personal data."""
from __future__ import annotations

from pyspark.sql import functions as F

from docsift.llm.personal import KINDS, as_text, find_personal
from docsift.llm.registry import query


def _count(kind):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@query("op5_personal")
def op5_personal(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find_personal(docs).select(
        "doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans")
    )
