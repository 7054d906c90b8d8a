"""Query of language identification."""
from __future__ import annotations

from docsift.llm.langid import fit, held_out, identify
from docsift.llm.registry import query


@query("op3_langid")
def op3_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
