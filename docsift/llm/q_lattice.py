"""Query of near-duplicate vectors."""
from __future__ import annotations

from docsift.llm.lattice import near_vectors
from docsift.llm.registry import query


@query("op9_lattice")
def op9_lattice(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
