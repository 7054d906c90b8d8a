"""Query of secret scans."""
from __future__ import annotations

from pyspark.sql import functions as F

from docsift.llm.registry import query
from docsift.llm.secrets import learn, scan


@query("op6_secrets")
def op6_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("path"))
    scanner = learn(docs)
    secret = F.filter("findings", lambda f: f["score"] >= scanner.threshold)
    return scan(docs, scanner).select(
        "doc_id",
        F.size("findings").cast("long").alias("n_findings"),
        F.size(secret).cast("long").alias("n_secrets"),
        F.array_join(F.transform(secret, lambda f: F.concat_ws(":", f["start"], f["end"])), ",").alias("spans"),
        F.sha2(F.coalesce("blanked", F.lit("")), 256).alias("blanked_sha256"),
    )
