"""Ingest and file round trips, and streams over the test tables."""
from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from catalog import query
from catalog.sqltext import DT, KEPT
from catalog.text import corpus, docs
from docsift.session import scratch_path
from docsift.sources import archive, bow_files
from docsift.streaming import counts


@query("bow_roundtrip", f"WITH {DT} SELECT doc_id, word_id, cnt FROM dt")
def bow_roundtrip(spark, sf):
    path = scratch_path(spark, "triples")
    bow_files.write_triples(corpus(spark, sf)[1], path)
    return bow_files.read_triples(spark, path)


@query("ingest_archive", """SELECT 'batch-' || (doc_id // 100) || '.zip' AS archive, 'in/' || doc_id || '.txt' AS member, doc_id || '.txt' AS name,
  strlen(text) AS n_bytes, md5(text) AS digest FROM documents""")
def ingest_archive(spark, sf):
    """The documents table zipped a hundred to an archive, then read back member by member."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                z.writestr(f"in/{doc}.txt", text.encode())
                z.writestr(f"in/{doc}.skip", b"not kept")
        return pd.DataFrame([(f"batch-{pdf['b'].iloc[0]}.zip", buf.getvalue())], columns=["path", "content"])

    files = docs(spark, sf).withColumn("b", F.floor(F.col("doc_id") / 100)).groupBy("b").applyInPandas(pack, "path string, content binary")
    got = archive.extract(files)
    return got.select("archive", "member", "name", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


@query("stream_word_counts", f"WITH {KEPT} SELECT word, df, cf FROM freq")
def stream_word_counts(spark, sf):
    """The documents arrive in four files, one micro-batch each."""
    path = scratch_path(spark, "arrivals")
    docs(spark, sf).repartition(4, "doc_id").write.parquet(path)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(path)
    return counts.run_available(spark, counts.word_totals(stream.select("doc_id", "text")), scratch_path(spark, "stream"))
