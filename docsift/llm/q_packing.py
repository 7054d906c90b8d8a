"""Query of packing into sequences of 2048 tokens."""
from __future__ import annotations

import public_tokenizers

from docsift.llm.packing import pack, pieces
from docsift.llm.registry import query


FILES = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(pieces(docs, *FILES))
