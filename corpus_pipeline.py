"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the
last returns pieces of sequences. Columns of the documents are kept aside while a stage works, so none of their
names clashes with its own. Null texts are rejected by the first stage, which finds no language in them. Where ids
are null or repeated, texts stand for their documents: of equal texts one row stays, different texts are judged apart.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.llm import langid, secrets
from docsift.llm.common import table
from docsift.llm.decontaminate import contaminated, decontaminate
from docsift.llm.forest import jaccard_join
from docsift.llm.packing import pack, pieces

MIN_SCORE = 0.5


def _aside(docs: DataFrame, **columns) -> DataFrame:
    """The columns that a stage works on, and the others of the documents as one column `_doc`."""
    rest = [c for c in docs.columns if columns.get(c) != c]
    return docs.select(F.struct(F.lit(0).alias(""), *rest).alias("_doc"), *(F.expr(c).alias(n) for n, c in columns.items()))


def _back(held: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    rest = held.schema["_doc"].dataType.names
    own = {c: F.col(f"_doc.`{c}`") if c in rest else F.col(c) for c in docs.columns}
    return held.select(*(changed.get(c, own[c]).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found with a score of at least MIN_SCORE; a missing lang is filled in."""
    found = langid.identify(_aside(docs, text="text", lang="lang"), langid.fit(docs.select("text", "lang")))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return _back(kept, docs, lang=F.coalesce("lang", "lang_pred"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more, the one with the smallest doc_id."""
    ids = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id")).first()
    unique = len(set(ids)) == 1
    held = _aside(docs, doc_id="doc_id" if unique else "xxhash64(text)", text="text")
    classes = table(spark, jaccard_join(held.select("doc_id", "text")), "classes")
    kept = held.join(classes.where("doc_id != class_id").select("doc_id"), "doc_id", "left_anti")
    return _back(kept if unique else kept.dropDuplicates(["doc_id"]), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    held = _aside(docs, doc_id="xxhash64(text)", text="text")
    hit = decontaminate(held.select("doc_id", "text"), items).where(contaminated()).select("doc_id").distinct()
    return _back(held.join(hit, "doc_id", "left_anti"), docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blanked out of the text."""
    held = _aside(docs, text="text", path="source")
    done = secrets.scan(held, secrets.learn(held.select("text", "path")))
    return _back(done, docs, text=F.col("blanked"), n_chars=F.length("blanked").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces(docs.select("doc_id", "text"), *files))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", blank_secrets),
    ("packing", pack_sequences),
]

#: Learned models decide in two stages, so there is no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
