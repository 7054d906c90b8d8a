"""Archive ingest: text and PDF members of zip, tar, gz and bz2 files."""
from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from docsift.functions.ranking import hash_rank

KEEP = (".txt", ".pdf")
SCHEMA = "archive string, member string, name string, content binary"


def members(path: str, data: bytes):
    """(member path, bytes) of the kept files inside one archive, read one at a time."""
    low = path.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.filename.lower().endswith(KEEP) and not info.is_dir():
                    yield info.filename, z.read(info)
    elif low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile() and info.name.lower().endswith(KEEP):
                    yield info.name, t.extractfile(info).read()
    elif low.endswith((".gz", ".bz2")):
        inner = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if inner.lower().endswith(KEEP):
            yield inner, (gzip if low.endswith(".gz") else bz2).decompress(data)
    elif low.endswith(KEEP):
        yield path.rsplit("/", 1)[-1], data


def extract(files: DataFrame) -> DataFrame:
    """(archive, member, name, content) from rows (path, content); one task per group of files."""

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                for member, content in members(path, data):
                    yield pd.DataFrame([(path, member, member.rsplit("/", 1)[-1], content)], columns=["archive", "member", "name", "content"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return extract(spark.read.format("binaryFile").load(path))


def documents(extracted: DataFrame) -> DataFrame:
    """docs(doc_id, name, text) of the text members, keyed by full member path so equal names stay apart."""
    texts = extracted.where(F.lower("name").endswith(".txt"))
    keyed = texts.select(F.concat_ws("!", "archive", "member").alias("path"), "name", F.col("content").cast("string").alias("text"))
    return hash_rank(keyed, "path", 0, "doc_id").select("doc_id", "name", "path", "text")
