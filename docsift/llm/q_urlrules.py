"""Query of the url filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from docsift.llm.registry import query
from docsift.llm.urlrules import judge

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op2_urlrules")
def op2_urlrules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # a page's path carries the number of the document it shows; that document's marks label the url
    number = F.regexp_extract(F.col("url"), r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1).cast("long")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    marks = marks.select(F.col("doc_id").alias("number"), F.when(bad, "block").otherwise("allow").alias("label"))
    labels = pages.select("url", number.alias("number")).join(marks, "number").select("url", "label")
    return judge(pages, RULES, labels).select("page_id", "host", "path", "rule", "verdict", "because")
