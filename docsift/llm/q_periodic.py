"""Query of periodic runs, over documents of which a tenth get a planted periodic tail."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docsift.llm.periodic import periodic_runs
from docsift.llm.registry import query

WORD = r"([^\x20\x09-\x0D]+)"


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text: with h the crc32 of the id, one text in ten repeats its words from a on with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def tailed(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " "))

    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(1)))
    chosen = (h % 10 == 0) & F.col("text").isNotNull()
    return docs.select("doc_id", F.when(chosen, F.get(F.transform(words, tailed), F.lit(0))).otherwise(F.col("text")).alias("text"))


def best(runs: str) -> Column:
    """The run of greatest length / period; ties: smallest start, then period. Compared by cross products."""
    ahead = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    return F.get(
        F.array_sort(
            runs,
            lambda a, b: F.when(ahead(a, b) != 0, -F.signum(ahead(a, b)))
            .otherwise(F.signum(F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])))
            .cast("int"),
        ),
        F.lit(0),
    )


@query("op11_periodic")
def op11_periodic(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(planted(docs)).withColumn("top", best("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
