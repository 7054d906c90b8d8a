"""Building an extractive summary: score sentences against a query, add and remove them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

KEY = ["doc_id", "sent_ix"]


def query_bow(sent_term: DataFrame, query: DataFrame) -> DataFrame:
    """(word_id, q): summed counts over the query sentences (columns doc_id, sent_ix)."""
    return sent_term.join(query.select(KEY), KEY, "left_semi").groupBy("word_id").agg(F.sum("cnt").alias("q"))


def unused(sents: DataFrame, summary: DataFrame) -> DataFrame:
    """Sentences not yet in the summary."""
    return sents.join(summary.select(KEY), KEY, "left_anti")


def similarity(sent_term: DataFrame, query: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_ix, score): negative cosine with the query counts; null for an empty query.

    The query norm adds up the squares of every query sentence's own counts.
    """
    own = sent_term.join(query.select(KEY), KEY, "left_semi")
    norm = own.select(F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double"))).scalar()
    joined = sent_term.join(query_bow(sent_term, query), "word_id", "left")
    dot = F.sum(F.col("cnt") * F.coalesce("q", F.lit(0))).cast("double")
    length = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double"))
    return joined.groupBy(KEY).agg((-dot / (length * norm) + 0.0).alias("score"))


def divergence(sent_term: DataFrame, query: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, score): KL of (candidate + query) counts from the corpus unigram.

    Query words a candidate lacks contribute (Q - n ln T) / T, with Q = sum q ln(q/u) and n the
    query total: one constant pair for all candidates. So only candidate words are joined, and
    each of them replaces its share of the constant.
    """
    total = vocab.select(F.sum("cf").cast("double")).scalar()
    uni = vocab.select("word_id", (F.col("cf") / total).alias("u"))
    words = uni.join(query_bow(sent_term, query), "word_id", "left").select(
        "word_id", "u", F.coalesce(F.col("q"), F.lit(0)).cast("double").alias("q")
    )
    xlogx = F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / F.col("u"))).otherwise(0.0)
    consts = words.agg(F.struct(F.sum(xlogx).alias("Q"), F.sum("q").alias("n"))).scalar()
    both = F.col("cnt") + F.col("q")
    parts = (
        sent_term.join(words, "word_id")
        .groupBy(KEY)
        .agg(
            F.sum(both * F.log(both / F.col("u")) - xlogx).alias("gain"),
            F.sum("cnt").cast("double").alias("m"),
        )
    )
    t = F.col("m") + F.col("n")
    score = (F.col("gain") + F.col("Q")) / t - F.log(t)
    return parts.withColumn("Q", consts["Q"]).withColumn("n", consts["n"]).select(*KEY, score.alias("score"))


def top_sentences(
    sents: DataFrame,
    sent_term: DataFrame,
    summary: DataFrame,
    metric: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
    vocab: DataFrame,
    query: DataFrame | None = None,
    n: int = 200,
) -> DataFrame:
    """The n unused sentences with the lowest metric ; ties by document and position.

    `metric(sent_term, query, vocab)` is pluggable and returns (doc_id, sent_ix, score).
    """
    scored = metric(sent_term, summary if query is None else query, vocab)
    best = unused(scored, summary).orderBy(F.asc_nulls_last("score"), *KEY).limit(n)
    return sents.join(best, KEY)


def add(summary: DataFrame, chosen: DataFrame) -> DataFrame:
    """Append sentences at the end, duplicates included."""
    start = summary.select(F.coalesce(F.max("pos"), F.lit(-1))).scalar() + 1
    return summary.unionByName(chosen.withColumn("pos", (F.col("pos") + start).cast("long")))


def delete(summary: DataFrame, chosen: DataFrame) -> DataFrame:
    return summary.join(chosen.select(KEY), KEY, "left_anti")
