"""Benchmark decontamination by winnowing.

Fingerprints of a text are the smallest hash of its 5-word grams in every 9 consecutive grams, so any
13 words that two texts share hold at least one fingerprint of both. Fingerprints of documents are
matched with those of the items; around every match the windows of `span` words are cut out and joined
with the items' windows as strings, so no hash collision becomes a hit.

Null and empty texts have no words and are clean. An item of fewer than `span` words is one window of
all its words, looked up by a gram of just that length. Every row is judged by its own text, whatever its doc_id.
Empty tables give empty results or clean documents. Other columns of either table are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import batch_by_bytes, gram_hashes, sliding_min_places, table, word_hashes, word_places

GRAM = 5
CANDIDATES = "doc_id {id}, n_words long, windows array<struct<first:int,len:int,window:string>>"


def fingerprints(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the winnowed grams of a text of at least `span` words."""
    grams = gram_hashes(hashes, GRAM)
    at = sliding_min_places(grams, span - GRAM + 1)
    return grams[at], at


def _item_prints(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = word_hashes(*word_places(text))
                if len(h) >= span:
                    rows += [(0, f) for f in fingerprints(h, span)[0].view(np.int64).tolist()]
                elif len(h):
                    rows.append((len(h), int(gram_hashes(h, len(h)).view(np.int64)[0])))
            yield pd.DataFrame(rows, columns=["len", "print"])

    return run


def _windows(low: bytes, starts, ends, found: dict[int, np.ndarray], span: int) -> list[tuple[int, int, str]]:
    """Windows around the found places: length 0 stands for a fingerprint, others for a whole short window."""
    n, out = len(starts), []
    for length, places in found.items():
        m = length or span
        if length:
            firsts = places
        else:
            reach = places[:, None] - np.arange(span - GRAM + 1)[None, :]
            firsts = np.unique(reach[(reach >= 0) & (reach <= n - m)])
        for f in firsts.tolist():
            window = b" ".join(low[a:b] for a, b in zip(starts[f : f + m], ends[f : f + m]))
            out.append((f, m, window.decode("utf-8", "replace")))
    return out


def _prints_of(hashes: np.ndarray, lengths: list[int], span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for m in lengths:
        if m:
            grams = gram_hashes(hashes, m)
            yield m, grams, np.arange(len(grams))
        elif len(hashes) >= span:
            yield (0, *fingerprints(hashes, span))


def _candidates(known, lengths: list[int], span: int):
    """Look up fingerprints in the shipped ones and cut out windows, in one pass over the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shipped = known.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                low, starts, ends = word_places(text)
                h, found = word_hashes(low, starts, ends), {}
                for m, prints, places in _prints_of(h, lengths, span):
                    at = np.searchsorted(shipped[m], prints)
                    hit = shipped[m][np.minimum(at, len(shipped[m]) - 1)] == prints
                    found[m] = places[hit]
                rows.append((len(h), _windows(low, starts, ends, found, span)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [r[0] for r in rows], "windows": [r[1] for r in rows]})

    return run


def _all_prints(lengths: list[int], span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"]):
                h = word_hashes(*word_places(text))
                for m, prints, places in _prints_of(h, lengths, span):
                    yield pd.DataFrame({"doc_id": key, "len": m, "print": prints.view(np.int64), "place": places})

    return run


def _cut(span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, places in zip(batch["text"], batch["places"]):
                low, starts, ends = word_places(text)
                found: dict[int, list[int]] = {}
                for p in places if places is not None else ():
                    found.setdefault(p["len"], []).append(p["place"])
                rows.append((len(starts), _windows(low, starts, ends, {m: np.unique(p) for m, p in found.items()}, span)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [r[0] for r in rows], "windows": [r[1] for r in rows]})

    return run


def item_windows(items: DataFrame, span: int) -> DataFrame:
    """Distinct (item_id, len, window) of all items."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = items.select("item_id", F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)).alias("w"))
    of = of.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(span)))
    firsts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return (
        of.select("item_id", "len", "w", F.explode(firsts).alias("f"))
        .select("item_id", "len", F.array_join(F.slice("w", F.col("f"), F.col("len")), " ").alias("window"))
        .distinct()
    )


def candidate_windows(docs: DataFrame, items: DataFrame, span: int = 13, ship_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, windows: one row per document, windows cut out around matching fingerprints.

    The items' fingerprints go to all tasks if they take at most `ship_bytes`; beyond that the
    fingerprints of the documents are joined with them.
    """
    spark = docs.sparkSession
    schema = CANDIDATES.format(id=dict(docs.dtypes)["doc_id"])
    docs = batch_by_bytes(docs).select("doc_id", "text")
    prints = table(spark, items.select("text").mapInPandas(_item_prints(span), "len int, print long").distinct(), "item-prints")
    lengths = [r[0] for r in prints.select("len").distinct().collect()]  # at most `span` values
    if prints.count() * 16 <= ship_bytes:
        local = prints.toPandas()
        known = {m: np.sort(local.loc[local["len"] == m, "print"].to_numpy(np.int64).view(np.uint64)) for m in lengths}
        return docs.mapInPandas(_candidates(spark.sparkContext.broadcast(known), lengths, span), schema)
    docs = table(spark, docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # a row is known by its number
    by_row = docs.select(F.col("_row").alias("doc_id"), "text")
    all_prints = by_row.mapInPandas(_all_prints(lengths, span), "doc_id long, len int, print long, place int")
    places = (
        all_prints.join(prints, ["len", "print"], "left_semi")
        .groupBy(F.col("doc_id").alias("_row"))
        .agg(F.collect_set(F.struct("len", "place")).alias("places"))  # at most one per word of the document
    )
    with_places = docs.join(places, "_row", "left")
    return with_places.select("doc_id", "text", "places").mapInPandas(_cut(span), schema)


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 13, ship_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of an item window), items (sorted ids as text)."""
    spark = docs.sparkSession
    numbered = candidate_windows(docs, items, span, ship_bytes).withColumn("_row", F.monotonically_increasing_id())
    found = table(spark, numbered, "windows")
    cut = found.select("_row", F.explode("windows").alias("c")).select("_row", "c.*")
    hits = (
        cut.join(item_windows(items, span), ["len", "window"])
        .groupBy("_row")
        .agg(
            F.sort_array(F.collect_set(F.struct("first", (F.col("first") + F.col("len")).alias("end")))).alias("spans"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["first"]))).alias("n"),
            F.greatest(a["to"], x["end"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    hits = hits.select("_row", covered.cast("long").alias("n_hit"), "items")
    return found.select("_row", "doc_id", "n_words").join(hits, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(percent: int = 5):
    """At least `percent` of the words are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
