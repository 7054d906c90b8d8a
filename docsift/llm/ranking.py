"""Ranked lexical search with bag deduplication.

Documents are restricted to the terms of the items. Documents with equal restricted term counts and equal
length part m score alike for every item: they form a class, found by a hash of both and verified by the
values themselves. Each class is scored once against all items; the documents of the best classes then take
their places by ascending doc_id. A document ranked among the `top` is one of the `top` smallest of its class,
and its class is one of the `top` best by score and smallest doc_id, so nothing else travels.

Items are dealt to blocks of about `block_terms` (item, term) pairs; a block's terms go to the tasks, and the
documents are read once a block. Statistics cover all documents.

Null and empty texts have no terms and are never ranked, but for documents without terms nothing changes N or L.
Rows that share an item_id are one item with the terms of all; a null item_id is an item too. Repeated document
rows each take a place; rows with a null doc_id come after others of their score. Empty tables give no rows.
Other columns of either table are not read.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docsift.llm.common import batch_by_bytes, table

#: A term: ASCII digits and letters, and every code point beyond ASCII.
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of a term to themselves, with A-Z lower-cased; all others to a space. Bytes of other code points are over 0x7F.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(_UPPER.encode(), _LOWER.encode()))


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    low = F.translate("text", _UPPER, _LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(1))).alias("term")).distinct()


def term_bags(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all terms with repeats), bag: (place in `terms`, occurrences), by place."""
    places = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})  # at most a block's terms
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n long, terms array<int>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "replace").translate(_TABLE).split()
                sizes.append(len(words))
                bags.append(sorted((known[w], c) for w, c in Counter(words).items() if w in known))
            lists = [pa.array([[x[i] for x in b] for b in bags], pa.list_(pa.int32())) for i in (0, 1)]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

    return batch_by_bytes(docs).select("doc_id", "text").mapInArrow(run, schema)


def classes(bags: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """m, terms, times, members, nulls: the `top` smallest doc_ids of the documents that share m, terms and times.

    Members without a doc_id are counted in nulls instead.
    """
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    found = bags.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "times")
    found = found.withColumn("h", F.xxhash64("m", "terms", "times"))
    same = ["h", "m", "terms", "times"]
    order = Window.partitionBy(same).orderBy(F.col("doc_id").asc_nulls_last())
    first = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top)
    nulls = F.count(F.when(F.col("doc_id").isNull(), 1)).cast("int")
    return first.groupBy(same).agg(F.sort_array(F.collect_list("doc_id")).alias("members"), nulls.alias("nulls")).drop("h")


def _weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _score(shipped, top: int):
    """Rows (item, score, members, nulls) of the `top` classes of each item among a task's classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, holders, weights, n_items = shipped.value
        best: pd.DataFrame | None = None
        floor = np.ones(n_items, np.int64)  # scores below this are out of reach

        def pruned(df: pd.DataFrame) -> pd.DataFrame:
            df = df.sort_values(["item", "score", "least"], ascending=[True, False, True], kind="stable", na_position="last")
            df = df[df.groupby("item").cumcount() < top]
            full = df.groupby("item")["score"].agg(["size", "min"])
            full = full[full["size"] == top]
            floor[full.index.to_numpy()] = full["min"].to_numpy()
            return df

        step = max(1, 4_000_000 // max(n_items, 1))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                lengths = part["terms"].str.len().to_numpy()
                terms = np.concatenate(part["terms"].to_numpy()).astype(np.int64)
                times = np.concatenate(part["times"].to_numpy()).astype(np.int64)
                row = np.repeat(np.arange(len(part)), lengths)
                m = part["m"].to_numpy(np.int64)[row]
                gain = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m))
                held = starts[terms + 1] - starts[terms]
                # every (class, term) meets the items that hold the term
                first = np.repeat(starts[terms] - np.concatenate(([0], np.cumsum(held)[:-1])), held)
                items = holders[first + np.arange(held.sum())]
                scores = np.zeros(len(part) * n_items, np.int64)
                np.add.at(scores, np.repeat(row, held) * n_items + items, np.repeat(gain, held))
                scores = scores.reshape(len(part), n_items)
                which, item = np.nonzero(scores >= floor)
                members = part["members"].to_numpy()[which]
                new = pd.DataFrame({"item": item, "score": scores[which, item], "least": [x[0] if len(x) else None for x in members], "members": members, "nulls": part["nulls"].to_numpy()[which]})
                best = pruned(new if best is None else pd.concat([best, new], ignore_index=True))
        if best is not None:
            yield best[["item", "score", "members", "nulls"]]

    return run


def _block(docs: DataFrame, pairs: pd.DataFrame, top: int) -> DataFrame:
    """Ranked documents of the items in `pairs` (item, item_id, term), as item, score, doc_id, rank."""
    spark = docs.sparkSession
    terms = sorted(pairs["term"].unique())
    place = {t: i for i, t in enumerate(terms)}
    bags = table(spark, term_bags(docs, terms), "bags")
    n_docs, n_terms = bags.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = bags.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()  # at most a block's terms
    df = np.zeros(len(terms), np.int64)
    df[held["term"].to_numpy(int)] = held["count"].to_numpy(np.int64)
    by_term = pairs.assign(place=pairs["term"].map(place)).sort_values("place", kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(by_term["place"], minlength=len(terms))))).astype(np.int64)
    n_items = int(pairs["item"].max()) + 1
    shipped = spark.sparkContext.broadcast((starts, by_term["item"].to_numpy(np.int64), _weights(n_docs, df), n_items))
    kind = dict(docs.dtypes)["doc_id"]
    scored = classes(bags, n_docs, n_terms, top).mapInPandas(_score(shipped, top), f"item int, score long, members array<{kind}>, nulls int")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    every = F.concat("members", F.array_repeat(F.lit(None).cast(kind), F.col("nulls")))
    placed = scored.select("item", "score", F.explode(every).alias("doc_id")).withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 50, block_terms: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0."""
    spark = docs.sparkSession
    pairs = table(spark, item_terms(items.select("item_id", "text")), "item-terms")
    blocks = max(1, -(-pairs.count() // block_terms))
    out = None
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        numbered = mine.select("item_id").distinct().withColumn("item", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("int"))
        numbered = table(spark, numbered, "items")  # one block of the stated queries
        local = mine.join(numbered.withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id"))).select("item", "term").toPandas()
        if len(local):
            part = _block(docs, local, top).join(F.broadcast(numbered), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
            out = part if out is None else out.unionByName(part)
    if out is not None:
        return out
    empty = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score long"
    return spark.createDataFrame([], empty)
