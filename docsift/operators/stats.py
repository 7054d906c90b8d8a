"""Sufficient statistics as a long table stats(field, k, i, j, value).

`field` names a statistic, k its component (-1 for none), i and j its other indices. Being
rows, statistics of batches, partitions and models combine with ordinary relational steps.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

SCHEMA = "field string, k int, i int, j int, value double"
KEYS = ["field", "k", "i", "j"]


def total(rows: DataFrame) -> DataFrame:
    return rows.groupBy(KEYS).agg(F.sum("value").alias("value"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return total(a.unionByName(b))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return total(a.unionByName(scale(b, -1.0)))


def scale(a: DataFrame, factor) -> DataFrame:
    return a.withColumn("value", F.col("value") * factor)


def merge(a: DataFrame, ka: int, kb: int) -> DataFrame:
    """Component kb folded into ka; later components move down by one."""
    k = F.when(F.col("k") == kb, F.lit(ka)).otherwise(F.col("k"))
    return _close_gap(total(a.withColumn("k", k)), kb)


def remove(a: DataFrame, k: int) -> DataFrame:
    return _close_gap(a.where(F.col("k") != k), k)


def _close_gap(a: DataFrame, gone: int) -> DataFrame:
    return a.withColumn("k", F.when(F.col("k") > gone, F.col("k") - 1).otherwise(F.col("k")).cast("int"))


def extract(a: DataFrame, k: int) -> DataFrame:
    """One component's statistics, as component 0."""
    return a.where(F.col("k") == k).withColumn("k", F.lit(0))


def insert(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The components of b after the k components of a; shared scalars (k = -1) add up."""
    moved = b.withColumn("k", F.when(F.col("k") >= 0, F.col("k") + k).otherwise(F.col("k")).cast("int"))
    return add(a, moved)


def subtract_components(a: DataFrame, b: DataFrame, pairs: dict[int, int]) -> DataFrame:
    """Subtract component kb of b from component ka of a for each ka -> kb."""
    where = F.create_map(*[F.lit(v) for ka, kb in pairs.items() for v in (kb, ka)])
    moved = b.withColumn("k", F.element_at(where, F.col("k"))).where(F.col("k").isNotNull())
    return subtract(a, moved)


def to_numpy(a: DataFrame, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    """Model-sized statistics as arrays. Only K- and D-sized fields may be listed in `shapes`."""
    out = {f: np.zeros(s) for f, s in shapes.items()}
    rows = a.where(F.col("field").isin(list(shapes))).toPandas()
    for f, part in rows.groupby("field"):
        rank = out[f].ndim
        at = tuple(part[c].to_numpy() for c in ("k", "i", "j")[:rank])
        if rank == 0:
            out[f] = np.asarray(part["value"].sum())
        else:
            np.add.at(out[f], at, part["value"].to_numpy())
    return out
