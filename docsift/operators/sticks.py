"""Stick-breaking weights over component rows (a model has K rows, so the windows are small)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docsift.functions.special import digamma

BEFORE = W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)
AFTER = W.orderBy("k").rowsBetween(1, W.unboundedFollowing)


def break_sticks(v: DataFrame) -> DataFrame:
    """(k, beta) from (k, v): v times what earlier sticks left over; the leftover comes last."""
    rest = F.exp(F.coalesce(F.sum(F.log1p(-F.col("v"))).over(BEFORE), F.lit(0.0)))
    beta = v.select("k", (F.col("v") * rest).alias("beta"))
    last = beta.agg((F.max("k") + 1).cast("int").alias("k"), (1.0 - F.sum("beta")).alias("beta"))
    return beta.unionByName(last)


def unbreak(beta: DataFrame) -> DataFrame:
    """(k, v) from (k, beta), the leftover being the mass not listed."""
    rest = 1.0 - F.coalesce(F.sum("beta").over(BEFORE), F.lit(0.0))
    return beta.select("k", (F.col("beta") / rest).alias("v"))


def dp_sticks(mass: DataFrame, alpha0: float) -> DataFrame:
    """(k, a, b, e_log_w) of a Dirichlet process from component masses (k, n)."""
    ab = mass.select(
        "k",
        (F.col("n") + 1.0).alias("a"),
        (F.coalesce(F.sum("n").over(AFTER), F.lit(0.0)) + alpha0).alias("b"),
    )
    both = digamma(F.col("a") + F.col("b"))
    logs = ab.select("k", "a", "b", (digamma(F.col("a")) - both).alias("lv"), (digamma(F.col("b")) - both).alias("l1"))
    return logs.select("k", "a", "b", (F.col("lv") + F.coalesce(F.sum("l1").over(BEFORE), F.lit(0.0))).alias("e_log_w"))
