"""Beta and Dirichlet families as column expressions, and entropies of all families.

Column forms work on tables of any length (a posterior for every node, word or source); the Gaussian
forms take the K-sized parameters of docsift.plans.gauss.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docsift.functions.special import digamma, lgamma, np_digamma, np_lgamma
from docsift.plans.gauss import LOG_2PI, log_norm


def beta_posterior(counts: DataFrame, ones: str, zeros: str, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """counts with a, b: the Beta posterior of the chance of a one, given how many ones and zeros were seen."""
    return counts.withColumn("a", F.col(ones) + F.lit(float(a0))).withColumn("b", F.col(zeros) + F.lit(float(b0)))


def beta_expected_logs(a: Column, b: Column) -> tuple[Column, Column]:
    """E[log p] and E[log(1 - p)]."""
    both = digamma(a + b)
    return digamma(a) - both, digamma(b) - both


def beta_log_norm(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def beta_entropy(a: Column, b: Column) -> Column:
    one, zero = beta_expected_logs(a, b)
    return beta_log_norm(a, b) - (a - 1.0) * one - (b - 1.0) * zero


def dirichlet_log_norm(cells: DataFrame, key: str, cell: str, value: str) -> DataFrame:
    """(key, log_norm, entropy) of Dirichlet parameters given as rows (key, cell, value); null cells are left out.

    Sums are combined before the shuffle, so a vocabulary of any size is one row per key.
    """
    v = F.col(value).cast("double")
    sums = cells.where(F.col(cell).isNotNull()).groupBy(key).agg(
        F.sum(v).alias("_t"), F.count(v).alias("_n"), F.sum(lgamma(v)).alias("_g"), F.sum((v - 1.0) * digamma(v)).alias("_d")
    )
    norm = F.col("_g") - lgamma(F.col("_t"))
    return sums.select(key, norm.alias("log_norm"), (norm + (F.col("_t") - F.col("_n")) * digamma(F.col("_t")) - F.col("_d")).alias("entropy"))


def log_precision(obs: str, q: dict) -> np.ndarray:
    """E[log determinant of the precision]; for "diag" one number per dimension."""
    if obs == "diag":
        return np_digamma(q["a"]) - np.log(q["b"])
    d = q["winv"].shape[-1]
    nu = np.asarray(q["nu"], float)
    return sum(np_digamma((nu - i) / 2.0) for i in range(d)) + d * np.log(2.0) - np.linalg.slogdet(q["winv"])[1]


def entropy(obs: str, q: dict) -> np.ndarray:
    """Entropy of the posterior of each component: Gauss-Gamma, Wishart or Gauss-Wishart."""
    logs = log_precision(obs, q)
    if obs == "diag":
        gamma = q["a"] - np.log(q["b"]) + np_lgamma(q["a"]) + (1.0 - q["a"]) * np_digamma(q["a"])
        mean = 0.5 * (LOG_2PI + 1.0 - np.log(q["kappa"])[:, None] - logs)
        return (gamma + mean).sum(-1)
    d = q["winv"].shape[-1]
    nu = np.asarray(q["nu"], float)
    wishart = log_norm("zero_mean", {"nu": nu, "winv": q["winv"]}) - 0.5 * (nu - d - 1.0) * logs + 0.5 * nu * d
    if obs == "zero_mean":
        return wishart
    return wishart + 0.5 * (d * (LOG_2PI + 1.0 - np.log(q["kappa"])) - logs)
