"""Digamma, log-gamma and softmax, as Spark columns and as small numpy helpers.

Both forms use the same series: shift the argument up, then the asymptotic expansion.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

SHIFT = 6
HALF_LOG_2PI = 0.9189385332046727

# Bernoulli-number coefficients of the two expansions, in powers of 1/y^2.
PSI_SERIES = [-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132]
GAMMA_SERIES = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]


def digamma(x: Column) -> Column:
    y = x + F.lit(float(SHIFT))
    inv = F.lit(1.0) / (y * y)
    total = F.lit(0.0)
    for c in reversed(PSI_SERIES):
        total = (total + F.lit(c)) * inv
    shifts = sum((F.lit(1.0) / (x + F.lit(float(i))) for i in range(SHIFT)), F.lit(0.0))
    return F.log(y) - F.lit(0.5) / y + total - shifts


def lgamma(x: Column) -> Column:
    y = x + F.lit(float(SHIFT))
    inv = F.lit(1.0) / (y * y)
    total = F.lit(0.0)
    for c in reversed(GAMMA_SERIES[1:]):
        total = (total + F.lit(c)) * inv
    total = (total + F.lit(GAMMA_SERIES[0])) / y
    product = x
    for i in range(1, SHIFT):
        product = product * (x + F.lit(float(i)))
    return (y - 0.5) * F.log(y) - y + F.lit(HALF_LOG_2PI) + total - F.log(product)


def multivariate_digamma(x: Column, d: int) -> Column:
    return sum((digamma(x + F.lit((1 - i) / 2.0)) for i in range(1, d + 1)), F.lit(0.0))


def multivariate_lgamma(x: Column, d: int) -> Column:
    const = d * (d - 1) / 4.0 * float(np.log(np.pi))
    return sum((lgamma(x + F.lit((1 - i) / 2.0)) for i in range(1, d + 1)), F.lit(const))


def log_sum_exp(a: Column) -> Column:
    return F.array_max(a) + F.log(
        F.aggregate(F.transform(a, lambda v: F.exp(v - F.array_max(a))), F.lit(0.0), lambda s, v: s + v)
    )


def divide_by_sum(a: Column) -> Column:
    """Array divided by its sum, evaluated once: the array and its total travel together."""
    packed = F.transform(F.array(a), lambda r: F.struct(r.alias("r"), F.aggregate(r, F.lit(0.0), lambda s, v: s + v).alias("t")))
    return F.flatten(F.transform(packed, lambda p: F.transform(p["r"], lambda v: v / p["t"])))


def softmax(a: Column) -> Column:
    """Row softmax of an array column, stable against large values."""
    packed = F.transform(F.array(a), lambda r: F.struct(r.alias("r"), F.array_max(r).alias("m")))
    return divide_by_sum(F.flatten(F.transform(packed, lambda p: F.transform(p["r"], lambda v: F.exp(v - p["m"])))))


def hard_assign(resp: Column) -> Column:
    """0-based index of the largest entry; the first one wins ties."""
    return (F.array_position(resp, F.array_max(resp)) - 1).cast("int")


def np_digamma(x):
    x = np.asarray(x) + 0.0
    y = x + SHIFT
    inv = 1.0 / (y * y)
    total = np.zeros_like(y)
    for c in reversed(PSI_SERIES):
        total = (total + c) * inv
    return np.log(y) - 0.5 / y + total - sum(1.0 / (x + i) for i in range(SHIFT))


def np_trigamma(x):
    x = np.asarray(x) + 0.0
    y = x + SHIFT
    inv = 1.0 / (y * y)
    tail = 1 / y + inv / 2 + inv / y * (1 / 6 - inv * (1 / 30 - inv * (1 / 42 - inv / 30)))
    return tail + sum(1.0 / (x + i) ** 2 for i in range(SHIFT))


def np_lgamma(x):
    x = np.asarray(x) + 0.0
    y = x + SHIFT
    inv = 1.0 / (y * y)
    total = np.zeros_like(y)
    for c in reversed(GAMMA_SERIES[1:]):
        total = (total + c) * inv
    total = (total + GAMMA_SERIES[0]) / y
    logs = sum(np.log(x + i) for i in range(SHIFT))
    return (y - 0.5) * np.log(y) - y + HALF_LOG_2PI + total - logs


def np_multi(fn, x, d):
    """Sum of fn over x, x - 1/2, ..., as in the D-dimensional gamma functions."""
    return sum(fn(np.asarray(x, float) + (1 - i) / 2.0) for i in range(1, d + 1))


def np_softmax(a):
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
