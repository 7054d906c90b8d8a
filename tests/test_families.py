"""Beta, Dirichlet and Gaussian families against integration, against one another, and tokens of a component."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import sampling
from docsift.plans import families as B, gauss as G, topics as P


def integrated(log_density, lo, hi, n=400_001):
    """Integral of p and of -p log p by the trapezoid rule."""
    x = np.linspace(lo, hi, n)
    log_p = log_density(x)
    p = np.exp(log_p)
    step = (hi - lo) / (n - 1)
    both = [np.where(p > 0, v, 0.0) for v in (p, -p * log_p)]
    return [float((v[0] / 2 + v[1:-1].sum() + v[-1] / 2) * step) for v in both]


@pytest.mark.parametrize("a, b", [(2.0, 3.0), (7.5, 2.25), (40.0, 900.0)])
def test_beta_by_integration(spark, a, b):
    got = spark.createDataFrame([(a - 1.0, b - 1.0)], "ones double, zeros double")
    got = B.beta_posterior(got, "ones", "zeros")
    one, zero = B.beta_expected_logs(F.col("a"), F.col("b"))
    row = got.select("a", "b", one.alias("l1"), zero.alias("l0"), B.beta_log_norm(F.col("a"), F.col("b")).alias("z"), B.beta_entropy(F.col("a"), F.col("b")).alias("h")).first()
    assert (row.a, row.b) == (a, b)
    density = lambda x: (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - row.z
    mass, h = integrated(density, 1e-12, 1 - 1e-12)
    assert abs(mass - 1) < 1e-6 and abs(h - row.h) < 1e-5
    x = np.linspace(1e-9, 1 - 1e-9, 400_001)
    p = np.exp(density(x))
    assert abs((p * np.log(x)).mean() - row.l1) < 1e-4 and abs((p * np.log1p(-x)).mean() - row.l0) < 1e-4


def test_beta_counts_may_be_missing(spark):
    rows = spark.createDataFrame([("x", 0, 0), ("y", None, 3)], "s string, n1 long, n0 long")
    got = B.beta_posterior(rows, "n1", "n0", 0.5, 2.0).select("s", "a", "b").collect()
    assert [tuple(r) for r in got] == [("x", 0.5, 2.0), ("y", None, 5.0)]


def test_dirichlet_of_two_cells_is_beta(spark):
    cells = spark.createDataFrame([("k", 0, 2.5), ("k", 1, 4.0), ("other", 0, 1.0), ("k", None, 9.0)], "key string, cell int, v double")
    got = {r.key: (r.log_norm, r.entropy) for r in B.dirichlet_log_norm(cells, "key", "cell", "v").collect()}
    ab = spark.range(1).select(F.lit(2.5).alias("a"), F.lit(4.0).alias("b"))
    want = ab.select(B.beta_log_norm(F.col("a"), F.col("b")), B.beta_entropy(F.col("a"), F.col("b"))).first()
    assert np.allclose(got["k"], list(want)) and np.allclose(got["other"], [0.0, 0.0])
    assert B.dirichlet_log_norm(cells.where("false"), "key", "cell", "v").count() == 0


def test_wishart_entropy_in_one_dimension_is_gammas():
    a, b = 3.5, 1.7  # a Wishart of nu and inverse scale winv is a gamma of nu / 2 and winv / 2
    h = B.entropy("zero_mean", {"nu": np.array([2 * a]), "winv": np.array([[[2 * b]]])})[0]
    density = lambda x: a * math.log(b) - math.lgamma(a) + (a - 1) * np.log(x) - b * x
    mass, want = integrated(density, 1e-9, 40.0)
    assert abs(mass - 1) < 1e-6 and abs(h - want) < 1e-5


def test_gaussian_families_agree_in_one_dimension():
    kappa, m, a, b = np.array([2.0, 0.3]), np.array([[1.0], [-4.0]]), np.array([[3.0], [9.5]]), np.array([[0.5], [6.0]])
    diag = B.entropy("diag", {"kappa": kappa, "m": m, "a": a, "b": b})
    full = B.entropy("full", {"kappa": kappa, "m": m, "nu": 2 * a[:, 0], "winv": 2 * b[:, :, None]})
    assert np.allclose(diag, full)


def test_wishart_entropy_by_draws():
    rng = np.random.default_rng(5)
    nu, winv = 9, np.array([[2.0, 0.4], [0.4, 1.0]])
    chol = np.linalg.cholesky(np.linalg.inv(winv))
    z = rng.normal(size=(60_000, nu, 2)) @ chol.T
    lam = z.transpose(0, 2, 1) @ z
    logs = np.linalg.slogdet(lam)[1]
    log_p = 0.5 * (nu - 3) * logs - 0.5 * np.trace(winv @ lam, axis1=1, axis2=2) - G.log_norm("zero_mean", {"nu": np.array([nu]), "winv": winv[None]})[0]
    got = B.entropy("zero_mean", {"nu": np.array([nu]), "winv": winv[None]})[0]
    assert abs(got + log_p.mean()) < 0.03
    assert abs(B.log_precision("full", {"nu": np.array([nu]), "winv": winv[None]})[0] - logs.mean()) < 0.02


def test_tokens_of_a_component(spark):
    rng = random.Random(2)
    triples = [(d, w, rng.randrange(1, 5)) for d in range(30) for w in rng.sample(range(12), 5)]
    lam = {w: [rng.uniform(0.1, 3), rng.uniform(0.1, 3), rng.uniform(0.1, 3)] for w in range(12)}
    docs = {d: [rng.uniform(0.2, 4) for _ in range(3)] for d in range(30)}
    topics = spark.createDataFrame(list(lam.items()), "word_id int, lam array<double>")
    alpha = spark.createDataFrame(list(docs.items()), "doc_id int, alpha array<double>")
    rows = spark.createDataFrame(triples, "doc_id int, word_id int, cnt int")
    psi = lambda x: G.np_digamma(np.array(x))
    total = psi(np.sum(list(lam.values()), axis=0))
    for given in (None, alpha):
        want = set()
        for d, w, c in triples:
            s = np.exp(psi(lam[w]) - total + (0 if given is None else psi(docs[d])))
            if s[1] / s.sum() > 0.4:
                want.add((d, w, c))
        tokens = P.token_responsibilities(rows, topics, 3, given)
        assert {tuple(r) for r in sampling.matching_tokens(tokens, 1, 0.4).collect()} == want
        few = {tuple(r) for r in sampling.matching_tokens(tokens, 1, 0.4, 4, 7).collect()}
        chosen = {r[0] for r in few}
        assert len(chosen) == min(4, len({r[0] for r in want})) and few == {r for r in want if r[0] in chosen}
    assert sampling.matching_tokens(P.token_responsibilities(rows.where("false"), topics, 3), 0, 0.1, 5).count() == 0
