"""Gaussian mixtures: EM, variational Bayes, Dirichlet process, hard Dirichlet process.

A lap is one `mapInPandas` over the vectors: it computes responsibilities batch by batch and
sends out only sums per partition, K x D x D numbers. The sums are added by a groupBy.
"""
from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsift.functions.ranking import hash_key, hash_uniform
from docsift.functions.special import np_digamma, np_lgamma, np_softmax
from docsift.operators import stats as ST
from docsift.plans import gauss as G


@dataclass
class Mixture:
    """alloc: "em", "vb", "dp" or "dp_hard"; obs: "full", "zero_mean" or "diag"."""

    alloc: str
    obs: str
    k: int
    dim: int
    prior: dict
    alpha0: float = 1.0
    weights: dict = field(default_factory=dict)
    comps: dict = field(default_factory=dict)

    def m_step(self, ss: dict) -> "Mixture":
        """A copy with parameters refitted to the statistics."""
        new = copy.deepcopy(self)
        n = ss["N"]
        new.k = len(n)
        if self.alloc == "em":
            w = n + (self.alpha0 - 1.0)
            new.weights = {"w": w / w.sum()}
            new.comps = G.maximum_likelihood(self.obs, ss)
        else:
            new.weights = self._posterior_weights(n)
            new.comps = G.posterior(self.obs, self.prior, ss)
        return new

    def _posterior_weights(self, n: np.ndarray) -> dict:
        if self.alloc == "vb":
            return {"alpha": self.alpha0 + n}
        return {"a": 1.0 + n, "b": self.alpha0 + np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)}

    def log_weights(self) -> np.ndarray:
        w = self.weights
        if self.alloc == "em":
            return np.log(np.maximum(w["w"], 1e-300))
        if self.alloc == "vb":
            return np_digamma(w["alpha"]) - np_digamma(w["alpha"].sum())
        both = np_digamma(w["a"] + w["b"])
        log_v, log_1mv = np_digamma(w["a"]) - both, np_digamma(w["b"]) - both
        return log_v + np.append(0.0, np.cumsum(log_1mv)[:-1])

    def log_lik(self, x: np.ndarray) -> np.ndarray:
        """Rows x components evidence, weights included."""
        density = G.log_pdf if self.alloc == "em" else G.expected_log_pdf
        return self.log_weights() + density(self.obs, self.comps, x)

    def resp(self, log_lik: np.ndarray) -> np.ndarray:
        if self.alloc == "dp_hard":
            return np.eye(log_lik.shape[1])[log_lik.argmax(1)]
        return np_softmax(log_lik)

    def weight_bound(self, n: np.ndarray) -> float:
        """Allocation part of the bound at the optimal weight posterior."""
        if self.alloc == "vb":
            z = lambda a: np_lgamma(a).sum() - np_lgamma(a.sum())
            return float(z(self.alpha0 + n) - z(np.full(len(n), self.alpha0)))
        w = self._posterior_weights(n)
        z = lambda a, b: np_lgamma(a) + np_lgamma(b) - np_lgamma(a + b)
        return float(z(w["a"], w["b"]).sum() - len(n) * z(1.0, self.alpha0))

    def elbo(self, ss: dict) -> float:
        """Bound on the evidence of data with these statistics, parameters refitted to them."""
        if self.alloc == "em":
            return float(ss["evidence"])
        n = ss["N"]
        post, pri = G.posterior(self.obs, self.prior, ss), self.prior
        data = G.log_norm(self.obs, post).sum() - len(n) * G.log_norm(self.obs, pri)
        entropy = 0.0 if self.alloc == "dp_hard" else -ss["rlogr"].sum()
        return float(data - 0.5 * n.sum() * self.dim * G.LOG_2PI + self.weight_bound(n) + entropy)


    def bound(self, ss: dict) -> float:
        """Bound of the model as it stands on data with these statistics.

        The bound at the statistics that the parameters hold, plus what the others add under them.
        """
        if self.alloc == "em":
            return float(ss["evidence"])
        own = G.held(self.obs, self.prior, self.comps)
        more = {f: ss[f] - own[f] for f in ("N", "x", "xx")}
        n = self.weights["alpha"] - self.alpha0 if self.alloc == "vb" else self.weights["a"] - 1.0
        held = G.log_norm(self.obs, self.comps).sum() - self.k * G.log_norm(self.obs, self.prior)
        data = held + G.expected_sum(self.obs, self.comps, more).sum() - 0.5 * ss["N"].sum() * self.dim * G.LOG_2PI
        weights = self.weight_bound(n) + float(((ss["N"] - n) * self.log_weights()).sum())
        entropy = 0.0 if self.alloc == "dp_hard" else -ss["rlogr"].sum()
        return float(data + weights + entropy)


def shapes(model: Mixture, pairs: bool = False) -> dict:
    k, d = model.k, model.dim
    out = {"N": (k,), "x": (k, d), "xx": (k, d) if model.obs == "diag" else (k, d, d), "rlogr": (k,), "evidence": (), "rows": ()}
    return {**out, "pair": (k, k)} if pairs else out


def xlogx(r: np.ndarray) -> np.ndarray:
    return np.where(r > 0, r * np.log(np.maximum(r, 1e-300)), 0.0)


def batch_sums(obs: str, x: np.ndarray, r: np.ndarray, log_lik=None, pairs: bool = False) -> dict:
    """All statistics of one Arrow batch."""
    out = G.moments(obs, x, r)
    out["rlogr"] = xlogx(r).sum(0)
    out["rows"] = np.asarray(float(len(x)))
    if log_lik is not None:
        top = log_lik.max(1)
        out["evidence"] = np.asarray((top + np.log(np.exp(log_lik - top[:, None]).sum(1))).sum())
    if pairs:
        k = r.shape[1]
        both = np.zeros((k, k))
        for a in range(k):
            both[a, a + 1 :] = xlogx(r[:, [a]] + r[:, a + 1 :]).sum(0)
        out["pair"] = both
    return out


def long_rows(sums: dict) -> pd.DataFrame:
    """Arrays as rows of the stats table."""
    parts = []
    for name, a in sums.items():
        a = np.asarray(a)
        ix = np.unravel_index(np.arange(a.size), a.shape) if a.ndim else ()
        cols = [ix[n] if n < a.ndim else np.full(a.size, -1) for n in range(3)]
        parts.append(pd.DataFrame({"field": name, "k": cols[0], "i": cols[1], "j": cols[2], "value": a.ravel()}))
    out = pd.concat(parts)
    return out.astype({"k": "int32", "i": "int32", "j": "int32"})


def _sums_by_partition(step: Callable[[pd.DataFrame], dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            if len(pdf):
                for name, v in step(pdf).items():
                    acc[name] = acc[name] + v if name in acc else v
        if acc:
            yield long_rows(acc)

    return run


def resp_stats(rows: DataFrame, obs: str, pairs: bool = False) -> DataFrame:
    """Stats of rows(x, resp) with given responsibilities."""

    def step(pdf):
        return batch_sums(obs, np.stack(pdf["x"]), np.stack(pdf["resp"]), pairs=pairs)

    return ST.total(rows.select("x", "resp").mapInPandas(_sums_by_partition(step), ST.SCHEMA))


def model_stats(vectors: DataFrame, model: Mixture, pairs: bool = False) -> DataFrame:
    """E step and sums in one pass."""

    def step(pdf):
        x = np.stack(pdf["x"])
        ll = model.log_lik(x)
        return batch_sums(model.obs, x, model.resp(ll), ll, pairs)

    return ST.total(vectors.select("x").mapInPandas(_sums_by_partition(step), ST.SCHEMA))


def score_vectors(vectors: DataFrame, model: Mixture) -> DataFrame:
    """(id, log_lik, resp) of each vector under the model."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                ll = model.log_lik(np.stack(pdf["x"]))
                yield pd.DataFrame({"id": pdf["id"], "log_lik": list(ll), "resp": list(model.resp(ll))})

    return vectors.select("id", "x").mapInPandas(run, "id long, log_lik array<double>, resp array<double>")


def data_covariance(vectors: DataFrame, label: str | None = None) -> DataFrame:
    """(i, j, cov): biased covariance, or the size-weighted mean of the covariances within labels."""
    rows = vectors.select(F.col(label).alias("g") if label else F.lit(0).alias("g"), "x")

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                x = np.stack(part["x"])
                v = [len(x), x.sum(0), x.T @ x]
                acc[g] = [a + b for a, b in zip(acc[g], v)] if g in acc else v
        for g, (n, s, xx) in acc.items():
            yield long_rows({"N": np.array([float(n)]), "x": s[None], "xx": xx[None]}).assign(k=np.int32(g))

    long = ST.total(rows.mapInPandas(run, ST.SCHEMA))
    n = long.where("field = 'N'").select("k", F.col("value").alias("n"))
    s = long.where("field = 'x'").select("k", "i", F.col("value").alias("s"))
    xx = long.where("field = 'xx'").select("k", "i", "j", "value").join(n, "k")
    full = xx.join(s, ["k", "i"]).join(s.select("k", F.col("i").alias("j"), F.col("s").alias("t")), ["k", "j"])
    within = F.col("value") - F.col("s") * F.col("t") / F.col("n")
    total = n.select(F.sum("n")).scalar()
    return full.groupBy("i", "j").agg(F.sum(within).alias("c")).select("i", "j", (F.col("c") / total).alias("cov"))


def one_hot(label, k: int):
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("double"))


def new_model(vectors: DataFrame, alloc: str, obs: str, k: int, alpha0=1.0, cov=None, **prior) -> Mixture:
    d = vectors.select(F.size("x")).first()[0]
    return Mixture(alloc, obs, k, d, G.prior(obs, d, cov, **prior), alpha0)


def init_resp(vectors: DataFrame, k: int, how: str = "randexamples", seed=0) -> DataFrame:
    """Rows (id, x, resp) that a first M step turns into a starting model."""
    if how == "randsoftpartition":
        raw = F.array(*[hash_uniform(f"{seed}/{c}", "id") + 1e-12 for c in range(k)])
        total = F.aggregate("raw", F.lit(0.0), lambda s, v: s + v)
        return vectors.withColumn("raw", raw).withColumn("t", total).select(
            "id", "x", F.transform("raw", lambda v: v / F.col("t")).alias("resp")
        )
    if how == "randexamples":
        picked = vectors.orderBy(hash_key(seed, "id"), "id").limit(k).select("id", "x").collect()
    elif how == "randexamplesbydist":
        picked = _spread_examples(vectors, k, seed)
    elif how == "randomnaive":
        cov = data_covariance(vectors).where("i = j").orderBy("i").toPandas()["cov"].to_numpy()
        fake = np.sqrt(cov) * np.random.RandomState(seed).randn(k, len(cov))
        picked = [(-1 - n, x.tolist()) for n, x in enumerate(fake)]
    else:
        raise ValueError(how)
    rows = [(int(r[0]), [float(v) for v in r[1]], [float(n == c) for c in range(k)]) for n, r in enumerate(picked)]
    # k rows
    return vectors.sparkSession.createDataFrame(rows, "id long, x array<double>, resp array<double>")


def _spread_examples(vectors: DataFrame, k: int, seed) -> list:
    """k examples, each drawn with chance proportional to its squared distance to those before.

    The draw is a race: the row with the least -ln(u) / distance wins, one job per example.
    """
    picked = vectors.orderBy(hash_key(seed, "id"), "id").limit(1).select("id", "x").collect()
    while len(picked) < k:
        dists = [
            F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in p["x"]]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
            for p in picked
        ]
        near = F.least(*dists) if len(dists) > 1 else dists[0]
        race = -F.log(hash_uniform(f"{seed}/{len(picked)}", "id") + 1e-12) / near
        picked += vectors.where(near > 0).orderBy(race, "id").limit(1).select("id", "x").collect()
    return picked


def start(vectors: DataFrame, model: Mixture, how="randexamples", seed=0) -> Mixture:
    rows = init_resp(vectors, model.k, how, seed)
    return model.m_step(ST.to_numpy(resp_stats(rows, model.obs), shapes(model)))


def start_from_labels(vectors: DataFrame, model: Mixture, repeats: int = 1, seed=0) -> Mixture:
    """A component for each label 0 .. or, if repeated, for each label in each of `repeats` random parts of the rows.

    The model must have labels x repeats components; rows (id, x, label) are dealt to parts by their id.
    """
    label = F.col("label")
    if repeats > 1:
        label = label + (model.k // repeats) * F.floor(hash_uniform(f"repeat {seed}", "id") * repeats)
    rows = vectors.withColumn("resp", one_hot(label, model.k))
    return model.m_step(ST.to_numpy(resp_stats(rows, model.obs), shapes(model)))


def same_figures(a: float, b: float, digits: int = 6) -> bool:
    """Equal to `digits` significant figures."""
    return a == b or abs(a - b) <= 10.0 ** (1 - digits) * max(abs(a), abs(b)) / 2


def fit(
    vectors: DataFrame,
    model: Mixture,
    n_lap: int = 10,
    digits: int = 6,
    callbacks: dict[str, Callable] | None = None,
    after_lap: Callable | None = None,
    first_lap: int = 0,
):
    """Full-data learner. Returns (model, trace rows). One job per lap.

    `callbacks` may hold onLapComplete and onAlgorithmComplete, called with (model, percent, info).
    `after_lap(model, stats)` may change the model's structure (merges and births).
    """
    trace, last, hooks = [], None, callbacks or {}
    began = time.time()
    for lap in range(first_lap, n_lap):
        ss = ST.to_numpy(model_stats(vectors, model, pairs=after_lap is not None), shapes(model, after_lap is not None))
        bound = model.elbo(ss)
        if after_lap is not None:
            model, ss, bound = after_lap(model, ss, bound)
        model = model.m_step(ss)
        trace.append((float(lap + 1), bound, model.k, int(ss["rows"]), time.time() - began))
        if "onLapComplete" in hooks:
            hooks["onLapComplete"](model, (lap + 1) / n_lap, trace[-1])
        if last is not None and same_figures(last, bound, digits):
            break
        last = bound
    if "onAlgorithmComplete" in hooks:
        hooks["onAlgorithmComplete"](model, 1.0, trace)
    return model, trace


def trace_table(spark, trace) -> DataFrame:
    return spark.createDataFrame(trace, "lap double, elbo double, k int, n_obs long, secs double")


def best_of(vectors: DataFrame, model: Mixture, seeds, n_lap: int, how="randexamples"):
    """The run with the highest bound among random restarts."""
    runs = [(s, *fit(vectors, start(vectors, model, how, s), n_lap)) for s in seeds]
    return max(runs, key=lambda r: r[2][-1][1]), runs


def comp_table(spark, model: Mixture) -> DataFrame:
    """comp(k, weight, mean, scale): one row per component."""
    w = np.exp(model.log_weights())
    w = w / w.sum()
    mean = model.comps.get("m", np.zeros((model.k, model.dim)))
    scale = next(model.comps[f] for f in ("var", "cov", "winv", "b") if f in model.comps)
    rows = [(k, float(w[k]), mean[k].tolist(), np.ravel(scale[k]).tolist()) for k in range(model.k)]
    return spark.createDataFrame(rows, "k int, weight double, mean array<double>, scale array<double>")
