"""Parameter updates of Gaussian components (K x D x D numbers, numpy on small arrays).

obs: "full" and "zero_mean" keep matrices, "diag" keeps vectors. With a prior the updates are
the conjugate ones (Gauss-Wishart, Wishart, Gauss-Gamma); without one, maximum likelihood.
"""
from __future__ import annotations

import numpy as np

from docsift.functions.special import np_digamma, np_lgamma, np_multi

LOG_2PI = float(np.log(2 * np.pi))


def prior(obs: str, d: int, cov=None, kappa=1e-4, a=1.0, b=2.0):
    """Default prior parameters; `cov` is the expected covariance (identity if not given)."""
    cov = np.eye(d) if cov is None else np.asarray(cov, float)
    if obs == "diag":
        return {"m": np.zeros(d), "kappa": kappa, "a": np.full(d, a), "b": np.full(d, b)}
    nu = d + 2.0
    return {"m": np.zeros(d), "kappa": kappa, "nu": nu, "winv": cov * (nu - d - 1)}


def empty(obs: str, k: int, d: int) -> dict:
    xx = (k, d) if obs == "diag" else (k, d, d)
    return {"N": np.zeros(k), "x": np.zeros((k, d)), "xx": np.zeros(xx)}


def moments(obs: str, x: np.ndarray, r: np.ndarray) -> dict:
    """Sums of r, r x and r x^2 (or r x x') over the rows of one Arrow batch."""
    out = {"N": r.sum(0), "x": r.T @ x}
    if obs == "diag":
        out["xx"] = r.T @ (x * x)
    else:
        out["xx"] = np.stack([(x * r[:, [k]]).T @ x for k in range(r.shape[1])])
    return out


def maximum_likelihood(obs: str, ss: dict, min_covar=1e-8) -> dict:
    n = np.maximum(ss["N"], 1e-300)
    d = ss["x"].shape[1]
    if obs == "zero_mean":
        return {"m": np.zeros_like(ss["x"]), "cov": ss["xx"] / n[:, None, None] + min_covar * np.eye(d)}
    m = ss["x"] / n[:, None]
    if obs == "diag":
        return {"m": m, "var": ss["xx"] / n[:, None] - m * m + min_covar}
    outer = m[:, :, None] * m[:, None, :]
    return {"m": m, "cov": ss["xx"] / n[:, None, None] - outer + min_covar * np.eye(d)}


def log_pdf(obs: str, p: dict, x: np.ndarray) -> np.ndarray:
    """Rows x components log density."""
    if obs == "diag":
        out = [-0.5 * (LOG_2PI * x.shape[1] + np.log(v).sum() + ((x - m) ** 2 / v).sum(1)) for m, v in zip(p["m"], p["var"])]
        return np.stack(out, 1)
    out = []
    for m, cov in zip(p["m"], p["cov"]):
        chol = np.linalg.cholesky(cov)
        z = np.linalg.solve(chol, (x - m).T)
        out.append(-0.5 * (LOG_2PI * x.shape[1] + (z * z).sum(0)) - np.log(np.diag(chol)).sum())
    return np.stack(out, 1)


def posterior(obs: str, pri: dict, ss: dict) -> dict:
    n, x, xx = ss["N"], ss["x"], ss["xx"]
    if obs == "zero_mean":
        return {"nu": pri["nu"] + n, "winv": pri["winv"] + xx}
    kappa = pri["kappa"] + n
    m = (pri["kappa"] * pri["m"] + x) / kappa[:, None]
    if obs == "diag":
        b = pri["b"] + 0.5 * (xx + pri["kappa"] * pri["m"] ** 2 - kappa[:, None] * m * m)
        return {"kappa": kappa, "m": m, "a": pri["a"] + 0.5 * n[:, None], "b": b}
    outer = lambda v: v[..., :, None] * v[..., None, :]
    winv = pri["winv"] + xx + pri["kappa"] * outer(pri["m"]) - kappa[:, None, None] * outer(m)
    return {"kappa": kappa, "m": m, "nu": pri["nu"] + n, "winv": winv}


def expected_log_pdf(obs: str, q: dict, x: np.ndarray) -> np.ndarray:
    """E[log p(x)] under the posterior of each component, constant included."""
    d = x.shape[1]
    if obs == "diag":
        rate = q["a"] / q["b"]
        const = 0.5 * (np_digamma(q["a"]) - np.log(q["b"])).sum(1) - 0.5 * d / q["kappa"]
        dist = np.stack([((x - m) ** 2 * r).sum(1) for m, r in zip(q["m"], rate)], 1)
        return const - 0.5 * dist - 0.5 * d * LOG_2PI
    out = []
    for k in range(len(q["nu"])):
        nu, chol = q["nu"][k], np.linalg.cholesky(q["winv"][k])
        m = q["m"][k] if "m" in q else np.zeros(d)
        z = np.linalg.solve(chol, (x - m).T)
        log_det = np_multi(np_digamma, nu / 2.0, d) + d * np.log(2.0) - 2 * np.log(np.diag(chol)).sum()
        spread = 0.5 * d / q["kappa"][k] if "kappa" in q else 0.0
        out.append(0.5 * log_det - 0.5 * nu * (z * z).sum(0) - spread - 0.5 * d * LOG_2PI)
    return np.stack(out, 1)


def expected_sum(obs: str, q: dict, ss: dict) -> np.ndarray:
    """Per component: the expected log density summed over rows with these statistics, 2 pi left out."""
    n, x, xx = ss["N"], ss["x"], ss["xx"]
    d = x.shape[1]
    if obs == "diag":
        rate, m = q["a"] / q["b"], q["m"]
        const = 0.5 * (np_digamma(q["a"]) - np.log(q["b"])).sum(1) - 0.5 * d / q["kappa"]
        return n * const - 0.5 * (rate * (xx - 2.0 * m * x + n[:, None] * m * m)).sum(1)
    m = q["m"] if "m" in q else np.zeros_like(x)
    cross = m[:, :, None] * x[:, None, :]
    spread = xx - cross - cross.transpose(0, 2, 1) + n[:, None, None] * m[:, :, None] * m[:, None, :]
    log_det = np.array([np_multi(np_digamma, nu / 2.0, d) for nu in q["nu"]]) + d * np.log(2.0) - np.linalg.slogdet(q["winv"])[1]
    near = q["nu"] * np.trace(np.linalg.solve(q["winv"], spread), axis1=1, axis2=2)
    return 0.5 * (n * log_det - near - n * (d / q["kappa"] if "kappa" in q else 0.0))


def held(obs: str, pri: dict, q: dict) -> dict:
    """The statistics to which these parameters would be the posterior."""
    a, b = natural(obs, q), natural(obs, {f: np.asarray(v, float) for f, v in pri.items()})
    if obs == "zero_mean":
        return {"N": a["nu"] - b["nu"], "x": np.zeros(a["winv"].shape[:2]), "xx": a["winv"] - b["winv"]}
    xx = 2.0 * (a["b"] - b["b"]) if obs == "diag" else a["winv"] - b["winv"]
    return {"N": a["kappa"] - b["kappa"], "x": a["km"] - b["km"], "xx": xx}


def log_norm(obs: str, q: dict) -> np.ndarray:
    """Log normaliser of each posterior (or of a prior given as one component)."""
    if obs == "diag":
        per_dim = np_lgamma(q["a"]) - q["a"] * np.log(q["b"]) + 0.5 * LOG_2PI
        return per_dim.sum(-1) - 0.5 * q["a"].shape[-1] * np.log(q["kappa"])
    d = q["winv"].shape[-1]
    nu = q["nu"]
    wishart = (
        0.5 * nu * d * np.log(2.0)
        - 0.5 * nu * np.linalg.slogdet(q["winv"])[1]
        + np_multi(np_lgamma, np.asarray(nu) / 2.0, d)
        + d * (d - 1) / 4.0 * np.log(np.pi)
    )
    if obs == "zero_mean":
        return wishart
    return wishart + 0.5 * d * (LOG_2PI - np.log(q["kappa"]))


def natural(obs: str, q: dict) -> dict:
    """Natural parameters: linear in the statistics, so they blend linearly."""
    if obs == "zero_mean":
        return dict(q)
    kappa = q["kappa"][..., None]
    out = {"kappa": q["kappa"], "km": kappa * q["m"]}
    if obs == "diag":
        return {**out, "a": q["a"], "b": q["b"] + 0.5 * kappa * q["m"] ** 2}
    return {**out, "nu": q["nu"], "winv": q["winv"] + kappa[..., None] * q["m"][..., :, None] * q["m"][..., None, :]}


def from_natural(obs: str, t: dict) -> dict:
    if obs == "zero_mean":
        return dict(t)
    kappa = t["kappa"][..., None]
    m = t["km"] / kappa
    out = {"kappa": t["kappa"], "m": m}
    if obs == "diag":
        return {**out, "a": t["a"], "b": t["b"] - 0.5 * kappa * m * m}
    return {**out, "nu": t["nu"], "winv": t["winv"] - kappa[..., None] * m[..., :, None] * m[..., None, :]}


def blend(obs: str, old: dict, new: dict, rho: float) -> dict:
    """(1 - rho) old + rho new in natural parameters."""
    a, b = natural(obs, old), natural(obs, new)
    return from_natural(obs, {f: (1 - rho) * a[f] + rho * b[f] for f in a})
