"""Undirected 0/1 graphs and an assortative community model with mixed membership.

Edges are rows (src, dst). Non-edges are never listed: their number and their expected sums
follow from node totals minus the edges, so the work grows with the edges, not with the
square of the nodes.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docsift.functions import special as SP
from docsift.functions.ranking import hash_uniform
from docsift.plans.topics import entries, sum_vectors
from docsift.session import checkpointed

EPS = 1e-3


def undirected(pairs: DataFrame) -> DataFrame:
    """Distinct edges with src < dst, loops dropped."""
    return (
        pairs.where("src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def mark_heldout(edges: DataFrame, share: float, seed=0) -> DataFrame:
    return edges.withColumn("heldout", hash_uniform(seed, "src", "dst") < share)


def ends(edges: DataFrame) -> DataFrame:
    """Each edge seen from both of its nodes: (id, other, ...)."""
    both = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))
    return edges.withColumn("e", both).select("e.id", "e.other", *[c for c in edges.columns if c not in ("src", "dst")])


def pair_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_edges, n_nonedges, n_heldout) over all pairs a node takes part in."""
    held = F.col("heldout").cast("long")
    seen = ends(edges).groupBy("id").agg(F.sum(1 - held).alias("n_edges"), F.sum(held).alias("n_heldout"))
    n = nodes.select(F.count(F.lit(1))).scalar()
    joined = nodes.join(seen, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "id", zero("n_edges").alias("n_edges"), (n - 1 - zero("n_edges") - zero("n_heldout")).alias("n_nonedges"), zero("n_heldout").alias("n_heldout")
    )


def start_members(nodes: DataFrame, k: int, seed=0, floor=0.1, spread=5.0) -> DataFrame:
    """(id, alpha): seeded Dirichlet parameters per node."""
    draws = [hash_uniform(f"{seed}/{c}", "id") * spread + floor for c in range(k)]
    return nodes.select("id", F.array(*draws).alias("alpha"))


def member_logs(members: DataFrame) -> DataFrame:
    """(id, e): expected log membership."""
    total = F.aggregate("alpha", F.lit(0.0), lambda s, v: s + v)
    psi = members.select("id", "alpha", SP.digamma(total).alias("t"))
    return psi.select("id", F.transform("alpha", lambda a: SP.digamma(a) - F.col("t")).alias("e"))


def edge_shares(edges: DataFrame, logs: DataFrame, rates: list[float], y: int = 1) -> DataFrame:
    """Edges with `both` (joint membership weights) and `r` (share explained by each community).

    Joins on node ids are many edges to one node; adaptive execution splits a hub's edges.
    """
    k = len(rates)
    a = logs.select(F.col("id").alias("src"), F.col("e").alias("ea"))
    b = logs.select(F.col("id").alias("dst"), F.col("e").alias("eb"))
    joined = edges.join(a, "src").join(b, "dst")
    both = F.zip_with("ea", "eb", lambda p, q: F.exp(p + q))
    rate = F.array(*[F.lit(r if y else 1.0 - r) for r in rates])
    back = EPS if y else 1.0 - EPS
    rows = joined.withColumn("both", both).withColumn("score", F.zip_with("both", rate, lambda p, q: p * q))
    total = lambda c: sum(entries(c, k)[1:], entries(c, k)[0])
    rows = rows.withColumn("z", total("score") + (1.0 - total("both")) * back)
    return rows.withColumn("r", F.transform("score", lambda s: s / F.col("z")))


def communities(nodes: DataFrame, edges: DataFrame, k: int, n_lap: int = 5, seed=0, lam=(0.1, 0.1), alpha0: float | None = None):
    """Fit by variational coordinate ascent: (members(id, alpha), rates, trace of held-out edge log likelihood).

    An edge's mass goes to the communities that explain it, and to the node's own mix where the
    background does. The non-edges of a node all see the mean membership of the nodes it is not
    linked to, which follows from the totals: m_k exp(L_k mean_k), L_k = ln(1 - rate_k) - ln(1 - eps).
    """
    alpha0 = 1.0 / k if alpha0 is None else alpha0
    train = checkpointed(edges.where(~F.col("heldout")).select("src", "dst"))
    held = edges.where("heldout").select("src", "dst")
    n = nodes.count()
    density = 2.0 * train.count() / max(n * (n - 1.0), 1.0)
    rates = np.clip(density * (0.5 + np.random.RandomState(seed).rand(k)) * k, 1e-6, 0.9)
    members = checkpointed(start_members(nodes, k, seed))
    trace = []
    for lap in range(n_lap):
        logs = checkpointed(member_logs(members))
        weight = logs.select("id", SP.softmax(F.col("e")).alias("m"))
        shares = edge_shares(train, logs, rates.tolist())
        # one shuffle by node: shares of its edges, memberships of its neighbours, background, degree
        rest = 1.0 - sum(entries("r", k)[1:], entries("r", k)[0])
        facing = F.array(
            F.struct(F.col("src").alias("id"), "r", SP.softmax(F.col("eb")).alias("q"), rest.alias("bg")),
            F.struct(F.col("dst").alias("id"), "r", SP.softmax(F.col("ea")).alias("q"), rest.alias("bg")),
        )
        seen = shares.select(F.explode(facing).alias("f"))
        seen = seen.select("f.id", F.concat("f.r", "f.q", F.array("f.bg", F.lit(1.0))).alias("vec"))
        wide = 2 * k + 2
        seen = sum_vectors(seen, ["id"], wide)
        total = weight.select(F.array(*[F.sum(c) for c in entries("m", k)])).first()[0]
        rows = weight.join(seen, "id", "left").withColumn("vec", F.coalesce("vec", F.array(*[F.lit(0.0)] * wide)))
        cells, m = entries("vec", wide), entries("m", k)
        away = [F.greatest(F.lit(total[c]) - m[c] - cells[k + c], F.lit(0.0)) for c in range(k)]
        tilt = np.log1p(-rates) - np.log1p(-EPS)
        n_away = F.greatest(F.lit(float(n - 1)) - cells[2 * k + 1], F.lit(1e-12))
        away_mix = SP.divide_by_sum(F.array(*[m[c] * F.exp(float(tilt[c]) * away[c] / n_away) for c in range(k)]))
        rows = rows.select(
            "id",
            F.array(*[cells[c] for c in range(k)]).alias("on"),
            F.array(*[m[c] * away[c] for c in range(k)]).alias("off"),
            F.array(*[cells[c] + cells[2 * k] * m[c] for c in range(k)]).alias("linked"),
            F.transform(away_mix, lambda v: v * n_away).alias("unlinked"),
        )
        rows = checkpointed(rows)
        sums = rows.select(*[F.sum(F.col(f)[c]) for f in ("on", "off") for c in range(k)]).first()
        on, non = np.array(sums[:k]) / 2.0, np.array(sums[k:]) / 2.0
        members = rows.select("id", F.zip_with("linked", "unlinked", lambda a, b: a + b + alpha0).alias("alpha"))
        rates = np.clip((lam[0] + on) / (lam[0] + lam[1] + on + non), 1e-9, 1.0 - 1e-9)
        score = edge_shares(held, logs, rates.tolist()).select(F.avg(F.log("z")), F.count(F.lit(1))).first()
        trace.append((float(lap + 1), float(score[0] or 0.0), k, int(score[1])))
    return members, rates, trace


def assign(members: DataFrame) -> DataFrame:
    """(id, k, share): each node's main community."""
    total = F.aggregate("alpha", F.lit(0.0), lambda s, v: s + v)
    return members.select("id", SP.hard_assign(F.col("alpha")).alias("k"), (F.array_max("alpha") / total).alias("share"))


