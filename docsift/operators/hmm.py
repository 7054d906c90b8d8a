"""Hidden Markov smoothing of many sequences at once, however long one of them is.

Events are put in global (key, time) order by a range exchange and cut into chunks of bounded
length. A chunk acts on the filter as one K x K matrix, so chunks are summarised in parallel,
the summaries are chained per slice and per key, and the messages that enter each chunk let
all chunks be smoothed in parallel again.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsift.functions.ranking import range_slices
from docsift.session import checkpointed

BLOCK = 2_000_000


class Hmm:
    """Start probabilities (K), transitions (K x K), emissions (K x symbols)."""

    def __init__(self, init, trans, emit):
        self.init, self.trans, self.emit = (np.asarray(a, float) for a in (init, trans, emit))
        self.k = len(self.init)

    def evidence(self, obs: np.ndarray) -> np.ndarray:
        """Rows x K likelihoods; an unknown symbol (-1) says nothing."""
        e = np.vstack([self.emit.T, np.ones(self.k)])
        return e[obs]


def chunks(events: DataFrame, key: str, order: list[str], length: int = 4096) -> DataFrame:
    """(key, slice, chunk, obs array, ids array), written once; events have columns id and obs."""
    cut = range_slices(events.select(key, *order, "id", "obs"), [key, *order, "id"])
    part = cut.withColumn("chunk", F.floor(F.col("_pos") / length))
    packed = F.sort_array(F.collect_list(F.struct("_pos", "id", "obs")))
    rows = part.groupBy(F.col(key).alias("key"), F.col("_slice").alias("slice"), "chunk").agg(packed.alias("p"))
    return checkpointed(rows.select("key", "slice", "chunk", F.col("p.obs").alias("obs"), F.col("p.id").alias("ids")))


def _blocks(pdf: pd.DataFrame, k: int):
    """Chunks of similar length together, so padding and memory stay small."""
    size = pdf["obs"].map(len).to_numpy()
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, BLOCK // max(size[order[at]] * k * k, 1))
        yield pdf.iloc[order[at : at + rows]], size[order[at : at + rows]]
        at += rows


def _evidence(block, size, hmm):
    obs = np.full((len(block), size.max()), -1)
    for n, o in enumerate(block["obs"]):
        obs[n, : len(o)] = o
    return hmm.evidence(obs)


def summaries(packed: DataFrame, hmm: Hmm) -> DataFrame:
    """(key, slice, chunk, m, ls): product of evidence and transitions over the chunk, scaled."""
    k = hmm.k

    def run(batches):
        for pdf in batches:
            for block, size in _blocks(pdf, k):
                e = _evidence(block, size, hmm)
                m = np.eye(k) * e[:, 0, None, :]
                ls = np.zeros(len(block))
                for t in range(1, size.max()):
                    live = size > t
                    step = (m[live] @ hmm.trans) * e[live, t, None, :]
                    top = step.max(axis=(1, 2))
                    m[live] = step / top[:, None, None]
                    ls[live] += np.log(top)
                yield block[["key", "slice", "chunk"]].assign(m=list(m.reshape(len(block), -1)), ls=ls)

    return packed.select("key", "slice", "chunk", "obs").mapInPandas(run, "key long, slice long, chunk long, m array<double>, ls double")


def _gathered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "m", "ls")))
    return rows.groupBy(*keys).agg(packed.alias("p")).select(*keys, F.col("p.at").alias("at"), F.col("p.m").alias("ms"), F.col("p.ls").alias("lss"))


def chained(rows: DataFrame, keys: list[str], order: str, hmm: Hmm) -> DataFrame:
    """Summaries of consecutive parts joined into one per key."""
    k = hmm.k

    def run(batches):
        for pdf in batches:
            m_out, l_out = [], []
            for ms, lss in zip(pdf["ms"], pdf["lss"]):
                m, ls = ms[0].reshape(k, k), float(lss[0])
                for nxt, l in zip(ms[1:], lss[1:]):
                    m = m @ hmm.trans @ nxt.reshape(k, k)
                    top = m.max()
                    m, ls = m / top, ls + np.log(top) + float(l)
                m_out.append(m.ravel())
                l_out.append(ls)
            yield pdf[keys].assign(m=m_out, ls=l_out)

    schema = ", ".join(f"{c} long" for c in keys) + ", m array<double>, ls double"
    return _gathered(rows, keys, order).mapInPandas(run, schema)


def log_likelihood(packed: DataFrame, hmm: Hmm) -> DataFrame:
    """(key, log_lik) of each whole sequence."""
    whole = chained(chained(summaries(packed, hmm), ["key", "slice"], "chunk", hmm), ["key"], "slice", hmm)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["m"]).reshape(len(pdf), hmm.k, hmm.k)
                yield pdf[["key"]].assign(log_lik=np.log((hmm.init @ m).sum(1)) + pdf["ls"])

    return whole.mapInPandas(run, "key long, log_lik double")


def messages(rows: DataFrame, parents: DataFrame | None, keys: list[str], order: str, hmm: Hmm, state: DataFrame | None = None) -> DataFrame:
    """What enters each part from both sides: (keys, order, f, b); f is empty at a sequence's start.

    `parents` carries the messages entering the whole run of parts; none means whole sequences,
    which start afresh or from the filters in `state` (key, f).
    """
    k = hmm.k
    grouped = _gathered(rows, keys, order)
    if parents is None:
        fresh = F.array().cast("array<double>")
        if state is not None:
            grouped = grouped.join(state.select("key", "f"), "key", "left").withColumn("f", F.coalesce("f", fresh))
        else:
            grouped = grouped.withColumn("f", fresh)
        grouped = grouped.withColumn("b", F.array(*[F.lit(1.0)] * k))
    else:
        grouped = grouped.join(parents, keys)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                ms = [m.reshape(k, k) for m in row.ms]
                f, fs = np.asarray(row.f, float), []
                for m in ms:
                    fs.append(f)
                    f = (hmm.init if len(f) == 0 else f @ hmm.trans) @ m
                    f = f / f.sum()
                b, bs = np.asarray(row.b, float), []
                for m in reversed(ms):
                    bs.append(b)
                    b = hmm.trans @ (m @ b)
                    b = b / b.sum()
                for at, f0, b0 in zip(row.at, fs, reversed(bs)):
                    out.append((*[getattr(row, c) for c in keys], at, f0, b0))
            yield pd.DataFrame(out, columns=[*keys, order, "f", "b"])

    schema = ", ".join(f"{c} long" for c in [*keys, order]) + ", f array<double>, b array<double>"
    return grouped.mapInPandas(run, schema)


def smooth(packed: DataFrame, hmm: Hmm) -> DataFrame:
    """(key, id, resp, pair): state probabilities of each event, and of it with the one before.

    `pair` is a K x K array in row order, null for the first event of a sequence.
    """
    rows = _with_messages(packed, checkpointed(summaries(packed, hmm)), hmm)

    def run(batches):
        for pdf in batches:
            for block, size in _blocks(pdf, hmm.k):
                yield _smooth_block(block, size, hmm)

    return rows.mapInPandas(run, "key long, id long, resp array<double>, pair array<double>")


def _with_messages(packed, parts, hmm, state=None):
    per_slice = chained(parts, ["key", "slice"], "chunk", hmm)
    into_slice = messages(per_slice, None, ["key"], "slice", hmm, state)
    into_chunk = messages(parts, into_slice, ["key", "slice"], "chunk", hmm)
    return packed.join(into_chunk, ["key", "slice", "chunk"])


def filter_forward(packed: DataFrame, hmm: Hmm, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Forward filters (key, id, f), and the state (key, f, log_lik) after the last event of each key.

    `state` continues earlier sequences. Both results are cheap in the number of keys, and a key
    with very many events is spread over its chunks.
    """
    parts = checkpointed(summaries(packed, hmm))
    rows = _with_messages(packed, parts, hmm, state)

    def run(batches):
        for pdf in batches:
            for block, size in _blocks(pdf, hmm.k):
                fwd = _forward(block, size, _evidence(block, size, hmm), hmm)[0]
                live = np.arange(size.max()) < size[:, None]
                yield pd.DataFrame({"key": np.repeat(block["key"].to_numpy(), size), "id": np.concatenate(block["ids"].to_numpy()), "f": list(fwd[live])})

    filters = rows.select("key", "ids", "obs", "f", "b").mapInPandas(run, "key long, id long, f array<double>")
    whole = chained(chained(parts, ["key", "slice"], "chunk", hmm), ["key"], "slice", hmm)
    if state is None:
        whole = whole.withColumn("f", F.array().cast("array<double>")).withColumn("log_lik", F.lit(0.0))
    else:
        whole = whole.join(state, "key", "full")

    def last(batches):
        for pdf in batches:
            out = []
            for key, m, ls, f, ll in zip(pdf["key"], pdf["m"], pdf["ls"], pdf["f"], pdf["log_lik"]):
                if m is not None:
                    start = hmm.init if f is None or len(f) == 0 else np.asarray(f) @ hmm.trans
                    new = start @ m.reshape(hmm.k, hmm.k)
                    f, ll = new / new.sum(), (0.0 if pd.isna(ll) else ll) + float(np.log(new.sum())) + ls
                out.append((key, f, ll))
            yield pd.DataFrame(out, columns=["key", "f", "log_lik"])

    return filters, whole.select("key", "m", "ls", "f", "log_lik").mapInPandas(last, "key long, f array<double>, log_lik double")


def _forward(block, size, e, hmm):
    first = block["f"].map(len).to_numpy() == 0
    prev = np.stack([f if len(f) else np.zeros(hmm.k) for f in block["f"]])
    fwd = np.zeros((len(block), size.max(), hmm.k))
    for t in range(size.max()):
        pred = (prev if t == 0 else fwd[:, t - 1]) @ hmm.trans
        if t == 0:
            pred[first] = hmm.init
        f = pred * e[:, t]
        fwd[:, t] = f / f.sum(1, keepdims=True)
    return fwd, prev, first


def _smooth_block(block, size, hmm):
    n, k = len(block), hmm.k
    e = _evidence(block, size, hmm)
    fwd, prev, first = _forward(block, size, e, hmm)
    back = np.zeros((n, size.max(), k))
    last = np.stack(block["b"])
    for t in range(size.max() - 1, -1, -1):
        inner = size > t + 1
        back[~inner, t] = last[~inner]
        if inner.any():
            b = (e[inner, t + 1] * back[inner, t + 1]) @ hmm.trans.T
            back[inner, t] = b / b.sum(1, keepdims=True)
    resp = fwd * back
    resp /= resp.sum(2, keepdims=True)
    before = np.concatenate([prev[:, None], fwd[:, :-1]], 1)
    pair = before[..., None] * hmm.trans * (e * back)[:, :, None, :]
    total = pair.sum((2, 3), keepdims=True)
    pair = pair / np.where(total > 0, total, 1.0)
    live = np.arange(size.max()) < size[:, None]
    pairs = list(pair[live].reshape(-1, k * k))
    starts = np.zeros_like(live)
    starts[first, 0] = True
    for at in np.flatnonzero(starts[live]):
        pairs[at] = None
    return pd.DataFrame({"key": np.repeat(block["key"].to_numpy(), size), "id": np.concatenate(block["ids"].to_numpy()), "resp": list(resp[live]), "pair": pairs})
