"""Topic models: LDA and the hierarchical Dirichlet process, by variational coordinate ascent.

Documents are independent given the topics, so the E step is a `mapInPandas` over document
rows. It sends out sums by word, already added up over the task's documents (or a chunk of them,
if the topic table is large); a groupBy adds them. The topic table stays a DataFrame (word_id, lam array of K). When
V x K doubles fit under `limit_bytes` it is shipped to the tasks as an array; beyond that documents are dealt
to blocks, and a block gets the topic rows of its own words, each once.
"""
from __future__ import annotations

import copy
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docsift.functions import special as SP
from docsift.functions.ranking import hash_key, hash_uniform
from docsift.operators import bow
from docsift.operators.vectors import sparse_vectors
from docsift.plans.mixture import same_figures, xlogx
from docsift.session import checkpointed, written
from docsift.sources.tables import spread

OUT = "kind string, id long, vec array<double>"
CHUNK = 20_000
ROWS = 20_000  # of a batch that a task sends out


@dataclass
class TopicModel:
    """kind: "lda" or "hdp"; sticks: "full" or "point"; assign: soft, hard, soft2hard or mode."""

    k: int
    vocab_size: int
    kind: str = "hdp"
    lam0: float = 0.01
    alpha0: float = None  # 1 for lda, 5 for hdp
    gamma: float = 0.5
    sticks: str = "full"
    assign: str = "soft"
    limit_bytes: int = 64 << 20
    u1: np.ndarray = field(default=None)
    u0: np.ndarray = field(default=None)
    topics: DataFrame = field(default=None, repr=False)
    matrix: np.ndarray = field(default=None, repr=False)
    mass: np.ndarray = field(default=None, repr=False)  # topic totals of a table too large to ship, once they are known

    def __post_init__(self):
        if self.alpha0 is None:
            self.alpha0 = 1.0 if self.kind == "lda" else 5.0
        if self.kind == "hdp" and self.u1 is None:
            self.set_beta(np.ones(self.k))

    def set_beta(self, beta: np.ndarray) -> None:
        """Stick parameters whose mean gives these topic weights, with 1/100 of the least left over.

        Their totals are those of the prior, one plus alpha0.
        """
        rest = np.append(np.cumsum(beta[::-1])[::-1][1:], 0.0) + beta.min() / 100.0  # weight behind each topic
        v = beta / (beta + rest)
        self.u1, self.u0 = (1.0 + self.alpha0) * v, (1.0 + self.alpha0) * (1.0 - v)

    def beta(self) -> np.ndarray:
        return weights_of(self.u1 / (self.u1 + self.u0))

    def doc_prior(self) -> np.ndarray:
        """Dirichlet prior of a document's topic mix: K entries, or K + 1 with the unused rest."""
        if self.kind == "lda":
            return np.full(self.k, self.alpha0)
        return self.gamma * self.beta()

    def replace(self, **changes) -> "TopicModel":
        new = copy.copy(self)
        new.matrix = new.mass = None
        for name, v in changes.items():
            setattr(new, name, v)
        return new

    def fits(self) -> bool:
        return self.vocab_size * self.k * 8 <= self.limit_bytes


def weights_of(v: np.ndarray) -> np.ndarray:
    """Weights from stick fractions, the leftover last; works along the last axis."""
    one = np.ones((*v.shape[:-1], 1))
    rest = np.concatenate([one, np.cumprod(1.0 - v, axis=-1)], axis=-1)
    return np.concatenate([v, one], axis=-1) * rest


# --- topic tables -------------------------------------------------------------------------


def entries(col, n: int) -> list[Column]:
    return [F.get(col, F.lit(i)) for i in range(n)]


def sum_vectors(rows: DataFrame, keys: list[str], n: int, col: str = "vec") -> DataFrame:
    """Element-wise sum of arrays: n ordinary sums, combined before the shuffle."""
    sums = [F.sum(c).alias(f"_{i}") for i, c in enumerate(entries(F.col(col), n))]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"_{i}" for i in range(n)]).alias(col))


def every_word(vocab: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(word_id, vec): the counts of every word of the vocabulary, zeros where there are none."""
    zero = F.array(*[F.lit(0.0)] * k)
    return vocab.select("word_id").join(counts, "word_id", "left").select("word_id", F.coalesce("vec", zero).alias("vec"))


def topics_from_counts(vocab: DataFrame | None, counts: DataFrame, lam0: float, k: int) -> DataFrame:
    """(word_id, lam): prior plus counts (word_id, vec) for every word of the vocabulary; None: counts have them all."""
    whole = counts if vocab is None else every_word(vocab, counts, k)
    return whole.select("word_id", F.transform("vec", lambda c: c + lam0).alias("lam"))


def totals(topics: DataFrame, k: int) -> Column:
    """Array of the K topic totals as a scalar subquery."""
    return topics.select(F.array(*[F.sum(c) for c in entries("lam", k)])).scalar()


def e_log_phi(topics: DataFrame, k: int) -> DataFrame:
    """(word_id, phi): expected log probability of the word under each topic."""
    psi = totals(topics.select("lam"), k)
    t = topics.withColumn("t", psi)
    return t.select("word_id", F.zip_with("lam", "t", lambda a, b: SP.digamma(a) - SP.digamma(b)).alias("phi"))


def token_loglik(triples: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """Each triple with its row of topic log probabilities."""
    return triples.join(e_log_phi(topics, k), "word_id")


def token_responsibilities(triples: DataFrame, topics: DataFrame, k: int, docs: DataFrame | None = None) -> DataFrame:
    """Each triple with `resp`, its responsibilities, given its document's posterior `alpha` in docs or none yet."""
    rows = token_loglik(triples, topics, k)
    score = F.col("phi")
    if docs is not None:
        rows = rows.join(docs.select("doc_id", "alpha"), "doc_id")
        score = F.zip_with(F.transform(F.slice("alpha", 1, k), SP.digamma), "phi", lambda a, b: a + b)
    return rows.select("doc_id", "word_id", "cnt", SP.softmax(score).alias("resp"))


def topic_shares(topics: DataFrame, k: int) -> DataFrame:
    """(word_id, phi): mean topic-word probabilities."""
    t = topics.withColumn("t", totals(topics, k))
    return t.select("word_id", F.zip_with("lam", "t", lambda a, b: a / b).alias("phi"))


def as_matrix(model: TopicModel) -> np.ndarray:
    """The V x K table as an array, fetched once per model; only for models under the size limit."""
    if not model.fits():
        raise ValueError("topic table above the limit")
    if model.matrix is None:
        lam = np.full((model.vocab_size, model.k), model.lam0)
        for part in model.topics.select("word_id", "lam").toArrow().to_batches():  # no object for a row or a cell
            lam[part.column(0).to_numpy()] = part.column(1).flatten().to_numpy().reshape(-1, model.k)
        model.matrix = lam
    return model.matrix


# --- E step -------------------------------------------------------------------------------


def multinomial_mode(n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Most likely split of n tokens over categories with weights w, row by row."""
    out = np.floor(n[:, None] * w)
    left = n - out.sum(1)
    while (left > 0).any():
        need = np.flatnonzero(left > 0)
        with np.errstate(divide="ignore"):
            best = ((out[need] + 1.0) / w[need]).argmin(1)
        out[need, best] += 1.0
        left[need] -= 1.0
    return out


def _relative(like: np.ndarray) -> np.ndarray:
    """Likelihoods of words as shares of their best topic's."""
    return np.exp(like - like.max(1, keepdims=True))


def _local(ids, counts, starts, like, base, k, assign, n_inner, tol, near=None):
    """`fixed_point` from the tokens' likelihoods."""
    if near is None and assign != "hard":
        near = _relative(like)
    return fixed_point(counts, starts, near, lambda at: like[at], base, k, assign, n_inner, tol)


def fixed_point(counts, starts, w, like, base, k, assign, n_inner, tol):
    """Fixed point of a chunk of documents: returns alpha, E log pi and token-topic mass.

    A token's shares are its word's weights (`w`, a row for each token) times its document's, so exponentials are
    taken in each step of the documents alone, and a step is two products of a document's rows of `w` with a vector:
    no share is written down before the last step. `like` gives the log likelihoods of some tokens, where those
    are needed. Documents that stand still keep what they have.
    """
    sizes = np.diff(np.append(starts, len(counts)))
    of = np.repeat(np.arange(len(starts)), sizes)
    alpha, old = np.ones((len(starts), len(base))), np.zeros((len(starts), k))
    total, each = np.ones(len(counts)), counts + 0.0  # of a token: sum of its shares, and count by that sum
    pull, psi = np.zeros((len(starts), k)), np.zeros((len(starts), k))  # of a document in its last step
    if assign != "hard":
        own = [(w[a:b], total[a:b], each[a:b]) for a, b in zip(starts, starts + sizes)]
    live, mass, last = np.arange(len(starts)), None, max(n_inner, 1) - 1
    for step in range(last + 1):
        crisp = assign == "hard" or (assign == "soft2hard" and step == n_inner - 1)
        if assign == "soft2hard" and step == n_inner - 1:
            live = np.arange(len(starts))
        if not len(live):
            if assign != "soft2hard":
                break
            continue
        a = alpha[live]
        e_pi = (SP.np_digamma(a) - SP.np_digamma(a.sum(1, keepdims=True)))[:, :k]
        if crisp:
            moves = np.zeros(len(starts), bool)
            moves[live] = True
            at = np.flatnonzero(moves[of])
            mass = np.zeros((len(counts), k)) if mass is None else mass
            mass[at] = np.eye(k)[(like(at) + np.repeat(e_pi, sizes[live], axis=0)).argmax(1)] * counts[at, None]
            new = np.add.reduceat(mass, starts, axis=0)[live]
        else:
            psi[live] = e_pi
            e = pull[live] = np.exp(e_pi - e_pi.max(1, keepdims=True))
            for row, d in zip(e, live):
                np.dot(own[d][0], row, out=own[d][1])
            faint = np.flatnonzero(total < 1e-200)  # no topic is likely for both: on the scale of logarithms
            with np.errstate(divide="ignore"):
                np.divide(counts, total, out=each)
            each[faint] = 0.0
            new = np.empty((len(live), k))
            for row, d in zip(new, live):
                np.dot(own[d][2], own[d][0], out=row)
            new *= e
            if len(faint):
                more = np.zeros((len(starts), k))
                np.add.at(more, of[faint], SP.np_softmax(like(faint) + psi[of[faint]]) * counts[faint, None])
                new += more[live]
        stay = np.abs(new - old[live]).max(1) >= tol
        old[live] = new
        alpha[live] = base
        alpha[live, :k] += new
        live = live[stay]
    if mass is None:
        mass = w * np.repeat(pull, sizes, axis=0)
        mass *= each[:, None]
        faint = np.flatnonzero(total < 1e-200)
        mass[faint] = SP.np_softmax(like(faint) + psi[of[faint]]) * counts[faint, None]
    if assign == "mode":
        mass = multinomial_mode(counts, mass / counts[:, None])
        alpha = base + np.pad(np.add.reduceat(mass, starts, axis=0), ((0, 0), (0, len(base) - k)))
    e_pi = SP.np_digamma(alpha) - SP.np_digamma(alpha.sum(1, keepdims=True))
    return alpha, e_pi, mass


def _chunks(batches):
    """Document rows regrouped so that a chunk holds about CHUNK tokens: ids, word ids, counts, starts."""
    for batch in batches:
        sizes = batch.column("word_ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = batch.column("word_ids").flatten().to_numpy(zero_copy_only=False)
        counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(float)
        begins = np.append(0, np.cumsum(sizes))
        part = begins[1:] // CHUNK
        for n in np.unique(part):
            mine = np.flatnonzero((part == n) & (sizes > 0))
            if len(mine):
                cut = slice(begins[mine[0]], begins[mine[-1] + 1])
                yield batch.column("doc_id").take(pa.array(mine)), words[cut], counts[cut], begins[mine] - begins[mine[0]]


def _out(kind: str, ids, vecs: np.ndarray):
    """Record batches (kind, id, vec) of a two-dimensional array."""
    ids = ids if isinstance(ids, pa.Array) else pa.array(ids, "int64")
    wide = vecs.shape[1]
    for n in range(0, len(vecs), ROWS):
        part = vecs[n : n + ROWS]
        offsets = np.arange(len(part) + 1, dtype="int32") * np.int32(wide)
        vec = pa.ListArray.from_arrays(offsets, np.ascontiguousarray(part, float).reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.repeat(kind, len(part)), ids[n : n + ROWS].cast("int64"), vec], ["kind", "id", "vec"])


def e_step(rows: DataFrame | Dealt, model: TopicModel, n_inner=10, tol=0.01, docs=False, sums=True, pairs=False) -> DataFrame:
    """One pass over document rows (doc_id, word_ids, counts): table (kind, id, vec).

    kinds: "w" topic counts of a word, "s" 0: sum of E log pi, 1: scalars of the bound and sizes,
    2: major shares, 3: entropy by topic, from 8 on: four triangles of pair sums, "d" the posterior of a document.
    """
    k, base, assign = model.k, model.doc_prior(), model.assign
    wide = len(base)

    def run(batches, table, place=None):
        # a table at hand has sums small enough to keep until the task ends
        whole = np.zeros(table.shape) if sums else None
        near = None if assign == "hard" else _relative(table)
        for doc_ids, ids, counts, starts in _chunks(batches):
            ids = ids if place is None else np.searchsorted(place, ids)
            alpha, e_pi, mass = fixed_point(counts, starts, None if near is None else near.take(ids, 0), lambda at: table[ids[at]], base, k, assign, n_inner, tol)
            if docs:
                yield from _out("d", doc_ids, alpha)
            if sums:
                words, inv = np.unique(ids, return_inverse=True)
                whole[words] += np.stack([np.bincount(inv, mass[:, j], len(words)) for j in range(k)], 1)
                pad = [np.pad(s, (0, wide - len(s))) if len(s) < wide else s for s in _scalars(alpha, e_pi, mass, counts, starts, k, assign, pairs)]
                yield from _out("s", np.arange(len(pad)), np.stack(pad))
        if whole is not None:
            seen = np.flatnonzero(whole.any(1))
            yield from _out("w", seen if place is None else place[seen], whole[seen])

    if model.fits():
        lam = as_matrix(model)
        shipped = SP.np_digamma(lam) - SP.np_digamma(lam.sum(0))
        rows = rows.rows if isinstance(rows, Dealt) else rows
        return rows.select("doc_id", "word_ids", "counts").mapInArrow(lambda batches: run(batches, shipped), OUT)

    if model.mass is None:
        model.mass = np.array(model.topics.agg(*[F.sum(c) for c in entries("lam", k)]).first(), float)
    psi = SP.np_digamma(model.mass)

    def run_block(documents: pa.Table, words: pa.Table) -> pa.Table:
        schema = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))])
        if not len(documents) or not len(words):
            return schema.empty_table()
        place = words["word_id"].to_numpy()
        order = np.argsort(place)
        lam = words["lam"].combine_chunks().flatten().to_numpy().reshape(len(words), k)[order]
        table = SP.np_digamma(lam) - psi
        return pa.Table.from_batches([b.cast(schema) for b in run(documents.to_batches(), table, place[order])], schema)

    mine, needed = _blocks(rows, model)
    return mine.groupBy("block").cogroup(needed.groupBy("of_block")).applyInArrow(run_block, OUT)


def _scalars(alpha, e_pi, mass, counts, starts, k, assign, pairs):
    by_doc = np.add.reduceat(mass, starts, axis=0)
    share = by_doc / np.maximum(by_doc.sum(1, keepdims=True), 1e-300)
    q_pi = SP.np_lgamma(alpha.sum(1)).sum() - SP.np_lgamma(alpha).sum() + ((alpha - 1.0) * e_pi).sum()
    if assign == "mode":
        entropy = SP.np_lgamma(mass + 1.0).sum(0)
        token = SP.np_lgamma(counts + 1.0).sum()
    else:
        entropy, token = (counts[:, None] * xlogx(mass / counts[:, None])).sum(0), 0.0
    z = (by_doc * e_pi[:, :k]).sum()
    bound = np.array([z, q_pi, token, float(len(starts)), counts.sum()])
    # the five bound scalars travel as separate one-entry vectors
    out = [e_pi.sum(0), np.where(share >= 0.05, share, 0.0).sum(0), entropy]
    out += [np.array([v]) for v in bound]
    if pairs:
        out += _pair_sums(alpha, e_pi, mass, by_doc, counts, k, assign)
    return out


def _pair_sums(alpha, e_pi, mass, by_doc, counts, k, assign):
    """What the sums become if topics a < b were one in every document: four upper triangles, row by row.

    Entropy of the merged topic; its sum of E log pi; the changes of the sums z and q_pi.
    """
    psi_all = SP.np_digamma(alpha.sum(1, keepdims=True))
    own_q = (alpha - 1.0) * e_pi - SP.np_lgamma(alpha)
    own_z = by_doc * e_pi[:, :k]
    rows = [[], [], [], []]
    for a in range(k):
        left = np.zeros(a + 1)
        if assign == "mode":
            both = SP.np_lgamma(mass[:, [a]] + mass[:, a + 1 :] + 1.0)
        else:
            both = counts[:, None] * xlogx((mass[:, [a]] + mass[:, a + 1 :]) / counts[:, None])
        one = alpha[:, [a]] + alpha[:, a + 1 : k]
        e_one = SP.np_digamma(one) - psi_all
        z = (by_doc[:, [a]] + by_doc[:, a + 1 :]) * e_one - own_z[:, [a]] - own_z[:, a + 1 :]
        q = (one - 1.0) * e_one - SP.np_lgamma(one) - own_q[:, [a]] - own_q[:, a + 1 : k]
        for out, v in zip(rows, (both, e_one, z, q)):
            out.append(np.append(left, v.sum(0)))
    return [v for part in rows for v in part]


@dataclass
class Dealt:
    """Document rows with their block, and the blocks (word_id, blocks) that hold each word: for tables of k topics."""

    rows: DataFrame
    holders: DataFrame
    k: int


def in_blocks(rows: DataFrame, k: int, limit_bytes: int) -> DataFrame:
    """Rows with a block of so few documents that even if no two shared a word its topic rows would stay below the limit."""
    pairs = rows.agg(F.sum(F.size("word_ids"))).first()[0] or 0
    n_blocks = int(pairs * k * 8 // max(limit_bytes, 1 << 20)) + 1
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))


def words_held(mine: DataFrame) -> DataFrame:
    return mine.select(F.col("block").alias("of_block"), F.explode("word_ids").alias("word_id")).distinct()


def deal(rows: DataFrame, model: TopicModel, keep: bool = False) -> Dealt:
    """Blocks of document rows, for topic tables too large to ship. With `keep` both tables are written.

    What a block holds stays the same in all laps, so a learner finds it once. A word's row goes once to each
    block that holds the word, however many documents of the block do.
    """
    mine = in_blocks(rows.select("doc_id", "word_ids", "counts"), model.k, model.limit_bytes)
    if keep:  # a block's documents lie together, so its words are found where they are
        mine = written(mine.repartition("block"), "blocks")
    holders = words_held(mine).groupBy("word_id").agg(F.collect_list("of_block").alias("blocks"))
    return Dealt(mine, written(holders, "holders") if keep else holders, model.k)


def laid_out(rows: DataFrame, model: TopicModel, before: Dealt | None = None) -> DataFrame | Dealt:
    """What the laps read: the rows as they are, or dealt once to blocks if the topic table is too large to ship."""
    if model.fits():
        return rows
    return before if before is not None and before.k >= model.k else deal(rows, model, keep=True)


def _blocks(rows: DataFrame | Dealt, model: TopicModel) -> tuple[DataFrame, DataFrame]:
    """Document rows by block, and each block's rows of the topic table."""
    dealt = rows if isinstance(rows, Dealt) else deal(rows, model)
    needed = dealt.holders.join(model.topics, "word_id")
    return dealt.rows, needed.select(F.explode("blocks").alias("of_block"), "word_id", "lam")


def blocks(rows: DataFrame, words: DataFrame, k: int, limit_bytes: int = TopicModel.limit_bytes) -> tuple[DataFrame, DataFrame]:
    """Document rows dealt to blocks, and each block's rows of the word table (word_id, array of K). Rows are read three times."""
    mine = in_blocks(rows, k, limit_bytes)
    return mine, words_held(mine).join(words, "word_id")


@dataclass
class TopicStats:
    """Sums of one E step: word counts as a table, the rest as K-sized arrays."""

    counts: DataFrame
    s: np.ndarray
    major: np.ndarray
    entropy: np.ndarray
    z: float
    q_pi: float
    token: float
    n_docs: float
    n_tokens: float
    pair: np.ndarray | None = None  # entropy of two topics as one
    pair_s: np.ndarray | None = None  # its sum of E log pi
    pair_z: np.ndarray | None = None  # changes of z and of q_pi
    pair_q: np.ndarray | None = None


#: Fields of TopicStats that add up over documents, besides the counts.
SUMS = ("s", "major", "entropy", "z", "q_pi", "token", "n_docs", "n_tokens")
PAIRS = ("pair", "pair_s", "pair_z", "pair_q")


def topic_stats(rows: DataFrame | Dealt, model: TopicModel, n_inner=10, tol=0.01, pairs=False) -> TopicStats:
    """E step, sums, and the checkpoint that lets the next lap start from a written table."""
    wide = len(model.doc_prior())
    out = checkpointed(sum_vectors(e_step(rows, model, n_inner, tol, pairs=pairs), ["kind", "id"], wide))
    small = {r["id"]: np.array(r["vec"], float) for r in out.where("kind = 's'").collect()}
    k = model.k
    if not small:  # no rows: all sums are zero
        small = {i: np.zeros(wide) for i in range(8 + 4 * k)}
    pair = []
    if pairs:
        pair = [np.stack([small[8 + n * k + a][:k] for a in range(k)]) for n in range(4)]
    counts = out.where("kind = 'w'").select(F.col("id").cast("int").alias("word_id"), F.slice("vec", 1, k).alias("vec"))
    return TopicStats(counts, small[0], small[1][:k], small[2][:k], *[float(small[i][0]) for i in range(3, 8)], *pair)


def add_stats(a: TopicStats, b: TopicStats, sign: float = 1.0) -> TopicStats:
    """a + b, or a - b with sign -1; the counts are a plan over both tables."""
    more = b.counts if sign == 1.0 else b.counts.select("word_id", F.transform("vec", lambda c: c * sign).alias("vec"))
    counts = sum_vectors(a.counts.unionByName(more), ["word_id"], len(a.entropy))
    fields = {f: getattr(a, f) + sign * getattr(b, f) for f in SUMS}
    if a.pair is not None:
        fields |= {f: getattr(a, f) + sign * getattr(b, f) for f in PAIRS}
    return TopicStats(counts, **fields)


def renewed_stats(total: TopicStats, old: TopicStats, new: TopicStats) -> TopicStats:
    """total - old + new, with one sum over the counts of all three."""
    change = add_stats(new, old, -1.0)
    out = add_stats(total, change)
    less = old.counts.select("word_id", F.transform("vec", lambda c: -c).alias("vec"))
    out.counts = sum_vectors(total.counts.unionByName(less).unionByName(new.counts), ["word_id"], len(total.entropy))
    return out


def merge_stats(ss: TopicStats, a: int, b: int) -> TopicStats:
    """Statistics with topic b folded into a < b; pair sums that involve a are void until they are gathered anew."""
    k = len(ss.entropy)
    cells = entries(F.col("vec"), k)
    vec = F.array(*[cells[a] + cells[b] if c == a else cells[c] for c in range(k) if c != b])
    s, major, entropy = ss.s.copy(), ss.major.copy(), ss.entropy.copy()
    s[a], entropy[a] = ss.pair_s[a, b], ss.pair[a, b]
    major[a] += major[b]
    out = TopicStats(
        ss.counts.select("word_id", vec.alias("vec")),
        np.delete(s, b), np.delete(major, b), np.delete(entropy, b),
        ss.z + ss.pair_z[a, b], ss.q_pi + ss.pair_q[a, b], ss.token, ss.n_docs, ss.n_tokens,
    )
    for f in PAIRS:
        v = np.delete(np.delete(getattr(ss, f), b, 0), b, 1)
        v[a], v[:, a] = 0.0, 0.0
        setattr(out, f, v)
    return out


def pad_stats(ss: TopicStats, n: int, before: int = 0) -> TopicStats:
    """Statistics with n empty topics behind the others, or `before` ones in front and no sums of documents."""
    zeros = lambda m: F.array(*[F.lit(0.0)] * m).cast("array<double>")
    vec = F.concat(zeros(before), F.col("vec"), zeros(n))
    k = len(ss.entropy)
    out = copy.copy(ss)
    out.counts = ss.counts.select("word_id", vec.alias("vec"))
    if before:
        return TopicStats(out.counts, np.zeros(len(ss.s) + before), *[np.zeros(k + before + n)] * 2, 0.0, 0.0, 0.0, 0.0, 0.0, *[np.zeros((k + before + n,) * 2)] * 4)
    out.s = np.concatenate([ss.s[:k], np.zeros(n), ss.s[k:]])  # the unused rest stays last
    out.major, out.entropy = np.append(ss.major, np.zeros(n)), np.append(ss.entropy, np.zeros(n))
    if ss.pair is not None:
        for f in PAIRS:
            setattr(out, f, np.pad(getattr(ss, f), (0, n)))
    return out


# --- bound and updates --------------------------------------------------------------------


def dirichlet_bound(model: TopicModel) -> np.ndarray:
    """Log normaliser of each topic's posterior minus that of the prior.

    A table small enough to ship is at hand as an array; a larger one is summed on Spark.
    """
    k, v = model.k, model.vocab_size
    prior = v * SP.np_lgamma(model.lam0) - SP.np_lgamma(v * model.lam0)
    if model.fits():
        lam = as_matrix(model)
        return SP.np_lgamma(lam).sum(0) - SP.np_lgamma(lam.sum(0)) - prior
    sums = [F.sum(SP.lgamma(c)).alias(f"g{i}") for i, c in enumerate(entries("lam", k))]
    mass = [F.sum(c).alias(f"t{i}") for i, c in enumerate(entries("lam", k))]
    row = model.topics.agg(*sums, *mass).first()
    g = np.array([row[f"g{i}"] for i in range(k)])
    t = model.mass = np.array([row[f"t{i}"] for i in range(k)])
    return g - SP.np_lgamma(t) - prior


def stick_logs(model: TopicModel):
    if model.sticks == "point":
        v = model.u1 / (model.u1 + model.u0)
        return np.log(v), np.log(1.0 - v)
    both = SP.np_digamma(model.u1 + model.u0)
    return SP.np_digamma(model.u1) - both, SP.np_digamma(model.u0) - both


def alloc_bound(model: TopicModel, ss: TopicStats) -> float:
    k, d = model.k, ss.n_docs
    if model.kind == "lda":
        prior = d * (SP.np_lgamma(k * model.alpha0) - k * SP.np_lgamma(model.alpha0))
        return float(prior + (model.alpha0 - 1.0) * ss.s[:k].sum() - ss.q_pi + ss.z - ss.entropy.sum() + ss.token)
    lv, l1 = stick_logs(model)
    g, a0 = model.gamma, model.alpha0
    left = k - np.arange(k)  # K + 1 - k for k = 1..K
    pi = d * (SP.np_lgamma(g) + (k + 1) * np.log(g) + lv.sum() + (left * l1).sum())
    pi += ((g * model.beta() - 1.0) * ss.s).sum() - ss.q_pi
    v = k * (SP.np_lgamma(a0 + 1.0) - SP.np_lgamma(a0)) + (a0 - 1.0) * l1.sum()
    if model.sticks == "full":
        u1, u0 = model.u1, model.u0
        v -= (SP.np_lgamma(u1 + u0) - SP.np_lgamma(u1) - SP.np_lgamma(u0) + (u1 - 1) * lv + (u0 - 1) * l1).sum()
    return float(pi + v + ss.z - ss.entropy.sum() + ss.token)


def standing_bound(model: TopicModel, ss: TopicStats, amp: float = 1.0) -> float:
    """Bound of the model as it stands on a corpus with `amp` times these sums."""
    k = model.k
    rows = model.topics.join(e_log_phi(model.topics, k), "word_id").join(ss.counts, "word_id", "left")
    seen = [F.coalesce(c, F.lit(0.0)) for c in entries(F.col("vec"), k)]
    parts = zip(seen, entries("lam", k), entries("phi", k))
    gap = sum(((amp * c + model.lam0 - lam) * phi for c, lam, phi in parts), F.lit(0.0))
    data = dirichlet_bound(model).sum() + (rows.agg(F.sum(gap)).first()[0] or 0.0)
    scaled = TopicStats(ss.counts, *[getattr(ss, f) * amp for f in ("s", "major", "entropy", "z", "q_pi", "token", "n_docs", "n_tokens")])
    return float(data) + alloc_bound(model, scaled)


def stirling_rest(u: np.ndarray):
    """ln Gamma(u) above (u - 1/2) ln u - u + ln(2 pi) / 2, and ln u - 1 / 2u above digamma(u)."""
    small, large = np.where(u.real < 50, u, 50.0), np.where(u.real < 50, 50.0, u)
    log, inv = np.log(small), 1.0 / (large * large)
    gamma = SP.np_lgamma(small) - (small - 0.5) * log + small - SP.HALF_LOG_2PI
    psi = log - 0.5 / small - SP.np_digamma(small)
    far = (1 / 12 - inv * (1 / 360 - inv / 1260)) / large, inv * (1 / 12 - inv * (1 / 120 - inv / 252))
    return np.where(u.real < 50, gamma, far[0]), np.where(u.real < 50, psi, far[1])


def stick_objective(c: np.ndarray, s: np.ndarray, d: float, alpha0: float, gamma: float, point: bool = False):
    """Part of the bound that depends on the sticks, per document.

    The last axis of c holds log u1 and log u0; other axes are separate evaluations.
    """
    k = c.shape[-1] // 2
    u1, u0 = np.exp(c[..., :k]), np.exp(c[..., k:])
    v = u1 / (u1 + u0)
    left = k - np.arange(k)
    if point:
        lv, l1 = np.log(v), np.log(1.0 - v)
        own = ((alpha0 - 1.0) * l1).sum(-1)
    else:
        # written around Stirling's terms, which cancel: u reaches the number of documents
        both, w = u1 + u0, u0 / (u1 + u0)
        (g1, t1), (g0, t0), (gb, tb) = (stirling_rest(u) for u in (u1, u0, both))
        lv = np.log(v) - 0.5 / u1 + 0.5 / both - t1 + tb
        l1 = np.log(w) - 0.5 / u0 + 0.5 / both - t0 + tb
        entropy = SP.HALF_LOG_2PI + 0.5 - 0.5 * (np.log(v) + np.log(w) + np.log(both))
        entropy = entropy + g1 + g0 - gb + u1 * t1 + u0 * t0 - both * tb
        own = (entropy + lv + alpha0 * l1).sum(-1)
    mass = ((gamma * weights_of(v) - 1.0) * s / d).sum(-1)
    return lv.sum(-1) + (left * l1).sum(-1) + mass + own / d


def update_sticks(model: TopicModel, s: np.ndarray, d: float, steps: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Quasi-Newton ascent on the 2K logs of u1 and u0, run until it converges; raises if it does not.

    Derivatives are complex steps. The end is a predicted gain below the precision of the objective, found
    twice: once with the gathered curvature and once more after a fresh start of it.
    """
    args = (s, max(d, 1.0), model.alpha0, model.gamma, model.sticks == "point")
    eye = np.eye(2 * model.k)

    def slope(c):
        return stick_objective(c + 1e-20j * eye, *args).imag / 1e-20

    u1, u0 = model.u1, model.u0
    if model.sticks == "full":
        # the totals u1 + u0 that are best for the present fractions and many documents
        total = (1.0 + d * (u0 / u1 + (model.k - np.arange(model.k)) * u1 / u0)) / (u1 + u0)
        u1, u0 = total * u1, total * u0
    c = np.log(np.concatenate([u1, u0]))
    best, grad, curve, fresh = stick_objective(c, *args), slope(c), eye, True
    for _ in range(steps):
        way = curve @ grad
        gain = float(grad @ way)
        size, value = 1.0, -np.inf
        if gain > 1e-14 * abs(best):
            size = min(1.0, 1.0 / np.abs(way).max())  # no entry of u moves by more than a factor e
            while size > 1e-12:
                trial = c + size * way
                value = stick_objective(trial, *args)
                if value > best + 1e-4 * size * gain or (value > best and size < 1e-6):
                    break
                size *= 0.5
        if not value > best:
            if fresh:
                break
            curve, fresh = eye, True
            continue
        new = slope(trial)
        step, bend = trial - c, grad - new
        scale = float(step @ bend)
        if scale > 1e-14 * np.linalg.norm(step) * np.linalg.norm(bend):
            if fresh:  # the first pair sets the scale of the curvature
                curve = eye * (scale / float(bend @ bend))
            left = eye - np.outer(step, bend) / scale
            curve, fresh = left @ curve @ left.T + np.outer(step, step) / scale, False
        c, best, grad = trial, value, new
    else:
        raise RuntimeError(f"stick weights did not converge in {steps} steps")
    return np.exp(c[: model.k]), np.exp(c[model.k :])


def m_step(model: TopicModel, vocab: DataFrame | None, ss: TopicStats) -> TopicModel:
    """The model of the sums. Without a vocabulary the counts have a row for every word."""
    new = model.replace(topics=topics_from_counts(vocab, ss.counts, model.lam0, model.k))
    if model.kind == "hdp":
        new.u1, new.u0 = update_sticks(model, ss.s, ss.n_docs)
    return new


# --- starting topics ----------------------------------------------------------------------


def example_topics(triples: DataFrame, k: int, seed=0) -> DataFrame:
    """(word_id, vec): counts of k documents, the first in hash order."""
    ids = triples.select("doc_id").distinct().orderBy(hash_key(seed, "doc_id"), "doc_id").limit(k).collect()
    which = F.create_map(*[F.lit(v) for n, r in enumerate(ids) for v in (r[0], n)])
    rows = triples.where(F.col("doc_id").isin([r[0] for r in ids])).withColumn("k", F.element_at(which, F.col("doc_id")))
    parts = [F.sum(F.when(F.col("k") == n, F.col("cnt")).otherwise(0)).cast("double") for n in range(k)]
    return rows.groupBy("word_id").agg(F.array(*parts).alias("vec"))


def random_topics(vocab: DataFrame, k: int, shape: float, n_tokens: float, seed=0) -> DataFrame:
    """(word_id, vec): Dirichlet draws scaled to the corpus size, one random stream per word."""

    def draw(batches):
        for pdf in batches:
            rows = [np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, int(w)])).gamma(shape, 1.0, k) + 1e-200 for w in pdf["word_id"]]
            yield pd.DataFrame({"word_id": pdf["word_id"], "lam": rows})

    drawn = vocab.select("word_id").mapInPandas(draw, "word_id int, lam array<double>")
    share = topic_shares(drawn, k)
    return share.select("word_id", F.transform("phi", lambda p: p * (n_tokens / k)).alias("vec"))


def soft_partition_topics(triples: DataFrame, k: int, seed=0) -> DataFrame:
    """(word_id, vec): counts when every token has random topic shares."""
    raw = F.array(*[hash_uniform(f"{seed}/{c}", "doc_id", "word_id") + 1e-12 for c in range(k)])
    rows = triples.withColumn("vec", SP.divide_by_sum(raw))
    rows = rows.select("word_id", F.transform("vec", lambda r: r * F.col("cnt")).alias("vec"))
    return sum_vectors(rows, ["word_id"], k)


def _one_per_document(triples: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(word_id, vec): word counts summed over the documents of each label (doc_id, k)."""
    parts = [F.sum(F.when(F.col("k") == n, F.col("cnt")).otherwise(0)).cast("double") for n in range(k)]
    return triples.join(labels, "doc_id").groupBy("word_id").agg(F.array(*parts).alias("vec"))


def cluster_topics(triples: DataFrame, k: int, seed=0, max_iter=10) -> DataFrame:
    """(word_id, vec): counts of k clusters of documents (k-means on word counts, a column per word id)."""
    from pyspark.ml.clustering import KMeans

    docs = sparse_vectors(triples, ["doc_id"], "word_id", F.col("cnt"))
    z = KMeans(featuresCol="x", k=k, seed=seed, maxIter=max_iter).fit(docs).transform(docs)
    return _one_per_document(triples, z.select("doc_id", F.col("prediction").alias("k")), k)


def plusplus_topics(triples: DataFrame, k: int, seed=0) -> DataFrame:
    """(word_id, vec): counts of k documents, each drawn in proportion to its squared distance from those before.

    A draw is the least of -ln(u) / distance, one pass over the triples joined with one document's words.
    """
    squares = F.sum(F.col("cnt").cast("double") * F.col("cnt"))
    docs = checkpointed(triples.groupBy("doc_id").agg(squares.alias("sq"), F.lit(None).cast("double").alias("far")))
    chosen = []
    for n in range(min(k, docs.count())):
        race = -F.log(hash_uniform(f"{seed}/{n}", "doc_id") + 1e-12) / F.coalesce("far", F.lit(1.0))
        left = docs.where(F.coalesce("far", F.lit(1.0)) > 0) if n else docs
        best = left.select(F.min_by(F.struct("doc_id", "sq"), F.struct(race, "doc_id"))).first()[0]
        if best is None:  # every document equals a chosen one
            break
        chosen.append(best["doc_id"])
        words = triples.where(F.col("doc_id") == best["doc_id"]).select("word_id", F.col("cnt").alias("c"))
        dot = triples.join(words, "word_id").groupBy("doc_id").agg(F.sum(F.col("cnt").cast("double") * F.col("c")).alias("dot"))
        near = F.greatest(F.col("sq") + best["sq"] - 2.0 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0))
        docs = checkpointed(docs.join(dot, "doc_id", "left").select("doc_id", "sq", F.least("far", near).alias("far")))
    if not chosen:
        return triples.select("word_id", F.array(*[F.lit(0.0)] * k).alias("vec")).limit(0)
    label = triples.sparkSession.createDataFrame([(d, n) for n, d in enumerate(chosen)], "doc_id long, k int")
    return _one_per_document(triples, label, k)


def start_topics(triples, vocab, k, how="randomfromprior", seed=0, lam0=0.01, arg=1.0) -> DataFrame:
    """Starting counts (word_id, vec) by the named routine."""
    if how == "randexamples":
        return example_topics(triples, k, seed)
    if how in ("randomfromprior", "randomfromarg"):
        n = triples.agg(F.sum("cnt")).first()[0]
        return random_topics(vocab, k, lam0 if how == "randomfromprior" else arg, float(n), seed)
    if how == "randsoftpartition":
        return soft_partition_topics(triples, k, seed)
    if how == "plusplus":
        return plusplus_topics(triples, k, seed)
    if how == "kmeansplusplus":
        return cluster_topics(triples, k, seed)
    raise ValueError(how)


def new_model(vocab, triples, k, how="randomfromprior", seed=0, **options) -> TopicModel:
    model = TopicModel(k, vocab.count(), **options)
    counts = start_topics(triples, vocab, k, how, seed, model.lam0)
    model.topics = checkpointed(topics_from_counts(vocab, counts, model.lam0, k))
    return model


# --- learner ------------------------------------------------------------------------------


def fit(rows, vocab, model, n_lap=10, digits=6, n_inner=10, callbacks=None, after_lap=None, first_lap=0):
    """Full-data learner: one pass over the document rows per lap. Returns (model, trace)."""
    trace, last, hooks, began, laid, seen = [], None, callbacks or {}, time.time(), None, None
    for lap in range(first_lap, n_lap):
        laid = laid_out(rows, model, laid)
        ss = topic_stats(laid, model, n_inner, pairs=after_lap is not None)
        if seen is None:  # the words of the rows are the same in all laps; sums that have them all need no vocabulary
            seen = ss.counts.count()
        model = m_step(model, None if seen == model.vocab_size else vocab, ss)
        data = dirichlet_bound(model)
        bound = float(data.sum()) + alloc_bound(model, ss)
        if after_lap is not None:
            model, bound = after_lap(model, ss, bound, data)
        trace.append((float(lap + 1), bound, model.k, int(ss.n_docs), time.time() - began))
        if "onLapComplete" in hooks:
            hooks["onLapComplete"](model, (lap + 1) / n_lap, trace[-1])
        if last is not None and same_figures(last, bound, digits):
            break
        last = bound
    if "onAlgorithmComplete" in hooks:
        hooks["onAlgorithmComplete"](model, 1.0, trace)
    return model, trace


def doc_topics(rows: DataFrame, model: TopicModel, n_inner=10, tol=0.01) -> DataFrame:
    """(doc_id, alpha): posterior topic weights of documents under a fitted model."""
    out = e_step(rows, model, n_inner, tol, docs=True, sums=False)
    return out.select(F.col("id").alias("doc_id"), F.col("vec").alias("alpha"))


def normalised(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, share): topic mix without the unused rest."""
    return docs.select("doc_id", SP.divide_by_sum(F.slice("alpha", 1, k)).alias("share"))


def corpus_rows(triples: DataFrame) -> DataFrame:
    """Document rows written once to the shared folder: every lap reads them, none re-tokenizes.

    A small corpus may end up in fewer partitions than cores; then it is written again, spread.
    """
    rows = checkpointed(bow.bow_rows(triples))
    spread_rows = spread(rows, "doc_id")
    return rows if spread_rows is rows else checkpointed(spread_rows)
