"""Moves of the memoized learners and merges from one E step, against direct computations."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.functions import special as SP
from docsift.operators import sampling, stats as ST
from docsift.plans import memoized as ME, mixture as X, moves as M, online as O, topics as P


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.RandomState(1)
    x = np.concatenate([rng.randn(100, 2) + c for c in (-12, 0, 12)])
    rows = [(i, v.tolist(), int(i // 100)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def parts(blobs):
    return O.split(blobs, sampling.minibatches(blobs, "id", 3), "id")


def rising(trace):
    return all(b[1] >= a[1] - 1e-9 * abs(a[1]) for a, b in zip(trace, trace[1:]))


def brute(scores, k, how, per_lap, listed, n_best=3):
    """The same lists by going through all pairs."""
    value = {(a, b): s for a, b, s in scores}
    best = sorted(value, key=lambda p: -value[p])
    listed = sorted(listed)
    if how == "marglik":
        return best[:per_lap]
    if how == "allpairsfromlist":
        return list(itertools.combinations(listed, 2))[:per_lap]
    if how == "allpairsfromlistbipartite":
        return [tuple(sorted((a, b))) for a in listed for b in range(k) if b not in listed][:per_lap]
    table, seen = {}, set()
    for c in listed:
        ok = lambda p: c in p and p not in seen and (how != "marglikfromlistbipartite" or len(set(p) & set(listed)) == 1)
        table[c] = list(filter(ok, best))[: 1 if how == "freshbestmatch" else n_best]
        seen |= set(table[c])
    out = [p for p in itertools.chain(*itertools.zip_longest(*table.values())) if p]
    if how != "marglikfromlistbipartite":
        out += [p for p in best if p not in seen]
    return out[:per_lap]


WAYS = ["marglik", "allpairsfromlist", "allpairsfromlistbipartite", "marglikfromlistbipartite", "bestnmatchfromlist", "freshbestmatch"]


@pytest.mark.parametrize("how", WAYS)
def test_candidates(how):
    rng = np.random.RandomState(0)
    for k, listed, per_lap in ((7, [5, 6], 25), (7, [1, 4, 6], 5), (3, [], 10), (2, [0, 1], 10), (9, [8], 4)):
        scores = sorted(((a, b, rng.randn()) for a in range(k) for b in range(a + 1, k)), key=lambda r: -r[2])
        got = M.candidates(scores, k, how, per_lap, listed=listed)
        assert got == brute(scores, k, how, per_lap, listed)
        assert len(set(got)) == len(got) <= per_lap and all(a < b for a, b in got)


def test_random_candidates_cover_all():
    got = M.candidates([], 5, "random", 100, seed=3)
    assert sorted(got) == list(itertools.combinations(range(5), 2)) and len(M.candidates([], 5, "random", 4)) == 4


def test_tracker_renumbers():
    t = M.Tracker()
    t.refused, t.fresh = {(0, 1), (3, 4), (5, 6), (2, 5)}, {3, 6}
    t.merged(2, 3)
    assert t.refused == {(0, 1), (4, 5)} and t.fresh == {5}
    assert t.open([(0, 1), (1, 2)]) == [(1, 2)]
    t.born(6, 2)
    assert t.refused == set() and t.fresh == {6, 7}


# --- memoized mixtures --------------------------------------------------------------------


def doubled(blobs, alloc="dp"):
    """Each true component twice."""
    model = X.start_from_labels(blobs, X.new_model(blobs, alloc, "full", 3))
    ss = ST.to_numpy(X.model_stats(blobs, model), X.shapes(model))
    half = {f: ss[f] / 2 for f in ("N", "x", "xx", "rlogr")}
    return model.m_step(M.stack(half, half))


@pytest.mark.parametrize("alloc", ["dp", "vb"])
def test_merges_are_replayed(blobs, parts, alloc):
    log = []
    kind = ME.Mixtures(blobs.sparkSession, True)
    model, trace, memory = ME.learn(parts, doubled(blobs, alloc), kind, 3, 1, merge="marglik", log=log)
    assert model.k == 3 and sum(r[4] for r in log) == 3
    before = {b: memory.held[b] for b in memory.held}
    total = memory.total()
    assert {e[0] for e in memory.log} == {"merge"} and all(at == 0 for _, at in before.values())
    # the replayed batches add up to the statistics that the model was fitted to
    assert np.isclose(total["N"].sum(), 300) and len(total["N"]) == 3
    again = model.m_step(total)
    assert all(np.allclose(again.comps[f], model.comps[f], rtol=1e-8) for f in model.comps)
    assert np.isclose(model.elbo(total), trace[-1][1], rtol=1e-10)


def test_bound_rises_over_laps_with_merges(blobs, parts):
    log = []
    model, trace = ME.movb_mixture(parts, doubled(blobs), 3, 20, merge="marglik", log=log)
    assert rising(trace) and model.k == 3 and trace[-1][3] == 300 and len(trace) < 20
    assert all(r[6] >= r[5] for r in log if r[4])


def test_birth_finds_planted_components(blobs, parts):
    one = X.start(blobs, X.new_model(blobs, "dp", "full", 1), "randsoftpartition")
    log = []
    kind = ME.Mixtures(blobs.sparkSession, True)
    model, trace, memory = ME.learn(parts, one, kind, 3, 30, merge="marglik", births=4, log=log)
    total = memory.total()
    big = np.sort(total["N"])[::-1][:3]
    assert rising(trace) and any(r[1] == "birth" and r[4] for r in log)
    assert np.isclose(total["N"].sum(), 300) and total["rows"] == 300  # the extra mass is off again
    assert np.allclose(big, 100, atol=5)
    assert np.allclose(sorted(model.comps["m"][np.argsort(-total["N"])[:3], 0]), [-12, 0, 12], atol=0.5)


def test_a_birth_that_does_not_help_is_undone(spark):
    x = np.random.RandomState(0).randn(90, 2)
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, x array<double>, batch_id int")
    model = X.start(rows, X.new_model(rows, "dp", "full", 1), "randsoftpartition")
    log = []
    fitted, trace = ME.movb_mixture(rows, model, 2, 12, births=3, log=log)
    assert rising(trace) and trace[-1][3] == 90
    assert fitted.k == 1 or any(r[4] for r in log)


def test_reservoir_is_bounded_and_follows_shares(spark):
    rows = spark.createDataFrame([(i, 0.9 if i < 300 else 0.15) for i in range(600)] + [(1000, 0.05)], "id long, share double")
    half = [rows.where(F.col("id") % 2 == r) for r in (0, 1)]
    held = ME._reservoir(ME._reservoir(None, half[0], 60, 1), half[1], 60, 1)
    whole = ME._reservoir(None, rows, 60, 1)
    ids = sorted(r.id for r in held.collect())
    assert ids == sorted(r.id for r in whole.collect()) and len(ids) == 60 and 1000 not in ids
    assert sum(i < 300 for i in ids) > 40
    with pytest.raises(ValueError):
        raise_em(spark)


def raise_em(spark):
    rows = spark.createDataFrame([(i, [float(i % 2)], 0) for i in range(6)], "id long, x array<double>, batch_id int")
    model = X.start(rows, X.new_model(rows, "em", "full", 2), "randsoftpartition")
    ME.movb_mixture(rows, model, 1, 2, merge="marglik")


# --- topics -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bars(spark):
    """Three topics over 30 words; documents hold one or two of them."""
    rng = np.random.RandomState(0)
    rows = []
    for d in range(90):
        n = np.bincount(rng.choice(30, 60, p=np.repeat(rng.dirichlet([0.2] * 3), 10) / 10), minlength=30)
        rows += [(d, w, int(c)) for w, c in enumerate(n) if c]
    triples = spark.createDataFrame(rows, "doc_id long, word_id int, cnt long").cache()
    vocab = spark.range(30).select(F.col("id").cast("int").alias("word_id")).cache()
    return vocab, triples, P.corpus_rows(triples)


def topic_model(bars, kind, k, seed=1, **options):
    vocab, triples, rows = bars
    model = P.new_model(vocab, triples, k, "randexamples", seed, kind=kind, **options)
    return P.fit(rows, vocab, model, 3)[0]


@pytest.mark.parametrize("kind,assign", [("lda", "soft"), ("hdp", "soft"), ("hdp", "hard"), ("lda", "mode")])
def test_gain_of_a_merge_equals_that_of_merged_documents(bars, kind, assign):
    """Bound from the pair sums against sums of documents whose local parameters were merged one by one."""
    vocab, triples, rows = bars
    model = topic_model(bars, kind, 4, assign=assign)
    ss = P.topic_stats(rows, model, pairs=True)
    fitted = P.m_step(model, vocab, ss)
    bound = float(P.dirichlet_bound(fitted).sum()) + P.alloc_bound(fitted, ss)
    # local parameters of every document, as the E step found them
    docs = rows.collect()
    table = SP.np_digamma(P.as_matrix(model)) - SP.np_digamma(P.as_matrix(model).sum(0))
    ids = np.concatenate([d.word_ids for d in docs])
    counts = np.concatenate([d.counts for d in docs]).astype(float)
    starts = np.append(0, np.cumsum([len(d.word_ids) for d in docs])[:-1])
    alpha, _, mass = P._local(ids, counts, starts, table[ids], model.doc_prior(), 4, assign, 10, 0.01)
    score = {(a, b): s for a, b, s in M.topic_merge_scores(fitted)}
    for a, b in ((0, 1), (1, 3)):
        one, merged, after = M.try_topic_merge(fitted, ss, bound, a, b, score[a, b])
        fold = lambda m: np.delete(np.where(np.arange(m.shape[1]) == a, m[:, [a]] + m[:, [b]], m), b, 1)
        al, ma = fold(alpha), fold(mass)
        e_pi = SP.np_digamma(al) - SP.np_digamma(al.sum(1, keepdims=True))
        s, major, entropy, *scalars = P._scalars(al, e_pi, ma, counts, starts, 3, assign, False)
        lam = np.zeros((30, 3))
        np.add.at(lam, ids, ma)
        z, q_pi, token, n_docs, n_tokens = (float(v[0]) for v in scalars)
        direct = P.TopicStats(None, s, major, entropy, z, q_pi, token, n_docs, n_tokens)
        assert np.allclose(merged.s, s) and np.allclose(merged.entropy, entropy)
        assert np.isclose(merged.z, z) and np.isclose(merged.q_pi, q_pi)
        again = one.replace()
        again.topics = vocab.sparkSession.createDataFrame([(w, (lam[w] + one.lam0).tolist()) for w in range(30)], "word_id int, lam array<double>")
        want = float(P.dirichlet_bound(again).sum()) + P.alloc_bound(again, direct)
        assert np.isclose(after, want, rtol=1e-9)


@pytest.mark.parametrize("kind", ["lda", "hdp"])
def test_topic_merges_from_one_pass(bars, kind):
    vocab, _, rows = bars
    log = []
    model, bound, log = M.topic_merges(rows, vocab, topic_model(bars, kind, 6), 30)
    assert 3 <= model.k < 6 and any(r[3] for r in log)
    assert all(r[5] >= r[4] for r in log if r[3])
    assert np.isclose(model.topics.select(F.sum(F.aggregate("lam", F.lit(0.0), lambda s, v: s + v))).first()[0], 90 * 60 + 30 * 0.01 * model.k)


@pytest.mark.parametrize("kind", ["lda", "hdp"])
def test_memoized_topics_with_merges(bars, kind):
    vocab, _, rows = bars
    split = O.split(rows, sampling.minibatches(rows, "doc_id", 3), "doc_id")
    family = ME.Topics(vocab, True)
    log = []
    model, trace, memory = ME.learn(split, topic_model(bars, kind, 5), family, 3, 12, merge="marglik", log=log)
    total = memory.total()
    assert any(r[4] for r in log) and model.k < 5 and rising(trace)
    assert total.n_docs == 90 and len(total.entropy) == model.k
    got = {r.word_id: np.array(r.vec) for r in total.counts.collect()}
    lam = {r.word_id: np.array(r.lam) - model.lam0 for r in model.topics.collect()}
    assert all(np.allclose(got.get(w, 0.0), v, atol=1e-8) for w, v in lam.items())
    assert np.isclose(family.bound(model, total), trace[-1][1], rtol=1e-8)


def test_memoized_topic_birth(bars):
    """A model of one topic finds the three planted ones, and the extra mass leaves no trace."""
    vocab, _, rows = bars
    split = O.split(rows, sampling.minibatches(rows, "doc_id", 2), "doc_id")
    log = []
    model, trace, memory = ME.learn(split, topic_model(bars, "hdp", 1), ME.Topics(vocab, True), 2, 10, merge="marglik", births=3, log=log)
    assert any(r[1] == "birth" and r[4] for r in log) and rising(trace)
    lam = P.as_matrix(model) - model.lam0
    assert np.isclose(lam.sum(), 90 * 60) and np.isclose(memory.total().n_docs, 90)
    by_group = np.stack([lam[g * 10 : g * 10 + 10].sum(0) for g in range(3)])
    owner = by_group.argmax(1)
    assert len(set(owner.tolist())) == 3 and all(by_group[g, owner[g]] > 0.8 * by_group[g].sum() for g in range(3))


def test_missing_frequencies(bars):
    vocab, triples, rows = bars
    model = topic_model(bars, "hdp", 2)
    docs = triples.select("doc_id").distinct().where("doc_id < 5")
    got = {(r.doc_id, r.word_id): r.gap for r in M.missing_frequencies(rows, triples, model, docs).collect()}
    phi = P.as_matrix(model) / P.as_matrix(model).sum(0)
    shares = {r.doc_id: np.array(r.share) for r in P.normalised(P.doc_topics(rows, model), 2).collect()}
    counts = {}
    for r in triples.where("doc_id < 5").collect():
        counts.setdefault(r.doc_id, np.zeros(30))[r.word_id] = r.cnt
    want = {}
    for d, n in counts.items():
        gap = n / n.sum() - phi @ shares[d]
        want |= {(d, int(w)): gap[w] for w in np.flatnonzero((gap > 0) & (n > 0))}
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x]) for x in want)


def test_critical_need_finds_an_absent_topic(bars):
    """A model of two topics lacks one of the three; a birth from what it misses brings it."""
    vocab, triples, rows = bars
    model, bound = topic_model(bars, "hdp", 1), None
    model, trace = P.fit(rows, vocab, model, 1)
    bound = trace[-1][1]
    grown, after, row = M.topic_birth(rows, triples, vocab, model, bound, "criticalneed", 3, n_target_words=25, min_tokens=10, seed=1)
    assert row[-1] and after > bound and grown.k >= 3
    grown, trace = P.fit(rows, vocab, grown, 20)
    lam = P.as_matrix(grown) - grown.lam0
    by_group = np.stack([lam[g * 10 : g * 10 + 10].sum(0) for g in range(3)])
    assert len(set(by_group.argmax(1).tolist())) == 3


def test_birth_from_matching_tokens(bars):
    """A birth from the tokens that the one topic explains splits it; the bound rises."""
    vocab, triples, rows = bars
    model, trace = P.fit(rows, vocab, topic_model(bars, "hdp", 1), 1)
    grown, after, row = M.topic_birth(rows, triples, vocab, model, trace[-1][1], k_fresh=3, only_matching=True, seed=1)
    assert row[-1] and after > trace[-1][1] and grown.k > 1


def test_deletion_never_lowers_the_bound(bars):
    vocab, triples, rows = bars
    model, trace = P.fit(rows, vocab, topic_model(bars, "hdp", 6), 3)
    model, before = M._refit(rows, vocab, model, 10)
    after_model, after, gone = M.delete_topics(rows, vocab, model, before, [2, 4, 5])
    assert after >= before and after_model.k == model.k - gone >= 3


@pytest.mark.parametrize("kind", ["lda", "hdp"])
def test_blocks_of_a_large_table_equal_the_shipped_one(bars, kind):
    vocab, _, rows = bars
    model = topic_model(bars, kind, 4)
    small = P.topic_stats(rows, model, pairs=True)
    large = P.topic_stats(rows, model.replace(limit_bytes=0), pairs=True)
    a, b = ({r.word_id: np.array(r.vec) for r in ss.counts.collect()} for ss in (small, large))
    assert a.keys() == b.keys() and all(np.allclose(a[w], b[w], rtol=1e-10, atol=1e-10) for w in a)
    for f in (*P.SUMS, *P.PAIRS):
        assert np.allclose(getattr(small, f), getattr(large, f), rtol=1e-10)
    one, two = ({r.doc_id: np.array(r.alpha) for r in P.doc_topics(rows, m).collect()} for m in (model, model.replace(limit_bytes=0)))
    assert one.keys() == two.keys() and all(np.allclose(one[d], two[d]) for d in one)
    empty = P.topic_stats(rows.limit(0), model.replace(limit_bytes=0))
    assert empty.n_docs == 0 and empty.counts.count() == 0


def test_topic_rows_travel_once_a_block(bars):
    """The shuffle of topic rows has a row per block and word, not one per document and word."""
    _, triples, rows = bars
    model = topic_model(bars, "lda", 3).replace(limit_bytes=0)
    mine, needed = P._blocks(rows, model)
    n_blocks = mine.select("block").distinct().count()
    assert needed.count() <= 30 * n_blocks < triples.count()
    assert needed.groupBy("of_block", "word_id").count().where("count > 1").isEmpty()
