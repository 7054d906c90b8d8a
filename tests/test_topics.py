import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import bow, sampling, topic_views as V
from docsift.plans import memoized, moves, online as O, topics as P
from docsift.sources import models
from docsift.streaming import learning


@pytest.fixture(scope="module")
def bars(spark):
    """Documents over a 3 x 3 grid of words, each mixing the six rows and columns."""
    rng = np.random.RandomState(0)
    grid = np.arange(9).reshape(3, 3)
    truth = np.zeros((6, 9))
    for k in range(3):
        truth[k, grid[k]] = 1 / 3
        truth[3 + k, grid[:, k]] = 1 / 3
    rows = []
    for d in range(120):
        mix = rng.dirichlet([0.15] * 6) @ truth
        counts = rng.multinomial(60, mix / mix.sum())
        rows += [(d, int(w), int(c)) for w, c in enumerate(counts) if c]
    triples = spark.createDataFrame(rows, "doc_id long, word_id int, cnt long").cache()
    vocab = spark.range(9).select(F.col("id").cast("int").alias("word_id"), F.concat(F.lit("w"), "id").alias("word")).cache()
    return vocab, triples, P.corpus_rows(triples), truth


def rising(trace, slack=2e-4):
    return all(b[1] >= a[1] - slack * abs(a[1]) for a, b in zip(trace, trace[1:]))


@pytest.mark.parametrize("kind", ["lda", "hdp"])
def test_bound_rises(bars, kind):
    vocab, triples, rows, _ = bars
    model = P.new_model(vocab, triples, 6, "randexamples", 1, kind=kind, **({"alpha0": 0.5} if kind == "lda" else {}))
    fitted, trace = P.fit(rows, vocab, model, 8, n_inner=50)
    assert rising(trace) and trace[-1][1] > trace[0][1]
    assert np.isclose(sum(fitted.topics.select(F.array(*[F.sum(c) for c in P.entries("lam", 6)])).first()[0]), 120 * 60 + 9 * 6 * 0.01)


def test_topics_found(bars):
    vocab, triples, rows, truth = bars
    best = max((P.fit(rows, vocab, P.new_model(vocab, triples, 6, "kmeansplusplus", s, kind="lda", alpha0=0.3), 15) for s in (1, 2)), key=lambda r: r[1][-1][1])
    lam = P.as_matrix(best[0]).T
    phi = lam / lam.sum(1, keepdims=True)
    near = [np.abs(phi - t).sum(1).min() for t in truth]
    assert sum(v < 0.4 for v in near) >= 4


def test_join_path_equals_shipped_path(bars):
    vocab, triples, rows, _ = bars
    model = P.new_model(vocab, triples, 4, "randexamples", 3)
    small = P.topic_stats(rows, model)
    large = P.topic_stats(rows, model.replace(limit_bytes=0))
    a = {r.word_id: r.vec for r in small.counts.collect()}
    b = {r.word_id: r.vec for r in large.counts.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[w], b[w]) for w in a)
    assert np.allclose(small.s, large.s) and np.isclose(small.q_pi, large.q_pi)
    assert np.allclose(P.dirichlet_bound(model), P.dirichlet_bound(model.replace(limit_bytes=0)))
    assert np.allclose([s[2] for s in moves.topic_merge_scores(model)], [s[2] for s in moves.topic_merge_scores(model.replace(limit_bytes=0), 2)])


def test_one_batch_memoized_equals_full(bars):
    vocab, triples, rows, _ = bars
    model = P.new_model(vocab, triples, 3, "randexamples", 1, kind="lda")
    _, full = P.fit(rows, vocab, model, 2)
    split = O.split(rows, sampling.minibatches(rows, "doc_id", 1), "doc_id")
    _, memo = memoized.movb_topics(split, vocab, model, 1, 2)
    assert np.allclose([r[1] for r in full], [r[1] for r in memo], rtol=1e-8)


def test_memoized_total_is_the_sum_of_batches(bars):
    vocab, triples, rows, _ = bars
    model = P.new_model(vocab, triples, 3, "randexamples", 1, kind="lda")
    split = O.split(rows, sampling.minibatches(rows, "doc_id", 3), "doc_id")
    fitted, trace = memoized.movb_topics(split, vocab, model, 3, 2)
    mass = fitted.topics.select(F.array(*[F.sum(c) for c in P.entries("lam", 3)])).first()[0]
    assert np.isclose(sum(mass), 120 * 60 + 9 * 3 * 0.01) and trace[-1][3] == 120


def test_full_step_online_equals_batch_update(bars):
    vocab, triples, rows, _ = bars
    model = P.new_model(vocab, triples, 3, "randexamples", 1, kind="lda")
    step, _ = O.sovb_topics_step(rows, vocab, model, 120, 1.0)
    full, _ = P.fit(rows, vocab, model, 1)
    assert np.allclose(P.as_matrix(step), P.as_matrix(full))


def test_stick_gradient_and_ascent():
    rng = np.random.RandomState(0)
    args = (-rng.rand(5) * 40, 20.0, 5.0, 0.5)
    c = rng.randn(8) * 0.3
    grad = P.stick_objective(c + 1e-20j * np.eye(8), *args).imag / 1e-20
    near = [(P.stick_objective(c + 1e-6 * e, *args) - P.stick_objective(c - 1e-6 * e, *args)) / 2e-6 for e in np.eye(8)]
    assert np.allclose(grad, near, atol=1e-6)
    model = P.TopicModel(4, 10)
    u1, u0 = P.update_sticks(model, args[0], 20.0)
    before = P.stick_objective(np.log(np.concatenate([model.u1, model.u0])), *args)
    assert P.stick_objective(np.log(np.concatenate([u1, u0])), *args) >= before


def test_beta_round_trip():
    model = P.TopicModel(3, 10)
    model.set_beta(np.array([0.5, 0.2, 0.3]))
    want = np.array([0.5, 0.2, 0.3, 0.002])
    assert np.allclose(model.beta(), want / want.sum())


@pytest.mark.parametrize("assign", ["hard", "soft2hard", "mode"])
def test_hard_variants_give_whole_counts(bars, assign):
    vocab, triples, rows, _ = bars
    model = P.new_model(vocab, triples, 3, "randexamples", 1, assign=assign)
    counts = np.array([r.vec for r in P.topic_stats(rows, model).counts.collect()])
    assert np.allclose(counts, counts.round()) and np.isclose(counts.sum(), 120 * 60)


def test_multinomial_mode_by_brute_force():
    from itertools import product
    from math import lgamma, log

    w = np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])
    got = P.multinomial_mode(np.array([7.0, 5.0]), w)
    for n, row, best in zip((7, 5), w, got):
        like = lambda c: sum(v * log(p) - lgamma(v + 1) for v, p in zip(c, row))
        top = max(like(c) for c in product(range(n + 1), repeat=3) if sum(c) == n)
        assert np.isclose(like(best), top) and best.sum() == n


def test_equal_topics_merge(bars):
    vocab, triples, rows, _ = bars
    model, _ = P.fit(rows, vocab, P.new_model(vocab, triples, 3, "randexamples", 1), 3)
    twice = model.replace(k=4, topics=model.topics.select("word_id", F.concat("lam", F.array(F.col("lam")[0])).alias("lam")))
    twice.set_beta(np.append(model.beta()[:-1], model.beta()[0]))
    scores = moves.topic_merge_scores(twice)
    merged = moves.merged_topics(twice, 0, 3)
    assert merged.k == 3 and np.isclose(merged.beta()[0] / merged.beta()[1], 2 * model.beta()[0] / model.beta()[1], rtol=1e-6)
    assert (scores[0][0], scores[0][1]) == (0, 3)


def test_birth_adds_topics(bars):
    vocab, triples, rows, _ = bars
    model, trace = P.fit(rows, vocab, P.new_model(vocab, triples, 1, "randsoftpartition", 1), 2)
    grown, after, row = moves.topic_birth(rows, triples, vocab, model, trace[-1][1], "datadriven", 4)
    assert row[-1] and grown.k > 1 and after > trace[-1][1]


def test_save_and_load(spark, bars, tmp_path):
    vocab, triples, rows, _ = bars
    model = P.new_model(vocab, triples, 3, "randexamples", 1)
    for lap in (1.0, 4.0):
        models.save_topics(spark, model, str(tmp_path), lap)
    again, lap = models.load_topics(spark, str(tmp_path), 2.1)
    assert lap == 1.0 and models.load_topics(spark, str(tmp_path))[1] == 4.0
    assert np.allclose(P.as_matrix(again), P.as_matrix(model)) and np.allclose(again.u1, model.u1)


def test_search_puts_matching_documents_first(bars):
    vocab, triples, rows, _ = bars
    model, _ = P.fit(rows, vocab, P.new_model(vocab, triples, 6, "kmeansplusplus", 1, kind="lda", alpha0=0.3), 5)
    top = V.top_words(model.topics, vocab, 6, 3)
    target = V.target_topics(top, 6, [], [2])
    assert [round(r.target, 9) for r in target.orderBy("k").collect()] == [0, 0, 1, 0, 0, 0]
    docs = triples.select("doc_id").distinct()
    got = V.search_docs(docs, V.search_scores(triples, model.topics, target, 6), 10.0).orderBy("rank").collect()
    share = {r.doc_id: r.share[2] for r in P.normalised(P.doc_topics(rows, model), 6).collect()}
    assert len(got) == 12 and np.mean([share[r.doc_id] for r in got]) > np.mean(list(share.values()))


def test_stream_learning_keeps_one_version_per_batch(spark, tmp_path):
    docs = [(i, "apple pear plum " * 3 if i % 2 else "river lake sea " * 3) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for part in range(2):
        df.where(F.col("doc_id") % 4 >= 2 if part else F.col("doc_id") % 4 < 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    vocab, triples = bow.corpus(df)
    vocab, triples = P.checkpointed(vocab), P.checkpointed(triples)
    start = P.new_model(vocab, triples, 2, "randexamples", 1, kind="lda", alpha0=0.5)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = learning.learn_topics(spark, stream, vocab, start, 40, str(tmp_path / "model"))
    laps = sorted(r.lap for r in spark.read.parquet(str(tmp_path / "model" / "laps")).collect())
    assert laps == [0.0, 1.0, 2.0] and P.as_matrix(model).sum() > 100
    again = learning.learn_topics(spark, stream, vocab, start, 40, str(tmp_path / "model"))
    assert np.array_equal(P.as_matrix(again), P.as_matrix(model))  # nothing new: the learned model, not the start


def test_no_rows_give_zero_sums(spark, bars):
    vocab, triples, rows, _ = bars
    model = P.new_model(vocab, triples, 3, "randexamples", 1, kind="lda")
    ss = P.topic_stats(rows.where(F.lit(False)), model, 1)
    assert ss.counts.count() == 0 and ss.n_docs == 0 and not ss.s.any()
    assert model.alpha0 == 1.0 and P.new_model(vocab, triples, 3, "randexamples", 1).alpha0 == 5.0
