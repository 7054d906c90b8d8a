"""Learners: sticks to their optimum, bounds of standing models, starts, vectors without collisions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.functions import special as SP
from docsift.operators import boundary as B
from docsift.operators.vectors import index_of, sparse_vectors
from docsift.plans import mixture as X, topics as P


def stick_case(k, d, seed=0):
    rng = np.random.RandomState(seed)
    alpha = rng.gamma(1.0, 1.0, k + 1) + 0.1
    return d * (SP.np_digamma(alpha) - SP.np_digamma(alpha.sum()))


@pytest.mark.parametrize("sticks", ["full", "point"])
@pytest.mark.parametrize("d", [5.0, 1e4, 1e9])
def test_sticks_reach_their_optimum(sticks, d):
    model, s = P.TopicModel(10, 100, sticks=sticks), stick_case(10, d)
    args = (s, d, model.alpha0, model.gamma, sticks == "point")
    u1, u0 = P.update_sticks(model, s, d)
    c = np.log(np.concatenate([u1, u0]))
    slope = P.stick_objective(c + 1e-20j * np.eye(20), *args).imag / 1e-20
    assert np.abs(slope).max() < 1e-5
    again = P.update_sticks(model.replace(u1=u1, u0=u0), s, d, steps=100_000)
    beta = lambda a, b: P.weights_of(a / (a + b))
    assert np.allclose(beta(u1, u0), beta(*again), atol=1e-6)


def test_sticks_that_do_not_converge_raise():
    with pytest.raises(RuntimeError):
        P.update_sticks(P.TopicModel(10, 100), stick_case(10, 1e4), 1e4, steps=2)


@pytest.mark.parametrize("alloc", ["vb", "dp"])
@pytest.mark.parametrize("obs", ["diag", "full", "zero_mean"])
def test_standing_bound(spark, alloc, obs):
    rng = np.random.RandomState(0)
    x = rng.randn(60, 2) + np.repeat([[0, 0], [4, 4], [-4, 4]], 20, 0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    model = X.start(rows, X.new_model(rows, alloc, obs, 3), "randexamples", 1)
    ss = X.ST.to_numpy(X.model_stats(rows, model), X.shapes(model))
    refitted = model.m_step(ss)
    assert np.isclose(refitted.bound(ss), refitted.elbo(ss))
    # any other parameters are below the optimum
    other = refitted.m_step({f: v * 1.5 for f, v in ss.items()})
    assert other.bound(ss) < refitted.bound(ss)


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(d, 10 * (d % 3) + w, 5 + (d + w) % 3) for d in range(30) for w in range(10)]
    triples = spark.createDataFrame(rows, "doc_id long, word_id int, cnt long")
    vocab = spark.range(30).select(F.col("id").cast("int").alias("word_id"))
    return vocab, triples


@pytest.mark.parametrize("kind", ["lda", "hdp"])
def test_standing_topic_bound(planted, kind):
    vocab, triples = planted
    model = P.new_model(vocab, triples, 3, "randexamples", 1, kind=kind)
    ss = P.topic_stats(P.corpus_rows(triples), model)
    fitted = P.m_step(model, vocab, ss)
    best = float(P.dirichlet_bound(fitted).sum()) + P.alloc_bound(fitted, ss)
    assert np.isclose(P.standing_bound(fitted, ss), best)
    assert P.standing_bound(model, ss) < best


def test_plusplus_start_picks_far_documents(planted):
    _, triples = planted
    got = P.plusplus_topics(triples, 3, 4).toPandas().set_index("word_id")["vec"]
    counts = np.zeros((30, 3))
    counts[got.index] = np.stack(got)
    groups = [set(np.flatnonzero(counts[:, j]) // 10) for j in range(3)]
    assert sorted(g.pop() for g in groups) == [0, 1, 2] and not any(groups)


def test_plusplus_start_with_equal_documents(spark):
    triples = spark.createDataFrame([(d, w, 2) for d in range(4) for w in range(3)], "doc_id long, word_id int, cnt long")
    got = {r.word_id: r.vec for r in P.plusplus_topics(triples, 3, 0).collect()}
    assert got == {w: [2.0, 0.0, 0.0] for w in range(3)}


def test_every_word_has_its_column(spark):
    words = spark.createDataFrame([(i, f"w{i % 50}") for i in range(200)] + [(999, None)], "id long, word string")
    index = index_of(words, "word")
    assert sorted(r.ix for r in index.collect()) == list(range(50))
    cells = words.join(index, "word", "left")
    got = {r.id: r.x for r in sparse_vectors(cells, ["id"], "ix", F.lit(1.0), 50).collect()}
    assert got[999].numNonzeros() == 0 and all(v.size == 50 for v in got.values())
    assert len({int(got[i].indices[0]) for i in range(50)}) == 50


def test_boundary_svm_separates(spark):
    rows = [(d, p, int((d + p) % 2), [f"a{(d + p) % 2}", f"b{d % 7}"]) for d in range(20) for p in range(3)]
    feats = spark.createDataFrame(rows, "doc_id long, pos int, label int, features array<string>")
    preds = B.classify_svm(feats, *B.train_svm(feats)).join(feats, ["doc_id", "pos"])
    assert preds.count() == 60 and preds.where((F.col("pred") > 0.5) != (F.col("label") == 1)).count() == 0
