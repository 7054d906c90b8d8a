"""Saving while fitting, going on, warm and repeated starts; held-out errors of the boundary classifier."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.functions.ranking import hash_uniform
from docsift.operators import boundary as B
from docsift.plans import mixture as X, runs, topics as P
from docsift.sources import models


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(3)
    rows = [(i, (rng.normal(size=2) + 6 * (i % 3)).tolist(), i % 3) for i in range(240)]
    return spark.createDataFrame(rows, "id long, x array<double>, label int").cache()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.RandomState(4)
    rows = [(d, int(w), int(c)) for d in range(50) for w, c in enumerate(rng.multinomial(30, rng.dirichlet([0.2] * 8))) if c]
    triples = spark.createDataFrame(rows, "doc_id long, word_id int, cnt long").cache()
    vocab = spark.range(8).select(F.col("id").cast("int").alias("word_id"), F.concat(F.lit("w"), "id").alias("word")).cache()
    return vocab, triples, P.corpus_rows(triples)


def test_mixture_saved_while_fitting_goes_on(spark, points, tmp_path):
    path = str(tmp_path)
    start = X.start(points, X.new_model(points, "vb", "full", 3), "randsoftpartition", 1)
    rows, tracing = runs.tracer(2)
    _, whole = X.fit(points, start, 5, digits=14, callbacks=runs.together(runs.saver(spark, path, 2), tracing))
    laps = [r.lap for r in spark.read.parquet(f"{path}/laps").orderBy("lap").collect()]
    assert laps == [2.0, 4.0, 5.0] == [r[0] for r in rows]
    assert models.load_mixture(spark, path)[1] == 5.0
    model, rest = runs.resume_mixture(points, path, 5, 1.6, digits=14)
    assert np.allclose([r[1] for r in whole[2:]], [r[1] for r in rest], rtol=1e-10)
    assert np.allclose(model.comps["m"], models.load_mixture(spark, path)[0].comps["m"])


@pytest.mark.parametrize("kind", ["lda", "hdp"])
def test_topics_saved_while_fitting_go_on(spark, corpus, tmp_path, kind):
    vocab, triples, rows = corpus
    path = str(tmp_path)
    start = P.new_model(vocab, triples, 3, "randexamples", 1, kind=kind)
    last, whole = P.fit(rows, vocab, start, 3, digits=14, callbacks=runs.saver(spark, path, 2))
    assert models.load_topics(spark, path)[1] == 3.0
    again, rest = runs.resume_topics(rows, vocab, path, 3, 2.0, digits=14)
    assert [r[0] for r in rest] == [3.0] and np.isclose(rest[0][1], whole[2][1], rtol=1e-10)
    assert np.allclose(P.as_matrix(again), P.as_matrix(last))


def test_warm_starts(points, corpus):
    em = X.start_from_labels(points, X.new_model(points, "em", "diag", 3))
    warm = runs.warm_mixture(points, em, X.new_model(points, "vb", "diag", 3))
    assert np.allclose(np.sort(warm.comps["m"][:, 0]), np.sort(em.comps["m"][:, 0]), atol=0.3)
    vocab, triples, rows = corpus
    old, trace = P.fit(rows, vocab, P.new_model(vocab, triples, 3, "randexamples", 1, kind="lda"), 4)
    new = P.new_model(vocab, triples, 3, "randexamples", 9, kind="lda")
    warm = runs.warm_topics(rows, vocab, old, new)
    cold, far = P.fit(rows, vocab, new, 1), P.fit(rows, vocab, warm, 1)
    assert far[1][0][1] >= trace[-1][1] - 1e-3 * abs(trace[-1][1]) and far[1][0][1] >= cold[1][0][1]


def test_repeated_labels(points):
    model = X.start_from_labels(points, X.new_model(points, "em", "diag", 6), repeats=2, seed=5)
    part = F.floor(hash_uniform("repeat 5", "id") * 2)
    want = points.groupBy((F.col("label") + 3 * part).alias("k")).agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(2)])
    want = np.array([(r.m0, r.m1) for r in want.orderBy("k").collect()])
    assert want.shape == (6, 2) and np.allclose(model.comps["m"], want)


def plain_bayes(rows, smooth=0.1):
    seen = sorted({f for *_, fs in rows for f in fs})
    n = {f: [smooth + sum(fs.count(f) for *_, y, fs in rows if y == c) for c in (0, 1)] for f in seen}
    t = [sum(v[c] for v in n.values()) for c in (0, 1)]
    weight = {f: np.log(v[1] / t[1]) - np.log(v[0] / t[0]) for f, v in n.items()}
    return lambda fs: 1 / (1 + np.exp(-(sum(weight.get(f, 0.0) for f in fs) + 4 * (np.log(t[1]) - np.log(t[0])))))


def test_few_valued_features_by_map_equal_a_plain_sum(spark):
    rng = np.random.RandomState(6)
    names = ["w1_a", "w1_b.", "w2_C", "w1length_3", "w1length_10", "w1abbr_0", "w2cap_True", "w2cap_False", "w2lower_4", "both_a_C", "w1w2upper_a_True"]
    rows = [(d, p, int(rng.rand() < 0.5), [n for n in names if rng.rand() < 0.4]) for d in range(25) for p in range(4)]
    schema = "doc_id long, pos int, label int, features array<string>"
    feats = spark.createDataFrame(rows, schema)
    new = spark.createDataFrame([(99, 0, 0, ["w1_never", "w2lower_40"]), (99, 1, 0, [])], schema)
    model, predict = B.train_naive_bayes(feats), plain_bayes(rows)
    got = {(r.doc_id, r.pos): r.pred for r in B.classify_naive_bayes(feats.unionByName(new), *model).collect()}
    assert len(got) == 102
    for d, p, _, fs in rows + [(99, 0, 0, []), (99, 1, 0, [])]:
        assert np.isclose(got[d, p], predict(fs))


def test_held_out_errors(spark):
    rows = [(d, p, int((d + p) % 2), [f"w1_x{(d + p) % 2}", "w1length_4", f"w2cap_{bool((d + p) % 2)}"]) for d in range(60) for p in range(3)]
    x = B.of_first_word(spark.createDataFrame(rows, "doc_id long, pos int, label int, features array<string>"))
    assert {f for r in x.collect() for f in r.features} == {"w1_x0", "w1_x1", "w1length_4"}
    test = x.where(B.held_out())
    assert 0 < test.count() < x.count() / 2
    errors = B.errors(test.join(B.classify_naive_bayes(test, *B.train_naive_bayes(x.where(~B.held_out()))), ["doc_id", "pos"]))
    assert B.accuracy(errors) == 1.0 and all(r.n == 3 and r.n_wrong == 0 for r in errors.collect())
    flipped = test.withColumn("label", 1 - F.col("label")).withColumn("pred", 1.0 - F.col("label"))
    assert B.accuracy(B.errors(flipped)) == 0.0 and np.isnan(B.accuracy(B.errors(flipped.where("false"))))
