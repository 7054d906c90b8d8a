"""The linear SVM dealt over executors: Spark ML's results, with no vector of all columns on the driver."""
import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from docsift.operators import boundary as B
from docsift.plans import svm


def test_dealt_svm_takes_the_steps_of_spark_ml(spark):
    r = np.random.RandomState(0)
    n, k = 80, 25
    x = (r.rand(n, k) < 0.2) * r.randint(1, 4, (n, k))
    x[:, 3] = 0  # a constant column
    y = (x @ r.randn(k) + 0.5 * r.randn(n) > 0).astype(float)
    wt = np.where(y == 1, 10.0, 1.0)
    rows = [(float(a), float(w), Vectors.dense(v.astype(float))) for a, w, v in zip(y, wt, x)]
    data = spark.createDataFrame(rows, ["label", "weight", "x"]).coalesce(1)
    want = LinearSVC(maxIter=4, tol=1e-4, regParam=1 / n, featuresCol="x", weightCol="weight").fit(data)
    cells = [(i, j, float(x[i, j]), float(wt[i] * y[i]), float(wt[i] * (1 - y[i]))) for i in range(n) for j in range(k) if x[i, j]]
    cells += [(i, None, 1.0, float(wt[i] * y[i]), float(wt[i] * (1 - y[i]))) for i in range(n)]
    df = spark.createDataFrame(cells, "row long, ix long, v double, w1 double, w0 double")
    got = svm.fit(df, k, len(cells), wt.sum(), (wt * wt).sum(), 1 / n, 4, 1e-4, block_cells=250, part_columns=15)
    assert isinstance(got.weights, DataFrame)
    weights = {r.ix: r.w for r in got.weights.collect()}
    assert sorted(weights) == list(range(k)) and weights[3] == 0.0
    assert np.allclose([weights[j] for j in range(k)], want.coefficients.toArray(), rtol=1e-8, atol=1e-10)
    assert np.isclose(got.intercept, want.intercept) and np.allclose(got.trace, list(want.summary().objectiveHistory))


def test_fragments_of_equal_features_are_one_row(spark):
    rows = [(d, p, int(d % 2 == 0 or p == 0), [f"a{d % 2}", f"p{p}"]) for d in range(6) for p in range(2)] + [(None, 0, 0, ["z"])]
    feats = spark.createDataFrame(rows, "doc_id long, pos int, label int, features array<string>")
    model, index = B.train_svm(feats, max_iter=3)
    assert model.n_columns == 5 and len(model.trace) <= 4
    preds = B.classify_svm(feats, model, index)
    assert preds.count() == 13 and preds.select("pred").where("pred is not null").distinct().count() <= 5


def test_fact_classifier_needs_both_labels(spark):
    rows = spark.createDataFrame([(i, ["a"], 0) for i in range(5)], "id long, words array<string>, label int")
    with pytest.raises(ValueError):
        B.train_fact_classifier(rows)


def test_fact_classifier_scores_rows_without_words(spark):
    rows = [(i, [f"w{i % 2}", "x"] if i % 5 else [], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, words array<string>, label int")
    model, scored = B.train_fact_classifier(df, max_iter=4)
    got = {r.id: (r.label, r.predicted) for r in scored.collect()}
    assert sorted(got) == list(range(32, 40)) and model.n_columns == 3
    assert all(got[i][0] == got[i][1] for i in got if i % 5)
