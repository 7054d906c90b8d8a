"""What a lap of the topic learner costs: tables written once, no row objects on the driver, exponentials of documents."""
import numpy as np
import pytest
from pyspark.sql import DataFrame

from catalog import topics as CT
from docsift.functions import special as SP
from docsift.operators import bow
from docsift.plans import topics as P

TEXTS = [(1, "red red green blue"), (1, "red sun"), (None, "blue moon"), (None, "moon sun"), (2, None), (3, "green Sun sun the")]


@pytest.fixture
def documents(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_where_texts_are(spark):
    """Texts are shuffled by document, words are not; repeated and null ids are still one document each."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    counts = bow.word_counts(docs)
    shuffles = [line for line in plan(counts).splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "word" not in shuffles[0]
    got = {(r.doc_id, r.word): r.cnt for r in counts.collect()}
    assert got == {
        (1, "red"): 3, (1, "green"): 1, (1, "blue"): 1, (1, "sun"): 1, (None, "blue"): 1, (None, "moon"): 2,
        (None, "sun"): 1, (3, "green"): 1, (3, "Sun"): 1, (3, "sun"): 1,
    }


def test_triples_are_joined_once(spark, documents):
    words, triples = CT.written(spark, documents)
    assert "Join" not in plan(triples) and "Exchange" not in plan(triples)
    named = {r.word_id: r.word for r in words.collect()}
    got = {(r.doc_id, named[r.word_id]): r.cnt for r in triples.collect()}
    assert got[1, "red"] == 3 if "red" in named.values() else set(named.values()) == {"green", "blue", "sun"}


def test_three_hard_fits_share_one_corpus(spark, documents, monkeypatch):
    seen = []

    def fit(spark, sf, corpus=None, **options):
        seen.append(corpus)
        return spark.range(1)

    monkeypatch.setattr(CT, "fitted_table", fit)
    CT.hdp_hard(spark, documents)
    assert len(seen) == 3 and seen[0] is not None and all(c is seen[0] for c in seen)


def test_topic_table_arrives_without_row_objects(spark, monkeypatch):
    def refused(self):
        raise AssertionError("an object for every row and cell")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(DataFrame, "collect", refused)
    model = P.TopicModel(3, 5, "lda")
    model.topics = spark.range(4).selectExpr("cast(3 - id as int) as word_id", "array(id + 0.5d, 1d, id * 2d) as lam").repartition(3)
    want = np.full((5, 3), model.lam0)
    want[:4] = [[i + 0.5, 1.0, i * 2.0] for i in (3, 2, 1, 0)]
    assert np.array_equal(P.as_matrix(model), want)


@pytest.mark.parametrize("assign", ["soft", "hard", "soft2hard"])
@pytest.mark.parametrize("scale", [1.0, 2000.0])
def test_fixed_point_equals_the_plain_one(assign, scale):
    """Also where exponentials of a word and a document are both zero in doubles."""
    rng = np.random.RandomState(3)
    sizes, k = [4, 1, 9, 30], 3
    n, starts = sum(sizes), np.append(0, np.cumsum(sizes)[:-1])
    like, counts, base = -scale * rng.rand(n, k), rng.randint(1, 5, n).astype(float), np.array([1e-4, 0.2, 0.3, 1e-3])
    alpha, e_pi, mass = P._local(np.arange(n), counts, starts, like, base, k, assign, 6, 0.01)
    doc, moves, a, old, m = np.repeat(range(4), sizes), np.ones(4, bool), np.ones((4, 4)), np.zeros((4, k)), np.zeros((n, k))
    for step in range(6):
        if assign == "soft2hard" and step == 5:
            moves[:] = True
        psi = SP.np_digamma(a) - SP.np_digamma(a.sum(1, keepdims=True))
        r = SP.np_softmax(like + psi[doc, :k])
        if assign == "hard" or (assign == "soft2hard" and step == 5):
            r = np.eye(k)[r.argmax(1)]
        m = np.where(moves[doc, None], counts[:, None] * r, m)
        new = np.add.reduceat(m, starts, axis=0)
        a = np.where(moves[:, None], base + np.pad(new, ((0, 0), (0, 1))), a)
        moves &= np.abs(new - old).max(1) >= 0.01
        old = new
    assert np.allclose(alpha, a, rtol=1e-10) and np.allclose(mass, m, rtol=1e-10, atol=1e-12)
