"""The fit of a topic model by word: topic rows travel once to a block, not once with every count."""
import numpy as np
from pyspark.sql import functions as F

from docsift.operators import bow, topic_views as V
from docsift.plans import topics as P


def corpus(spark, k=3):
    rng = np.random.RandomState(3)
    triples = [(d, w, int(rng.randint(1, 5))) for d in range(40) for w in range(25) if rng.rand() < 0.4]
    triples = spark.createDataFrame(triples, "doc_id long, word_id int, cnt long")
    lam = rng.gamma(1.0, 1.0, (25, k)) + 0.1
    topics = spark.createDataFrame([(w, lam[w].tolist()) for w in range(25)], "word_id int, lam array<double>")
    e_pi = np.log(rng.dirichlet(np.ones(k + 1), 40))
    priors = spark.createDataFrame([(d, e_pi[d].tolist()) for d in range(39)], "doc_id long, e_pi array<double>")
    return triples, topics, priors, lam, e_pi


def test_fit_by_word_equals_brute_force_without_a_row_of_topics_for_each_count(spark):
    k = 3
    triples, topics, priors, lam, e_pi = corpus(spark, k)
    fit = V.model_fit_by_word(triples, topics, priors, k)
    plan = fit._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join Inner, (word_id" in plan  # blocks' words meet topics, counts do not
    from docsift.functions import special as SP

    lik = np.exp(SP.np_digamma(lam) - SP.np_digamma(lam.sum(0)))
    pi = np.exp(e_pi[:, :k])
    rows = triples.collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.cnt
    got = {(r.doc_id, r.word_id): (r.cnt, r.emp, r["mod"]) for r in fit.collect()}
    assert len(got) == sum(r.doc_id < 39 for r in rows)  # a document without a prior has no fit
    for r in rows:
        if r.doc_id < 39:
            mod = pi[r.doc_id] @ lik[r.word_id] / (pi[r.doc_id] @ lik.sum(0))
            assert np.allclose(got[r.doc_id, r.word_id], (r.cnt, r.cnt / (total[r.doc_id] + 1e-9), mod), rtol=1e-9)


def test_blocks_change_nothing(spark):
    triples, topics, priors, *_ = corpus(spark)
    rows = bow.bow_rows(triples)
    mine, needed = P.blocks(rows, P.e_log_phi(topics, 3), 3)
    assert mine.count() == 40 and needed.count() == needed.select("of_block", "word_id").distinct().count() == 25


def test_stopwords_are_dropped_from_counts_not_tokens(spark):
    docs = spark.createDataFrame([(0, "The cat and the dog The cat"), (1, None), (2, "and")], "doc_id long, text string")
    counts = bow.word_counts(docs)
    assert {(r.doc_id, r.word): r.cnt for r in counts.collect()} == {(0, "cat"): 2, (0, "dog"): 1}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # tokens are not filtered inside an array, where nothing is compiled
