"""What a visit of the memoized topic learner costs: blocks are found once, sums are added up once, topics need no join."""
import numpy as np
import pytest

from docsift.operators import bow, sampling
from docsift.plans import memoized, online as O, topics as P

K = 3


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.RandomState(5)
    cells = [(d, int(w), int(rng.randint(1, 6))) for d in range(60) for w in range(20) if rng.rand() < (0.7 if w % K == d % K else 0.1)]
    triples = spark.createDataFrame(cells, "doc_id long, word_id int, cnt long").cache()
    vocab = spark.range(21).selectExpr("cast(id as int) as word_id").cache()  # word 20 is in no document
    rows = bow.bow_rows(triples)
    return vocab, triples, O.split(rows, sampling.minibatches(rows, "doc_id", 2, 1), "doc_id")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("merge", [None, "marglik"])
def test_large_tables_deal_a_batch_once_for_all_laps(corpus, monkeypatch, merge):
    vocab, triples, rows = corpus
    model = P.new_model(vocab, triples, K, "randexamples", 1, kind="lda")
    _, small, _ = memoized.learn(rows, model, memoized.Topics(vocab, merge is not None), 2, 3, digits=12, merge=merge)
    dealt, deal = [], P.deal

    def counted(*args, **options):
        dealt.append(args)
        return deal(*args, **options)

    monkeypatch.setattr(P, "deal", counted)
    kind = memoized.Topics(vocab, merge is not None)
    _, large, _ = memoized.learn(rows, model.replace(limit_bytes=0), kind, 2, 3, digits=12, merge=merge)
    assert len(dealt) == 2 and len(kind.dealt) == 2  # of six visits
    assert np.allclose([r[1] for r in small], [r[1] for r in large], rtol=1e-9) and [r[2:4] for r in small] == [r[2:4] for r in large]


def test_full_learner_deals_once(corpus, monkeypatch):
    vocab, triples, rows = corpus
    dealt, deal = [], P.deal
    monkeypatch.setattr(P, "deal", lambda *args, **options: dealt.append(args) or deal(*args, **options))
    model = P.new_model(vocab, triples, K, "randexamples", 1, kind="lda", limit_bytes=0)
    _, trace = P.fit(rows, vocab, model, 3, digits=12)
    assert len(trace) == 3 and len(dealt) == 1


def test_more_topics_are_dealt_anew(corpus):
    vocab, triples, rows = corpus
    model = P.new_model(vocab, triples, K, "randexamples", 1, kind="lda", limit_bytes=0)
    laid = P.laid_out(rows, model)
    assert P.laid_out(rows, model, laid) is laid and P.laid_out(rows, model.replace(k=2), laid) is laid
    assert P.laid_out(rows, model.replace(k=K + 1), laid) is not laid
    held = {(r.word_id, b) for r in laid.holders.collect() for b in r.blocks}
    assert held == {(w, r.block) for r in laid.rows.collect() for w in r.word_ids}
    assert P.laid_out(rows, model.replace(limit_bytes=64 << 20), laid) is rows


def test_topics_of_a_visit_are_read_without_a_join(corpus):
    vocab, triples, rows = corpus
    kind = memoized.Topics(vocab, False)
    model = P.new_model(vocab, triples, K, "randexamples", 1, kind="lda")
    total, _ = kind.gather(rows, model)
    want = {r.word_id: r.lam for r in P.m_step(model, vocab, total).topics.collect()}
    fitted = kind.fit(model, total)
    assert "Join" not in plan(fitted.topics) and "Exchange" not in plan(fitted.topics)
    got = {r.word_id: r.lam for r in fitted.topics.collect()}
    assert len(got) == 21 and got[20] == [model.lam0] * K and all(np.allclose(got[w], want[w], rtol=1e-12) for w in want)


def test_a_batch_is_renewed_with_one_sum(corpus):
    vocab, triples, rows = corpus
    model = P.new_model(vocab, triples, K, "randexamples", 1)
    total, old, new = (P.topic_stats(rows.where(f"doc_id % 5 < {n}"), model, pairs=True) for n in (4, 2, 3))
    got, want = P.renewed_stats(total, old, new), P.add_stats(P.add_stats(total, old, -1.0), new)
    assert plan(got.counts).count("Exchange") == 1
    a, b = ({r.word_id: r.vec for r in ss.counts.collect()} for ss in (got, want))
    assert a.keys() == b.keys() and all(np.allclose(a[w], b[w], atol=1e-9) for w in a)
    assert all(np.allclose(getattr(got, f), getattr(want, f), atol=1e-9) for f in P.SUMS + P.PAIRS)
