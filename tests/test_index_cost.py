"""The sentence index shuffles its words to the vocabulary and once more, by document."""
from docsift.operators import sentences as S


def test_counts_and_numbers_of_sentences_share_a_shuffle(spark, monkeypatch):
    made = []
    kept = S.checkpointed
    monkeypatch.setattr(S, "checkpointed", lambda df: made.append(df) or kept(df))
    rows = [(1, 0, "red sun"), (1, 1, "of the"), (1, 2, "sun sun"), (2, 0, "moon"), (None, 0, "red"), (None, 0, "red")]
    sentences = spark.createDataFrame(rows, "doc_id long, sent_no int, sentence string")
    vocab = spark.createDataFrame([(0, "red"), (1, "sun"), (2, "moon")], "word_id int, word string")
    _, terms = S.sentence_index(sentences, vocab)
    lines = made[1]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    assert sum("Exchange hashpartitioning(doc_id" in x for x in lines) == 1
    got = sorted(((r.doc_id or 0, r.sent_ix, r.word_id, r.cnt) for r in terms.collect()))
    assert got == [(0, 0, 0, 2), (1, 0, 0, 1), (1, 0, 1, 1), (1, 1, 1, 2), (2, 0, 2, 1)]
