"""What the corpus tables and the laps of the topic learners cost, and that it changes no row."""
import re
from collections import Counter

from pyspark.sql import functions as F

from docsift.functions.stopwords import ENGLISH
from docsift.operators import bow
from docsift.plans import topics as P


def test_words_are_counted_without_a_row_for_a_token(spark):
    texts = [(1, "Ship ship ships don't It's"), (1, "ship x''y The"), (None, "ab"), (None, "ab cd"), (2, None), (3, "and the"), (4, "é1a_b-naïve'"), (5, "")]
    docs = spark.createDataFrame(texts * 2, "doc_id long, text string").repartition(5)
    for lowercase in (False, True):
        want = Counter()
        for d, t in texts * 2:
            t = (t or "").lower() if lowercase else t or ""
            want.update((d, w) for w in re.findall("[A-Za-z]+'*[A-Za-z]*", t) if w.lower() not in set(ENGLISH))
        counts = bow.word_counts(docs, lowercase=lowercase)
        assert sorted(map(str, counts.collect())) == sorted(str(r) for r in spark.createDataFrame([(*k, n) for k, n in want.items()], counts.schema).collect())
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_counts_meet_the_vocabulary_unsorted(spark, monkeypatch):
    from catalog import topics as C

    plans, real = {}, C.session.written

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(C.session, "written", written)
    C.written(spark, "/root/testdata/sf0.001")
    assert "ShuffledHashJoin" in plans["triples"] and "SortMergeJoin" not in plans["triples"]


def test_laps_do_not_join_the_vocabulary_again(spark):
    triples = spark.createDataFrame([(d, w, 1 + (d + w) % 3) for d in range(12) for w in range(8) if (d * w) % 5 < 3], "doc_id long, word_id int, cnt long")
    rows, ends = P.corpus_rows(triples), []
    for words in (8, 9):  # the ninth word is in no document
        vocab = spark.range(words).select(F.col("id").cast("int").alias("word_id"))
        for limit in (64 << 20, 1):
            model = P.new_model(vocab, triples, 3, "randexamples", limit_bytes=limit)
            model, trace = P.fit(rows, vocab, model, 3)
            plan = model.topics._jdf.queryExecution().optimizedPlan().toString()
            assert ("Join" in plan) == (words == 9)
            assert model.topics.count() == words
            ends.append(trace[-1][1])
    assert abs(ends[0] - ends[1]) < 1e-9 * abs(ends[0]) and abs(ends[2] - ends[3]) < 1e-9 * abs(ends[2])
