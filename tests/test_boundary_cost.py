"""Boundary queries at size: texts are split once, fragments never meet their predictions in a join."""
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.operators import boundary as B, sentences as S

TEXT = "Dr. Smith met <NUM> -- 12 people. He left.<S> Then; \"Why?\" she asked.\n\nA new part. «» -- end. of 3,5 it"


def fragments(spark, n=12):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{TEXT} "), F.col("id").cast("string"), F.lit(". More.")).alias("text"))
    return B.weak_labels(S.fragments(docs, words=True))


def test_a_text_is_cut_once(spark):
    docs = spark.createDataFrame([(0, TEXT)], "doc_id long, text string")
    plan = docs.select(T.fragments(F.col("text")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(") + plan.count("text#") <= 3  # the scan and one use


def test_edge_words_are_those_of_the_whole_cleaned_fragment(spark):
    texts = ["a b c", "«» a -- «»", "", "--", "x--y", "12,5 z ;-", "«--» q", " a  b ", "1 2", "-«-a b-«-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    clean = T.squeeze(T.boundary_clean(F.col("t")))
    got = df.select(
        T.edge_word(F.col("t")).alias("a"), T.edge_word(F.col("t"), last=True).alias("b"),
        F.substring_index(clean, " ", 1).alias("x"), F.substring_index(clean, " ", -1).alias("y"),
    ).collect()
    assert [(r.a, r.b) for r in got] == [(r.x, r.y) for r in got]


def test_word_statistics_count_every_use(spark):
    frags = spark.createDataFrame([("a b. a",), ("A b.",), ("a",)], "tokenized string")
    assert {r.word: (r.n_lower, r.n_plain) for r in B.word_stats(frags).collect()} == {"a": (3, 3), "b": (2, 0), "A": (0, 1)}


def test_labels_travel_with_the_features(spark):
    frags = fragments(spark)
    x = B.features(frags, B.word_stats(frags))
    x = x.unionByName(x.where("doc_id = 3")).unionByName(x.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    model = B.train_naive_bayes(x)
    joined = x.select("doc_id", "pos", "label").join(B.classify_naive_bayes(x, *model), ["doc_id", "pos"])
    got = B.classify_naive_bayes(x, *model, labels=True)
    key = lambda df: sorted((r.doc_id, r.pos, r.label, round(r.pred, 9)) for r in df.collect())
    assert key(got) == key(joined) and got.count() > 12
    assert "features" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_model_sentences_move_texts_once(spark):
    frags = fragments(spark)
    preds = frags.select("doc_id", "pos", (F.col("pos") % 2).cast("double").alias("pred"))
    got = B.model_sentences(frags, preds)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    want = {}
    for r in frags.join(preds, ["doc_id", "pos"]).orderBy("doc_id", "pos").collect():
        rows = want.setdefault(r.doc_id, [[]])
        rows[-1].append(r.orig)
        if r.ends_seg or r.pred > 0.5:
            rows.append([])
    want = {(d, n, " ".join(p)) for d, rows in want.items() for n, p in enumerate(rows) if p}
    assert {(r.doc_id, r.sent_no, r.sentence) for r in got.collect()} == want
