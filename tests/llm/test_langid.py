"""Language identification: held-out accuracy, backoff, odd rows, nothing but the text decides."""
from pyspark.sql import functions as F

from docsift.llm.langid import fit, identify, letter_words
from docsift.llm.q_langid import op3_langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_langid(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(held) > 100
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_of_letters_only():
    assert letter_words("Ab1cd½e_F ab") == {"ab": 2, "cd": 1, "e": 1, "f": 1}
    assert not letter_words(None) and not letter_words("12 ½ _ %")


def test_backoff_and_odd_rows(spark):
    learn = [("the house is here", "en"), ("the mouse", "en"), ("das haus ist hier", "de"), ("die maus", "de"), (None, "en"), ("x", None), ("y", "")]
    model = fit(spark.createDataFrame(learn, "text string, lang string"))
    assert model.langs == ["de", "en"]
    texts = [(1, "the mouse", "zz"), (2, "mouses", None), (3, None, "a"), (4, " 12 ", "b"), (5, "", "c"), (6, "das " * 50_000, "d"), (None, "Ж", "e")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in identify(docs.withColumnRenamed("score", "own"), model).collect()}
    assert (got[1].lang_pred, got[6].lang_pred) == ("en", "de")
    assert got[2].lang_pred == "en"  # by n-grams of an unseen word
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))
    assert got[None].lang_pred == "de" and got[None].score == 0.5  # no gram known: a tie
    assert got[1].own == "zz"


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = fit(empty)
    docs = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in identify(docs, model).collect()] == [("und", 0.0)]
    assert identify(empty, model).count() == 0


def test_bounds(spark):
    rows = spark.range(500).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("a").alias("lang"))
    rows = rows.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    assert len(fit(rows, max_words=50, max_grams=20).words) == 50
    assert len(fit(rows, sample_rows=100).words) < 200
