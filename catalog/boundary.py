"""Boundary statistics, features and classifiers; the fact classifier."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.sentences import FRAG, frags
from catalog.sqltext import rnd
from catalog.text import docs
from docsift.functions import text as T
from docsift.operators import boundary as B, sentences as S
from docsift.session import written

# The rewrite patterns of the boundary features.
CLEAN = r"""replace(regexp_replace(regexp_replace({0}, '[.,\d]*\d', '<NUM>', 'g'), '[^a-zA-Z0-9,.;:<>\-''/?!$% ]', '', 'g'), '--', ' ')"""

STATS = FRAG + """,
tw AS (SELECT unnest(string_split(tokenized, ' ')) AS w FROM fr),
ta AS (SELECT w, replace(w, '.', '') AS bare FROM tw WHERE regexp_matches(replace(w, '.', ''), '^[A-Za-z]+$')),
us AS (SELECT bare AS word, 1 AS lo, 0 AS pl FROM ta WHERE w = lower(w)
  UNION ALL SELECT w, 0, 1 FROM ta WHERE NOT ends_with(w, '.')),
stats AS (SELECT word, cast(sum(lo) AS BIGINT) AS n_lower, cast(sum(pl) AS BIGINT) AS n_plain FROM us GROUP BY word)"""

FEATS = STATS + rf""",
wl AS (SELECT doc_id, pos, cast(ends_seg OR coalesce(regexp_matches(next_tokenized, '^["''(\[]*[A-Z]'), false) AS INTEGER) AS label,
  regexp_extract({CLEAN.format('tokenized')}, '([^ ]*) *$', 1) AS w1,
  coalesce(regexp_extract({CLEAN.format('next_tokenized')}, '^ *([^ ]*)', 1), '') AS w2 FROM fn),
cc AS (SELECT doc_id, pos, label, regexp_replace(w1, '^.+?-', '') AS c1, regexp_replace(w2, '-.+$', '') AS c2 FROM wl),
kn AS (SELECT cc.*, regexp_matches(replace(c1, '.', ''), '^[A-Za-z]+$') AS a1, regexp_matches(replace(c2, '.', ''), '^[A-Za-z]+$') AS a2,
  coalesce(p.n_plain, 0) AS np, coalesce(l.n_lower, 0) AS nl, CASE WHEN regexp_matches(c2, '^[A-Z]') THEN 'True' ELSE 'False' END AS cap
  FROM cc LEFT JOIN stats p ON p.word = left(c1, length(c1) - 1) LEFT JOIN stats l ON l.word = lower(c2)),
fe AS (SELECT doc_id, pos, label, unnest(list_filter(['w1_' || c1, 'w2_' || c2, 'both_' || c1 || '_' || c2,
  CASE WHEN a1 THEN 'w1length_' || least(10, length(regexp_replace(c1, '\W', '', 'g'))) END,
  CASE WHEN a1 THEN 'w1abbr_' || cast(floor(ln(np + 1)) AS BIGINT) END,
  CASE WHEN a2 THEN 'w2cap_' || cap END, CASE WHEN a2 THEN 'w2lower_' || cast(floor(ln(nl + 1)) AS BIGINT) END,
  CASE WHEN a2 THEN 'w1w2upper_' || c1 || '_' || cap END], lambda x: x IS NOT NULL)) AS feature FROM kn)"""

NB = FEATS + """,
nc AS (SELECT feature, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM fe GROUP BY feature),
nt AS (SELECT sum(n0) + 0.1 * count(*) AS t0, sum(n1) + 0.1 * count(*) AS t1 FROM nc),
nb AS (SELECT feature, (n0 + 0.1) / t0 AS p0, (n1 + 0.1) / t1 AS p1 FROM nc, nt),
pr AS (SELECT 4 * (ln(t1 / (t0 + t1)) - ln(t0 / (t0 + t1))) AS z0 FROM nt),
pd AS (SELECT doc_id, pos, 1.0 / (1.0 + exp(-(sum(ln(p1) - ln(p0)) + any_value(z0)))) AS pred FROM fe JOIN nb USING (feature), pr GROUP BY doc_id, pos)"""


def weak_frags(spark, sf):
    """The labelled fragments, written once: statistics, features and sentences read them, and the texts are split once."""
    f = B.weak_labels(S.fragments(docs(spark, sf), words=True))
    return written(f.select("doc_id", "pos", "orig", "ends_seg", "label", "last_word", "next_word"), "fragments")


def feats(spark, sf, keep=True, frags=None):
    """Features of every fragment. Word statistics and features are written once, then read often."""
    frags = weak_frags(spark, sf) if frags is None else frags
    stats = written(B.word_stats(frags.select(S.tokenized(F.col("orig")).alias("tokenized"))), "word-stats")
    x = B.features(frags, stats)
    return written(x, "boundaries") if keep else x


@query("sbd_clean", f"WITH {FRAG} SELECT doc_id, pos, {CLEAN.format('tokenized')} AS cleaned FROM fr")
def sbd_clean(spark, sf):
    return frags(spark, sf).select("doc_id", "pos", T.boundary_clean(F.col("tokenized")).alias("cleaned"))


@query("sbd_candidates", r"""WITH w AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS word FROM documents)
SELECT word, regexp_matches(word, '\.["'')\]]*(<A>)?(<E>)?(<S>)?$') AS is_candidate, count(*) AS n FROM w GROUP BY word""")
def sbd_candidates(spark, sf):
    words = docs(spark, sf).select(F.explode(F.split(T.squeeze(F.col("text")), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", T.is_candidate(F.col("word")).alias("is_candidate"), "n")


@query("sbd_word_stats", f"WITH {STATS} SELECT word, n_lower, n_plain FROM stats")
def sbd_word_stats(spark, sf):
    return B.word_stats(frags(spark, sf))


@query("sbd_features", f"WITH {FEATS} SELECT doc_id, pos, feature FROM fe")
def sbd_features(spark, sf):
    return feats(spark, sf, False).select("doc_id", "pos", F.explode("features").alias("feature"))


@query("nb_train", f"""WITH {NB} SELECT feature, {rnd('p0', 9)} AS p0, {rnd('p1', 9)} AS p1 FROM nb""")
def nb_train(spark, sf):
    model, _ = B.train_naive_bayes(feats(spark, sf, False))
    return model.select("feature", F.round("p0", 9).alias("p0"), F.round("p1", 9).alias("p1"))


@query("nb_classify", f"WITH {NB} SELECT doc_id, pos, {rnd('pred')} AS pred FROM pd")
def nb_classify(spark, sf):
    f = feats(spark, sf)
    preds = B.classify_naive_bayes(f, *B.train_naive_bayes(f))
    return preds.select("doc_id", "pos", F.round("pred", 6).alias("pred"))


@query("sentences_model", f"""WITH {NB}, j AS (SELECT fr.*, pred FROM fr JOIN pd USING (doc_id, pos)),
g AS (SELECT doc_id, pos, orig, coalesce(sum(cast(ends_seg OR pred > 0.5 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_no FROM j)
SELECT doc_id, cast(sent_no AS INTEGER) AS sent_no, string_agg(orig, ' ' ORDER BY pos) AS sentence FROM g GROUP BY doc_id, sent_no""")
def sentences_model(spark, sf):
    f = weak_frags(spark, sf)
    x = feats(spark, sf, frags=f)
    return B.model_sentences(f, B.classify_naive_bayes(x, *B.train_naive_bayes(x)))


@query("confusion", f"""WITH {NB} SELECT label, cast(pred > 0.5 AS INTEGER) AS predicted, count(*) AS n
FROM pd JOIN wl USING (doc_id, pos) GROUP BY ALL""")
def confusion(spark, sf):
    x = feats(spark, sf)
    joined = B.classify_naive_bayes(x, *B.train_naive_bayes(x), labels=True)
    return B.confusion(joined.withColumn("predicted", (F.col("pred") > 0.5).cast("int")))


@query("nb_heldout", f"""WITH {FEATS},
fh AS (SELECT *, cast('0x' || substr(md5('heldout:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 AS held FROM fe WHERE regexp_matches(feature, '^(w1|w1length|w1abbr)_')),
nc AS (SELECT feature, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM fh WHERE NOT held GROUP BY feature),
nt AS (SELECT sum(n0) + 0.1 * count(*) AS t0, sum(n1) + 0.1 * count(*) AS t1 FROM nc),
pd AS (SELECT doc_id, pos, label, sum(coalesce(ln((n1 + 0.1) / t1) - ln((n0 + 0.1) / t0), 0)) + any_value(4 * (ln(t1 / (t0 + t1)) - ln(t0 / (t0 + t1)))) AS z
  FROM fh LEFT JOIN nc USING (feature), nt WHERE held GROUP BY doc_id, pos, label)
SELECT doc_id, count(*) AS n, cast(sum(cast((z > 0) <> (label = 1) AS INTEGER)) AS BIGINT) AS n_wrong FROM pd GROUP BY doc_id""")
def nb_heldout(spark, sf):
    """Errors on held-out documents, of a model without the features that see the next word, as the labels do."""
    x = B.of_first_word(feats(spark, sf))
    model = B.train_naive_bayes(x.where(~B.held_out()))
    return B.errors(B.classify_naive_bayes(x.where(B.held_out()), *model, labels=True))


@query("svm_boundary")
def svm_boundary(spark, sf):
    x = feats(spark, sf)
    return B.classify_svm(x, *B.train_svm(x))


@query("fact_classifier")
def fact_classifier(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs(spark, sf).join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("words"), F.col("quality").alias("label")
    )
    _, scored = B.train_fact_classifier(rows)
    return B.confusion(scored)
