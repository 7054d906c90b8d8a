"""Topic model queries. Fixed starting topics (documents in hash order) make one-pass results exact."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from catalog import query
from catalog.sqltext import DT, digamma, rnd
from catalog.text import docs
from docsift import session
from docsift.functions import special as SP
from docsift.operators import bow, topic_views as V
from docsift.plans import topics as P
from docsift.plans.mixture import trace_table

K = 10

TOPICS = DT + f""",
ids AS (SELECT doc_id, cast(row_number() OVER (ORDER BY md5('13:' || doc_id), doc_id) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT doc_id FROM dt) ORDER BY k LIMIT {K}),
lam AS (SELECT ids.k, v.word_id, 0.01 + coalesce(d.cnt, 0) AS lam FROM ids CROSS JOIN vocab v LEFT JOIN dt d ON d.doc_id = ids.doc_id AND d.word_id = v.word_id),
tot AS (SELECT k, sum(lam) AS t FROM lam GROUP BY k),
phi AS (SELECT k, word_id, lam, t, {digamma('lam')} - pt AS e FROM lam JOIN (SELECT k, t, {digamma('t')} AS pt FROM tot) USING (k)),
tl AS (SELECT doc_id, word_id, cnt, k, e FROM dt JOIN phi USING (word_id))"""
PASS1 = TOPICS + f""",
x1 AS (SELECT *, exp(e - max(e) OVER (PARTITION BY doc_id, word_id)) AS x FROM tl),
r1 AS (SELECT doc_id, word_id, cnt, k, e, x / sum(x) OVER (PARTITION BY doc_id, word_id) AS r FROM x1),
c1 AS (SELECT doc_id, k, sum(cnt * r) AS n FROM r1 GROUP BY doc_id, k)"""
# HDP prior: gamma = 0.5, beta_k = 1 / (K + 0.01), the rest beta = 0.01 / (K + 0.01).
HDP1 = PASS1 + f""",
a1 AS (SELECT doc_id, k, n + 0.5 / {K}.01 AS alpha FROM c1),
s1 AS (SELECT doc_id, sum(alpha) + 0.5 * 0.01 / {K}.01 AS t FROM a1 GROUP BY doc_id),
p1 AS (SELECT doc_id, k, alpha, {digamma('alpha')} - pt AS e_pi FROM a1 JOIN (SELECT doc_id, {digamma('t')} AS pt FROM s1) USING (doc_id))"""
FIT = HDP1 + """,
zz AS (SELECT doc_id, sum(exp(e_pi) * l) AS z FROM p1 JOIN (SELECT k, sum(exp(e)) AS l FROM phi GROUP BY k) USING (k) GROUP BY doc_id),
le AS (SELECT doc_id, sum(cnt) AS n FROM dt GROUP BY doc_id),
mf AS (SELECT doc_id, word_id, any_value(cnt) / (any_value(le.n) + 1e-9) AS emp, sum(exp(e_pi + e)) / any_value(z) AS mod
  FROM tl JOIN p1 USING (doc_id, k) JOIN zz USING (doc_id) JOIN le USING (doc_id) GROUP BY doc_id, word_id)"""
TOP = TOPICS + """,
tw AS (SELECT k, word_id, lam / t AS p, row_number() OVER (PARTITION BY k ORDER BY lam / t DESC, word_id) - 1 AS rank FROM phi),
top AS (SELECT k, cast(rank AS INTEGER) AS rank, word_id, word, p FROM tw JOIN vocab USING (word_id) WHERE rank < 100)"""


def written(spark, sf):
    """The corpus written once to the shared folder, since a learner reads it many times."""
    d = docs(spark, sf)
    counts = session.written(bow.word_counts(d), "counts")
    kept = session.written(bow.kept_words(counts, d), "words")
    words = session.written(bow.vocabulary(kept), "vocab")
    # words and counts meet once; every later read finds the ids
    # a part of the words is a small hash table: the counts, a row for each word of a document, are not sorted by word
    return words, session.written(bow.doc_term(counts, words.hint("shuffle_hash")), "triples")


def fixed(spark, sf, kind="hdp", **options):
    """Vocabulary, triples, document rows and a model whose topics are ten documents."""
    words, triples = written(spark, sf)
    model = P.TopicModel(K, words.count(), kind=kind, **options)
    model.topics = P.topics_from_counts(words, P.example_topics(triples, K, 13), model.lam0, K)
    return words, triples, model


def first_pass(spark, sf, kind="hdp", n_inner=1, **options):
    _, triples, model = fixed(spark, sf, kind, **options)
    return model, P.doc_topics(P.corpus_rows(triples), model, n_inner, tol=0.0)


def by_topic(df, col, out, digits=6):
    """Array column as rows (doc_id, k, value)."""
    return df.select("doc_id", F.posexplode(col).alias("k", out)).withColumn(out, F.round(out, digits))


@query("topic_word", f"WITH {TOPICS} SELECT k, word_id, {rnd('lam')} AS lam, {rnd('e')} AS e_log_phi FROM phi")
def topic_word(spark, sf):
    _, _, model = fixed(spark, sf)
    rows = model.topics.join(P.e_log_phi(model.topics, K), "word_id")
    pairs = F.posexplode(F.arrays_zip("lam", "phi"))
    return rows.select("word_id", pairs.alias("k", "r")).select(
        "k", "word_id", F.round("r.lam", 6).alias("lam"), F.round("r.phi", 6).alias("e_log_phi")
    )


@query("token_loglik", f"WITH {TOPICS} SELECT doc_id, word_id, cnt, {rnd('max(e)')} AS ll_max, {rnd('sum(e)', 5)} AS ll_sum FROM tl GROUP BY doc_id, word_id, cnt")
def token_loglik(spark, sf):
    _, triples, model = fixed(spark, sf)
    rows = P.token_loglik(triples, model.topics, K)
    total = F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)
    return rows.select("doc_id", "word_id", "cnt", F.round(F.array_max("phi"), 6).alias("ll_max"), F.round(total, 5).alias("ll_sum"))


@query("lda_estep1", f"WITH {PASS1} SELECT doc_id, k, {rnd('n + 1')} AS alpha FROM c1")
def lda_estep1(spark, sf):
    _, docs = first_pass(spark, sf, "lda")
    return by_topic(docs, "alpha", "alpha")


@query("hdp_estep1", f"""WITH {HDP1} SELECT doc_id, k, {rnd('alpha')} AS alpha FROM a1
UNION ALL SELECT DISTINCT doc_id, {K}, {rnd(f'0.5 * 0.01 / {K}.01')} FROM a1""")
def hdp_estep1(spark, sf):
    _, docs = first_pass(spark, sf)
    return by_topic(docs, "alpha", "alpha")


@query("doc_topic_counts", f"WITH {PASS1} SELECT doc_id, k, {rnd('n')} AS n FROM c1")
def doc_topic_counts(spark, sf):
    model, docs = first_pass(spark, sf, "lda")
    n = F.transform("alpha", lambda a: a - model.alpha0)
    return by_topic(docs.select("doc_id", n.alias("n")), "n", "n")


@query("topic_word_counts", f"WITH {PASS1} SELECT k, word_id, {rnd('sum(cnt * r)')} AS n FROM r1 GROUP BY k, word_id")
def topic_word_counts(spark, sf):
    _, triples, model = fixed(spark, sf)
    ss = P.topic_stats(P.corpus_rows(triples), model, 1)
    return ss.counts.select("word_id", F.posexplode("vec").alias("k", "n")).select("k", "word_id", F.round("n", 6).alias("n"))


@query("hdp_stats", f"""WITH {HDP1}, t AS (SELECT doc_id, sum(n) AS t FROM c1 GROUP BY doc_id),
m AS (SELECT k, sum(CASE WHEN n / t >= 0.05 THEN n / t ELSE 0 END) AS major FROM c1 JOIN t USING (doc_id) GROUP BY k)
SELECT k, {rnd('sum(e_pi)', 5)} AS s, count(*) AS n_docs, {rnd('any_value(major)', 5)} AS n_major FROM p1 JOIN m USING (k) GROUP BY k""")
def hdp_stats(spark, sf):
    _, triples, model = fixed(spark, sf)
    ss = P.topic_stats(P.corpus_rows(triples), model, 1)
    rows = [(k, round(float(ss.s[k]), 5), int(ss.n_docs), round(float(ss.major[k]), 5)) for k in range(K)]
    return spark.createDataFrame(rows, "k int, s double, n_docs long, n_major double")


@query("score_docs", f"""WITH {PASS1}, q1 AS (SELECT doc_id, k, {digamma('(n + 1)')} AS e_pi FROM c1),
x2 AS (SELECT tl.*, exp(e + e_pi - max(e + e_pi) OVER (PARTITION BY doc_id, word_id)) AS x FROM tl JOIN q1 USING (doc_id, k)),
r2 AS (SELECT doc_id, word_id, cnt, k, x / sum(x) OVER (PARTITION BY doc_id, word_id) AS r FROM x2)
SELECT doc_id, k, {rnd('sum(cnt * r) + 1', 5)} AS alpha FROM r2 GROUP BY doc_id, k""")
def score_docs(spark, sf):
    _, docs = first_pass(spark, sf, "lda", 2)
    return by_topic(docs, "alpha", "alpha", 5)  # the two digammas differ in the tenth digit


@query("doc_topics_norm", f"WITH {HDP1} SELECT doc_id, k, {rnd('alpha / sum(alpha) OVER (PARTITION BY doc_id)')} AS share FROM a1")
def doc_topics_norm(spark, sf):
    _, docs = first_pass(spark, sf)
    return by_topic(P.normalised(docs, K), "share", "share")


@query("target_docs", f"""WITH {PASS1}, s AS (SELECT doc_id, k, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM c1)
SELECT doc_id FROM s WHERE k = 0 AND share > 0.1 ORDER BY md5('4:' || doc_id), doc_id LIMIT 200""")
def target_docs(spark, sf):
    from docsift.operators import sampling

    model, docs = first_pass(spark, sf, "lda")
    mass = F.transform("alpha", lambda a: a - model.alpha0)
    shares = docs.select("doc_id", SP.divide_by_sum(mass)[0].alias("share"))
    return sampling.targeted_sample(shares, "doc_id", 0.1, 200, 4).select("doc_id")


@query("target_tokens", f"""WITH {PASS1}, m AS (SELECT doc_id, word_id, cnt FROM r1 WHERE k = 0 AND r > 0.1),
d AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM m) ORDER BY md5('5:' || doc_id), doc_id LIMIT 200)
SELECT doc_id, word_id, cnt FROM m SEMI JOIN d USING (doc_id)""")
def target_tokens(spark, sf):
    from docsift.operators import sampling

    _, triples, model = fixed(spark, sf, "lda")
    return sampling.matching_tokens(P.token_responsibilities(triples, model.topics, K), 0, 0.1, 200, 5)


@query("topic_entropy", f"""WITH {TOPICS}
SELECT k, {rnd('sum(lgamma(lam)) - lgamma(any_value(t))', 3)} AS log_norm,
  {rnd(f"sum(lgamma(lam)) - lgamma(any_value(t)) + (any_value(t) - count(*)) * {digamma('any_value(t)')} - sum((lam - 1) * {digamma('lam')})", 3)} AS entropy
FROM phi GROUP BY k""")
def topic_entropy(spark, sf):
    from docsift.plans.families import dirichlet_log_norm

    model = fixed(spark, sf)[2]
    cells = model.topics.select("word_id", F.posexplode("lam").alias("k", "lam"))
    return dirichlet_log_norm(cells, "k", "word_id", "lam").select("k", *(F.round(c, 3).alias(c) for c in ("log_norm", "entropy")))


@query("log_factorial", f"""WITH {TOPICS}, b AS (SELECT doc_id, word_id, cnt, k, row_number() OVER (PARTITION BY doc_id, word_id ORDER BY e DESC, k) AS rn FROM tl),
n AS (SELECT d.doc_id, ids.k, coalesce(sum(b.cnt), 0) AS n FROM (SELECT DISTINCT doc_id FROM dt) d CROSS JOIN ids LEFT JOIN b ON b.doc_id = d.doc_id AND b.k = ids.k AND rn = 1 GROUP BY 1, 2)
SELECT a.k AS ka, b.k AS kb, {rnd('sum(CASE WHEN a.k = b.k THEN lgamma(a.n + 1) ELSE lgamma(a.n + b.n + 1) END)', 3)} AS value FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.k <= b.k GROUP BY 1, 2""")
def log_factorial(spark, sf):
    model, docs = first_pass(spark, sf, "lda", assign="hard")
    counts = docs.select("doc_id", F.transform("alpha", lambda a: a - model.alpha0).alias("n"))
    return V.log_factorials(counts, K).withColumn("value", F.round("value", 3))


@query("multinomial_mode")
def multinomial_mode(spark, sf):
    _, triples, model = fixed(spark, sf)
    rows = P.token_loglik(triples, model.topics, K).select("doc_id", "word_id", "cnt", SP.softmax(F.col("phi")).alias("r"))

    def split(batches):
        for batch in batches:
            share = batch.column("r").flatten().to_numpy().reshape(-1, K)
            n = P.multinomial_mode(batch.column("cnt").to_numpy().astype(float), share)
            lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype="int32") * np.int32(K), n.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("word_id"), lists], ["doc_id", "word_id", "counts"])

    return rows.mapInArrow(split, "doc_id long, word_id int, counts array<double>")


@query("topic_top_words", f"WITH {TOP} SELECT k, rank, word_id, word, {rnd('p')} AS p FROM top")
def topic_top_words(spark, sf):
    return top(spark, sf).withColumn("p", F.round("p", 6))


def top(spark, sf):
    words, _, model = fixed(spark, sf)
    return V.top_words(model.topics, words, K)


@query("topic_labels", f"WITH {TOP} SELECT k, string_agg(word, ' ' ORDER BY rank) AS label FROM top WHERE rank < 6 GROUP BY k")
def topic_labels(spark, sf):
    return V.labels(top(spark, sf))


@query("topic_lines", f"WITH {TOP} SELECT k, 'topic ' || k || ': ' || string_agg(word, ' ' ORDER BY rank) AS line FROM top WHERE rank < 10 GROUP BY k")
def topic_lines(spark, sf):
    return V.topic_lines(top(spark, sf))


@query("word_cloud", f"""WITH {TOP} SELECT k, rank, word, {rnd("CASE WHEN lower(word) IN ('que', 'die', 'ent') THEN 0.0 ELSE size END")} AS size
FROM (SELECT *, p / sum(p) OVER (PARTITION BY k) * 800 AS size FROM top) WHERE rank < 40""")
def word_cloud(spark, sf):
    return V.word_cloud(top(spark, sf), ["que", "Die", "ent"]).withColumn("size", F.round("size", 6))


def model_fit(spark, sf):
    _, triples, model = fixed(spark, sf)
    docs = P.doc_topics(P.corpus_rows(triples), model, 1, tol=0.0)
    total = F.aggregate("alpha", F.lit(0.0), lambda s, v: s + v)
    psi = docs.select("doc_id", "alpha", SP.digamma(total).alias("pt"))
    priors = psi.select("doc_id", F.transform("alpha", lambda a: SP.digamma(a) - F.col("pt")).alias("e_pi"))
    return triples, V.model_fit_by_word(triples, model.topics, priors, K)


@query("doc_model_kl", f"WITH {FIT} SELECT doc_id, {rnd('sum(emp * (ln(emp + 1e-100) - ln(mod + 1e-100)))')} AS kl FROM mf GROUP BY doc_id")
def doc_model_kl(spark, sf):
    return V.doc_model_kl(model_fit(spark, sf)[1]).withColumn("kl", F.round("kl", 6))


@query("missing_words", f"""WITH {FIT}, w AS (SELECT word_id, cast(count(*) FILTER (emp > mod) AS BIGINT) AS n_docs, sum(greatest(emp - mod, 0)) AS score FROM mf GROUP BY word_id)
SELECT word_id, n_docs, {rnd('round(score, 9)')} AS score FROM w WHERE n_docs >= 10
ORDER BY round(score, 9) DESC, word_id LIMIT 2 * (SELECT count(DISTINCT doc_id) FROM dt)""")
def missing_words(spark, sf):
    triples, fit = model_fit(spark, sf)
    keep = triples.select(2 * F.count_distinct("doc_id")).scalar()
    # rounded before ranking: the two engines add up in another order, and their ties must be the same
    misfit = V.word_misfit(fit).withColumn("score", F.round("score", 9))
    return V.missing_words(misfit, 10, keep).select("word_id", "n_docs", F.round("score", 6).alias("score"))


# --- fitted models ------------------------------------------------------------------------

LAPS = 100  # at most; the learners stop when the bound keeps its first six figures


def corpus_of(spark, sf):
    words, triples = written(spark, sf)
    return words, triples, P.corpus_rows(triples)


def fitted(spark, sf, how="randexamples", n_lap=LAPS, seed=0, k=K, corpus=None, **options):
    words, triples, rows = corpus or corpus_of(spark, sf)
    model = P.new_model(words, triples, k, how, seed, **options)
    return words, triples, rows, *P.fit(rows, words, model, n_lap)


def topic_table(spark, words, rows, model, trace):
    """One row per topic: weight, label, words held, bound of the fit."""
    weight = model.beta() if model.kind == "hdp" else None
    labels = V.labels(V.top_words(model.topics, words, model.k))
    mass = [float(v) for v in model.topics.select(F.array(*[F.sum(c) for c in P.entries("lam", model.k)])).first()[0]]
    info = [(k, float(weight[k]) if weight is not None else 1.0 / model.k, mass[k] - model.lam0 * model.vocab_size, trace[-1][1]) for k in range(model.k)]
    return spark.createDataFrame(info, "k int, weight double, n_words double, elbo double").join(labels, "k")


def fitted_table(spark, sf, *args, **options):
    words, _, rows, model, trace = fitted(spark, sf, *args, **options)
    return topic_table(spark, words, rows, model, trace)


@query("lda")
def lda(spark, sf):
    return fitted_table(spark, sf, kind="lda")


@query("hdp")
def hdp(spark, sf):
    return fitted_table(spark, sf)


@query("hdp_point")
def hdp_point(spark, sf):
    return fitted_table(spark, sf, sticks="point")


@query("hdp_hard")
def hdp_hard(spark, sf):
    """All three hard variants, one after the other."""
    corpus = corpus_of(spark, sf)
    parts = [fitted_table(spark, sf, assign=a, corpus=corpus).withColumn("assign", F.lit(a)) for a in ("hard", "soft2hard", "mode")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("init_topics")
def init_topics(spark, sf):
    """Total counts per topic of every starting routine."""
    words, triples = written(spark, sf)
    out = []
    for how in ("randexamples", "randomfromprior", "randomfromarg", "randsoftpartition", "plusplus", "kmeansplusplus"):
        counts = P.start_topics(triples, words, 4, how, seed=1)
        row = P.sum_vectors(counts.withColumn("how", F.lit(how)), ["how"], 4)
        out.append(row.select("how", F.posexplode("vec").alias("k", "n_words")))
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


@query("fit_topics")
def fit_topics(spark, sf):
    """The application's run: triples to a 10-topic HDP from random topics, then top words."""
    words, _, _, model, _ = fitted(spark, sf, "randomfromprior")
    return V.top_words(model.topics, words, model.k)


@query("topic_trace")
def topic_trace(spark, sf):
    return trace_table(spark, fitted(spark, sf, "randomfromprior", kind="lda")[4])
