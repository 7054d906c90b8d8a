"""Sentence splitting, sentence index and summary queries."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from catalog import query
from catalog.sqltext import STOP, VOCAB, rnd
from catalog.text import corpus, docs
from docsift.functions import text as T
from docsift.functions.ranking import hash_key
from docsift.operators import bow, sentences as S, summary as M
from docsift.session import checkpointed

FRAG = r"""ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS l FROM documents),
lw AS (SELECT doc_id, l, regexp_extract_all(line, '[^ \t\n\x0B\f\r]+') AS ws FROM ln),
lx AS (SELECT doc_id, l, CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END AS ws FROM lw),
wd AS (SELECT doc_id, l, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM lx),
sq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l, i) AS n,
  coalesce(regexp_matches(word, '\.["'')\]]*(<A>)?(<E>)?(<S>)?$'), false) AS c FROM wd),
hd AS (SELECT *, coalesce(max(cast(c AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND word IS NULL AS b FROM sq),
gr AS (SELECT *, coalesce(sum(cast(c OR b AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM hd),
f0 AS (SELECT doc_id, g, string_agg(word, ' ' ORDER BY n) AS orig, bool_or(b) AS b FROM gr GROUP BY doc_id, g),
f1 AS (SELECT *, coalesce(lead(orig IS NULL AND b) OVER (PARTITION BY doc_id ORDER BY g), false) AS nb FROM f0),
fr AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS pos, orig,
  regexp_replace(orig, '(<A>)|(<E>)|(<S>)', '', 'g') AS tokenized,
  b OR nb OR row_number() OVER (PARTITION BY doc_id ORDER BY g DESC) = 1 AS ends_seg,
  cast(contains(string_split(orig, ' ')[-1], '<S>') AS INTEGER) AS label FROM f1 WHERE orig IS NOT NULL),
fn AS (SELECT *, lead(tokenized) OVER (PARTITION BY doc_id ORDER BY pos) AS next_tokenized FROM fr)"""

#: The same fragments of texts whose lines are joined with spaces, as the sentence index takes them.
JOINED = FRAG.replace("string_split(coalesce(text, ''), chr(10))", "[replace(coalesce(text, ''), chr(10), ' ')]")

INDEX = VOCAB + ",\n" + JOINED + f""",
sw AS (SELECT doc_id, pos, orig, unnest(regexp_extract_all(orig, '[A-Za-z]+['']*[A-Za-z]*')) AS word
  FROM fr WHERE length(orig) <= 200),
sb AS (SELECT doc_id, pos, orig, word_id, count(*) AS cnt FROM sw JOIN vocab USING (word)
  WHERE lower(word) NOT IN ({STOP}) GROUP BY ALL),
st AS (SELECT *, cast(dense_rank() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS sent_ix FROM sb),
sents AS (SELECT DISTINCT doc_id, sent_ix, orig AS sentence FROM st),
summary AS (SELECT row_number() OVER (ORDER BY md5('1:' || doc_id || ':' || sent_ix)) - 1 AS pos, doc_id, sent_ix, sentence
  FROM sents ORDER BY pos LIMIT 5),
chosen AS (SELECT row_number() OVER (ORDER BY md5('2:' || doc_id || ':' || sent_ix)) - 1 AS pos, doc_id, sent_ix, sentence
  FROM sents ORDER BY pos LIMIT 3),
qb AS (SELECT word_id, cast(sum(cnt) AS BIGINT) AS q FROM st SEMI JOIN summary USING (doc_id, sent_ix) GROUP BY word_id)"""


def frags(spark, sf, tokenize=False):
    return S.fragments(docs(spark, sf), tokenize)


def index(spark, sf):
    """Vocabulary, sents and sent_term of the documents table, by the boundary rule."""
    d = docs(spark, sf)
    words = bow.corpus_vocabulary(d)
    return (words, *S.sentence_index(S.rule_sentences(S.unwrapped(d)), words))


def to_nine(metric):
    """The metric rounded before ranking: the two engines add up in another order, and their ties must be the same."""
    return lambda *tables: metric(*tables).withColumn("score", F.round("score", 9))


def pick(sents, n, seed):
    """A user's n chosen sentences, kept as a table: the first in hash order (a fixed small n)."""
    order = hash_key(seed, "doc_id", "sent_ix")
    best = sents.withColumn("h", order).orderBy("h").limit(n)
    return checkpointed(best).select((F.row_number().over(W.orderBy("h")) - 1).cast("long").alias("pos"), "doc_id", "sent_ix", "sentence")


@query("fragments", f"WITH {FRAG} SELECT doc_id, pos, orig, ends_seg, label FROM fr")
def fragments(spark, sf):
    return frags(spark, sf).select("doc_id", "pos", "orig", "ends_seg", "label")


@query("frag_next", f"WITH {FRAG} SELECT doc_id, pos, tokenized, next_tokenized FROM fn")
def frag_next(spark, sf):
    return frags(spark, sf).select("doc_id", "pos", "tokenized", "next_tokenized")


@query("sentences_rule", f"WITH {FRAG} SELECT doc_id, pos AS sent_no, orig AS sentence FROM fr")
def sentences_rule(spark, sf):
    return S.rule_sentences(docs(spark, sf))


@query("short_sents", f"WITH {FRAG} SELECT doc_id, pos AS sent_no, orig AS sentence FROM fr WHERE length(orig) <= 200")
def short_sents(spark, sf):
    return S.short(S.rule_sentences(docs(spark, sf)))


@query("sent_bow", f"WITH {INDEX} SELECT doc_id, sent_ix, word_id, cnt FROM st")
def sent_bow(spark, sf):
    return index(spark, sf)[2]


@query("num_sents", f"WITH {INDEX} SELECT count(*) AS n_sents FROM sents")
def num_sents(spark, sf):
    return index(spark, sf)[1].agg(F.count(F.lit(1)).alias("n_sents"))


@query("query_bow", f"WITH {INDEX} SELECT word_id, q FROM qb")
def query_bow(spark, sf):
    _, sents, terms = index(spark, sf)
    return M.query_bow(terms, pick(sents, 5, 1))


@query("unused_sents", f"WITH {INDEX} SELECT doc_id, sent_ix, sentence FROM sents ANTI JOIN summary USING (doc_id, sent_ix)")
def unused_sents(spark, sf):
    sents = index(spark, sf)[1]
    return M.unused(sents, pick(sents, 5, 1))


@query("summary_add", f"""WITH {INDEX} SELECT pos, doc_id, sent_ix, sentence FROM summary
UNION ALL SELECT pos + 5, doc_id, sent_ix, sentence FROM chosen""")
def summary_add(spark, sf):
    sents = index(spark, sf)[1]
    return M.add(pick(sents, 5, 1), pick(sents, 3, 2))


@query("summary_delete", f"""WITH {INDEX} SELECT pos, doc_id, sent_ix, sentence FROM summary
ANTI JOIN (SELECT doc_id, sent_ix FROM summary WHERE pos IN (1, 3)) USING (doc_id, sent_ix)""")
def summary_delete(spark, sf):
    kept = pick(index(spark, sf)[1], 5, 1)
    return M.delete(kept, kept.where(F.col("pos").isin(1, 3)))


@query("similar_sents", f"""WITH {INDEX},
nm AS (SELECT sqrt(cast(sum(cnt * cnt) AS DOUBLE)) AS norm FROM st SEMI JOIN summary USING (doc_id, sent_ix)),
sc AS (SELECT doc_id, sent_ix, -cast(sum(cnt * coalesce(q, 0)) AS DOUBLE) / (sqrt(cast(sum(cnt * cnt) AS DOUBLE)) * (SELECT norm FROM nm)) + 0.0 AS score
  FROM st LEFT JOIN qb USING (word_id) GROUP BY doc_id, sent_ix)
SELECT doc_id, sent_ix, sentence, {rnd('round(score, 9)')} AS score FROM sc JOIN sents USING (doc_id, sent_ix)
ANTI JOIN summary USING (doc_id, sent_ix) ORDER BY round(score, 9), doc_id, sent_ix LIMIT 200""")
def similar_sents(spark, sf):
    words, sents, terms = index(spark, sf)
    got = M.top_sentences(sents, terms, pick(sents, 5, 1), to_nine(M.similarity), words)
    return got.select("doc_id", "sent_ix", "sentence", F.round("score", 6).alias("score"))


@query("variety_sents", f"""WITH {INDEX},
u AS (SELECT word_id, cf / (SELECT sum(cf) FROM vocab) AS u FROM vocab),
cand AS (SELECT DISTINCT doc_id, sent_ix FROM st ANTI JOIN summary USING (doc_id, sent_ix)),
allw AS (SELECT doc_id, sent_ix, word_id, cnt FROM st
  UNION ALL SELECT doc_id, sent_ix, word_id, q FROM cand, qb),
m AS (SELECT doc_id, sent_ix, word_id, cast(sum(cnt) AS DOUBLE) AS c FROM allw JOIN cand USING (doc_id, sent_ix) GROUP BY ALL),
t AS (SELECT doc_id, sent_ix, sum(c) AS t FROM m GROUP BY ALL),
sc AS (SELECT doc_id, sent_ix, sum(c / t * ln(c / t / u)) AS score FROM m JOIN t USING (doc_id, sent_ix) JOIN u USING (word_id) GROUP BY ALL)
SELECT doc_id, sent_ix, sentence, {rnd('round(score, 9)')} AS score FROM sc JOIN sents USING (doc_id, sent_ix)
ORDER BY round(score, 9), doc_id, sent_ix LIMIT 200""")
def variety_sents(spark, sf):
    words, sents, terms = index(spark, sf)
    got = M.top_sentences(sents, terms, pick(sents, 5, 1), to_nine(M.divergence), words)
    return got.select("doc_id", "sent_ix", "sentence", F.round("score", 6).alias("score"))


@query("highlight", f"""WITH {INDEX}, h AS (SELECT doc_id, sent_ix, sentence, text, strpos(text, sentence) AS p
  FROM sents JOIN documents USING (doc_id))
SELECT doc_id, sent_ix, cast(p AS INTEGER) AS position, CASE WHEN p > 0 THEN p - 1 ELSE length(text) END AS prefix_len,
  CASE WHEN p > 0 THEN sentence ELSE '' END AS hit,
  CASE WHEN p > 0 THEN length(text) - (p - 1) - length(sentence) ELSE 0 END AS suffix_len FROM h""")
def highlight(spark, sf):
    sents = index(spark, sf)[1]
    h = sents.join(docs(spark, sf), "doc_id").withColumn("h", S.highlight(F.col("text"), F.col("sentence")))
    return h.select(
        "doc_id",
        "sent_ix",
        "h.position",
        F.length("h.prefix").cast("long").alias("prefix_len"),
        "h.hit",
        F.length("h.suffix").cast("long").alias("suffix_len"),
    )
