"""Document search by topic mix and keyword."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.sqltext import rnd
from catalog.text import docs
from catalog.topics import K, TOP, fixed
from docsift.operators import topic_views as V

WORDS = ["que", "die", "la", "que"]
BLOCKS = [2, 2, 5, -1]

TARGET = TOP + """,
asked AS (SELECT unnest(['que', 'die', 'la', 'que']) AS word),
hits AS (SELECT k, word, p FROM top JOIN asked USING (word)),
ms AS (SELECT ids.k, 1e-7 + coalesce(sum(p), 0) AS m FROM ids LEFT JOIN hits ON hits.k = ids.k GROUP BY ids.k),
bl AS (SELECT k, m / sum(m) OVER () AS s, CASE k WHEN 2 THEN 2.0 / 3 WHEN 5 THEN 1.0 / 3 ELSE 0 END AS b FROM ms),
target AS (SELECT k, (s + b) / 2 / sum((s + b) / 2) OVER () AS target FROM bl)"""
SCORES = TARGET + """,
mix AS (SELECT word_id, ln(sum(lam / t * target)) AS lp FROM phi JOIN target USING (k) GROUP BY word_id),
sc AS (SELECT doc_id, pow(2, -sum(cnt * lp) / sum(cnt)) / sum(cnt) AS score FROM dt JOIN mix USING (word_id) GROUP BY doc_id)"""


def target(spark, sf):
    words, triples, model = fixed(spark, sf)
    top = V.top_words(model.topics, words, K)
    return triples, model, top, V.target_topics(top, K, WORDS, BLOCKS)


@query("search_topics", f"WITH {TARGET} SELECT k, word, {rnd('p')} AS p FROM hits")
def search_topics(spark, sf):
    _, _, top, _ = target(spark, sf)
    return V.search_hits(WORDS, top).withColumn("p", F.round("p", 6))


@query("target_topics", f"WITH {TARGET} SELECT k, {rnd('target')} AS target FROM target")
def target_topics(spark, sf):
    return target(spark, sf)[3].withColumn("target", F.round("target", 6))


@query("search_docs", f"""WITH {SCORES}, rk AS (SELECT doc_id, 'doc-' || doc_id AS name, score, row_number() OVER (ORDER BY round(score, 9) NULLS LAST, doc_id) - 1 AS rank FROM documents LEFT JOIN sc USING (doc_id))
SELECT rank, doc_id, name, {rnd('round(score, 9)')} AS score FROM rk WHERE rank < floor((SELECT count(*) FROM documents) * 0.2)""")
def search_docs(spark, sf):
    triples, model, _, mix = target(spark, sf)
    scores = V.search_scores(triples, model.topics, mix, K)
    # rounded before ranking: the two engines add up in another order, and their ties must be the same
    best = V.search_docs(docs(spark, sf), scores.withColumn("score", F.round("score", 9)), 20.0)
    name = F.concat(F.lit("doc-"), F.col("doc_id"))
    return best.select("rank", "doc_id", name.alias("name"), F.round("score", 6).alias("score"))
