"""Text counting queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog import query
from catalog.sqltext import DT, KEPT, NOSTOP, STOP, TOK, VOCAB, WC, rnd
from docsift.functions import text as T
from docsift.operators import bow, sampling
from docsift.sources.tables import parquet_docs


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return parquet_docs(spark, f"{sf}/documents.parquet")


def corpus(spark, sf):
    """Vocabulary and triples of the documents table."""
    return bow.corpus(docs(spark, sf))


@query("scan_docs", "SELECT doc_id, 'doc-' || doc_id AS name, text FROM documents")
def scan_docs(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("name"), "text")


SUBSET = "subset AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)"


def subset(spark, sf):
    """A named subset as the application keeps it: here the documents labelled good and harmless."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


@query("subset_docs", f"""WITH {SUBSET}
SELECT doc_id, 'doc-' || doc_id AS name, text FROM documents WHERE doc_id IN (SELECT doc_id FROM subset)""")
def subset_docs(spark, sf):
    return scan_docs(spark, sf).join(subset(spark, sf), "doc_id", "left_semi").orderBy("doc_id")


@query("create_subset", f"""WITH {SUBSET} SELECT DISTINCT 'good' AS subset_name, doc_id FROM subset""")
def create_subset(spark, sf):
    return subset(spark, sf).select(F.lit("good").alias("subset_name"), "doc_id").distinct()


@query("tokens", """WITH a AS (SELECT doc_id,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+['']*[A-Za-z]*') AS ws FROM documents)
SELECT doc_id, cast(generate_subscripts(ws, 1) - 1 AS INTEGER) AS pos, unnest(ws) AS word FROM a""")
def tokens(spark, sf):
    return bow.tokens(docs(spark, sf))


@query("tokens_nostop", f"WITH {NOSTOP} SELECT doc_id, word FROM nostop")
def tokens_nostop(spark, sf):
    return bow.content_tokens(docs(spark, sf))


@query("word_counts", f"WITH {WC} SELECT doc_id, word, cnt FROM wc")
def word_counts(spark, sf):
    return bow.word_counts(docs(spark, sf))


@query("doc_freq", f"WITH {KEPT} SELECT word, df, cf FROM freq")
def doc_freq(spark, sf):
    return bow.document_frequency(bow.word_counts(docs(spark, sf)))


@query("vocab_filter", f"WITH {KEPT} SELECT word, df, cf FROM kept")
def vocab_filter(spark, sf):
    d = docs(spark, sf)
    return bow.kept_words(bow.word_counts(d), d)


@query("vocab", f"WITH {VOCAB} SELECT word_id, word, df, cf FROM vocab")
def vocab(spark, sf):
    return corpus(spark, sf)[0]


@query("doc_term", f"WITH {DT} SELECT doc_id, word_id, cnt FROM dt")
def doc_term(spark, sf):
    return corpus(spark, sf)[1]


@query("subset_bow", f"WITH {DT}, {SUBSET} SELECT doc_id, word_id, cnt FROM dt WHERE doc_id IN (SELECT doc_id FROM subset)")
def subset_bow(spark, sf):
    return corpus(spark, sf)[1].join(subset(spark, sf), "doc_id", "left_semi")


@query("long_docs", f"""WITH {DT}
SELECT doc_id, cast(sum(cnt) AS BIGINT) AS n_words, count(*) AS n_distinct FROM dt GROUP BY doc_id HAVING sum(cnt) >= 100""")
def long_docs(spark, sf):
    return bow.doc_length(corpus(spark, sf)[1]).where(F.col("n_words") >= 100)


@query("doc_length", f"WITH {DT} SELECT doc_id, cast(sum(cnt) AS BIGINT) AS n_words, count(*) AS n_distinct FROM dt GROUP BY doc_id")
def doc_length(spark, sf):
    return bow.doc_length(corpus(spark, sf)[1])


@query("unigram", f"""WITH {VOCAB}
SELECT word_id, {rnd('cf / (SELECT sum(cf) FROM vocab)', 9)} AS p FROM vocab""")
def unigram(spark, sf):
    return bow.unigram(corpus(spark, sf)[0]).select("word_id", F.round("p", 9).alias("p"))


@query("doc_len_percentiles", f"""WITH {DT},
len AS (SELECT doc_id, sum(cnt) AS w, count(*) AS d FROM dt GROUP BY doc_id),
pct AS (SELECT unnest([0, 5, 50, 95, 100]) AS pct, unnest([0.0, 0.05, 0.5, 0.95, 1.0]) AS q)
SELECT cast(pct AS INTEGER) AS pct,
  {rnd("CASE q WHEN 0.0 THEN (SELECT quantile_cont(cast(w AS DOUBLE), 0.0) FROM len) WHEN 0.05 THEN (SELECT quantile_cont(cast(w AS DOUBLE), 0.05) FROM len) WHEN 0.5 THEN (SELECT quantile_cont(cast(w AS DOUBLE), 0.5) FROM len) WHEN 0.95 THEN (SELECT quantile_cont(cast(w AS DOUBLE), 0.95) FROM len) ELSE (SELECT quantile_cont(cast(w AS DOUBLE), 1.0) FROM len) END")} AS n_words,
  {rnd("CASE q WHEN 0.0 THEN (SELECT quantile_cont(cast(d AS DOUBLE), 0.0) FROM len) WHEN 0.05 THEN (SELECT quantile_cont(cast(d AS DOUBLE), 0.05) FROM len) WHEN 0.5 THEN (SELECT quantile_cont(cast(d AS DOUBLE), 0.5) FROM len) WHEN 0.95 THEN (SELECT quantile_cont(cast(d AS DOUBLE), 0.95) FROM len) ELSE (SELECT quantile_cont(cast(d AS DOUBLE), 1.0) FROM len) END")} AS n_distinct
FROM pct""")
def doc_len_percentiles(spark, sf):
    got = bow.length_percentiles(corpus(spark, sf)[1])
    return got.select("pct", F.round("n_words", 6).alias("n_words"), F.round("n_distinct", 6).alias("n_distinct"))


@query("corpus_stats", f"""WITH {DT} SELECT (SELECT count(*) FROM documents) AS n_docs,
  count(DISTINCT doc_id) AS n_docs_with_words, count(*) AS n_pairs, cast(sum(cnt) AS BIGINT) AS n_tokens,
  (SELECT count(*) FROM vocab) AS vocab_size FROM dt""")
def corpus_stats(spark, sf):
    words, triples = corpus(spark, sf)
    return bow.corpus_stats(docs(spark, sf), triples, words)


@query("weighted_docword", f"""WITH {DT} SELECT doc_id, word_id, {rnd('1.0 / df * cnt', 9)} AS value
FROM dt JOIN vocab USING (word_id) WHERE 1.0 / df > 0.01""")
def weighted_docword(spark, sf):
    words, triples = corpus(spark, sf)
    weighted = triples.join(words.select("word_id", (1.0 / F.col("df")).alias("weight")), "word_id")
    got = bow.weighted_docword(weighted, 0.01)
    return got.select("doc_id", "word_id", F.round("value", 9).alias("value"))


@query("unpack_bow", f"WITH {DT} SELECT doc_id, word_id, cnt FROM dt")
def unpack_bow(spark, sf):
    return bow.unpack(bow.pack(corpus(spark, sf)[1]))


@query("ldac_lines", f"""WITH {DT} SELECT doc_id,
  count(*) || ' ' || string_agg(word_id || ':' || cnt, ' ' ORDER BY word_id) AS line FROM dt GROUP BY doc_id""")
def ldac_lines(spark, sf):
    return bow.ldac_lines(corpus(spark, sf)[1])


CONV = f"""ctok AS (SELECT conv_id * 1000 + turn AS doc_id,
    unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+['']*[A-Za-z]*')) AS word FROM conversations),
cdt AS (SELECT doc_id, word_id, count(*) AS cnt FROM ctok JOIN vocab USING (word)
  WHERE lower(word) NOT IN ({STOP}) GROUP BY doc_id, word_id)"""


@query("concat_bow", f"""WITH {DT}, {CONV} SELECT doc_id, word_id, cnt FROM dt
UNION ALL SELECT doc_id + (SELECT max(doc_id) + 1 FROM dt), word_id, cnt FROM cdt""")
def concat_bow(spark, sf):
    words, triples = corpus(spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    second = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return bow.concat_bow(triples, bow.doc_term(bow.word_counts(second), words))


@query("clean_text", r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.clean_lines(F.col("text")).alias("text"))


@query("treebank_tokens")
def treebank_tokens(spark, sf):
    words = F.split(F.btrim(T.treebank(F.col("text"))), " ")
    return docs(spark, sf).select("doc_id", F.posexplode(words).alias("pos", "token"))


BATCHES = """ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS r,
  greatest((SELECT count(*) FROM documents) // 10, 1) AS size FROM documents),
batches AS (SELECT doc_id, cast(least(r // size, 9) AS INTEGER) AS batch_id FROM ranked)"""


def batches(spark, sf):
    return sampling.minibatches(docs(spark, sf), "doc_id", 10, seed=7)


@query("minibatches", f"WITH {BATCHES} SELECT doc_id, batch_id FROM batches")
def minibatches(spark, sf):
    return batches(spark, sf)


@query("batch_order", f"""WITH {BATCHES}, s AS (SELECT batch_id, count(*) AS n_items FROM batches GROUP BY batch_id)
SELECT cast(lap AS INTEGER) AS lap, cast(row_number() OVER (PARTITION BY lap ORDER BY md5((7 + lap) || ':' || batch_id), batch_id) - 1 AS INTEGER) AS visit,
  batch_id, n_items FROM s, (SELECT unnest(range(0, 5)) AS lap)""")
def batch_order(spark, sf):
    return sampling.batch_order(batches(spark, sf), 5, seed=7)


@query("batch_rows", f"""WITH {DT}, {BATCHES} SELECT doc_id, word_id, cnt FROM dt
WHERE doc_id IN (SELECT doc_id FROM batches WHERE batch_id = 3)""")
def batch_rows(spark, sf):
    wanted = batches(spark, sf).where(F.col("batch_id") == 3)
    return corpus(spark, sf)[1].join(wanted, "doc_id", "left_semi")


@query("sample_docs", """SELECT doc_id, text FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 100""")
def sample_docs(spark, sf):
    return sampling.sample(docs(spark, sf), "doc_id", 100, seed=11).select("doc_id", "text")


@query("weighted_draw", """WITH c AS (SELECT doc_id, cast(n_chars AS DOUBLE) AS w, sum(cast(n_chars AS DOUBLE)) OVER (ORDER BY doc_id) AS hi FROM documents),
d AS (SELECT i AS draw, cast(('0x' || substr(md5('5:' || i), 1, 8)) AS BIGINT) / 4294967296.0 * (SELECT sum(n_chars) FROM documents) AS u
  FROM (SELECT unnest(range(0, 50)) AS i))
SELECT cast(draw AS INTEGER) AS draw, min_by(doc_id, hi) AS doc_id FROM d JOIN c ON c.hi > d.u GROUP BY draw""")
def weighted_draw(spark, sf):
    items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("n_chars").cast("double").alias("w"))
    return sampling.weighted_draw(items, "doc_id", "w", 50, seed=5)
