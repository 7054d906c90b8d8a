"""What users see of a topic model: top words, labels, clouds, and search by topic and keyword."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docsift.functions.ranking import order_rank
from docsift.operators import bow
from docsift.plans.topics import blocks, e_log_phi, entries, topic_shares
from docsift.session import written


def top_words(topics: DataFrame, vocab: DataFrame, k: int, n: int = 100) -> DataFrame:
    """(k, rank, word_id, word, p): the n likeliest words of each topic.

    Spark limits each partition to n rows per topic before the window's shuffle.
    """
    rows = topic_shares(topics, k).select("word_id", F.posexplode("phi").alias("k", "p"))
    best = W.partitionBy("k").orderBy(F.desc("p"), "word_id")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.join(vocab.select("word_id", "word"), "word_id").select("k", (F.col("rank") - 1).alias("rank"), "word_id", "word", "p")


def _words_in_order(top: DataFrame, n: int) -> Column:
    first = F.collect_list(F.when(F.col("rank") < n, F.struct("rank", "word")))
    return F.array_join(F.transform(F.sort_array(first), lambda r: r["word"]), " ")


def labels(top: DataFrame, n: int = 6) -> DataFrame:
    """(k, label): the first words of each topic."""
    return top.groupBy("k").agg(_words_in_order(top, n).alias("label"))


def word_cloud(top: DataFrame, stopwords: list[str], n: int = 40, total: float = 400.0, factor: float = 2.0) -> DataFrame:
    """(k, rank, word, size): weights rescaled over the whole top list; user stopwords keep their slot at 0."""
    share = F.col("p") / F.sum("p").over(W.partitionBy("k"))
    hidden = F.lower("word").isin([w.lower() for w in stopwords])
    size = F.when(hidden, 0.0).otherwise(share * total * factor)
    return top.withColumn("size", size).where(F.col("rank") < n).select("k", "rank", "word", "size")


def topic_lines(top: DataFrame, n: int = 10) -> DataFrame:
    """(k, line): one text line per topic for export."""
    return top.groupBy("k").agg(
        F.concat_ws(" ", F.format_string("topic %d:", F.col("k")), _words_in_order(top, n)).alias("line")
    )


def search_hits(words: list[str], top: DataFrame) -> DataFrame:
    """(k, word, p): search words found in a topic's top list (exact case); repeated words count again."""
    asked = top.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return top.join(F.broadcast(asked), "word").select("k", "word", "p")


def target_topics(top: DataFrame, k: int, words: list[str], blocks: list[int], smooth: float = 1e-7) -> DataFrame:
    """(k, target): the topic mix a search asks for. Blocks name chosen topics, -1 an empty slot."""
    grid = top.sparkSession.range(k).select(F.col("id").cast("int").alias("k"))
    chosen = [b for b in blocks if b >= 0]
    block = sum(((F.col("k") == b).cast("double") for b in chosen), F.lit(0.0)) / float(max(len(chosen), 1))
    if not " ".join(words).strip():
        target = grid.withColumn("t", block)
    else:
        hits = search_hits(words, top).groupBy("k").agg(F.sum("p").alias("p"))
        mass = F.coalesce("p", F.lit(0.0)) + smooth
        target = grid.join(hits, "k", "left").withColumn("m", mass)
        target = target.withColumn("t", (F.col("m") / F.sum("m").over(W.partitionBy()) + block) / 2.0)
    total = F.sum("t").over(W.partitionBy())
    return target.select("k", F.when(total == 0, 1.0 / k).otherwise(F.col("t") / total).alias("target"))


def search_scores(triples: DataFrame, topics: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """(doc_id, score), lower is better: per-word perplexity under the target mix over the length."""
    mix = target.select(F.transform(F.sort_array(F.collect_list(F.struct("k", "target"))), lambda r: r["target"])).scalar()
    words = topic_shares(topics, k).withColumn("t", mix)
    dot = F.aggregate(F.zip_with("phi", "t", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = triples.join(words.select("word_id", F.log(dot).alias("lp")), "word_id")
    length = F.sum("cnt")
    return scored.groupBy("doc_id").agg((F.pow(F.lit(2.0), -F.sum(F.col("cnt") * F.col("lp")) / length) / length).alias("score"))


def search_docs(docs: DataFrame, scores: DataFrame, percent: float) -> DataFrame:
    """The best `percent` of all documents by ascending score; documents without words come last.

    The cut grows with the corpus, so the rank comes from a range exchange, not one sorted task.
    """
    n = docs.select(F.floor(F.count(F.lit(1)) * F.lit(percent / 100.0))).scalar()
    rows = docs.select("doc_id").join(scores, "doc_id", "left")
    rows = rows.withColumn("key", F.coalesce("score", F.lit(float("inf"))))
    return order_rank(rows, ["key", "doc_id"]).where(F.col("rank") < n).drop("key")


def model_fit_by_word(triples: DataFrame, topics: DataFrame, priors: DataFrame, k: int) -> DataFrame:
    """(doc_id, word_id, cnt, emp, mod): empirical and model share of each word of a document.

    `priors` holds (doc_id, e_pi). The model share needs its normaliser over the whole vocabulary,
    which is one K-vector for all documents; words outside a document never matter. Documents are dealt to blocks,
    and a block gets the topic rows of its own words, each once.
    """
    phi = e_log_phi(topics, k).select("word_id", F.transform("phi", F.exp).alias("lik"))
    mass = phi.select(F.array(*[F.sum(c) for c in entries("lik", k)])).scalar()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    own = priors.select("doc_id", F.transform(F.slice("e_pi", 1, k), F.exp).alias("pi")).withColumn("mass", mass)
    own = own.select("doc_id", "pi", dot("pi", "mass").alias("z"))
    rows = written(bow.bow_rows(triples).join(own, "doc_id"), "fit-rows")
    kinds = {f.name: f.dataType.simpleString() for f in triples.schema}
    schema = f"doc_id {kinds['doc_id']}, word_id {kinds['word_id']}, cnt {kinds['cnt']}, emp double, mod double"

    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(documents["word_ids"]).to_numpy()
        ids, counts = pc.list_flatten(documents["word_ids"]), pc.list_flatten(documents["counts"])
        place, row = words["word_id"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(place)
        lik = pc.list_flatten(words["lik"]).to_numpy().reshape(-1, k)
        pi = pc.list_flatten(documents["pi"]).to_numpy().reshape(-1, k)
        known = np.flatnonzero(np.isin(ids.to_numpy(), place))
        at = order[np.searchsorted(place, ids.to_numpy()[known], sorter=order)]
        n = np.bincount(row, counts.to_numpy(), len(sizes))
        ids, counts, row = ids.take(pa.array(known)), counts.take(pa.array(known)), row[known]
        model = sum((pi[row, j] * lik[at, j] for j in range(k)), np.zeros(len(row))) / documents["z"].to_numpy()[row]
        columns = [documents["doc_id"].take(pa.array(row)), ids, counts, counts.to_numpy() / (n[row] + 1e-9), model]
        return pa.table(columns, names=["doc_id", "word_id", "cnt", "emp", "mod"])

    mine, needed = blocks(rows, phi, k)
    return mine.groupBy("block").cogroup(needed.groupBy("of_block")).applyInArrow(run, schema)


def doc_model_kl(fit: DataFrame) -> DataFrame:
    """(doc_id, kl) between the document's words and the model."""
    term = F.col("emp") * (F.log(F.col("emp") + 1e-100) - F.log(F.col("mod") + 1e-100))
    return fit.groupBy("doc_id").agg(F.sum(term).alias("kl"))


def word_misfit(fit: DataFrame) -> DataFrame:
    """(word_id, n_docs, score): documents that hold more of a word than the model says, and how much more."""
    miss = F.greatest(F.col("emp") - F.col("mod"), F.lit(0.0))
    return fit.groupBy("word_id").agg(F.sum((miss > 0).cast("long")).alias("n_docs"), F.sum(miss).alias("score"))


def missing_words(misfit: DataFrame, min_docs: int, keep: Column) -> DataFrame:
    """(word_id, n_docs, score, rank): words the model explains worst, the first `keep` of them."""
    ranked = misfit.where(F.col("n_docs") >= min_docs).withColumn("key", -F.col("score"))
    return order_rank(ranked, ["key", "word_id"]).where(F.col("rank") < keep).drop("key")


def log_factorials(doc_counts: DataFrame, k: int) -> DataFrame:
    """(ka, kb, value) for ka <= kb: sum over documents of ln n!, of one topic or of two merged."""
    from docsift.functions.special import lgamma

    cells = entries("n", k)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    total = [F.sum(lgamma((cells[a] if a == b else cells[a] + cells[b]) + 1.0)).alias(f"v{a}_{b}") for a, b in pairs]
    row = F.array(*[F.struct(F.lit(a).alias("ka"), F.lit(b).alias("kb"), F.col(f"v{a}_{b}").alias("value")) for a, b in pairs])
    return doc_counts.agg(*total).select(F.explode(row).alias("r")).select("r.*")
