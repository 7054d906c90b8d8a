"""Bag-of-words tables: documents -> tokens -> counts -> vocabulary -> document-term triples.

Every table is long form. Counting is partial before each shuffle, shuffles are keyed by
(doc_id, word) or word, and joins on word are many-to-one, so adaptive skew handling can
split a hot word.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docsift.functions import text as T
from docsift.functions.ranking import hash_rank
from docsift.functions.stopwords import ENGLISH
from docsift.session import small_batches, written


def tokens(docs: DataFrame, lowercase: bool = False) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.tokens(F.col("text"), lowercase)).alias("pos", "word"))


def content_tokens(docs: DataFrame, stopwords=ENGLISH, lowercase: bool = False) -> DataFrame:
    words = T.content_tokens(F.col("text"), stopwords, lowercase)
    return docs.select("doc_id", F.explode(words).alias("word"))


def word_counts(docs: DataFrame, stopwords=ENGLISH, lowercase: bool = False) -> DataFrame:
    """(doc_id, word, cnt) without stopwords.

    The texts are dealt by document and sorted by it, so the rows of a document are neighbours and its words are
    counted where they are found: no word is shuffled, and a row is made of a word of a document, never of a token.
    """
    text = F.lower("text") if lowercase else F.col("text")
    # dealt before anything is computed: texts that are already spread are shuffled once
    rows = small_batches(docs).select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    rows = rows.select("doc_id", text.cast("binary").alias("text"))
    doc_id = docs.schema["doc_id"].dataType
    count = _counter(frozenset(w.encode() for w in stopwords), T.TOKEN.encode())
    return rows.mapInArrow(count, StructType([StructField("doc_id", doc_id), StructField("word", StringType()), StructField("cnt", LongType())]))


def _counter(drop: frozenset, token: bytes, most: int = 100_000):
    """Counts of the words (in bytes: a word is ASCII) of documents whose rows are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(token).findall
        owners, sizes, words, counts = [], [], [], []
        held: Counter = Counter()

        def close(owner) -> None:
            mine = [(w, n) for w, n in held.items() if w.lower() not in drop]  # of the counted words: fewer than the tokens
            owners.append(owner)
            sizes.append(len(mine))
            words.extend(w for w, _ in mine)
            counts.extend(n for _, n in mine)
            held.clear()

        def rows(kind) -> pa.RecordBatch:
            at = np.repeat(np.arange(len(owners)), sizes)
            columns = [pa.array(owners, kind).take(pa.array(at)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
            for x in (owners, sizes, words, counts):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "word", "cnt"])

        kind = owner = None
        for batch in batches:
            if kind is None and len(batch):
                kind, owner = batch.column("doc_id").type, batch.column("doc_id")[0].as_py()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if doc != owner:
                    close(owner)
                    owner = doc
                    if len(words) > most:
                        yield rows(kind)
                if text:
                    held.update(find(text))
        if kind is not None:
            close(owner)
            yield rows(kind)

    return run


def document_frequency(counts: DataFrame) -> DataFrame:
    """(word, df, cf): documents holding the word, and its total count."""
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("cf"))


def doc_total(docs: DataFrame) -> Column:
    """Number of documents, empty ones included, as a scalar subquery."""
    return docs.select(F.count(F.lit(1))).scalar()


def kept_words(counts: DataFrame, docs: DataFrame, min_doc: int = 2, max_share: float = 0.8) -> DataFrame:
    """Words in at least `min_doc` documents and at most `max_share` of them."""
    return document_frequency(counts).where(
        (F.col("df") >= min_doc) & (F.col("df") / doc_total(docs) <= max_share)
    )


def vocabulary(words: DataFrame, seed=0) -> DataFrame:
    """(word_id, word, df, cf) with dense ids from 0 in hash order.

    Any order of ids is as good as another; hash order lets the ids be given out by many
    tasks at once.
    """
    return hash_rank(words, "word", seed, "word_id").select(
        F.col("word_id").cast("int").alias("word_id"), "word", "df", "cf"
    )


def doc_term(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, word_id, cnt): Spark picks broadcast or shuffle from the measured vocabulary size."""
    return counts.join(vocab.select("word", "word_id"), "word").select("doc_id", "word_id", "cnt")


def corpus(docs: DataFrame, stopwords=ENGLISH, min_doc: int = 2, max_share: float = 0.8, lowercase: bool = False):
    """The vocabulary and the triples of a document table.

    The counts are written once: the texts are read and tokenized once, and the vocabulary reads back
    no more than words and counts.
    """
    counts = written(word_counts(docs, stopwords, lowercase), "counts")
    # written as well: the ranks read the words twice
    vocab = vocabulary(written(kept_words(counts, docs, min_doc, max_share), "words"))
    return vocab, doc_term(counts, vocab)


def corpus_vocabulary(docs: DataFrame, stopwords=ENGLISH, min_doc: int = 2, max_share: float = 0.8, lowercase: bool = False) -> DataFrame:
    """The vocabulary alone: what is written has a row per word, none per document."""
    words = kept_words(word_counts(docs, stopwords, lowercase), docs, min_doc, max_share)
    return vocabulary(written(words, "words"))


def unigram(vocab: DataFrame) -> DataFrame:
    """Corpus share of each word."""
    total = vocab.select(F.sum("cf")).scalar()
    return vocab.select("word_id", (F.col("cf") / total).alias("p"))


def doc_length(triples: DataFrame) -> DataFrame:
    return triples.groupBy("doc_id").agg(
        F.sum("cnt").alias("n_words"), F.count(F.lit(1)).alias("n_distinct")
    )


def length_percentiles(triples: DataFrame, points=(0, 5, 50, 95, 100)) -> DataFrame:
    """Interpolated percentiles of words and distinct words per document, one row per point."""
    at = F.array(*[F.lit(p / 100.0) for p in points])
    wide = doc_length(triples).agg(
        F.percentile("n_words", at).alias("w"), F.percentile("n_distinct", at).alias("d")
    )
    rows = F.arrays_zip(F.array(*[F.lit(p) for p in points]).alias("pct"), F.col("w"), F.col("d"))
    return wide.select(F.explode(rows).alias("r")).select(
        F.col("r.pct").alias("pct"), F.col("r.w").alias("n_words"), F.col("r.d").alias("n_distinct")
    )


def corpus_stats(docs: DataFrame, triples: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: documents, documents with words, document-word pairs, tokens, vocabulary size."""
    seen = doc_length(triples).agg(
        F.count(F.lit(1)).alias("n_docs_with_words"),
        F.sum("n_distinct").alias("n_pairs"),
        F.sum("n_words").alias("n_tokens"),
    )
    return seen.select(
        doc_total(docs).alias("n_docs"),
        "n_docs_with_words",
        "n_pairs",
        "n_tokens",
        vocab.select(F.count(F.lit(1))).scalar().alias("vocab_size"),
    )


def weighted_docword(weighted: DataFrame, threshold: float) -> DataFrame:
    """Sum of weight * count per document and word, over rows whose weight is above the threshold."""
    return (
        weighted.where(F.col("weight") > threshold)
        .groupBy("doc_id", "word_id")
        .agg(F.sum(F.col("weight") * F.col("cnt")).alias("value"))
    )


def bow_rows(triples: DataFrame) -> DataFrame:
    """One row per document: word_ids and counts as parallel arrays in word order."""
    packed = F.sort_array(F.collect_list(F.struct("word_id", "cnt")))
    # a group is one document, itself one cell of the input
    return triples.groupBy("doc_id").agg(packed.alias("p")).select(
        "doc_id", F.col("p.word_id").alias("word_ids"), F.col("p.cnt").alias("counts")
    )


def pack(triples: DataFrame) -> DataFrame:
    """Packed form: space-separated 1-based ids and counts."""
    rows = bow_rows(triples)
    return rows.select(
        "doc_id",
        F.array_join(F.transform("word_ids", lambda i: (i + 1).cast("string")), " ").alias("ids"),
        F.array_join(F.transform("counts", lambda c: c.cast("string")), " ").alias("cnts"),
    )


def unpack(packed: DataFrame) -> DataFrame:
    """Triples from the packed form, ids back to 0-based."""
    pairs = F.arrays_zip(F.split("ids", " ").alias("i"), F.split("cnts", " ").alias("c"))
    return packed.select("doc_id", F.explode(pairs).alias("r")).select(
        "doc_id",
        (F.col("r.i").cast("int") - 1).alias("word_id"),
        F.col("r.c").cast("long").alias("cnt"),
    )


def ldac_lines(triples: DataFrame, offset: int = 0) -> DataFrame:
    """One text line per document: number of pairs, then id:count pairs."""
    pairs = F.transform(
        F.arrays_zip("word_ids", "counts"),
        lambda r: F.concat_ws(":", (r["word_ids"] + offset).cast("string"), r["counts"].cast("string")),
    )
    return bow_rows(triples).select(
        "doc_id", F.concat_ws(" ", F.size("word_ids").cast("string"), F.array_join(pairs, " ")).alias("line")
    )


def concat_bow(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two corpora over one vocabulary as one; the second's document ids move past the first's."""
    if first.schema.names != second.schema.names:
        raise ValueError("both corpora need the columns doc_id, word_id, cnt")
    shift = first.select(F.max("doc_id")).scalar() + 1
    return first.unionByName(second.withColumn("doc_id", F.col("doc_id") + shift))
