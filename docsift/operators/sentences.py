"""Sentence splitting and the sentence index.

Splitting works inside each document row (array functions), so it needs no shuffle. Only
the vocabulary join and the per-sentence counts move data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docsift.functions import text as T
from docsift.functions.stopwords import ENGLISH
from docsift.session import checkpointed


def fragments(docs: DataFrame, tokenize: bool = False, words: bool = False) -> DataFrame:
    """(doc_id, pos, orig, tokenized, ends_seg, label, next_tokenized).

    `label` is 1 where the last word carries the mark <S>; `next_tokenized` is the following
    fragment of the same document. With `words` also the cleaned words around the boundary,
    `last_word` and `next_word`, each fragment being cleaned once.
    """
    frags = F.transform(
        T.fragments(F.col("text")),
        lambda f: F.struct(
            f["orig"].alias("orig"),
            tokenized(f["orig"], tokenize).alias("tokenized"),
            f["ends_seg"].alias("ends_seg"),
        ),
    )
    rows = docs.select("doc_id", frags.alias("fs"))
    if words:
        rows = rows.withColumn("cw", F.transform("fs", lambda f: _edge_words(f["tokenized"])))
    both = [F.col(c) for c in rows.columns[1:]]
    after = [F.slice(c, F.lit(2), F.size("fs")).alias(f"n{n}") for n, c in enumerate(both)]
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(*both, *after)).alias("pos", "f"))
    extra = [F.col("f.cw.last").alias("last_word"), F.coalesce("f.n1.first", F.lit("")).alias("next_word")] if words else []
    return rows.select(
        "doc_id",
        "pos",
        "f.fs.orig",
        "f.fs.tokenized",
        "f.fs.ends_seg",
        F.element_at(F.split("f.fs.orig", " "), -1).contains("<S>").cast("int").alias("label"),
        F.col("f.n0.tokenized").alias("next_tokenized"),
        *extra,
    )


def _edge_words(tokenized: Column) -> Column:
    return F.struct(T.edge_word(tokenized).alias("first"), T.edge_word(tokenized, last=True).alias("last"))


def tokenized(orig: Column, tokenize: bool = False) -> Column:
    return T.unmarked(T.treebank(orig) if tokenize else orig)


def segment(frags: DataFrame, boundary: Column) -> DataFrame:
    """(doc_id, sent_no, sentence): fragments joined up to each boundary or segment end.

    The window holds one document's fragments, at most one input cell of text.
    """
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    cut = (F.col("ends_seg") | F.coalesce(boundary, F.lit(False))).cast("int")
    numbered = frags.withColumn("sent_no", F.coalesce(F.sum(cut).over(before), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("pos", "orig")))
    return (
        numbered.groupBy("doc_id", "sent_no")
        .agg(parts.alias("p"))
        .select("doc_id", F.col("sent_no").cast("int"), F.array_join(F.col("p.orig"), " ").alias("sentence"))
    )


def unwrapped(docs: DataFrame) -> DataFrame:
    """Documents with the lines of each text joined."""
    return docs.withColumn("text", T.joined_lines(F.col("text")))


def rule_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, sentence) when every candidate is a boundary: no shuffle at all."""
    return docs.select("doc_id", F.posexplode(T.rule_sentences(F.col("text"))).alias("sent_no", "sentence"))


def short(sentences: DataFrame, limit: int = 200) -> DataFrame:
    """Sentences of at most `limit` characters."""
    return sentences.where(F.length("sentence") <= limit)


def sentence_index(sentences: DataFrame, vocab: DataFrame, stopwords=ENGLISH, limit: int = 200):
    """The two tables of the summary search: sents and sent_term.

    sents(doc_id, sent_ix, sentence): short sentences with at least one vocabulary word;
    sent_ix counts the kept sentences of a document. sent_term(doc_id, sent_ix, word_id, cnt).
    Only words and counts are shuffled; the text joins again by key. Both tables are written, so a
    search reads them and splits nothing. The application joins the lines of a text before it
    splits: see unwrapped.
    """
    kept = checkpointed(short(sentences, limit))
    counts = (
        kept.select("doc_id", "sent_no", F.explode(T.content_tokens(F.col("sentence"), stopwords)).alias("word"))
        .join(vocab.select("word", "word_id"), "word")
        .select("doc_id", "sent_no", "word_id")
        .repartition("doc_id")  # one shuffle for the counts and the numbers below
        .groupBy("doc_id", "sent_no", "word_id")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # dense_rank over the kept rows of one document numbers its kept sentences
    ix = F.dense_rank().over(W.partitionBy("doc_id").orderBy("sent_no")) - 1
    terms = checkpointed(counts.withColumn("sent_ix", ix))
    keys = terms.select("doc_id", "sent_no", "sent_ix").distinct()
    sents = kept.join(keys, ["doc_id", "sent_no"]).select("doc_id", "sent_ix", "sentence")
    return checkpointed(sents), terms.select("doc_id", "sent_ix", "word_id", "cnt")


def sentence_maps(sent_term: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, bow map): the counts of one sentence in one cell."""
    entries = F.sort_array(F.collect_list(F.struct("word_id", "cnt")))
    return sent_term.groupBy("doc_id", "sent_ix").agg(F.map_from_entries(entries).alias("bow"))


def highlight(text: Column, sentence: Column) -> Column:
    """Position (1-based, 0 if absent) of the sentence in the text, and the text around it."""
    at = F.position(sentence, text)
    return F.struct(
        at.alias("position"),
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("prefix"),
        F.when(at > 0, sentence).otherwise("").alias("hit"),
        F.when(at > 0, F.substring(text, at + F.length(sentence), F.length(text))).otherwise("").alias("suffix"),
    )
