"""Language identification by known words, backing off to shorter and shorter character n-grams.

A word seen in training is scored by its log frequency in each language. An unseen word is scored by
the longest order (5 down to 1) at which one of its character n-grams, with word-edge marks, was seen:
the mean log frequency of its seen grams of that order. A document's score is the posterior of the best
language under equal priors.

Training reads about `sample_rows` labelled rows, chosen by a hash of the row, and keeps the `max_words`
most frequent words and `max_grams` most frequent grams: the model's size is bounded by these parameters.
Every document is predicted, over its whole text. Null texts and texts without a letter are `und` with
score 0, and so is everything if nothing was learned. Ties go to the first language in order. Rows with
null or empty lang teach nothing. Repeated rows count as often as they occur. Extra columns pass through.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import batch_by_bytes, table

ORDERS = (5, 4, 3, 2, 1)
CACHED = 1 << 18  # unseen words whose scores a task remembers, in one array
_RUNS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> Counter:
    """Lower-cased runs of letters with their counts."""
    out = Counter(_RUNS.findall((text or "").lower()))
    for w in [w for w in out if not w.isalpha()]:  # other numerals, such as fractions, are no letters
        n = out.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            out[part] += n
    return out


def grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)] if order > 1 else list(word)


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    seen: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "scores": None}

    def unseen(self, w: str) -> int:
        """Row of `scores` with the log frequency in each language of a word that is not in the model."""
        at = self.seen.get(w)
        if at is None:
            if self.scores is None:
                self.scores = np.zeros((CACHED, len(self.langs)))
            at = self.seen[w] = len(self.seen)
            self.scores[at] = 0.0
            for order in ORDERS:
                known = [self.grams[g] for g in grams(w, order) if g in self.grams]
                if known:
                    self.scores[at] = self.gram_logs[known].mean(axis=0)
                    break
        return at

    def text(self, text: str | None) -> tuple[str, float]:
        found = letter_words(text)
        if not found or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        known, counts, rest, others = [], [], [], []
        for w, n in found.items():
            at = self.words.get(w)
            if at is None:
                if len(self.seen) >= CACHED and w not in self.seen:
                    total += np.array(others, float) @ self.scores[rest]
                    rest, others = [], []
                    self.seen.clear()
                rest.append(self.unseen(w))
                others.append(n)
            else:
                known.append(at)
                counts.append(n)
        if rest:
            total += np.array(others, float) @ self.scores[rest]
        if known:
            total += np.array(counts, float) @ self.word_logs[known]
        odds = np.exp(total - total.max())
        return self.langs[int(total.argmax())], float(odds.max() / odds.sum())


def _rows(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame([(term, lang, n) for (lang, term), n in counts.items()], columns=["term", "lang", "n"])


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for text, lang in zip(batch["text"], batch["lang"]):
            for w, n in letter_words(text).items():
                counts[lang, w] += n
            if len(counts) > 50_000:  # keeps a task's memory small; Spark adds the parts
                yield _rows(counts)
                counts.clear()
        yield _rows(counts)


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for w, lang, n in zip(batch["term"], batch["lang"], batch["n"]):
            for order in ORDERS:
                for g in grams(w, order):
                    counts[lang, g] += n
            if len(counts) > 50_000:
                yield _rows(counts)
                counts.clear()
        yield _rows(counts)


def _summed(df: DataFrame, langs: list[str], most: int) -> pd.DataFrame:
    """The `most` most frequent terms with their counts by language; ties in the order of terms."""
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)]
    total = sum((F.col(f"c{i}") for i in range(1, len(langs))), F.col("c0"))
    chosen = df.groupBy("term").agg(*by_lang).orderBy(total.desc(), "term").limit(most)
    return table(df.sparkSession, chosen, "terms").toPandas()  # chosen by the executors, at most `most` rows arrive


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(len(counts), 1)))


def fit(labelled: DataFrame, sample_rows: int = 40_000, max_words: int = 200_000, max_grams: int = 200_000) -> Model:
    """Learn from rows (text, lang)."""
    rows = batch_by_bytes(labelled).where((F.col("lang") != "") & F.col("text").isNotNull()).select("text", "lang")
    share = min(1.0, sample_rows / max(rows.count(), 1))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("text", "lang"), 11) <= int(share * (1 << 53)))
    schema = "term string, lang string, n long"
    counts = sample.mapInPandas(_word_counts, schema).groupBy("term", "lang").agg(F.sum("n").alias("n"))
    counts = table(labelled.sparkSession, counts, "words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Model([], {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    words_ = _summed(counts, langs, max_words)
    grams_ = _summed(counts.mapInPandas(_gram_counts, schema), langs, max_grams)
    columns = [f"c{i}" for i in range(len(langs))]
    gram_counts = grams_[columns].to_numpy(float)
    gram_logs, order = np.zeros_like(gram_counts), grams_["term"].str.len().to_numpy()
    for n in ORDERS:
        gram_logs[order == n] = _logs(gram_counts[order == n])
    return Model(
        langs,
        {w: i for i, w in enumerate(words_["term"])},
        _logs(words_[columns].to_numpy(float)),
        {g: i for i, g in enumerate(grams_["term"])},
        gram_logs,
    )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; only the text is looked at."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shipped.value.text(t) for t in batch], columns=["lang_pred", "score"])

    found = F.pandas_udf(run, "lang_pred string, score double")
    return batch_by_bytes(docs).withColumn("_found", found("text")).select("*", "_found.lang_pred", "_found.score").drop("_found")


def held_out():
    """A quarter of the documents, by their id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
