"""Secret scanning with a random forest that removes false positives.

A finding is a value of at least 6 characters after a name that announces a secret and `=` or `:` (any characters, up
to the closing quote or white space), a quoted value of at least 8 characters after any other `=` or `:`, or a run of at
least 16 characters of keys (letters, digits, `+/_-`, closing `=`) with a digit or a change from lower to upper case.
Where these overlap, the former goes first and the latter keeps what is left. Its features are
length, character classes, transitions between classes, entropy, the share of it that dictionary words
cover, marks of the path it comes from, and the neighbouring words. A random forest trained on labelled
findings scores every finding; those above the threshold are secrets and are blanked out of the text.

Where no labels are given, findings are labelled by strong signs (`weak_label`) and the others are left
unlabelled. Training takes about `sample` findings of each label. The dictionary is counted over all
documents and holds the words that at least `word_share` of them have outside findings, so its size follows
the vocabulary and not the rows. Forest and dictionary go to all tasks, so that texts are scanned, judged
and blanked where they are, without a shuffle.

Null texts have no findings and stay null. Without findings of both labels nothing is learned and the
weak label alone decides. Repeated rows get equal results. Null paths count as empty. Other columns pass
through.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import batch_by_bytes, table
from docsift.session import scratch_path

# fixed lists: names that announce a secret, beginnings that providers give their keys
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "auth")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "AIza", "eyJ")
PLACEHOLDERS = ("example", "changeme", "placeholder", "xxxx", "your", "dummy", "test", "0000", "1234567")
PATH_MARKS = ("test", "example", "doc", "sample", "config", "env")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_NAME = re.compile(rf"""(?:{"|".join(NAMES)})[\w-]{{0,20}}["']?[ \t]{{0,8}}\Z""", re.I)
_SIGN = re.compile(r"(?:=>|:=|[=:])[ \t]{0,8}")
_VALUE = re.compile(r""""([^"\n]{6,})"|'([^'\n]{6,})'|(?!"[^"\n]*"|'[^'\n]*')["']?([^\s"']\S{5,})""")
_CLOSING = "\"'`,;.)]}>"  # what follows an unquoted value
_QUOTED = re.compile(r"""[=:]\s?["']([^"'\s]{8,})["']""")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
_WORDS = re.compile(r"[a-z]{3,}")
_NEXT = re.compile(r"\s*(\S{1,40})")
HASHED = 8


def _named(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while sign := _SIGN.search(text, at):
        at = sign.end()
        m = _NAME.search(text, max(0, sign.start() - 45), sign.start()) and _VALUE.match(text, at)
        if m:
            s, at = m.span(m.lastindex)
            yield s, at if m.lastindex < 3 else max(s + len(text[s:at].rstrip(_CLOSING)), s + 6)


def findings(text: str) -> list[tuple[int, int]]:
    """Non-overlapping spans, by start."""
    kept: list[tuple[int, int]] = list(_named(text))
    for more, least in (([m.span(1) for m in _QUOTED.finditer(text)], 8), ([m.span() for m in _RUN.finditer(text)], 16)):
        taken, free, i = kept, [], 0
        for s, e in more:
            while i < len(taken) and taken[i][1] <= s:
                i += 1
            j = i
            while j < len(taken) and taken[j][0] < e:
                free.append((s, taken[j][0]))
                s = taken[j][1]
                j += 1
            free.append((s, e))
        kept = sorted(taken + [(s, e) for s, e in free if e - s >= least and (least == 8 or _MIXED.search(text, s, e))])
    return kept


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def neighbours(text: str, start: int, end: int) -> tuple[str, str]:
    """The 60 characters before, lower-cased, and the next word."""
    m = _NEXT.match(text, end)
    return text[max(0, start - 60) : start].lower(), m.group(1).lower() if m else ""


def weak_label(value: str, before: str, words: frozenset[str] = frozenset()) -> int:
    """1 secret, 0 none, -1 unknown. A word of the dictionary after a colon is prose, after = it may be either."""
    near = before[-30:].rstrip(" \t\"'")
    assigned = near.endswith(("=", ":", "=>")) and any(n in near for n in NAMES)
    low = value.lower()
    if any(p in low for p in PLACEHOLDERS) or len(set(value)) < 5:
        return 0
    if assigned and low in words:
        return 0 if near.endswith(":") else -1
    if assigned or value.startswith(PREFIXES):
        return 1
    return -1 if any(n in near for n in NAMES) else 0


def features(value: str, before: str, after: str, path: str, dictionary: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = [_class(c) for c in value]
    moves = Counter(zip(kinds, kinds[1:]))
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    covered = sum(len(w) for w in _WORDS.findall(value.lower()) if w in dictionary)
    near = before[-30:].rstrip(" \t\"'")
    words = re.findall(r"[^\W\d_]+", before)[-2:] + [after]
    hashed = [0.0] * HASHED
    for w in words:
        hashed[sum(map(ord, w)) % HASHED] += 1
    return [
        float(n), entropy, covered / n, *[kinds.count(k) / n for k in range(4)],
        *[moves[a, b] / n for a in range(4) for b in range(4) if a != b],
        float(all(c in "0123456789abcdefABCDEF" for c in value)), float(value.startswith(PREFIXES)),
        float(near.endswith(("=", ":"))), float(before.endswith(('"', "'"))), float(any(w in near for w in NAMES)),
        *[float(m in path) for m in PATH_MARKS], *hashed,
    ]


def _common_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            plain, at = [], 0
            for s, e in findings(text):
                plain.append(text[at:s])
                at = e
            counts.update(set(_WORDS.findall(" ".join([*plain, text[at:]]).lower())))
            if len(counts) > 200_000:
                yield pd.DataFrame(list(counts.items()), columns=["word", "n"])
                counts = Counter()
    if counts:
        yield pd.DataFrame(list(counts.items()), columns=["word", "n"])


def dictionary(docs: DataFrame, word_share: float) -> frozenset[str]:
    """The words that stand outside findings in at least `word_share` of all documents."""
    rows = docs.where(F.col("text").isNotNull()).select("text")
    least = word_share * rows.count()
    counts = rows.mapInPandas(_common_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(counts.where(F.col("n") >= least).select("word").toArrow()["word"].to_pylist())


def _labelled(shipped):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, path in zip(batch["text"], batch["path"]):
                for s, e in findings(text or ""):
                    before, after = neighbours(text, s, e)
                    label = weak_label(text[s:e], before, shipped.value)
                    if label >= 0:
                        rows.append((features(text[s:e], before, after, (path or "").lower(), shipped.value), float(label)))
            yield pd.DataFrame(rows, columns=["features", "label"])

    return run


class Forest:
    """Trees as arrays, for use inside tasks."""

    def __init__(self, trees: list[pd.DataFrame]):
        self.trees = []
        for t in trees:
            t = t.sort_values("id")
            self.trees.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "chance")))

    def chances(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, chance in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := left[at] >= 0).any():
                go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
                at = np.where(inner, go, at)
            total += chance[at]
        return total / max(len(self.trees), 1)


def train(docs: DataFrame, words: frozenset[str], sample: int = 20_000, trees: int = 30, depth: int = 8) -> Forest | None:
    """A forest from the labelled findings of docs (text, path)."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(words)
    rows = table(spark, docs.select("text", "path").mapInPandas(_labelled(shipped), "features array<double>, label double"), "findings")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1, sample / counts[1.0]).otherwise(sample / counts[0.0])
    data = table(spark, rows.where(F.rand(6) < share).select(array_to_vector("features").alias("features"), "label"), "training")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=6, subsamplingRate=0.8).fit(data)
    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")  # at most trees * 2 ** (depth + 1) rows
    n = nodes.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.coalesce(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        (F.col("nodeData.impurityStats")[1] / (F.col("nodeData.impurityStats")[0] + F.col("nodeData.impurityStats")[1])).alias("chance"),
    ).toPandas()
    return Forest([t for _, t in n.groupby("tree")])


class Scanner:
    """Findings of a text with their scores."""

    def __init__(self, words: frozenset[str], forest: Forest | None, threshold: float):
        self.words, self.forest, self.threshold = words, forest, threshold

    def scores(self, text: str, path: str | None) -> list[tuple[int, int, float]]:
        spans = findings(text)
        if not spans:
            return []
        around = [neighbours(text, s, e) for s, e in spans]
        if self.forest is None:
            return [(s, e, float(weak_label(text[s:e], b, self.words) == 1)) for (s, e), (b, _) in zip(spans, around)]
        low = (path or "").lower()
        x = np.array([features(text[s:e], b, a, low, self.words) for (s, e), (b, a) in zip(spans, around)])
        return [(s, e, float(p)) for (s, e), p in zip(spans, self.forest.chances(x))]

    def blanked(self, text: str, scored: list[tuple[int, int, float]]) -> str:
        out, at = [], 0
        for s, e, p in scored:
            if p >= self.threshold:
                out += [text[at:s], "[SECRET]"]
                at = e
        return "".join(out) + text[at:]


def learn(docs: DataFrame, threshold: float = 0.5, word_share: float = 1e-5, **limits) -> Scanner:
    """A scanner from docs (text, path)."""
    words = dictionary(batch_by_bytes(docs), word_share)
    return Scanner(words, train(docs, words, **limits), threshold)


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """docs (text, path and any other columns) with findings (start, end, score) and blanked."""
    shipped = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, paths in columns:
            rows = []
            for text, path in zip(texts, paths):
                scored = shipped.value.scores(text, path) if text else []
                rows.append((scored, None if text is None else shipped.value.blanked(text, scored)))
            yield pd.DataFrame(rows, columns=["findings", "blanked"])

    found = F.pandas_udf(run, "findings array<struct<start:int,end:int,score:double>>, blanked string")
    return batch_by_bytes(docs).withColumn("_scan", found("text", "path")).select("*", "_scan.findings", "_scan.blanked").drop("_scan")
