"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base spans (email, ip, card, phone) are found by fixed patterns in one pass over the whole text. Each is
a seed. Tokens with a digit outside base spans are candidates. The words around seeds and candidates make
lexical patterns: the two words before, and the word before with the word after. A pattern's score for a
kind is the lower confidence bound (Wilson) of the share of its distinct instances that are known to be of
the kind, so candidates that nothing supports lower it, and few instances leave it low. The instances of
trusted patterns become known, as their best pattern's kind, and support further patterns, until no round
finds new ones. Trusted patterns mark candidates as further spans. Graph and scores are tables; nothing of
them passes the driver.

Null texts are empty. Rows repeated with one doc_id are judged by their own texts. Ties between kinds go
to the higher score, then to the first kind. Empty tables give empty results. Other columns are not read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import batch_by_bytes, table

KINDS = ("email", "ip", "card", "phone")
# fixed patterns of the base kinds
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s")
_EDGE = " \t\r\n\"'`.,;:!?()[]{}<>|*#$%&"


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards, which takes linear time on texts without any."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    out = [(0, *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGITS.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def candidate_tokens(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit, without the punctuation around them, that touch no taken span."""
    out, done, taken = [], 0, sorted(taken)
    i = 0
    while m := _DIGIT.search(text, done):
        start, end = m.start(), _SPACE.search(text, m.end())
        end = end.start() if end else len(text)
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if not any(a < end and start < b for a, b in taken[i : i + 4]):
            out.append((start, end))
    return out


def _word_before(text: str, at: int) -> tuple[str, int]:
    """The token that ends before `at` (at most 40 characters of it, digits as 0), and its start."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace() and end - start < 40:
        start -= 1
    return _DIGIT.sub("0", text[start:end].lower()).strip(_EDGE) or text[start:end], start


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span."""
    one, at = _word_before(text, start)
    two, _ = _word_before(text, at)
    rest = text[end : end + 80].split(None, 1)
    after = _DIGIT.sub("0", rest[0][:40].lower()).strip(_EDGE) or rest[0][:40] if rest else ""
    return [p for p, full in ((f"{two} {one} _", two and one), (f"{one} _ {after}", one and after)) if full]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, mark, text in zip(batch["doc_id"], batch["mark"], batch["text"]):
            text = text or ""
            base = base_spans(text)
            own = [(k, a, b) for k, a, b in base] + [(-1, a, b) for a, b in candidate_tokens(text, [s[1:] for s in base])]
            rows.append((key, mark, base, [(k, a, b, text[a:b][:200], contexts(text, a, b)) for k, a, b in own]))
        yield pd.DataFrame(rows, columns=["doc_id", "mark", "base", "seen"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), base spans, and what was seen with its contexts."""
    span = "kind:int,start:int,end:int"
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, base array<struct<{span}>>, seen array<struct<{span},instance:string,patterns:array<string>>>"
    return batch_by_bytes(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInPandas(_scan, schema)


def learned_patterns(seen: DataFrame, share: float, z: float) -> DataFrame:
    """(pattern, kind, score) of the trusted patterns; seen: rows of kind, instance, patterns."""
    spark = seen.sparkSession
    edges = table(spark, seen.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "edges")
    links = edges.select("pattern", "instance").distinct()
    sizes = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # with fewer instances the bound stays below the share even if all of them are known
    links = table(spark, links.join(sizes.where(F.col("n") * (1 - share) >= z * z * share), "pattern"), "links")
    seeds = edges.where("kind >= 0").select("instance", "kind").distinct()
    known = table(spark, seeds, "instances")
    p, n = F.col("k") / F.col("n"), F.col("n")
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    while True:  # what is known only grows, so this ends
        support = links.join(known, "instance").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        patterns = support.select("pattern", "kind", bound.alias("score")).where(F.col("score") >= share)
        patterns = table(spark, patterns, "patterns")
        best = F.max(F.struct("score", (-F.col("kind")).alias("k")))
        found = links.join(patterns, "pattern").groupBy("instance").agg((-best["k"]).alias("kind"))
        new = table(spark, found.join(known.select("instance").distinct(), "instance", "left_anti"), "found")
        if new.isEmpty():
            return patterns
        known = table(spark, known.unionByName(new), "instances")


def find_personal(docs: DataFrame, share: float = 0.5, z: float = 1.2816) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by kind and start); spans has the learned ones too.

    A pattern is trusted if more than `share` of what it finds is of the kind, with 90 % confidence (z = 1.2816).
    """
    spark = docs.sparkSession
    found = table(spark, scan(docs), "personal")
    seen = found.select("doc_id", "mark", F.explode("seen").alias("s")).select("doc_id", "mark", "s.*")
    patterns = table(spark, learned_patterns(seen.select("kind", "instance", "patterns"), share, z), "trusted")
    best = F.max(F.struct("score", (-F.col("p_kind")).alias("k")))
    more = (
        seen.where("kind < 0")
        .select("doc_id", "mark", "start", "end", F.explode("patterns").alias("pattern"))
        .join(patterns.withColumnRenamed("kind", "p_kind"), "pattern")
        .groupBy("doc_id", "mark", "start", "end")
        .agg((-best["k"]).alias("kind"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.select("doc_id", "mark", "base").join(more, same, "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans")
    )


def as_text(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
