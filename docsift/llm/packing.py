"""Best-two-fit packing of token pieces into sequences.

A bin is filled greedily with the largest piece that still fits; then its smallest piece is replaced by
two unpacked pieces that fill the widened gap more tightly, if there are such. Only lengths matter to
this, so the plan is made from the histogram of lengths (at most `size` numbers, whatever the corpus),
and a filled bin is used again as often as the counts allow. Spark numbers the pieces of each length and
every piece looks up its place in the plan, so no piece passes the driver.

A null or empty text is the closing id alone. Rows repeated with one doc_id are packed as often as they
occur; ties are equal pieces. An empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import batch_by_bytes, slots, table

PIECE = "piece int, start long, length long, ids_crc32 long"


LONG_SPACE = re.compile(r"\s{2000}")


class BytePairs:
    """Ids as the named encoder (the json file) gives them; strings of its added tokens get their own ids.

    The rank file's encoder of the same vocabulary is several times faster but knows no added tokens; texts
    that hold one of them, or very long runs of white space, on which its splitter overflows, go to the
    named encoder.
    """

    def __init__(self, ranks_path: str, json_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, encoding="utf-8") as f:
            added = [re.escape(t["content"]) for t in json.load(f)["added_tokens"]]
        self.slow_only = re.compile("|".join([LONG_SPACE.pattern, *added]))
        self.json_path, self._slow = json_path, None

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.json_path)
        return self._slow

    def ids(self, text: str) -> list[int]:
        if self.slow_only.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than `size`, if there are several."""
    if n <= size:
        return [(0, n)]
    first = (n - 1) % size + 1
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, ranks_path: str, json_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document, with the closing id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = BytePairs(ranks_path, json_path)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array(encoder.ids(text or "") + [end_id], "<u4")
                rows += [(key, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), size))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return batch_by_bytes(docs).select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {PIECE}")


class _Lengths:
    """Counts by length; finds the largest length with pieces left, at most a given one."""

    def __init__(self, counts: dict[int, int], size: int):
        self.left = [0] * (size + 1)
        for n, c in counts.items():
            self.left[n] = c
        self.alive = sorted(n for n, c in counts.items() if c)

    def largest(self, at_most: int) -> int:
        """0 if there is none."""
        i = bisect_right(self.alive, at_most)
        return self.alive[i - 1] if i else 0

    def take(self, n: int, times: int = 1):
        self.left[n] -= times
        if not self.left[n]:
            del self.alive[bisect_left(self.alive, n)]

    def put_back(self, n: int):
        self.left[n] += 1
        if self.left[n] == 1:
            insort(self.alive, n)


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), covering exactly the counted pieces."""
    pool, out = _Lengths(counts, size), []
    while first := pool.largest(size):
        held, gap = [first], size - first
        pool.take(first)
        while n := pool.largest(gap):
            pool.take(n)
            held.append(n)
            gap -= n
        if gap and len(held) > 1:
            room, best = gap + held[-1], (held[-1], 0, 0)
            a = pool.largest(room - 1)
            while a and 2 * a >= best[0] and best[0] < room:
                pool.take(a)
                b = pool.largest(min(room - a, a))
                pool.put_back(a)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                a = pool.largest(a - 1)
            if best[1]:
                pool.put_back(held.pop())
                for n in best[1:]:
                    pool.take(n)
                    held.append(n)
        uses = {n: held.count(n) for n in held}
        more = min(pool.left[n] // k for n, k in uses.items())
        if more:
            for n, k in uses.items():
                pool.take(n, k * more)
        out.append((held, 1 + more))
    return out


class _Places:
    """The plan by length: which sequence and offset the i-th piece of a length gets."""

    def __init__(self, bins: list[tuple[list[int], int]]):
        entries, offsets, used, sequence = [], [], {}, 0
        for held, times in bins:
            at: dict[int, list[int]] = {}
            place = 0
            for n in held:
                at.setdefault(n, []).append(place)
                place += n
            for n, places in at.items():
                entries.append((n, used.get(n, 0), sequence, len(places), len(offsets)))
                offsets += places
                used[n] = used.get(n, 0) + len(places) * times
            sequence += times
        entries.sort()
        table_ = np.array(entries, np.int64).reshape(-1, 5)
        self.first = (table_[:, 0] << 48) + table_[:, 1]
        self.base, self.sequence, self.each, self.offset_at = table_[:, 1], table_[:, 2], table_[:, 3], table_[:, 4]
        self.offsets = np.array(offsets, np.int64)

    def of(self, length: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.searchsorted(self.first, (length << 48) + ordinal, "right") - 1
        turn = ordinal - self.base[e]
        return self.sequence[e] + turn // self.each[e], self.offsets[self.offset_at[e] + turn % self.each[e]]


def pack(cut_pieces: DataFrame, size: int = 2048, buckets: int = 64) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    cut_pieces = table(spark, cut_pieces, "pieces")  # texts are encoded once
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _Places(plan(counts, size))  # the collected histogram has at most `size` rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seq, off = places.of(batch["length"].to_numpy(np.int64), batch.pop("ordinal").to_numpy(np.int64))
            yield batch.assign(sequence_id=seq, offset=off)

    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    numbered = slots(cut_pieces, "length", order, "ordinal", buckets)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = f"doc_id {dict(cut_pieces.dtypes)['doc_id']}, {PIECE}, sequence_id long, offset long"
    return numbered.select(*columns, "ordinal").mapInPandas(run, schema)
