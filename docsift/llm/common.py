"""Words and their hashes, tables in the shared folder, ranks: what several operators need."""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docsift.session import scratch_path

#: A word of the operators that hash words: ASCII digits and lower-case letters, and every code point beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
# In UTF-8 every byte of a code point beyond ASCII is at least 0x80, so words can be cut in the bytes.
_IN_WORD = np.zeros(256, bool)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _IN_WORD[_c] = True
_BYTE_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return got[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times base ** position; two of them give the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(_BASE, len(data)), out=out[1:], dtype=np.uint64)
    return out


def inverse_powers(n: int) -> np.ndarray:
    """Factors that move a stretch from its position to position 0."""
    return powers(pow(_BASE, -1, 2**64), n)


def stretch_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[starts:ends], equal for equal bytes at any place."""
    return mixed((prefix[ends] - prefix[starts]) * inverse_powers(len(prefix))[starts])


def window_hashes(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """`stretch_hashes` of the n bytes from each place, without prefix sums of all of data."""
    out = np.zeros(len(at), np.uint64)
    if len(at):
        view, factors = np.lib.stride_tricks.sliding_window_view(data, n), powers(_BASE, n)
        for s in range(0, len(at), 20_000):
            out[s : s + 20_000] = (_BYTE_VALUE[view[at[s : s + 20_000]]] * factors).sum(1, dtype=np.uint64)
    return mixed(out)


def word_places(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) UTF-8 bytes of a text, and where its words start and end. Null has no words."""
    low = (text or "").encode("utf-8", "replace").translate(_LOWER)
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = _IN_WORD[np.frombuffer(low, np.uint8)]
    step = np.diff(inside)
    return low, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(low: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return stretch_hashes(prefix_hashes(np.frombuffer(low, np.uint8)), starts, ends)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + hashes[j : j + n]
    return mixed(out)


def sliding_min_places(values: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest value (the first of equals) of every w consecutive values, each place once."""
    if len(values) < w:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, w)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def words(text: str | None) -> list[str]:
    """The same words as strings."""
    return re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def batch_by_bytes(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """df, in a session whose Arrow batches to Python hold at most `most` bytes: texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch_path(spark, name)
    # a writer holds a row group of its task in memory: texts make groups large long before they are many rows
    df.write.option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slots(df: DataFrame, group: str, order: list[Column], name: str, buckets: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps; a group is numbered by many tasks.

    Rows go to `buckets` parts of their group by a hash; a small table of part sizes (groups x buckets
    rows) gives each part its first number.
    """
    from pyspark.sql import Window

    parted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = parted.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return (
        parted.withColumn("_within", within)
        .join(first, [group, "_part"])
        .withColumn(name, (F.col("_first") + F.col("_within") - 1).cast("long"))
        .drop("_part", "_within", "_first")
    )
