"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q, at least max(least, times * q) long, that no
neighbouring word extends. Each of its words stands in it at least `times` times, so a word that occurs less
often in a segment is in no run of the segment and splits it. Pieces are split again by their own counts
until nothing changes; pieces of fewer than `least` words hold no run. What survives is scanned lag by lag:
the stretches in which every word equals the word one lag later. Lags below DIRECT are scanned one by one.
A lag of B = 2 ** k to 2 B - 1 has a run only if some aligned block of B words recurs at that lag, so longer
lags are scanned where the hash of such a block recurs; the scan itself compares words, so a collision costs
time and changes nothing. A lag that a shorter period of the same run explains is passed over.

Words are what stands between the white space of ASCII. Null and empty texts have no words and no run, and
the collapsed text "". Repeated rows are each answered; null ids and other columns pass through, as do
columns called `runs` or `collapsed` by being replaced. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from docsift.llm.common import batch_by_bytes, mixed, powers, stretch_hashes

DIRECT = 64
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def segments(words: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that splitting at rare words leaves."""
    todo, out = [(0, len(words))], []
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        _, at, counts = np.unique(words[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[at] < times)
        if not len(rare):
            out.append((a, b))
            continue
        starts = a + np.concatenate(([0], rare + 1))
        ends = a + np.concatenate((rare, [b - a]))
        long = ends - starts >= least
        todo += zip(starts[long].tolist(), ends[long].tolist())
    return sorted(out)


def _scan(w: np.ndarray, lag: int, least: int, times: int, found: dict[tuple[int, int], int]) -> None:
    """Add the maximal stretches of period `lag`; a stretch known by a smaller period keeps that."""
    same = np.zeros(len(w) - lag + 2, np.int8)
    same[1:-1] = w[lag:] == w[:-lag]
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[::2], edges[1::2] + lag
    long = ends - starts >= max(least, times * lag)
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        found.setdefault((a, b), lag)


def scan_lags(w: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of a segment of word numbers."""
    found: dict[tuple[int, int], int] = {}
    most = len(w) // times
    for lag in range(1, min(DIRECT, most + 1)):
        _scan(w, lag, least, times, found)
    if most < DIRECT:
        return found
    values = mixed(w.astype(np.uint64) + np.uint64(1))
    prefix = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(values * powers(0x9E3779B97F4A7C15, len(w)), out=prefix[1:], dtype=np.uint64)
    size = DIRECT
    while size <= most:
        at = np.arange(len(w) - size + 1)
        blocks = stretch_hashes(prefix, at, at + size)
        later = at[size:]
        anchors = (later // size - 1) * size  # the one aligned block at a lag of size to 2 * size - 1
        near = later - anchors <= most
        first, second = anchors[near], later[near]
        equal = blocks[first] == blocks[second]
        first, second = first[equal], second[equal]
        while len(first):
            lag = int((second - first).min())
            _scan(w, lag, least, times, found)
            left = second - first != lag
            first, second = first[left], second[left]
            for (a, b), q in found.items():
                if not len(first):
                    break
                known = ((second - first) % q == 0) & (first >= a) & (second + size <= b)
                first, second = first[~known], second[~known]
        size *= 2
    return found


def word_runs(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, by start, then period."""
    numbers: dict = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    out = []
    for a, b in segments(w, least, times):
        _, part = np.unique(w[a:b], return_inverse=True)
        out += [(a + s, e - s, q) for (s, e), q in scan_lags(part, least, times).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)] if runs else words).decode("utf-8", "replace")


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """docs with runs (by start, then period) and collapsed: the words that no run repeats, joined by a space.

    A word is dropped if it stands in a run after the run's first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, collapsed = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "replace").split()
                runs = word_runs(words, least, times)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                collapsed.append(_collapsed(words, runs))
            columns = [*batch.columns, pa.array(found, RUNS), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "runs", "collapsed"])

    rest = batch_by_bytes(docs).drop("runs", "collapsed")
    added = StructType.fromDDL("runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return rest.mapInArrow(run, StructType(rest.schema.fields + added.fields))
