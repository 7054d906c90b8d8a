"""Periodic runs against a brute-force search, odd rows, the contract's planted tails."""
import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np

from docsift.llm.periodic import periodic_runs, segments, word_runs
from docsift.llm.q_periodic import best, op11_periodic, planted

SF = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    """Every maximal stretch of every period; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        alphabet = rng.choice([2, 3, 8, 40, 400])
        if kind < 0.4:
            out += [rng.randrange(alphabet) for _ in range(rng.randint(0, 60))]
        else:
            unit = [rng.randrange(alphabet) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 20, 70, 130]))]
            out += (unit * 12)[: rng.randint(1, max(24, 5 * len(unit)))]
    return out


def test_equals_brute_force():
    rng = random.Random(4)
    found = 0
    for _ in range(400):
        words = made(rng)
        want = brute(words)
        assert word_runs(words) == want, words
        found += len(want)
    assert found > 200


def test_small_limits_and_nested_periods():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(rng.randint(0, 90))]
        assert word_runs(words, 6, 3) == brute(words, 6, 3)
    nested = ([0] * 100 + [1]) * 5
    assert word_runs(nested) == brute(nested)
    assert (0, 505, 101) in word_runs(nested)


def test_long_periods_of_every_level():
    rng = random.Random(6)
    for q in (63, 64, 65, 127, 128, 200, 256, 391):
        unit = [rng.randrange(30) for _ in range(q)]
        words = [-1] * 5 + (unit * 4)[: 3 * q + rng.randrange(q)] + [-2] * 30
        assert word_runs(words) == brute(words)


def test_splitting_keeps_only_frequent_words():
    words = np.array([1, 2, 3] * 10 + list(range(10, 80)) + [4] * 24)
    assert segments(words, 24, 3) == [(0, 30), (100, 124)]
    assert segments(words[:0], 24, 3) == []


def test_very_long_texts_take_seconds():
    t = time.time()
    assert word_runs([7] * 400_000) == [(0, 400_000, 1)]
    unit = list(range(50_000))
    assert word_runs(unit * 4) == [(0, 200_000, 50_000)]
    assert time.time() - t < 20


def test_odd_rows(spark):
    run = "a b c " * 10
    rows = [(1, run, "x"), (1, run, "y"), (None, run, "z"), (2, None, ""), (3, "", ""), (4, " \t\n", ""), (5, "é x\x1cy", ""), (6, "w " * 30, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [tuple(x) for x in by[1][0].runs] == [(0, 30, 3)] and len(by[1]) == 2 and by[None][0].collapsed == "a b c"
    assert all(by[i][0].runs == [] and by[i][0].collapsed == "" for i in (2, 3, 4))
    assert by[5][0].collapsed == "é x\x1cy" and by[6][0].collapsed == "w"
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op11_periodic(spark, SF).collect()}
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    runs_seen = 0
    for d in docs:
        words = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 1500:
            continue
        runs, r = brute(words), got[d.doc_id]
        runs_seen += len(runs)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(b" ".join(w for i, w in enumerate(words) if i not in dropped).decode())
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (top or (None,) * 3)
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
    assert runs_seen > 5


def test_best_run_and_null_ids(spark):
    runs = [[(0, 30, 10), (40, 24, 8), (90, 60, 20)], [(5, 24, 3), (2, 48, 6), (2, 24, 3)], []]
    df = spark.createDataFrame([(r,) for r in runs], "runs array<struct<start:long,length:long,period:long>>")
    assert [tuple(r[0]) if r[0] else None for r in df.select(best("runs")).collect()] == [(0, 30, 10), (2, 24, 3), None]
    docs = spark.createDataFrame([(None, "a b"), (None, None), (0, "")], "doc_id long, text string")
    assert [tuple(r) for r in planted(docs).collect()] == [(None, "a b"), (None, None), (0, "")]
