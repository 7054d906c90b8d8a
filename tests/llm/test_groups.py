"""Components, Jaccard join, lattice hashing and repeated strings against brute force."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm.blocks import roots
from docsift.llm.common import words
from docsift.llm.components import components
from docsift.llm.forest import block_pairs, forest_depth, forest_recall, jaccard_join, paths, shingles
from docsift.llm.lattice import MINIMAL, near_vectors, nearest_e8
from docsift.llm.q_forest import op4_jaccard
from docsift.llm.suffixes import Strings, merge_sorted, remove_repeats

SF = "/root/testdata/sf0.01"


def union(nodes, edges):
    p = {n: n for n in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(2000, i) for i in range(2001, 2300)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == union({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert roots(6, np.array([0, 5, 3]), np.array([5, 2, 4])).tolist() == [0, 1, 0, 3, 3, 0]


def plain_jaccard(rows, least=(4, 5)):
    sets = {}
    for key, text in rows:
        w = words(text)
        k = min(5, len(w))
        sets[key] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    inverted, shared = {}, {}
    for key in sorted(sets):
        for s in sets[key]:
            inverted.setdefault(s, []).append(key)
    for keys in inverted.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in shared.items() if n * least[1] >= (len(sets[a]) + len(sets[b]) - n) * least[0]]
    count = dict.fromkeys(sets, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    group = union(sets, links)
    return sorted((k, group[k], count[k]) for k in sets)


def test_jaccard_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_jaccard(spark, SF).collect())) == plain_jaccard(rows)


def test_jaccard_large_group_in_blocks_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A, b!"), (104, "a c"), (105, "only " * 40_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = sorted(map(tuple, jaccard_join(docs, block=7, per_task=20).collect()))
    assert got == plain_jaccard(rows)
    assert jaccard_join(docs.where(F.lit(False))).count() == 0
    twice = jaccard_join(docs.unionByName(docs)).collect()
    assert len(twice) == len(rows)


def test_jaccard_repeated_rows_count_once(spark):
    w = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(w[:60] + ([f"n{i}"] if i % 3 else []) + w[60:])) for i in range(12)] + [(20, "a b c d e f"), (21, "g h i j k l"), (22, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for times in (docs.unionByName(docs), docs.unionByName(docs.where("doc_id IN (1, 2, 20)")).unionByName(docs.where("doc_id = 2"))):
        assert sorted(map(tuple, jaccard_join(times, block=5, per_task=10).collect())) == plain_jaccard(rows)
    other = docs.unionByName(spark.createDataFrame([(20, None), (1, ""), (22, "x y")], docs.schema))
    assert sorted(map(tuple, jaccard_join(other).collect())) == plain_jaccard(rows)


def test_depth_reaches_the_recall():
    d = forest_depth(24, 8, 0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 24


def test_forest_paths_and_pairs_of_blocks(spark):
    rng = random.Random(12)
    base = [f"v{i}" for i in range(90)]
    texts = []
    for i in range(60):
        w = [f"u{i // 6}x{x}" if i % 2 else x for x in base]
        for _ in range(2 * (i % 6)):
            w[rng.randrange(len(w))] = f"n{i}"
        texts.append(" ".join(w))
    trees, depth, least = 24, 8, forest_depth(24, 8, 0.8, 0.9999)
    held = [paths(shingles(t), trees, depth, least) for t in texts]
    assert all(h.shape == (trees, 8 + 4 * (depth - least)) for h in held)
    # the same values, cut by themselves: a path begins alike exactly as far as the values agree
    deep = [paths(shingles(t), trees, depth, 1) for t in texts]
    block = {i: i // 2 for i in range(60)}
    want = {}
    for i in range(60):
        for j in range(60):
            if block[i] >= block[j]:
                continue
            for x, y, u, v in zip(held[i], held[j], deep[i], deep[j]):
                same = next((k for k in range(depth) if u[: 12 + 4 * k].tobytes() != v[: 12 + 4 * k].tobytes()), depth) if u[:8].tobytes() == v[:8].tobytes() else 0
                same = min(same + (same > 0), depth)
                if same >= least:
                    assert x[: 8 + 4 * (same - least)].tobytes() == y[: 8 + 4 * (same - least)].tobytes()
                    want[block[i], block[j]] = max(want.get((block[i], block[j]), 0), same)
                else:
                    assert x[:8].tobytes() != y[:8].tobytes()
    rows = [(bytearray(path.tobytes()), block[i]) for i, h in enumerate(held) for path in h]
    got = block_pairs(spark.createDataFrame(rows, "path binary, block long"), trees, depth, 0.8, 0.9999).collect()
    assert {(r.lo, r.hi): r.depth for r in got} == want and len(got) == len(want) and len(set(want.values())) > 1
    one = spark.createDataFrame([(r[0], 1) for r in rows], "path binary, block long")
    assert block_pairs(one, trees, depth, 0.8, 0.9999).count() == 0


def test_found_links_reach_the_recall():
    """Made pairs of about the least similarity meet in some tree as often as the formula says."""
    rng = np.random.default_rng(8)
    meet = []
    for _ in range(1500):
        common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])) for _ in range(2))
        x, y = (paths(s, 8, 6, 5)[:, :8] for s in (a, b))
        meet.append((x == y).all(axis=1).any())
    assert abs(np.mean(meet) - forest_recall(8, 5, 0.8)) < 0.02


def test_lattice_points():
    assert len(np.unique(MINIMAL, axis=0)) == 240 and np.allclose((MINIMAL**2).sum(axis=1), 2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8)) * 2
    p = nearest_e8(x)
    doubled = np.rint(p * 2)
    assert ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()
    assert (((x[:, None] - p[:, None] - MINIMAL) ** 2).sum(axis=2) >= d[:, None] - 1e-9).all()


def test_every_row_is_a_vector(spark):
    """Ids that are null or stand for several vectors lose no row and no link."""
    big = (1 << 62) + 1
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (big, [0.0, -1.0]), (big, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")
    got = sorted((tuple(r) for r in near_vectors(df).collect()), key=str)
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted([*want, (big, 0, big, True), (big, 0, big, True)], key=str)


@pytest.mark.parametrize("block", [512, 16])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 64))
    x[100:160] = x[100] + rng.normal(size=(60, 64)) * 0.15
    for i in range(200, 300, 2):
        x[i + 1] = x[i] + rng.normal(size=64) * rng.uniform(0.05, 0.4)
    x[400] = x[401]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] + [1.0] * 63), (1003, [None] * 64), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, [])]
    df = spark.createDataFrame([(*r, 3) for r in rows + odd + rows[:5]], "vec_id long, embedding array<float>, n_links int")
    out = near_vectors(df, block=block, per_task=300).collect()
    got = {r.vec_id: r for r in out}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    u = np.concatenate([u, u[:5]])  # five rows come twice
    names = [*range(700), *range(5)]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    links = [(names[i], names[j]) for i, j in zip(a, b)] + [(1004, 1005)]
    keys = [r[0] for r in rows + odd]
    found = sum(r.n_links for r in out) / 2
    assert found >= 0.999 * len(links) and found <= len(links)
    if found == len(links):
        assert {k: got[k].component_id for k in keys} == union(keys, [(i, j) for i, j in links if i != j])
    assert all(got[k].kept == (got[k].component_id == k) for k in keys) and len(out) == len(keys) + 5
    assert near_vectors(df.where(F.lit(False))).count() == 0


def plain_repeats(rows, size=50):
    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], key)
    out = {}
    for key, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < key:
                gone[i : i + size] = b"\1" * size
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 1, "per_bucket": 256, "per_task": 40}, {"hot": 3, "per_bucket": 4096, "per_task": 2000}])
def test_repeats_against_brute_force(spark, limits):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage = prose(130)
    rows = [(i, prose(rng.randrange(300)) + (passage[rng.randrange(40) : rng.randrange(60, 130)] if i % 2 else "") + prose(rng.randrange(200))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "z" * 49), (103, "z" * 50), (104, "z" * 5000), (105, "z" * 49), (106, "zy" * 3000), (107, "yz" * 100)]
    rows += [(108, rows[3][1]), (109, rows[3][1]), (110, passage), (111, passage * 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_spans int")
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs, **limits).collect()}
    assert got == plain_repeats(rows)


def test_repeats_odd_tables(spark):
    docs = spark.createDataFrame([(None, "q" * 80), (1, "q" * 80), (1, "q" * 80)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(docs).collect())
    assert got == [("1", 80), ("1", 80), ("None", 0)]
    assert remove_repeats(docs.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("limits", [{}, {"hot": 1, "per_bucket": 256, "per_task": 40}])
def test_repeats_of_null_and_shared_ids(spark, limits):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    common = prose(90)
    texts = [prose(rng.randrange(20, 400)) + common[i % 30 :] + prose(i * 20) for i in range(12)] + [None, "", prose(60), common + "q" * 300]
    rows = [(None, t) for t in texts[:8]] + [(5, t) for t in texts[4:]] + [(7, t) for t in texts[:12:3]] + [(8, texts[0]), (9, texts[1] * 2)]
    rows += rows[3:16:2]
    want = {}
    for key, text in rows:  # each text of an id against the documents with smaller ids
        smaller = [(k if k is not None else -1, t) for k, t in rows if (-1 if k is None else k) < (-1 if key is None else key)]
        want[key, hashlib.sha256((text or "").encode()).hexdigest()] = plain_repeats([*smaller, (99, text)])[99]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in remove_repeats(docs, **limits).collect()]
    order = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    expected = [(k, *want[k, hashlib.sha256((t or "").encode()).hexdigest()]) for k, t in rows]
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_hash_compared_merge_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    place = rng.integers(0, 2950, 500)
    group = np.sort(rng.integers(0, 4, 500))
    order = merge_sorted(Strings(data, 50), place, group)
    keys = [(g, data[p : p + 50].tobytes()) for g, p in zip(group[order], place[order])]
    assert keys == sorted(keys)
